"""Spelling variants: for each word of a corpus the words one edit away, the commonest of which is its form.

A run is a maximal run of ``[A-Za-z\\u00C0-\\u00FF]``; only A-Z is lower-cased. The checksum of ``<doc_id>:<run>`` decides whether a run
loses a character: if ``EVERY`` divides it, the one at the checksum modulo the length goes. Words are the distinct results of at least
``LEAST_CHARS`` characters and ``LEAST_COUNT`` occurrences n. Two words are near if one inserted, deleted or replaced
character turns one into the other. A word's form is its near word of the largest n (ties: the least by code points), if that n
is at least ``RATIO`` times its own; its root is where the forms lead to.

The words in order are cut into shards by range, and each shard becomes a compact trie of flat arrays, built in the
tasks. Tries are broadcast in packs of ``PACK_BYTES``, a pass over all words a pack: each word's automaton of one edit
and each trie are followed together, depth first, so that a trie that holds nothing near is left after a few
steps. A pass hands on one row a word that has neighbours: their number and the best one; the passes are added up by word. Nothing
but one pack at a time is on the driver or in a task. Forms are at least five times as common as their words, so
that a chain of them is short; roots are found by doubling.

Null and empty texts have no words. A null id is hashed as an empty string. Repeated rows count each for
itself. Empty tables give an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.store import durable, small_batches
from quernstone.llm.target_resampling import CRC_SQL, LOWER, UPPER

RUN = "[A-Za-zÀ-ÿ]+"
EVERY, LEAST_CHARS, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words of one trie, and bytes of the tries that are broadcast together.
SHARD_WORDS, PACK_BYTES = 50_000, 32 << 20


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), 0)


def worn(doc_id: Column, run: Column) -> Column:
    """The run, or what is left of it if its checksum says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of every word."""
    runs = docs.select(docs[doc_col].alias("doc_id"), F.explode(runs_of(docs[text_col])).alias("run")).filter(F.length("run") >= least_chars)
    words = runs.select(worn(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Trie:
    """Words in flat arrays: the children of node v are first[v] to first[v + 1], by rising labels; n is 0 where no word ends."""

    def __init__(self, first: array, label: array, n: array):
        self.first, self.label, self.n = first, label, n

    @classmethod
    def build(cls, words: list[str], counts: list[int]) -> Trie:
        """words: different ones in order. Level by level, a node being a stretch of them with one beginning."""
        first, label, n = array("i", [1]), array("i", [0]), array("q", [0])
        level = [(0, len(words))] if words else []
        depth = 0
        while level:
            below = []
            for lo, hi in level:
                while lo < hi:
                    c = words[lo][depth]
                    end = lo
                    while end < hi and words[end][depth] == c:
                        end += 1
                    label.append(ord(c))
                    whole = len(words[lo]) == depth + 1
                    n.append(counts[lo] if whole else 0)
                    below.append((lo + whole, end))
                    lo = end
                first.append(len(label))
            level, depth = below, depth + 1
        while len(first) <= len(label):
            first.append(len(label))
        return cls(first, label, n)

    def dump(self) -> bytes:
        return b"".join([len(self.label).to_bytes(8, "little"), self.first.tobytes(), self.label.tobytes(), self.n.tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> Trie:
        size = int.from_bytes(raw[:8], "little")
        out, at = [], 8
        for kind, width, count in (("i", 4, size + 1), ("i", 4, size), ("q", 8, size)):
            out.append(array(kind, raw[at : at + width * count]))
            at += width * count
        return cls(*out)

    def _rest(self, node: int, word: list[int], at: int) -> int:
        """The node that the rest of the word leads to and where a word ends, or -1: the automaton has no edit left."""
        first, label = self.first, self.label
        for c in word[at:]:
            lo, hi = first[node], first[node + 1]
            node = bisect_left(label, c, lo, hi)
            if node == hi or label[node] != c:
                return -1
        return node if self.n[node] else -1

    def near(self, word: str) -> list[tuple[str, int]]:
        """The words one edit away, with their n."""
        chars = [ord(c) for c in word]
        first, label, rest = self.first, self.label, self._rest
        found: dict[int, str] = {}
        node, size = 0, len(chars)
        for at in range(size + 1):  # node: where the first `at` characters lead to, no edit made yet
            lo, hi = first[node], first[node + 1]
            if at < size and (end := rest(node, chars, at + 1)) >= 0:
                found[end] = word[:at] + word[at + 1 :]
            own = -1
            for child in range(lo, hi):
                c = label[child]
                if at < size:
                    if c == chars[at]:
                        own = child
                    elif (end := rest(child, chars, at + 1)) >= 0:
                        found[end] = word[:at] + chr(c) + word[at + 1 :]
                if (end := rest(child, chars, at)) >= 0:
                    found[end] = word[:at] + chr(c) + word[at:]
            if own < 0:
                break
            node = own
        return [(w, self.n[end]) for end, w in found.items()]


def tries(words: DataFrame, n_words: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(words, trie) of shards of the words in order, one shard a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[str], list[int]] = ([], [])

        def shard(size: int) -> pa.RecordBatch:
            raw = Trie.build(held[0][:size], held[1][:size]).dump()
            out = pa.RecordBatch.from_arrays([pa.array([min(size, len(held[0]))], pa.int64()), pa.array([raw], pa.binary())], names=["words", "trie"])
            del held[0][:size], held[1][:size]
            return out

        for batch in batches:
            held[0].extend(batch.column(0).to_pylist())
            held[1].extend(batch.column(1).to_pylist())
            while len(held[0]) >= shard_words:
                yield shard(shard_words)
        if held[0]:
            yield shard(len(held[0]))

    dealt = words.select("word", "n").repartitionByRange(max(1, -(-n_words // shard_words)), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "words bigint, trie binary")


def _packs(shards: DataFrame, pack_bytes: int) -> Iterator[list[bytes]]:
    """The tries in packs of bounded size; only one pack at a time is on the driver."""
    pack: list[bytes] = []
    for row in shards.select("trie").toLocalIterator():
        if pack and sum(map(len, pack)) + len(row.trie) > pack_bytes:
            yield pack
            pack = []
        pack.append(bytes(row.trie))
    if pack:
        yield pack


_NEAR = "word string, n_near bigint, best_n bigint, best string"


def _pass(words: DataFrame, pack: list[bytes]) -> tuple[DataFrame, object]:
    """Of each word with neighbours in the pack: how many, and the best one. And the broadcast."""
    held = words.sparkSession.sparkContext.broadcast(pack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [Trie.load(raw) for raw in held.value]
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                near = [x for trie in every for x in trie.near(word)]
                if near:
                    best, n = min(near, key=lambda x: (-x[1], x[0]))
                    rows.append((word, len(near), n, best))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    return words.select("word").mapInArrow(run, _NEAR), held


def neighbours(words: DataFrame, *, shard_words: int = SHARD_WORDS, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """words: (word, n), written down. Of each word with near ones: (word, n_near, best_n, best)."""
    spark = words.sparkSession
    small_batches(spark)
    shards = durable(tries(words, words.count(), shard_words), "tries")
    # As many tasks as the session shuffles to: reading a small table would be one task, and its words are work.
    dealt = durable(words.select("word").repartition(F.xxhash64("word")), "words_dealt")
    found = None
    for pack in _packs(shards, pack_bytes):
        part, held = _pass(dealt, pack)
        part = durable(part, "near")
        held.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form), without rings. (word, root): where each word's forms lead to, by doubling: a round halves every chain."""
    now = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("next"))
        now = durable(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").head(1):
            return now.select("word", "root")


def variants(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, shard_words: int = SHARD_WORDS, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Per word: word, n, n_near, form, form_n (nulls: none) and root."""
    words = durable(word_counts(docs, doc_col=doc_col, text_col=text_col), "words")
    near = neighbours(words, shard_words=shard_words, pack_bytes=pack_bytes).withColumnRenamed("word", "w")
    common = F.col("best_n") >= ratio * F.col("n")
    known = durable(words.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(common, F.col("best")).alias("form"), F.when(common, F.col("best_n")).alias("form_n"),
    ), "forms")
    ends = roots(known.filter("form IS NOT NULL")).withColumnRenamed("word", "w")
    return known.join(ends, F.col("word") == F.col("w"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


SQL = r"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
long_runs AS MATERIALIZED (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS k FROM runs WHERE length(run) >= 6),
""" + CRC_SQL.replace("{texts}", "SELECT k AS s FROM long_runs") + r""",
worn AS (
  SELECT CASE WHEN crc % 199 = 0 THEN left(run, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word FROM long_runs JOIN crcs ON k = s),
words AS MATERIALIZED (SELECT word, count(*)::BIGINT AS n FROM worn WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
near AS (
  SELECT word, count(*)::BIGINT AS n_near, max(m) AS best_n, arg_min(other, (-m, encode(other))) AS best FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
steps AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, s.root FROM forms f JOIN steps s USING (word) JOIN forms e ON s.root = e.word WHERE e.form IS NULL
"""
