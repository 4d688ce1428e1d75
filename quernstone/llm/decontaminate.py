"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window. The words of a
document inside any occurrence of a window are hit.

Each task streams the words of its documents through the automaton, which keeps the longest match that ends
at each word. Stretches of a document whose word pairs don't all stand in the items can't hold a window and
are passed over beforehand; that loses nothing.

Items beyond ``MAX_WORDS`` words are handled in several automata, a pass over the numbered rows each. A pass writes down
the spans it finds and lets its automaton go before the next one is built, so that the driver and a task hold one at a
time; the spans of all passes are merged row by row, and limits apply to the merged ones. Nulls and empty texts have no words. Repeated items, or rows of documents, each count for themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytewise import ALNUM, LOWER, Texts, chunks
from quernstone.llm.store import durable, small_batches

WINDOW = 10
#: Words of the items in one automaton, and so the bound of one broadcast (some hundred bytes a word).
MAX_WORDS = 200_000


def _words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = LOWER[t.data]
    begin, end, first = t.spans(ALNUM[low])
    return begin, end, first, t.hashes(low, begin, end)


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        texts = list(chunks(pa.array([text for _, text in items], pa.large_string()), 1 << 40))
        _, _, first, h = _words(texts[0]) if texts else (None, None, np.zeros(1, np.int64), np.zeros(0, np.uint64))
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs: list[np.ndarray] = [np.zeros(0, np.uint64)]
        kept = []
        for k, (item, _) in enumerate(items):
            seq = ids[first[k] : first[k + 1]].tolist()
            if seq:
                kept.append((item, seq))
                self._add(seq)
                pairs.append(self._pair(np.array(seq[:-1]), np.array(seq[1:])))
        self.pairs = np.unique(np.concatenate(pairs))
        self.least = min((min(window, len(seq)) for _, seq in kept), default=0)
        # Each window's end: (its state, its length) -> the items that have it.
        self.ends: dict[int, dict[int, set[str]]] = {}
        for item, seq in kept:
            size = min(window, len(seq))
            state = matched = 0
            for x in seq:
                state, matched = self._step(state, matched, x)
                if matched >= size:
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    matched = min(matched, self.length[state])
                    self.ends.setdefault(state, {}).setdefault(size, set()).add(item)
        # From each state the nearest one, itself or along the links, where a window ends.
        self.nearest = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.nearest[s] = s if s in self.ends else self.nearest[self.link[s]]
        seen = np.zeros(1 << 16, bool)
        seen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.seen = seen

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, x: int) -> int:
        """The state reached from p by x, made to hold strings no longer than length[p] + 1."""
        q = self.next[p][x]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def _add(self, seq: list[int]) -> None:
        last = 0
        for x in seq:
            p = last
            if x in self.next[p]:
                last = self._split(p, x)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, x)
            last = new

    def _step(self, state: int, matched: int, x: int) -> tuple[int, int]:
        while x not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return self.next[state][x], matched + 1

    def stream(self, seq: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """Every occurrence of a window: (index of its last word, its length, its items)."""
        state = matched = 0
        for i, x in enumerate(seq):
            state, matched = self._step(state, matched, x)
            s = self.nearest[state]
            while s > 0:
                for size, items in self.ends[s].items():
                    if size <= matched:
                        yield i, size, items
                s = self.nearest[self.link[s]]

    def hits(self, t: Texts) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]], tuple]:
        """For each text: its number of words, the merged spans of hit words, the items that occur."""
        begin, end, first, h = _words(t)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(t))]
        items: list[set[str]] = [set() for _ in range(len(t))]
        if len(self.vocabulary) and len(h):
            at = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
            ids = np.full(len(h), -1, np.int64)
            pos = np.minimum(np.searchsorted(self.vocabulary, h[at]), len(self.vocabulary) - 1)
            ids[at] = np.where(self.vocabulary[pos] == h[at], pos, -1)
            last = np.repeat(first[1:], np.diff(first))
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (np.arange(len(h) - 1) + 1 < last[:-1]))
            linked = np.zeros(len(h), bool)  # this word and the next one stand side by side in an item
            if len(self.pairs):
                pair = self._pair(ids[both], ids[both + 1])
                k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                linked[both] = self.pairs[k] == pair
            known = ids >= 0
            after = np.concatenate([[False], linked[:-1]])
            cut, stop = np.flatnonzero(known & ~after), np.flatnonzero(known & ~linked) + 1
            long = stop - cut >= self.least
            for a, b in zip(cut[long].tolist(), stop[long].tolist(), strict=True):
                d = int(np.searchsorted(first, a, "right")) - 1
                off = a - int(first[d])
                for i, size, found in self.stream(ids[a:b].tolist()):
                    items[d] |= found
                    lo, hi = off + i - size + 1, off + i + 1
                    while spans[d] and spans[d][-1][1] >= lo:
                        lo = min(lo, spans[d][-1][0])
                        hi = max(hi, spans[d].pop()[1])
                    spans[d].append((lo, hi))
        return np.diff(first), spans, items, (begin, end, first)


def _item_chunks(benchmark: DataFrame, item_col: str, text_col: str, max_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items in pieces of bounded size; only one piece at a time is on the driver."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].alias("text")).filter("text IS NOT NULL")
    piece: list[tuple[str, str]] = []
    words = 0
    for row in items.toLocalIterator():
        piece.append((row.item if row.item is not None else "", row.text))
        words += 1 + len(row.text) // 4
        if words >= max_words:
            yield piece
            piece, words = [], 0
    if piece or not words:
        yield piece


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))
_FOUND = "n_words bigint, spans array<struct<b:bigint,e:bigint>>, items array<string>"


def _pass(rows: DataFrame, items: list[tuple[str, str]], window: int, *, all_rows: bool) -> tuple[DataFrame, object]:
    """rows: some columns, text last. Those columns with n_words, spans and items for one automaton; without all_rows only
    rows that are hit. And the broadcast."""
    held = rows.sparkSession.sparkContext.broadcast(Automaton(items, window))
    keep = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for batch in batches:
            for t in chunks(batch.column(len(keep))):
                n, spans, items, _ = automaton.hits(t)
                part = batch.slice(t.first, len(t))
                out = pa.RecordBatch.from_arrays([
                    *part.columns[: len(keep)], pa.array(n, pa.int64()),
                    pa.array([[{"b": a, "e": b} for a, b in s] for s in spans], _SPAN), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ], names=[*part.schema.names[: len(keep)], "n_words", "spans", "items"])
                yield out if all_rows else out.filter(pa.array([bool(s) for s in spans]))

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + (", " if keep else "") + _FOUND), held


def _merged(numbered: DataFrame, text: str, pieces: Iterator[list[tuple[str, str]]], window: int) -> DataFrame:
    """(row, n_words, spans, items) of the numbered rows over all pieces: n_words of every row, spans and items merged."""
    parts, narrow = [], numbered.select("row", text)
    for k, piece in enumerate(pieces):
        found, held = _pass(narrow, piece, window, all_rows=not k)
        parts.append(durable(found, "spans"))
        held.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    one = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"b": a, "e": b} for a, b in _union([(x["b"], x["e"]) for x in s])] for s in batch.column(2).to_pylist()]
            items = [sorted(set(x)) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

    return durable(one.mapInArrow(run, "row bigint, " + _FOUND), "merged")


def _numbered(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns and a number for each row; written down, so that the numbers stand."""
    return durable(docs.select(F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in columns.items()]), "numbered")


def _split(benchmark: DataFrame, item_col: str, text_col: str, max_words: int) -> tuple[list[tuple[str, str]], Iterator[list[tuple[str, str]]] | None]:
    """The first piece, and all of them if there are more."""
    pieces = _item_chunks(benchmark, item_col, text_col, max_words)
    first = next(pieces)
    second = next(pieces, None)
    return first, None if second is None else chain([first, second], pieces)


def hit_spans(docs: DataFrame, benchmark: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, spans of hit words [begin, end), and the items that occur."""
    small_batches(docs.sparkSession)
    first, pieces = _split(benchmark, item_col, item_text_col, max_words)
    columns = {"doc_id": docs[doc_col], "text": docs[text_col]}
    if pieces is None:
        return _pass(docs.select(*[c.alias(n) for n, c in columns.items()]), first, window, all_rows=True)[0]
    rows = _numbered(docs, columns)
    return rows.select("row", "doc_id").join(_merged(rows, "text", pieces, window), "row").select("doc_id", "n_words", "spans", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hit_spans(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, x: acc + x["e"] - x["b"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _cut(first: int, t: Texts, spans: list[list[tuple[int, int]]], words: tuple, n: np.ndarray, max_span: int, max_coverage: float) -> tuple[np.ndarray, dict[int, str]]:
    """Which texts of t are kept, and the new ones, by their place in the batch."""
    begin, end, begins = words
    keep, texts = np.ones(len(t), bool), {}
    for k in range(len(t)):
        if not spans[k]:
            continue
        if sum(b - a for a, b in spans[k]) > max_coverage * n[k]:
            keep[k] = False
            continue
        cut, pos = [], int(t.start[k])
        for a, b in spans[k]:
            if b - a > max_span:
                cut.append(t.data[pos : begin[begins[k] + a]].tobytes())
                pos = int(end[begins[k] + b - 1])
        cut.append(t.data[pos : t.stop[k]].tobytes())
        texts[first + k] = b"".join(cut).decode()
    return keep, texts


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, max_span: int = 0, max_coverage: float = 0.0, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without contamination, in its own columns. A row whose hit words are more than max_coverage of
    its words is dropped; of the others, spans of more than max_span hit words are cut out of the text."""
    small_batches(docs.sparkSession)
    piece, pieces = _split(benchmark, item_col, item_text_col, max_words)
    at, columns = docs.columns.index(text_col), docs.schema
    held = None
    if pieces is None:
        held, rows = docs.sparkSession.sparkContext.broadcast(Automaton(piece, window)), docs
    else:
        numbered = _numbered(docs, {f"c{i}": docs[c] for i, c in enumerate(docs.columns)})
        spans = _merged(numbered, f"c{at}", pieces, window).select("row", "spans").filter(F.size("spans") > 0)
        rows = numbered.join(spans, "row", "left").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("spans").alias("__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = np.ones(batch.num_rows, bool), {}
            for t in chunks(batch.column(at)):
                if held is not None:
                    n, spans, _, words = held.value.hits(t)
                else:
                    begin, end, begins, _ = _words(t)
                    n, words = np.diff(begins), (begin, end, begins)
                    spans = [[(x["b"], x["e"]) for x in s or ()] for s in batch.column(batch.num_columns - 1).slice(t.first, len(t)).to_pylist()]
                keep[t.first : t.first + len(t)], more = _cut(t.first, t, spans, words, n, max_span, max_coverage)
                texts |= more
            batch = batch.select(range(len(columns)))
            if texts:
                whole = batch.column(at).to_pylist()
                for k, v in texts.items():
                    whole[k] = v
                batch = batch.set_column(at, batch.schema.field(at), pa.array(whole, batch.schema.field(at).type))
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, columns)


SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_sizes AS (SELECT item_id, w, least(10, len(w)) AS k FROM item_words WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM item_sizes)),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM item_sizes))),
met AS (SELECT d.doc_id, d.k, d.i, t.item_id FROM doc_windows d JOIN item_windows t ON d.k = t.k AND d.s = t.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
