"""Near-duplicate groups by ProbMinHash over weighted word shingles, banding and verification.

Shingles are five consecutive words (a shorter text is one shingle); words are runs of ASCII letters and
digits and of characters beyond ASCII, lower-cased. A shingle found n times weighs 1 + ln n.

Signature. Each shingle is a Poisson process of arrivals whose rate is its weight; an arrival falls on one of
``SLOTS`` slots, and a slot keeps the shingle of its earliest arrival. Arrivals depend on the shingle alone, so
two texts agree in a slot with the probability Jaccard of their weights. A process ends once its next arrival
comes after the latest time held by any slot of the text: nothing later can matter.

Candidates. ``BANDS`` bands of ``ROWS`` slots. A pair at similarity 0.8 meets in at least one of 24 bands of 5
with probability 1 - (1 - 0.8^5)^24 = 0.99993, one at 0.9 with all but 2e-10. In a bucket of up to
``SMALL`` texts all pairs are candidates. In a larger one, each text is a candidate with the bucket's first
text; those that turn out too different are compared with the first of their own, and so on for ``ROUNDS``
rounds. These rounds only save work: what they link is one group. A large bucket whose texts are in several
groups after that is cut into blocks by hash, and each block is compared with each (itself too): every pair of
texts that are not in one group yet is a candidate, in the first of the bands in which the two agree. Signatures alone
decide that; a text moves to a pair of blocks only if it is in a candidate there. This work grows with the square of such a
bucket, dealt to as many tasks as there are pairs of blocks; signatures grow with the bucket times its blocks.

Verification. A pair must agree in 65 % of the slots (four standard deviations under 0.8), then the probability
Jaccard of the two whole texts is computed exactly and must reach 0.8.

Groups are the connected components of the links. Exact copies (after lower-casing) are joined by a 64-bit hash and
enter all of this once; texts that only share that hash are told apart by a second one. Rows whose text is null, or
whose id is null, are in no group; texts without words are grouped only with equal ones. Repeated rows share their
class. An id that stands for several texts is in the class of each, and a class is named by the least id in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytewise import ALNUM, Texts, chunks, grouped, mix, owners, windows
from quernstone.llm.components import components
from quernstone.llm.store import durable, small_batches

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
SMALL = 12
ROUNDS = 3
#: Texts and bytes of one block of a large bucket, on average.
BLOCK, BLOCK_BYTES = 1024, 1 << 23
#: Below this many rows (16 bytes each) a table of keys is broadcast, and below so many a table of signatures (half a
#: kilobyte each); else it is joined by a plain shuffle of written tables, whose hot partitions Spark can split.
BROADCAST_ROWS, BROADCAST_SIGNATURES = 1_000_000, 16_384
#: Where there are no more texts than that, of so many bytes in all, the texts are broadcast with them.
BROADCAST_BYTES = 16 << 20

_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct weighted shingles of some lower-cased texts: text, shingle, weight, sorted by text."""
    begin, end, first = t.spans(ALNUM[t.data])
    h = t.hashes(t.data, begin, end)
    at, w = windows(h, first, SHINGLE)
    owner = owners(first)[at]
    for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE)):
        total = np.full(1, first[d + 1] - first[d], np.uint64)
        for k in range(first[d], first[d + 1]):
            total = mix(total * _G + h[k])
        owner, w = np.append(owner, d), np.append(w, total)
    doc, shingle, count, _ = grouped(owner, w)
    return doc, shingle, 1.0 + np.log(count)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """(n, slots) of the 32-bit marks of the winning shingles; a text without shingles keeps zeros."""
    best = np.full(n * slots, np.inf)
    mark = np.zeros(n * slots, np.uint32)
    seed = mix(shingle + _G)
    tag = (seed >> np.uint64(32)).astype(np.uint32)
    time = np.zeros(len(doc))
    live = np.unique(doc)
    latest = np.full(n, np.inf)
    rate = weight
    step = np.zeros(1, np.uint64)
    while len(doc):
        step += np.uint64(1)
        r = mix(seed + step * _G)
        time = time - np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / rate
        slot = doc * slots + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(time < best[slot])
        s, v = slot[better], time[better]
        np.minimum.at(best, s, v)
        won = best[s] == v
        mark[s[won]] = tag[better[won]]
        latest[live] = best.reshape(n, slots)[live].max(1) if len(live) < n else best.reshape(n, slots).max(1)
        on = np.flatnonzero(time < latest[doc])
        doc, seed, tag, time, rate = doc[on], seed[on], tag[on], time[on], rate[on]
        live = doc[np.flatnonzero(np.diff(doc, prepend=-1))]
    return mark.reshape(n, slots)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact: the sum over common d of 1 / sum_i max(x_i / x_d, y_i / y_d)."""
    keys = np.union1d(a, b)
    if not len(keys):
        return 0.0
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a)] = wa
    y[np.searchsorted(keys, b)] = wb
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    x_up = np.cumsum(x)
    y_over = y.sum() - np.cumsum(y)
    common = np.flatnonzero((x > 0) & (y > 0))
    upto = np.searchsorted(ratio, ratio[common], "right") - 1
    return float(np.sum(1.0 / (x_up[upto] / x[common] + y_over[upto] / y[common])))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of the bands of some signatures."""
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        h = mix(h * _G + sig.reshape(len(sig), BANDS, ROWS)[:, :, k].astype(np.uint64))
    return h


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in chunks(batch.column(2)):
            doc, shingle, weight = shingles(t)
            sig = signatures(doc, shingle, weight, len(t))
            h = band_keys(sig)
            filled = np.zeros(len(t), bool)
            filled[doc] = True
            counts = np.where(filled, BANDS, 0)
            part = batch.slice(t.first, len(t))
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(h[filled].reshape(-1).view(np.int64)))
            data = np.ascontiguousarray(sig).view(np.uint8).reshape(-1)
            sigs = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer((np.arange(len(t) + 1) * (4 * SLOTS)).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), bands, sigs], names=["doc_id", "tk", "check", "bands", "sig"])


#: The share of slots in which a pair must agree.
AGREE = SIMILARITY - 4 * np.sqrt(SIMILARITY * (1 - SIMILARITY) / SLOTS)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures agree in enough slots."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, SLOTS) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).mean(1) >= AGREE))


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            sides = []
            for column in (batch.column(2), batch.column(3)):
                own: list[tuple[np.ndarray, np.ndarray]] = []
                unique = column.dictionary_encode()
                for t in chunks(unique.dictionary):
                    doc, s, w = shingles(t)
                    at = np.searchsorted(doc, np.arange(len(t) + 1))
                    own += [(s[at[k] : at[k + 1]], w[at[k] : at[k + 1]]) for k in range(len(t))]
                sides.append((own, unique.indices.to_pylist()))
            for i in range(batch.num_rows):
                x, y = (own[index[i]] for own, index in sides)
                keep[i] = probability_jaccard(*x, *y) >= similarity - 1e-9
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of equal slots, row, row) of the candidates between two blocks of a bucket (or within one): in different groups, with
    signatures that agree in enough slots, and not met in an earlier band. A pair's earlier bucket was compared as a whole, too."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    group, block = table["group"].to_numpy(), table["block"].to_numpy()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, SLOTS)
    here = int(np.argmax(band_keys(sig[:1])[0].view(np.int64) == table["band"][0].as_py()))
    right = np.flatnonzero(block == j)
    pairs = [np.empty((3, 0))]
    for p in np.flatnonzero(block == i):
        q = right[(group[right] != group[p]) & ((right > p) if i == j else True)]
        equal = sig[q] == sig[p]
        share = equal.mean(1)
        on = np.flatnonzero(share >= AGREE)
        if len(on):
            on = on[~equal[on, : here * ROWS].reshape(-1, here, ROWS).all(2).any(1)] if here else on
            pairs.append(np.stack([share[on], np.full(len(on), p), q[on]]))
    share, x, y = np.concatenate(pairs, 1)
    return share, x.astype(np.int64), y.astype(np.int64)


def _needed(table: pa.Table) -> pa.Table:
    """The rows that are in a candidate."""
    _, x, y = _pairs(table)
    return table.take(pa.array(np.unique(np.append(x, y))))


def _compare(similarity: float):
    """Links between the texts of two blocks (or within one) that connect all that the near pairs connect."""

    def run(table: pa.Table) -> pa.Table:
        tk, group = table["tk"].to_numpy(), table["group"].to_numpy()
        share, x, y = _pairs(table)
        needed = np.unique(np.append(x, y))
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for t in chunks(table["text"].combine_chunks().take(pa.array(needed))) if len(needed) else ():
            doc, s, w = shingles(t)
            at = np.searchsorted(doc, np.arange(len(t) + 1))
            own += [(s[at[k] : at[k + 1]], w[at[k] : at[k + 1]]) for k in range(len(t))]
        place = dict(zip(needed.tolist(), range(len(needed)), strict=True))
        parent: dict[int, int] = {}

        def root(g: int) -> int:
            while (up := parent.get(g, g)) != g:
                parent[g] = g = parent.get(up, up)
            return g

        links = []
        # The likeliest first: pairs within what these connect need no check.
        for k in np.lexsort((tk[y], tk[x], -share)):
            a, b = root(int(group[x[k]])), root(int(group[y[k]]))
            if a != b and probability_jaccard(*own[place[int(x[k])]], *own[place[int(y[k])]]) >= similarity - 1e-9:
                parent[max(a, b)] = min(a, b)
                links.append((int(tk[x[k]]), int(tk[y[k]])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _near(left: DataFrame, keys: DataFrame, rows: int, on: str) -> DataFrame:
    """left restricted to keys (distinct, rows of them)."""
    return left.join(F.broadcast(keys) if rows <= BROADCAST_ROWS else keys, on)


def _keyed(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(doc_id, tk, text, check) of the rows with an id and a text."""
    base = docs.filter(docs[doc_col].isNotNull() & docs[text_col].isNotNull()).select(docs[doc_col].alias("doc_id"), F.lower(docs[text_col]).alias("text"))
    return base.select("doc_id", F.xxhash64("text").alias("tk"), "text", F.xxhash64(F.lit(1), "text").alias("check"))


def _told_apart(keyed: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """keyed with keys of their own for texts that share one by chance."""
    if clashes is None:
        return keyed
    few = clashes.count()
    marked = keyed.join(F.broadcast(clashes) if few <= BROADCAST_ROWS else clashes, "tk", "left")
    return marked.withColumn("tk", F.when(F.col("clash"), F.xxhash64("tk", "check")).otherwise(F.col("tk"))).select(*keyed.columns)


def _classes(docs: DataFrame, *, doc_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """Per row with an id and a text: doc_id, tk, class_id, class_tk, class_size (nulls: in no group). And the keys that clash."""
    small_batches(docs.sparkSession)
    keyed, clashes = _keyed(docs, doc_col, text_col), None
    kind = dict(keyed.dtypes)["doc_id"]
    signed = durable(keyed.mapInArrow(_sign, f"doc_id {kind}, tk bigint, check bigint, bands array<bigint>, sig binary"), "signed")
    ids = durable(signed.groupBy("tk").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), (F.min("check") < F.max("check")).alias("clash")), "ids")
    if ids.filter("clash").head(1):
        clashes = durable(ids.filter("clash").select("tk", "clash"), "clashes")
        keyed, signed = _told_apart(keyed, clashes), durable(_told_apart(signed, clashes), "signed")
        ids = durable(signed.groupBy("tk").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "ids")

    # One row for each distinct text and band; buckets of one text are of no use. Buckets are reduced map-side to their
    # ends and sizes; where these few figures are small they go to the rows, so that a hot bucket meets in no task.
    rows = signed.select("tk", F.explode("bands").alias("band"))
    several = durable(rows.groupBy("band").agg(F.min("tk").alias("least"), F.max("tk").alias("most")).filter("least < most").select("band"), "several")
    n_buckets = several.count()
    met = durable(_near(rows, several, n_buckets, "band").distinct(), "buckets")
    sizes = durable(met.groupBy("band").agg(F.count("*").alias("n"), F.min("tk").alias("a")), "sizes")
    sized = _near(met, sizes, n_buckets, "band")
    whole, n_whole = _candidates(met, ids, signed, keyed)
    small = n_whole <= BROADCAST_SIGNATURES and (whole.agg(F.sum("bytes")).first()[0] or 0) <= BROADCAST_BYTES

    few = sized.filter(F.col("n") <= SMALL).select("band", "tk")
    pairs = few.select("band", F.col("tk").alias("a")).join(few.select("band", F.col("tk").alias("b")), "band").filter("a < b").select("a", "b").distinct()
    links = _check(pairs, whole, n_whole, similarity, small)
    with_lead = durable(sized.filter((F.col("n") > SMALL) & (F.col("tk") > F.col("a"))).select("band", "tk", "a"), "large")
    for _ in range(ROUNDS):
        if not with_lead.head(1):
            break
        held = _check(with_lead.select("a", F.col("tk").alias("b")).distinct(), whole, n_whole, similarity, small)
        links = links.unionByName(held)
        open_rows = durable(with_lead.join(held.withColumnRenamed("b", "tk"), ["a", "tk"], "left_anti").select("band", "tk"), "open")
        lead = open_rows.groupBy("band").agg(F.min("tk").alias("a"))
        lead = lead if n_buckets <= BROADCAST_ROWS else durable(lead, "lead")
        with_lead = durable(_near(open_rows, lead, n_buckets, "band").filter("tk > a").select("band", "tk", "a"), "large")

    # Every distinct text in a group, and every text found twice, with its class.
    groups = durable(components(links).withColumnsRenamed({"node": "tk", "component": "group"}), "groups")
    more = _between_groups(sized.filter(F.col("n") > SMALL).select("band", "tk"), n_buckets, groups, whole, n_whole, similarity, small)
    if more.head(1):
        groups = components(groups.select(F.col("tk").alias("a"), F.col("group").alias("b")).unionByName(more)).withColumnsRenamed({"node": "tk", "component": "group"})
    known = ids.select("tk", "least", "n").join(groups, "tk", "left").filter("n > 1 OR group IS NOT NULL").withColumn("group", F.coalesce("group", "tk"))
    known = durable(known, "known")
    classes = durable(known.groupBy("group").agg(F.min(F.struct("least", "tk")).alias("lead"), F.sum("n").alias("class_size")).select("group", F.col("lead.least").alias("class_id"), F.col("lead.tk").alias("class_tk"), "class_size"), "classes")
    table = durable(known.join(classes, "group").select("tk", "class_id", "class_tk", "class_size"), "table")
    return signed.select("doc_id", "tk").join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, "tk", "left"), clashes


def near_duplicates(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row of docs: doc_id, class_id (the least id of its group, its own if it is in none), class_size."""
    found, _ = _classes(docs, doc_col=doc_col, text_col=text_col, similarity=similarity)
    rest = docs.filter(docs[doc_col].isNull() | docs[text_col].isNull()).select(docs[doc_col].alias("doc_id"), docs[doc_col].alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size")).unionByName(rest)


def _candidates(met: DataFrame, ids: DataFrame, signed: DataFrame, keyed: DataFrame) -> tuple[DataFrame, int]:
    """(tk, sig, text, bytes) of every text that meets another in a bucket, written once for all comparisons, and their number.

    The row of the least id stands for a text, so that copies move neither text nor signature."""
    ends = durable(met.select("tk").distinct().join(ids.select("tk", "least"), "tk"), "ends")
    n = ends.count()
    own = F.broadcast(ends) if n <= BROADCAST_ROWS else ends
    sigs = durable(signed.join(own, "tk").filter("doc_id = least").select("tk", "sig").dropDuplicates(["tk"]), "signatures")
    texts = keyed.join(own, "tk").filter("doc_id = least").select("tk", "text").dropDuplicates(["tk"])
    return durable(texts.join(sigs, "tk").select("tk", "sig", "text", F.octet_length("text").alias("bytes")), "candidates"), n


def _both(pairs: DataFrame, sides: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with column (na, nb) of both ends from sides (tk, column)."""
    a, b = (sides.select(F.col("tk").alias(end), F.col(column).alias(f"n{end}")) for end in "ab")
    return pairs.join(F.broadcast(a), "a").join(F.broadcast(b), "b").select("a", "b", "na", "nb")


def _check(pairs: DataFrame, whole: DataFrame, n_whole: int, similarity: float, small: bool = False) -> DataFrame:
    """The pairs (a, b) of text keys that are similar enough. Few and small texts go to all pairs, in one pass.

    Else all sides are written tables: a text with very many partners is a hot key on the side of the pairs, which Spark splits."""
    if small:
        close = _both(pairs, whole, "sig").mapInArrow(_agree, "a bigint, b bigint")
        return durable(_both(close, whole, "text").mapInArrow(_verify(similarity), "a bigint, b bigint"), "links")
    pairs = durable(pairs, "pairs")
    sigs, n = _ends(pairs, whole.select("tk", "sig"), n_whole)
    sigs = F.broadcast(sigs) if n <= BROADCAST_SIGNATURES else sigs
    both = pairs.join(sigs.select(F.col("tk").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("tk").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
    close = durable(both.mapInArrow(_agree, "a bigint, b bigint"), "close")
    texts, _ = _ends(close, whole.select("tk", "text"), n_whole)
    both = close.join(texts.select(F.col("tk").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("tk").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return durable(both.mapInArrow(_verify(similarity), "a bigint, b bigint"), "links")


def _ends(pairs: DataFrame, rows: DataFrame, n_rows: int) -> tuple[DataFrame, int]:
    """rows (tk, ...) of the texts in pairs, so that others don't move, and their number."""
    ends = durable(pairs.select(F.explode(F.array("a", "b")).alias("tk")).distinct(), "ends")
    n = ends.count()
    return (rows if n == n_rows else _near(rows, ends, n, "tk")), n


def _between_groups(met: DataFrame, n_buckets: int, groups: DataFrame, whole: DataFrame, n_whole: int, similarity: float, small: bool = False) -> DataFrame:
    """Links (a, b) between texts that meet (band, tk) and are not in one group (tk, group) yet; a text without a group is its own."""
    known = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    placed = met.join(known, "tk", "left").withColumn("group", F.coalesce("group", "tk"))
    placed = durable(placed, "placed")
    mixed = durable(placed.groupBy("band").agg(F.min("group").alias("least"), F.max("group").alias("most")).filter("least < most").select("band"), "several")
    placed = durable(_near(placed, mixed, n_buckets, "band"), "mixed")
    if not placed.head(1):
        return placed.select(F.col("tk").alias("a"), F.col("tk").alias("b"))
    sizes = whole.select("tk", "bytes")
    blocks = placed.join(F.broadcast(sizes) if n_whole <= BROADCAST_ROWS else sizes, "tk").groupBy("band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES, F.lit(1.0))).alias("blocks"))
    blocks = durable(blocks, "blocks")
    cut = _near(placed, blocks, n_buckets, "band").withColumn("block", F.pmod("tk", "blocks"))
    dealt = cut.select("band", "tk", "group", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("band", "tk", "group", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sigs = whole.select("tk", "sig")
    dealt = dealt.join(F.broadcast(sigs) if n_whole <= BROADCAST_SIGNATURES else sigs, "tk")
    few = durable(dealt.groupBy("band", "i", "j").applyInArrow(_needed, dealt.schema), "needed")
    texts = whole.select("tk", "text")
    found = few.join(F.broadcast(texts) if small else texts, "tk").groupBy("band", "i", "j").applyInArrow(_compare(similarity), "a bigint, b bigint")
    return durable(found, "between")


def keep_one(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: of the rows with the least id, one with the least text key. A row is judged by its id
    and its text together, so that others with the same id and another text are not touched. Rows without an id or text stay."""
    found, clashes = _classes(docs, doc_col=doc_col, text_col=text_col, similarity=SIMILARITY)
    found = durable(found.filter("class_id IS NOT NULL"), "found")
    lead = (F.col("doc_id") == F.col("class_id")) & (F.col("tk") == F.col("class_tk"))
    lost = durable(found.filter(~lead).select("doc_id", "tk").distinct(), "lost")
    again = durable(found.filter(lead).groupBy("doc_id", "tk").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "tk"), "again")
    n, m = lost.count(), again.count()
    if not n and not m:
        return docs
    row = F.struct(*[docs[c] for c in docs.columns])
    text = F.lower(docs[text_col])
    marked = docs.select(row.alias("row"), docs[doc_col].alias("doc_id"), F.xxhash64(text).alias("tk"), F.xxhash64(F.lit(1), text).alias("check"), text.isNotNull().alias("has"))
    marked = _told_apart(marked, clashes).withColumn("tk", F.when(F.col("has"), F.col("tk")))
    kept = marked.join(F.broadcast(lost) if n <= BROADCAST_ROWS else lost, ["doc_id", "tk"], "left_anti")
    if m:
        few = F.broadcast(again) if m <= BROADCAST_ROWS else again
        kept = kept.join(few, ["doc_id", "tk"], "left_anti").unionByName(kept.join(few, ["doc_id", "tk"], "left_semi").dropDuplicates(["doc_id", "tk"]).select(*kept.columns))
    return kept.select("row.*")
