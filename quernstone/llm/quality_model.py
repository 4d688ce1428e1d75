"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Each statistic is cut at quantiles into at most ``BINS`` bins; a level of a tree is grown from histograms of
gradients and curvatures. Trees are complete and of depth ``DEPTH``, kept as flat arrays of features,
thresholds and leaf values, so that a batch walks one level with one gather.

Training takes at most ``MAX_ROWS`` labelled rows, those least by a hash of their id; prediction covers every
row. Labels that are null, and rows whose text is null, teach nothing; without labels every score is 0.5.
A null or empty text is scored like any other, from zeros. A document with labels on both sides teaches both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.doc_stats import COUNTS, with_counts
from quernstone.llm.store import durable

BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15
#: Least curvature in a leaf, and the ridge on its value.
LEAST, RIDGE = 1.0, 1.0
MAX_ROWS = 20_000
THRESHOLD = 0.3


def features(c: np.ndarray) -> np.ndarray:
    """Rates and logarithms from the counts of doc_stats."""
    v = {k: c[:, i].astype(np.float64) for i, k in enumerate(COUNTS)}
    words, chars, lines, letters = (np.maximum(x, 1) for x in (v["n_words"], v["n_chars"], v["n_lines"], v["n_upper"] + v["n_lower"]))
    return np.stack([
        np.log1p(v["n_words"]), v["word_chars"] / words, v["n_symbols"] / words, v["n_dup_lines"] / lines, v["n_repeat_words"] / words,
        np.log1p(v["n_lines"]), v["n_upper"] / letters, v["n_digits"] / chars, v["n_marks"] / words, v["n_stops"] / words, v["n_wide"] / chars,
        v["n_distinct"] / words, v["n_top"] / words, v["n_twice"] / words, v["n_words"] / lines, v["n_symbols"] / chars,
    ], 1)


@dataclass
class Forest:
    """base score; for each tree 2^DEPTH - 1 features and thresholds (go right if above) and 2^DEPTH leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, th, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > th[at])
            total += leaf[at - (2**DEPTH - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Forest:
    n_nodes = 2**DEPTH - 1
    if not len(y):
        return Forest(0.0, np.zeros((0, n_nodes), np.int64), np.zeros((0, n_nodes)), np.zeros((0, n_nodes + 1)))
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin <= k: x <= cuts[k]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    forest: tuple[list, list, list] = ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            base_node, width = 2**level - 1, 2**level
            local = at - base_node
            gain, best_f, best_b = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                key = local * (BINS + 1) + binned[:, j]
                gs, hs = (np.bincount(key, v, width * (BINS + 1)).reshape(width, -1).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gr, hr = gt - gl, ht - hl
                s = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - gt**2 / (ht + RIDGE)
                s[(hl < LEAST) | (hr < LEAST)] = 0
                s = s[:, : len(cuts[j])]
                k = s.argmax(1)
                v = s[np.arange(width), k]
                up = v > gain
                gain[up], best_f[up], best_b[up] = v[up], j, k[up]
            for node in np.flatnonzero(best_b >= 0):
                feature[base_node + node], threshold[base_node + node] = best_f[node], cuts[best_f[node]][best_b[node]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        cell = at - n_nodes
        leaf = -RATE * np.bincount(cell, g, n_nodes + 1) / (np.bincount(cell, h, n_nodes + 1) + RIDGE)
        margin += leaf[cell]
        for store, value in zip(forest, (feature, threshold, leaf), strict=True):
            store.append(value)
    return Forest(base, *(np.array(v) for v in forest))


def fit(stats: DataFrame, labels: DataFrame, allowed: Column, *, label_col: str = "quality", max_rows: int = MAX_ROWS) -> Forest:
    """stats: doc_id and the counts. allowed is a condition on labels."""
    known = labels.filter(allowed & labels[label_col].isNotNull() & labels["doc_id"].isNotNull()).select(labels["doc_id"].alias("id"), (labels[label_col] > 0).cast("int").alias("y")).distinct()
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    # At most max_rows pairs are broadcast.
    rows = stats.join(F.broadcast(chosen), stats["doc_id"] == chosen["id"]).orderBy(F.xxhash64("id"), "id", "y", *COUNTS).limit(max_rows).select("y", *COUNTS).toPandas()
    return train(features(rows[list(COUNTS)].to_numpy(np.int64).reshape(-1, len(COUNTS))), rows["y"].to_numpy(np.float64))


def with_quality(stats: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of stats, score, predicted."""
    held = stats.sparkSession.sparkContext.broadcast(forest)
    narrow = stats.select(*keep, *COUNTS)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keep)]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns[len(keep) :]], 1) if batch.num_rows else np.zeros((0, len(COUNTS)), np.int64)
            score = held.value.probability(features(c))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    return narrow.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, *, held_out: str, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. held_out is SQL over an id named doc_id."""
    narrow = docs.select(docs[doc_col].alias("doc_id"), docs[text_col].alias("text"))
    stats = durable(with_counts(narrow), "stats")
    forest = fit(stats, labels, ~F.expr(held_out))
    marked = stats.withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    return with_quality(marked, forest, ("doc_id", "held_out"))
