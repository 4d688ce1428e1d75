"""Language identification by a convolutional network over bytes, trained in numpy.

A text is lower-cased; ASCII bytes other than letters become spaces. It is cut into overlapping windows of
``WINDOW`` bytes that together hold every run of ``WIDTH`` bytes of the whole text. Each byte has a vector;
filters of 2, 3, 4 and 5 bytes run over the vectors; each filter's maximum over the window feeds a softmax.
A text's score is the geometric mean of its windows' probabilities, weighted by their letters.

Training draws at most ``PER_LANGUAGE`` rows of each label (``MAX_ROWS`` of all, ``MAX_LABELS`` labels), those least by
a hash of their id, cuts their whole texts into pieces of ``PIECE`` characters, and learns from at most ``PIECES`` pieces
of each label, again by hash. That sample is the only thing of bounded size; prediction reads whole texts. A hash
threshold taken from the label's count comes before each choice, so that no label's rows are put in order.

One more output, beside the labels, is for what is no language: pieces with their letters shuffled, random letters,
hexadecimal and base64 runs, key mashing. It is never a prediction; its share over a text is the text's ``noise``.

A null text, or one without letters, is ``und`` with score 0. Labels that are null teach nothing. Without any
labelled row every text with letters is ``und`` too. Rows are handled one by one: repeats and ties need nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.bytewise import Texts, chunks
from quernstone.llm.store import durable, small_batches

WIDTHS, FILTERS, DIM = (2, 3, 4, 5), 12, 8
WIDTH = max(WIDTHS)
WINDOW = 256
PER_LANGUAGE, MAX_ROWS, MAX_LABELS = 1500, 60_000, 1000
PIECE, PIECES = 400, 3000
EPOCHS, RATE, BATCH = 5, 0.004, 64
UND = "und"
#: Windows of one matrix product: small enough for the processor's caches.
GROUP = 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_FOLD[0x41:0x5B] += 32


@dataclass
class ByteNet:
    """labels; byte vectors (256, DIM); filters (WIDTH * DIM, n) with zeros past each filter's width; softmax over the labels and noise."""

    labels: list[str]
    vectors: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, bytes) -> columns, their filter values' maxima and where these stand."""
        n, size = x.shape
        v = self.vectors[x].reshape(n, size * DIM)
        cols = np.lib.stride_tricks.as_strided(v, (n, size - WIDTH + 1, WIDTH * DIM), (v.strides[0], DIM * v.itemsize, v.itemsize))
        z = cols.reshape(-1, WIDTH * DIM) @ self.filters
        z = z.reshape(n, size - WIDTH + 1, -1)
        at = z.argmax(1)
        return cols, np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.shift, at

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, bytes) -> (windows, labels and noise)."""
        out = np.empty((len(x), self.out.shape[1]), np.float32)
        for i in range(0, len(x), GROUP):
            part = x[i : i + GROUP]
            n, size = part.shape
            # Bytes outermost: the maximum then runs over long rows.
            v = np.ascontiguousarray(self.vectors[part.T])
            cols = np.concatenate([v[k : size - WIDTH + 1 + k] for k in range(WIDTH)], axis=2)
            z = (cols.reshape(-1, WIDTH * DIM) @ self.filters).reshape(size - WIDTH + 1, -1).max(0).reshape(n, -1)
            logits = np.maximum(z + self.shift, 0) @ self.out + self.bias
            logits -= logits.max(1, keepdims=True)
            out[i : i + GROUP] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return out


def windows_of(data: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Windows of folded bytes that overlap by WIDTH - 1; the last one is filled up with zeros."""
    step = size - WIDTH + 1
    n = max(1, -(-(len(data) - WIDTH + 1) // step)) if len(data) else 0
    padded = np.zeros(n * step + WIDTH - 1 if n else 0, np.uint8)
    padded[: len(data)] = data[: len(padded)]
    return np.lib.stride_tricks.as_strided(padded, (n, size), (step, 1)) if n else padded.reshape(0, size)


def noise_like(folded: list[np.ndarray], n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """n pieces of folded bytes that are no language."""
    out = []
    for k in range(n if folded else 0):
        base = folded[int(rng.integers(len(folded)))].copy()
        kind = k % 5
        if kind == 0:  # its own letters, shuffled
            at = np.flatnonzero(base != 0x20)
            base[at] = rng.permutation(base[at])
        else:
            size = int(rng.integers(PIECE // 4, PIECE + 1))
            # Random letters; digits fold to spaces in hexadecimal and base64; a hand's run of keys.
            alphabet = (b"abcdefghijklmnopqrstuvwxyz", b"          abcdef", b"abcdefghijklmnopqrstuvwxyz" * 2 + b" " * 12, b"asdfghjkl" * 3 + b"qwertyuiopzxcvbnm")[kind - 1]
            base = rng.choice(np.frombuffer(alphabet, np.uint8), size)
            if kind in (1, 4):
                base[np.cumsum(rng.integers(2, 14, size))[: size // 8] % size] = 0x20
        out.append(base)
    return out


def train(texts: list[str], langs: list[str], seed: int = 7) -> ByteNet:
    """Adam on the cross entropy over windows of random lengths."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    y_of = {x: i for i, x in enumerate(labels)}
    mask = np.concatenate([np.repeat(np.arange(WIDTH) < w, DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
    n = mask.shape[1]
    p = {
        "vectors": rng.normal(0, 0.5, (256, DIM)), "filters": rng.normal(0, 0.25, mask.shape) * mask, "shift": np.zeros(n),
        "out": rng.normal(0, 0.3, (n, len(labels) + 1)), "bias": np.zeros(len(labels) + 1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["vectors"][0] = 0
    folded = [_FOLD[np.frombuffer(t.lower().encode(), np.uint8)] for t in texts]
    noise = noise_like(folded, len(folded) // max(1, len(labels)), rng)
    y = np.array([y_of[x] for x in langs] + [len(labels)] * len(noise), np.int64)
    folded += noise
    m, s, step = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2)), None, 0
    m, s = m
    for epoch in range(EPOCHS if labels else 0):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            size = int(rng.choice([12, 24, 48, 96, 192]))
            x = np.zeros((len(rows), size), np.uint8)
            for k, r in enumerate(rows):
                a = int(rng.integers(0, max(1, len(folded[r]) - size + 1)))
                piece = folded[r][a : a + size]
                x[k, : len(piece)] = piece
            net = ByteNet(labels, **p)
            cols, z, at = net.pooled(x)
            hidden = np.maximum(z, 0)
            logits = hidden @ p["out"] + p["bias"]
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            d = prob
            d[np.arange(len(rows)), y[rows]] -= 1
            d /= len(rows)
            dz = (d @ p["out"].T) * (z > 0)
            won = np.take_along_axis(cols, at[:, :, None], 1)  # (rows, filters, WIDTH * DIM)
            g = {"out": hidden.T @ d + 1e-5 * p["out"], "bias": d.sum(0), "shift": dz.sum(0), "filters": np.einsum("rf,rfc->cf", dz, won) * mask, "vectors": np.zeros_like(p["vectors"])}
            dv = (dz[:, :, None] * p["filters"].T[None]).reshape(len(rows), n, WIDTH, DIM)
            bytes_at = np.take_along_axis(x[:, :, None], (at[:, :, None] + np.arange(WIDTH)).reshape(len(rows), -1, 1), 1).reshape(len(rows), n, WIDTH)
            np.add.at(g["vectors"], bytes_at.ravel(), dv.reshape(-1, DIM))
            g["vectors"][0] = 0
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) ** 0.5
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                p[k] = p[k].astype(np.float32)
    return ByteNet(labels, **p)


def classify(net: ByteNet, t: Texts, lettered: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The label, score, share of noise and letters (bytes) of each lower-cased text; lettered marks the texts with letters."""
    data = _FOLD[t.data]
    parts, owner = [], []
    for k in np.flatnonzero(lettered) if net.labels else []:
        w = windows_of(data[t.start[k] : t.stop[k]])
        parts.append(w)
        owner.append(np.full(len(w), k))
    langs, score, noise, letters = [UND] * len(t), np.zeros(len(t)), np.zeros(len(t)), t.sums(data != 0x20)
    if not parts:
        return langs, score, noise, letters
    x, own = np.concatenate(parts), np.concatenate(owner)
    weight = 1e-3 + ((x != 0x20) & (x != 0)).sum(1)
    logp = net.log_probabilities(x)
    weights = np.maximum(np.bincount(own, weight, len(t)), 1e-9)
    noise = np.bincount(own, np.exp(logp[:, -1]) * weight, len(t)) / weights
    logp = logp[:, :-1] - np.log(np.exp(logp[:, :-1]).sum(1, keepdims=True) + 1e-30)  # among the labels
    logp *= weight[:, None]
    mean = np.stack([np.bincount(own, logp[:, j], len(t)) for j in range(len(net.labels))], 1) / weights[:, None]
    prob = np.exp(mean - mean.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    best = prob.argmax(1)
    for k in np.unique(own):
        langs[k], score[k] = net.labels[best[k]], prob[k, best[k]]
    return langs, score, noise, letters


def least_by_hash(rows: DataFrame, key: str, h: str, most: int) -> DataFrame:
    """At most ``most`` different rows of each key, those of the least hash (column h). A threshold that about 1.25 times as
    many pass comes first, so that only those are put in order, however many rows a key has. Keys must be few."""
    counts = durable(rows.groupBy(key).agg(F.approx_count_distinct(h, 0.02).alias("__n")), "counts")
    n_keys = counts.count()
    if n_keys > MAX_LABELS:
        raise ValueError(f"{n_keys} labels are more than a model of this kind can tell apart")
    share = F.lit((1.25 * most + 100) * (1 << 30)) / F.col("__n")
    lucky = rows.join(F.broadcast(counts), key).filter(F.pmod(h, F.lit(1 << 30)) < share).drop("__n").distinct()
    rest = [c for c in rows.columns if c not in (key, h)]
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.pmod(h, F.lit(1 << 30)), h, *rest))
    return lucky.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")


def training_rows(docs: DataFrame, allowed: Column, *, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, pieces: int = PIECES) -> list:
    """(text piece, lang) of a bounded sample: pieces from anywhere in the whole texts of the chosen rows."""
    ids = docs.filter(allowed & docs[lang_col].isNotNull() & docs[doc_col].isNotNull() & docs[text_col].rlike("\\p{L}")).select(docs[doc_col].alias("doc_id"), docs[lang_col].alias("lang"), F.xxhash64(docs[doc_col]).alias("h"))
    chosen = durable(least_by_hash(ids, "lang", "h", per_language), "chosen")
    n_labels = max(1, chosen.select("lang").distinct().count())
    if n_labels * per_language > MAX_ROWS:
        few = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
        chosen = durable(chosen.withColumn("place", few).filter(F.col("place") <= MAX_ROWS // n_labels).drop("place"), "chosen")
    # At most MAX_ROWS rows are here: the size of the broadcast is bounded.
    mine = chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"))
    sample = durable(docs.join(F.broadcast(mine), (docs[doc_col] == mine["id"]) & (docs[lang_col] == mine["of"])).filter(allowed).select("id", docs[text_col].alias("text"), "of"), "sample")
    cut = sample.select("of", "id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(PIECE))).alias("at")).select("of", F.xxhash64("id", "at").alias("h"), F.substring("text", F.col("at") + 1, F.lit(PIECE)).alias("text"))
    drawn = least_by_hash(cut.filter(F.col("text").rlike("\\p{L}")), "of", "h", pieces)
    return drawn.select("text", F.col("of").alias("lang")).orderBy("lang", "text").collect()


def fit(docs: DataFrame, allowed: Column, **options) -> ByteNet:
    rows = training_rows(docs, allowed, **options)
    return train([r.text for r in rows], [r.lang for r in rows])


def with_language(docs: DataFrame, net: ByteNet, *, text_col: str = "text", names: tuple[str, str, str, str] = ("lang_pred", "score", "noise", "letters")) -> DataFrame:
    """docs with the label, the score, the share of noise and the letters (bytes) in front, under names; its own columns follow untouched."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(net)
    columns = docs.columns
    named = docs.select(F.lower(docs[text_col]).alias("__text"), F.coalesce(docs[text_col].rlike("\\p{L}"), F.lit(False)).alias("__letters"), *[docs[c] for c in columns])
    schema = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ("string", "double", "double", "bigint"), strict=True)) + ", " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            has = batch.column(1).to_numpy(zero_copy_only=False)
            for t in chunks(batch.column(0)):
                part = batch.slice(t.first, len(t))
                langs, *figures = classify(net, t, has[t.first : t.first + len(t)])
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *map(pa.array, figures), *part.columns[2:]], names=[*names, *part.schema.names[2:]])

    return named.mapInArrow(run, schema)


def identify(docs: DataFrame, *, held_out: Column, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, by a network that learns from the rows not held out."""
    net = fit(docs, ~held_out, doc_col=doc_col, text_col=text_col, lang_col=lang_col)
    narrow = docs.select(docs[doc_col].alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), docs[text_col].alias("text"))
    return with_language(narrow, net).select("doc_id", "held_out", "lang_pred", "score")
