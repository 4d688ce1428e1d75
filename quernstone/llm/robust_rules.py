"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source.

Each row's vector: mean word length, and the square roots of the rates of symbols, repeated lines, repeated
words and capitals. It is fixed to thousandths, so that every sum below is exact and reruns agree.

Estimates are made for three kinds of groups at once: (language, source), language, and all rows. Sought are the
``SHARE`` of a group's rows whose covariance, with ``FLOOR`` added to the deviations, has the least determinant (most
texts have no symbol or repeated line at all, and a covariance of zeros has no inverse). As in FastMCD there are several
starts: medians with median absolute deviations, mean and covariance of all rows, and ``DRAWS`` sets of a few rows drawn
by hash. A concentration step takes the share of rows with the least distances for the next mean and covariance, which
can't raise the determinant. All starts make ``FIRST`` steps, the ``BEST`` of each group go on until their
determinants no longer fall (their logarithms by ``STILL``, within ``STEPS`` steps; the table says which did), and the
least determinant wins.

Each step is two passes over all rows: one counts them by group, start and bin of the distance (``LOG_STEP`` wide in its
logarithm), which gives the bin at whose end the share is cut; the other adds up the rows up to it. Tasks add up what they
see before anything moves. No sample, and no group in one task. The winner is scaled to a consistent covariance by the group's median distance.

A row is judged by its (language, source) if that has ``LEAST_ROWS`` rows with words, else by its language if that has,
else by all rows. It is rejected if its squared distance exceeds the chi-squared quantile of ``CONFIDENCE``. A null
language or source is a value of its own. Rows without words have no vector; the base rules fail them.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.doc_stats import with_counts
from quernstone.llm.store import durable

VECTOR = ("v_length", "v_symbols", "v_lines", "v_words", "v_upper")
D = len(VECTOR)
#: Added to the standard deviation of each coordinate, in its own unit. One repeated line of a short text alone
#: moves the roots of the two rates of repetition by about 0.4.
FLOOR = (0.35, 0.06, 0.11, 0.11, 0.08)
SHARE, LEAST_ROWS, CONFIDENCE = 0.75, 60, 1 - 1e-9
DRAWS, FIRST, BEST, STEPS, STILL = 3, 2, 2, 60, 1e-6
UNIT = 1000
#: Groups whose estimates are broadcast; beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Squared distances are told apart to this step of their logarithm.
LOG_STEP = 0.001
#: Rows that a task adds up at once.
TASK_ROWS = 200_000
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_quantile(p: float, d: int = D) -> float:
    """Wilson and Hilferty's approximation."""
    a = 2 / (9 * d)
    return d * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def _vector() -> list[Column]:
    words = F.col("n_words")
    parts = (F.col("word_chars") / words, F.sqrt(F.col("n_symbols") / words), F.sqrt(F.col("n_dup_lines") / F.col("n_lines")), F.sqrt(F.col("n_repeat_words") / words), F.sqrt(F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))))
    return [F.round(UNIT * F.least(x, F.lit(100.0))).cast("bigint").alias(n) for x, n in zip(parts, VECTOR, strict=True)]


def _distance() -> Column:
    """(x - mean)' inverse (x - mean), of column form (row by row)."""
    d = [F.col(v) / UNIT - F.col("form")[i] for i, v in enumerate(VECTOR)]
    return sum((d[i] * d[j] * F.col("form")[D + k] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


#: A form is the mean, then the factors of these products in the distance.
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_SUMS = [*(f"s_{i}" for i in range(D)), *(f"s_{i}_{j}" for i, j in PAIRS)]
_FORMS = "key string, start int, n bigint, form array<double>, logdet double"


def _form(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, float]:
    """The form and the log determinant of a mean and a covariance, floor included."""
    cov = cov + np.diag(np.square(FLOOR))
    inverse = np.linalg.inv(cov)
    return np.concatenate([mean, [inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS]]), float(np.linalg.slogdet(cov)[1])


def _start(rows: pd.DataFrame) -> pd.DataFrame:
    spread = np.maximum(1.4826 * rows[[f"mad_{v}" for v in VECTOR]].to_numpy(float) / UNIT, np.array(FLOOR))
    made = [_form(m / UNIT, np.diag(s**2 - np.square(FLOOR))) for m, s in zip(rows[[f"med_{v}" for v in VECTOR]].to_numpy(float), spread, strict=True)]
    return pd.DataFrame({"key": rows["key"], "start": 0, "n": rows["n"], "form": [f for f, _ in made], "logdet": [x for _, x in made]})


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    made = []
    for r in rows.to_dict("records"):
        n = float(r["n"])
        mu = np.array([float(r[f"s_{i}"]) for i in range(D)]) / n / UNIT
        cov = np.empty((D, D))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = float(r[f"s_{i}_{j}"]) / n / UNIT**2 - mu[i] * mu[j]
        made.append(_form(mu, cov))
    return pd.DataFrame({"key": rows["key"], "start": rows["start"], "n": rows["n"], "form": [f for f, _ in made], "logdet": [x for _, x in made]})


def _estimates(raw: DataFrame, step) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield step(rows)

    return durable(raw.mapInPandas(run, _FORMS), "estimates")


def _with(rows: DataFrame, table: DataFrame, n_groups: int, on: str = "key") -> DataFrame:
    return rows.join(F.broadcast(table) if n_groups <= BROADCAST_GROUPS else table, on)


def _added(vectors: DataFrame) -> DataFrame:
    """Sums of the rows of each (key, start). Thousandths are whole numbers: sums are exact, and one beyond 64 bits is an error."""
    return vectors.groupBy("key", "start").agg(F.count("*").alias("n"), *[F.sum(VECTOR[i]).alias(f"s_{i}") for i in range(D)], *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"s_{i}_{j}") for i, j in PAIRS])


def bins_of(distance: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(distance, 1e-9)) / LOG_STEP).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, VECTOR, starts, forms, cuts) added up as far as one task sees them: without cuts counted by key, start and bin of
    the distance; with cuts, those up to the cut summed by key and start."""
    codes: dict[str, int] = {}
    waiting: list[tuple[np.ndarray, np.ndarray]] = []  # (key, start, bin) in one number; counts and sums
    size, summed = 0, False

    def merged() -> list[tuple[np.ndarray, np.ndarray]]:
        ids, values = np.concatenate([i for i, _ in waiting]), np.concatenate([v for _, v in waiting])
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        return [(ids[first], np.add.reduceat(values[order], first, axis=0))]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).dictionary_encode()
        code = np.array([codes.setdefault(k, len(codes)) for k in keys.dictionary.to_pylist()])[keys.indices.to_numpy()]
        x = np.stack([batch.column(1 + i).to_numpy() for i in range(D)], 1)
        starts, cuts = batch.column(1 + D), batch.column(3 + D)
        owner = np.repeat(np.arange(len(x)), np.diff(starts.offsets.to_numpy()))
        form = batch.column(2 + D).flatten().to_numpy().reshape(len(owner), D + len(PAIRS))
        d = x[owner] / UNIT - form[:, :D]
        # Product by product: a row's distance doesn't depend on the rows beside it.
        bins = bins_of(sum(d[:, i] * d[:, j] * form[:, D + k] for k, (i, j) in enumerate(PAIRS)))
        ids = (code[owner] << 32) + (starts.flatten().to_numpy().astype(np.int64) << 20)
        if summed := cuts.null_count == 0:
            near = bins <= cuts.flatten().to_numpy()
            y = x[owner[near]]
            waiting.append((ids[near], np.concatenate([np.ones((len(y), 1), np.int64), y, np.stack([y[:, i] * y[:, j] for i, j in PAIRS], 1)], 1)))
        else:
            waiting.append((ids + bins + (1 << 19), np.ones((len(ids), 1), np.int64)))
        size += len(waiting[-1][0])
        if size > TASK_ROWS:
            waiting = merged()
            size = len(waiting[0][0])
    if size:
        ids, values = merged()[0]
        names = list(codes)
        bins = pa.nulls(len(ids), pa.int32()) if summed else pa.array(((ids & 0xFFFFF) - (1 << 19)).astype(np.int32))
        sums = [pa.array(c) for c in np.ascontiguousarray(values.T)] + [pa.nulls(len(ids), pa.int64())] * (0 if summed else len(_SUMS))
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in ids >> 32], pa.string()), pa.array(((ids >> 20) & 0xFFF).astype(np.int32)), bins, *sums], names=["key", "start", "bin", "n", *_SUMS])


def _passed(vectors: DataFrame, table: DataFrame, n_groups: int) -> DataFrame:
    """What the tasks add up for the table's keys and forms (and cuts, if it has them)."""
    fields = ("start", "form", "cut") if "cut" in table.columns else ("start", "form")
    forms = table.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("f"))
    cuts = F.transform("f", lambda f: f["cut"]) if "cut" in fields else F.lit(None).cast("array<int>")
    forms = forms.select("key", F.transform("f", lambda f: f["start"]).alias("starts"), F.flatten(F.transform("f", lambda f: f["form"])).alias("forms"), cuts.alias("cuts"))
    rows = _with(vectors, forms, n_groups).select("key", *VECTOR, "starts", "forms", "cuts")
    return rows.mapInArrow(_partial, "key string, start int, bin int, n bigint, " + ", ".join(f"{c} bigint" for c in _SUMS))


def _cuts(vectors: DataFrame, table: DataFrame, n_groups: int, share: float) -> DataFrame:
    """(key, start, cut): the bin in which each pair has its share of rows. A pair has a few thousand bins at most."""
    hist = _passed(vectors, table, n_groups).groupBy("key", "start", "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("key", "start")
    before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = hist.withColumns({"before": before, "all": F.sum("n").over(own)}).filter(F.col("before") < F.col("all") * share)
    return durable(upto.groupBy("key", "start").agg(F.max("bin").alias("cut")), "cuts")


def _step(vectors: DataFrame, table: DataFrame, n_groups: int) -> DataFrame:
    cut = table.join(_cuts(vectors, table, n_groups, SHARE), ["key", "start"])
    sums = _passed(vectors, cut, n_groups).groupBy("key", "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _SUMS])
    return _estimates(sums, _solve)


def _drawn(vectors: DataFrame, sizes: DataFrame, n_groups: int) -> DataFrame:
    """DRAWS sets of D + 1 different vectors of each key, by hash: key, start, VECTOR. A key with few different vectors has fewer sets."""
    wanted = DRAWS * (D + 1)
    h = F.xxhash64("key", *VECTOR)
    lucky = _with(vectors, sizes, n_groups).filter(F.pmod(h, F.lit(1 << 30)) < F.lit(8 * wanted * (1 << 30)) / F.col("n"))
    # About 8 * wanted different vectors of a key are left, whatever its size; copies are one before they move.
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", *VECTOR), *VECTOR))
    return lucky.groupBy("key", *VECTOR).agg(F.lit(1)).withColumn("place", place).filter(F.col("place") <= wanted).select("key", (2 + F.floor((F.col("place") - 1) / (D + 1))).cast("int").alias("start"), *VECTOR)


def estimate(vectors: DataFrame) -> DataFrame:
    """vectors: key and VECTOR. Returns key, n, form (scaled), logdet, start, steps and settled (the winner's) of every key."""
    med = durable(vectors.groupBy("key").agg(F.count("*").alias("n"), *[F.median(v).alias(f"med_{v}") for v in VECTOR]), "medians")
    n_groups = med.count()
    off = _with(vectors, med.drop("n"), n_groups).groupBy("key").agg(*[F.median(F.abs(F.col(v) - F.col(f"med_{v}"))).alias(f"mad_{v}") for v in VECTOR])
    sums = _added(vectors.withColumn("start", F.lit(1))).unionByName(_added(_drawn(vectors, med.select("key", "n"), n_groups)))
    now = _estimates(med.join(off, "key"), _start).unionByName(_estimates(sums, _solve))
    for _ in range(FIRST):
        now = _step(vectors, now, n_groups)
    order = Window.partitionBy("key").orderBy("logdet", "start")  # as many rows as starts
    on = durable(now.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BEST).drop("place"), "best")
    ended = []
    for k in range(STEPS):
        # Distances are told apart by bins, so that a step near the end may raise a determinant a little: then the one before stays.
        was = on.select("key", "start", F.struct("logdet", "form").alias("was"))
        both = _step(vectors, on, n_groups).join(was, ["key", "start"]).withColumn("least", F.least(F.struct("logdet", "form"), F.col("was")))
        made = both.select("key", "start", "n", F.col("least.form").alias("form"), F.col("least.logdet").alias("logdet"), (F.col("was.logdet") - F.col("logdet") < STILL).alias("settled"), F.lit(FIRST + k + 1).alias("steps"))
        made = durable(made, "step")
        last = k == STEPS - 1
        ended.append(made if last else made.filter("settled"))
        on = made.filter("NOT settled").drop("settled", "steps")
        if last or not on.head(1):
            break
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    names = ("start", "form", "logdet", "steps", "settled")
    best = durable(every.groupBy("key").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("b")).select("key", "b.*"), "winners")
    middle = _cuts(vectors, best, n_groups, 0.5).select("key", "cut")
    scale = F.greatest(F.exp((F.col("cut") + 1) * LOG_STEP) / chi2_quantile(0.5), F.lit(1.0))
    form = F.transform("form", lambda x, i: F.when(i < D, x).otherwise(x / scale))
    out = best.join(middle, "key").join(med.select("key", "n"), "key").select("key", "n", form.alias("form"), "logdet", "start", "steps", "settled")
    return durable(out, "mcd")


def _keys() -> list[Column]:
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("0")) for c in ("lang", "source"))
    return [F.concat(F.lit("s"), F.length(lang), lang, source), F.concat(F.lit("l"), lang), F.lit("a")]


def quality_rules(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared, null without words)."""
    keep = {"doc_id": doc_col, "lang": lang_col, "source": source_col}
    counted = with_counts(docs, (*_BASE, "n_lines", "n_upper", "n_lower"), text_col=text_col, keep=keep)
    stats = durable(counted.withColumns({"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")}), "stats")
    worded = stats.filter("n_words > 0").select("*", *_vector())
    table = estimate(durable(worded.select(F.explode(F.array(*_keys())).alias("key"), *VECTOR), "vectors"))
    n_groups = table.count()
    enough = table.filter((F.col("n") >= LEAST_ROWS) | (F.col("key") == "a"))
    share = enough.select("key", "form")
    out = worded.withColumns(dict(zip(("k0", "k1", "k2"), _keys(), strict=True)))
    for k in range(3):
        side = share.select(F.col("key").alias(f"k{k}"), F.col("form").alias(f"e{k}"))
        out = out.join(F.broadcast(side) if n_groups <= BROADCAST_GROUPS else side, f"k{k}", "left")
    out = out.withColumn("form", F.coalesce("e0", "e1", "e2")).withColumn("distance", F.round(_distance(), 6))
    columns = ["doc_id", *_BASE]
    out = out.select(*columns, "distance").unionByName(stats.filter("n_words = 0").select(*columns, F.lit(None).cast("double").alias("distance")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(*columns, failed.alias("base_failed"), (~failed & F.coalesce(F.col("distance") <= chi2_quantile(CONFIDENCE), F.lit(False))).alias("kept"), "distance")
