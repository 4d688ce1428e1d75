"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words (runs of non-white-space; a null text has none). Its key is
-ln(u) / quality: u is drawn from a hash of its id, quality is one less twice its share of characters that are
neither letters nor white space (0.05 at least). The least keys of a source are a weighted sample without
replacement.

Targets: sources, by code point with null last, weigh 3, 1, 2, repeating, and share ``SHARE`` of all sizes; none
gets more than ``MOST`` times its size, and what it would have got beyond that is shared again by weight. A
source is taken whole as often as its target holds its size; then documents are taken by key as long as more
than half of the next one fits into the rest.

Nothing is sorted as a whole: sizes are summed by (source, bin of the key), and sums of bins give the bin in which the
target falls. As long as such a bin holds more than ``EDGE_ROWS`` documents it is cut into bins again; only then are
its documents put in order. The last key taken of each source then decides for every document by itself, in the query
as in a stage that carries texts. Sizes and keys are read from the texts once and written down.

A null id is one id; rows that agree in id and size share their decision, so that reruns agree. Empty sources
have a target of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.store import durable

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BINS = 4096
#: Documents of one source that are put in order at most, unless their keys are all the same.
EDGE_ROWS = 200_000
SEED = "mix:"
WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose figures are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_of(text: Column) -> Column:
    odd = F.coalesce(F.regexp_count(text, F.lit(r"[^\p{L}\s]")), F.lit(0)) / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1))
    return F.greatest(F.lit(0.05), 1 - 2 * odd)


def draw(doc_id: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits + 0.5) / float(2**52)


def with_keys(docs: DataFrame, *, doc_col: str, text_col: str, quality: Column | None = None) -> dict[str, Column]:
    return {"__size": size_of(docs[text_col]), "__key": -F.log(draw(docs[doc_col])) / (quality_of(docs[text_col]) if quality is None else quality)}


def _bin(key: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor((1 - F.exp(-key)) * BINS)).cast("int")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: source, source_size. Adds target. One row a source; the windows order sources, not documents."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = sizes.withColumn("weight", F.element_at(weights, (F.pmod(F.row_number().over(place) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    # Filled in order of limit to weight: the first source whose even share stays under its limit sets the level;
    # those before it are full, and levels that would count later ones as full too are lower.
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    ahead, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(everything) - MOST * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))) / F.sum("weight").over(rest)
    tried = weighed.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= MOST * F.col("source_size"), F.col("level"))
    return tried.withColumn("level", F.max(fits).over(everything)).select("source", "source_size", F.least(MOST * F.col("source_size").cast("double"), F.coalesce(F.col("level") * F.col("weight"), MOST * F.col("source_size").cast("double"))).alias("target"))


def plan(narrow: DataFrame) -> DataFrame:
    """narrow: doc_id, source, __size, __key. Per source: source_size, target, epochs, and the last key, id and size taken beyond them (nulls: none)."""
    bins = durable(narrow.groupBy("source", _bin(F.col("__key")).alias("bin")).agg(F.sum("__size").alias("n")), "bins")
    goal = targets(bins.groupBy("source").agg(F.sum("n").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    goal = durable(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goal")
    g = goal.select(F.col("source").alias("s"), "rest").filter("rest > 0")
    n = goal.count()
    few = (lambda df: F.broadcast(df)) if n <= BROADCAST_SOURCES else (lambda df: df)
    edge = _edge(bins, few(g.withColumn("ahead", F.lit(0).cast("bigint"))))
    mine = F.col("source").eqNullSafe(F.col("s"))
    inside = durable(narrow.withColumn("b", _bin(F.col("__key"))).join(few(edge), mine & (F.col("b") == F.col("bin"))).select("s", "bin", "doc_id", "source", "__size", "__key", "before", "rest"), "inside")
    while True:
        ends = inside.groupBy("s").agg(F.count("*").alias("n"), F.min("__key").alias("lo"), F.max("__key").alias("hi"), F.first("before").alias("ahead"), F.first("rest").alias("rest"))
        wide = durable(ends.filter((F.col("n") > EDGE_ROWS) & (F.col("lo") < F.col("hi"))), "wide")
        if not wide.head(1):
            break
        # Equal parts of the range of keys that the bin holds.
        sub = F.least(F.lit(BINS - 1), F.floor((F.col("__key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int")
        cut = durable(inside.drop("before", "rest").join(few(wide.select(F.col("s").alias("t"), "lo", "hi")), F.col("s").eqNullSafe(F.col("t"))).withColumn("sub", sub).drop("t", "lo", "hi"), "cut")
        fine = _edge(cut.groupBy("source", F.col("sub").alias("bin")).agg(F.sum("__size").alias("n")), few(wide.select("s", "rest", "ahead"))).withColumnsRenamed({"s": "t", "bin": "fine"})
        kept = cut.join(few(fine), F.col("s").eqNullSafe(F.col("t")) & (F.col("sub") == F.col("fine"))).select(*inside.columns)
        rest = inside.join(few(wide.select(F.col("s").alias("t"))), F.col("s").eqNullSafe(F.col("t")), "left_anti")
        inside = durable(kept.unionByName(rest), "inside")
    order = Window.partitionBy("s").orderBy("__key", "doc_id", "__size")
    start = F.col("before") + F.coalesce(F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.struct("__key", "doc_id", "__size")
    last = inside.withColumn("start", start).groupBy("s").agg(F.max(F.when(F.col("start") + F.col("__size") / 2 <= F.col("rest"), own)).alias("last"), F.min(own).alias("first"))
    known = edge.select("s", "bin").join(last.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left").select("s", F.struct("bin", "first", "last").alias("edge"))
    return durable(goal.join(known, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "epochs", "edge"), "plan")


def _edge(bins: DataFrame, goals: DataFrame) -> DataFrame:
    """bins: source, bin, n. goals: s, rest, ahead (sizes before all bins). The bin (s, bin, before, rest) in which each source's rest is reached."""
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    upto = bins.withColumn("up", F.coalesce(F.sum("n").over(run), F.lit(0))).join(goals, F.col("source").eqNullSafe(F.col("s"))).withColumn("before", F.col("up") + F.col("ahead"))
    return durable(upto.filter("before < rest AND rest <= before + n").select("s", "bin", "before", "rest"), "edge")


def times() -> Column:
    """How often a row is taken, from the plan's columns beside its own."""
    own = F.struct("__key", F.col("__id").alias("doc_id"), "__size")
    more = F.when(F.col("edge").isNull(), F.lit(False)).when(_bin(F.col("__key")) < F.col("edge.bin"), F.lit(True)).when(_bin(F.col("__key")) > F.col("edge.bin"), F.lit(False)).otherwise((own < F.col("edge.first")) | F.coalesce(own <= F.col("edge.last"), F.lit(False)))
    return F.col("epochs") + F.coalesce(more, F.lit(False)).cast("bigint")


def _joined(rows: DataFrame, figures: DataFrame, source: str) -> DataFrame:
    figures = figures.withColumnRenamed("source", "__of")
    if figures.count() <= BROADCAST_SOURCES:
        figures = F.broadcast(figures)
    return rows.join(figures, F.col(source).eqNullSafe(F.col("__of")), "left")


def mix(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words). quality: a column of docs above 0, else the share of letters."""
    keys = with_keys(docs, doc_col=doc_col, text_col=text_col, quality=quality)
    narrow = durable(docs.select(docs[doc_col].alias("doc_id"), docs[source_col].alias("source"), *[c.alias(n) for n, c in keys.items()]), "keys")
    out = _joined(narrow.withColumn("__id", F.col("doc_id")), plan(narrow), "source")
    return out.select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * times()).alias("taken"))


def mixed(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """The mix itself: rows of docs, in its own columns, each as often as it is taken. Rows are written down beside their keys,
    so that the texts are read for them once."""
    keys = with_keys(docs, doc_col=doc_col, text_col=text_col, quality=quality)
    whole = durable(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[doc_col].alias("__id"), docs[source_col].alias("__source"), *[c.alias(n) for n, c in keys.items()]), "keyed")
    figures = plan(whole.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), "__size", "__key"))
    out = _joined(whole, figures, "__source").select("__row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(MOST).cast("bigint"))).alias("copy"), times().alias("n"))
    return out.filter("copy <= n").select("__row.*")


SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / greatest(0.05::DOUBLE, 1 - 2 * (coalesce(len(regexp_extract_all(text, '[^\p{L}\s]')), 0)::DOUBLE / greatest(coalesce(length(text), 0), 1))) AS k
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size,
    coalesce(weight * max(CASE WHEN level * weight <= 2 * source_size THEN level END) OVER (), 2.0::DOUBLE * source_size)) AS target
  FROM levels),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals),
placed AS (
  SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN epochs e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, round(target, 3) AS target,
  (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
