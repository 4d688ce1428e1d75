"""Importance resampling towards a target distribution of hashed n-grams, in Spark SQL alone.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A feature is a run of
1 to ``GRAMS`` words of one text, joined by a space, as often as it occurs; it falls into the bucket of the checksum of
its bytes modulo ``BUCKETS``. With S features in all documents, s of them in a bucket, and T and t of them in the
target's texts, a bucket's gain is floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))), B being the number of
buckets. A document's weight is the sum of the gains of its features (0 without any), and its score is the weight and
floor(-1000 * ln(-ln(u))), u being drawn from a hash of its id: the highest scores are a sample without replacement.
Of the N documents of ``LEAST_WORDS`` words or more, floor(N * PERCENT / 100) are drawn, ties going to smaller ids.

Features are never kept: they are made twice, once for the counts, of which a task hands on one number a bucket, and once
for the sums, of which it hands on one row a document. The table of gains, which is broadcast, has a row a bucket. The
scores are narrow rows; they are sorted as a whole by range, and a row's rank is its place in its partition and the
rows of the partitions before.

A null or empty text has no words and no features; a null id is hashed as an empty string and comes first among ties.
Repeated rows are judged each for itself, so that copies can be drawn together. An empty target has T = 0; an empty table gives
an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.store import durable

BUCKETS, GRAMS = 10_000, 3
LEAST_WORDS, PERCENT = 20, 5
SEED = "42:"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words as they are written."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), 0), F.array().cast("array<string>"))


def lowered(c: Column) -> Column:
    """A-Z in lower case. Texts of ASCII alone, most of them, take the cheap way; lower() would change other letters too."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def features(rows: DataFrame) -> DataFrame:
    """rows (with __words) as one row for each feature, its bucket and whether it is a word; for those without any, one row of nulls.

    Each word is followed by the next ones in its own row, so that an array of n-grams a word is exploded and no lambda is run."""
    keep = [c for c in rows.columns if c != "__words"]
    each = rows.select(*keep, "__words", F.posexplode_outer("__words").alias("__at", "__word"))
    grams = [lowered(F.col("__word"))]
    for k in range(1, GRAMS):
        grams.append(F.concat(grams[-1], F.lit(" "), lowered(F.get("__words", F.col("__at") + k))))  # null behind the last word
    return each.select(*keep, F.posexplode_outer(F.array(*map(bucket_of, grams))).alias("__n", "bucket")).filter("bucket IS NOT NULL OR __n = 0").select(*keep, "bucket", ((F.col("__n") == 0) & F.col("bucket").isNotNull()).alias("is_word"))


def bucket_of(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % BUCKETS).cast("int")


def bucket_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all texts; buckets without features are left out."""
    found = features(texts.select(words_of(texts[text_col]).alias("__words")))
    return found.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(bucket, gain) of every bucket; at most BUCKETS rows."""
    spark = docs.sparkSession
    source = durable(bucket_counts(docs, text_col), "source_buckets").withColumnsRenamed({"bucket": "b", "n": "s"})
    wanted = durable(bucket_counts(target, target_text_col), "target_buckets").withColumnsRenamed({"bucket": "c", "n": "t"})
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(source), F.col("bucket") == F.col("b"), "left").join(F.broadcast(wanted), F.col("bucket") == F.col("c"), "left").select("bucket", *[F.coalesce(F.col(x), F.lit(0)).cast("double").alias(x) for x in ("s", "t")])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + BUCKETS)) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    return durable(both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain")), "gains")  # one row of totals


def noise(doc_id: Column) -> Column:
    """floor(-1000 ln(-ln(u))), with u in (0, 1) from 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def scores(docs: DataFrame, gain: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: row (a number), doc_id, n_words, n_features, weight, score."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_col].alias("doc_id"), words_of(docs[text_col]).alias("__words"))
    table = F.broadcast(gain.withColumnRenamed("bucket", "b"))  # a row a bucket
    met = features(rows).join(table, F.col("bucket") == F.col("b"), "left")
    summed = met.groupBy("row", "doc_id").agg(F.count_if("is_word").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return summed.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def _ranked(pool: DataFrame) -> DataFrame:
    """pool with the rank of every row by falling score, then by id: a sort by range, and offsets of its partitions."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    placed = durable(pool.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return placed.join(F.broadcast(offsets), part == F.col("p")).withColumn("rank", F.col("ahead") + inside + 1)


def resample(docs: DataFrame, target: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, and rank among the drawn ones (null: not drawn)."""
    scored = durable(scores(docs, gains(docs, target, text_col=text_col, target_text_col=target_text_col), doc_col=doc_col, text_col=text_col), "scores")
    pool = scored.filter(F.col("n_words") >= least_words)
    drawn = pool.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = _ranked(pool.select("row", *columns)).select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank")))


#: The checksum of a text is a sum (exclusive or) of one term a byte, which depends on the byte and the bytes that follow it, and one
#: of the length. {texts} is a query with the column s; the result crcs has (s, crc) of each different one.
CRC_SQL = r"""
crc_one AS (
  SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS t FROM (SELECT unnest(range(256)) AS b)),
crc_texts AS MATERIALIZED (SELECT DISTINCT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM ({texts})),
crc_steps AS (
  SELECT b, 0 AS d, t AS c FROM crc_one UNION ALL SELECT 256, 0, 4294967295
  UNION ALL
  SELECT r.b, r.d + 1, xor(r.c >> 8, o.t) FROM crc_steps r JOIN crc_one o ON o.b = (r.c & 255) WHERE r.d < (SELECT max(n) FROM crc_texts)),
crc_terms AS (
  SELECT s, n, ('0x' || substr(x, 2 * i + 1, 2))::INT AS b, n - 1 - i AS d FROM (SELECT *, unnest(range(n)) AS i FROM crc_texts)),
crcs AS (
  SELECT t.s, xor(xor(bit_xor(r.c), any_value(z.c)), 4294967295) AS crc
  FROM crc_terms t JOIN crc_steps r ON r.b = t.b AND r.d = t.d JOIN crc_steps z ON z.b = 256 AND z.d = t.n GROUP BY t.s)
"""

SQL = r"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
target_words AS (
  SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
doc_grams AS MATERIALIZED (
  SELECT doc_id, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT unnest([1, 2, 3]) AS k))),
target_grams AS MATERIALIZED (
  SELECT array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM target_words, (SELECT unnest([1, 2, 3]) AS k))),
""" + CRC_SQL.replace("{texts}", "SELECT s FROM doc_grams UNION ALL SELECT s FROM target_grams") + r""",
doc_buckets AS MATERIALIZED (SELECT g.doc_id, c.crc % 10000 AS b FROM doc_grams g JOIN crcs c ON g.s = c.s),
target_buckets AS MATERIALIZED (SELECT c.crc % 10000 AS b FROM target_grams g JOIN crcs c ON g.s = c.s),
gains AS (
  SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM doc_buckets) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target_buckets) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT b, count(*) AS s FROM doc_buckets GROUP BY b) LEFT JOIN (SELECT b, count(*) AS t FROM target_buckets GROUP BY b) USING (b)),
weights AS (SELECT doc_id, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS weight FROM doc_buckets JOIN gains USING (b) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM doc_words d LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM ranked
"""
