"""Lookups, guards, comparisons and set operations between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of child without a row in parent."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in on])
    return child.join(keys, [c for c, _ in on], "left_anti")


def guarded(df: DataFrame, purges: DataFrame, *keys: list[tuple[str, str]]) -> DataFrame:
    """Rows none of whose keys is purged. A key is pairs (column here, column of purges); each is an anti-join of its own, so that no disjunction is planned as a nested loop."""
    return reduce(lambda d, key: missing(d, purges, key), keys, df)


def purged(df: DataFrame, purges: DataFrame, on: list[str]) -> DataFrame:
    return df.join(purges.select(*on), on, "left_semi")


def cascade(stale: DataFrame, **children: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Child tables without the rows of stale keys (one column); each child comes with the column of its key."""
    name = stale.columns[0]
    return {k: df.join(stale.select(F.col(name).alias(column)), column, "left_anti") for k, (df, column) in children.items()}


def keyed_diff(active: DataFrame, shadow: DataFrame, key: list[str], table: str = "") -> DataFrame:
    """Rows that are missing from, extra in or changed in shadow: table, key columns, change, columns (the changed ones). Null equals null alone."""
    values = [c for c in active.columns if c not in key]
    a = active.select(*key, F.struct(F.lit(1).alias("there"), *values).alias("a"))
    b = shadow.select(*key, F.struct(F.lit(1).alias("there"), *values).alias("b"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in values])) if values else F.array().cast("array<string>")
    change = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.size("d") > 0, "changed")
    both = a.join(b, key, "full_outer").withColumn("d", changed).withColumn("change", change).filter("change IS NOT NULL")
    return both.select(F.lit(table).alias("table"), *key, "change", F.when(F.col("change") == "changed", F.array_join("d", ",")).otherwise("").alias("columns"))


def multiset_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Contents whose numbers of rows differ: columns, n_a, n_b. Both sides are counted in one grouping."""
    both = a.select(*columns, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(*columns, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return both.groupBy(*columns).agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b")).filter("n_a <> n_b")


def phone_matches(contacts: DataFrame, imported: DataFrame, phone_key) -> DataFrame:
    """Each contact with the first imported name of its phone and a class: no_phone, no_match, same, matched.

    imported: pos (its order), name, phones (array). Names are reduced to one a phone before the join."""
    phones = imported.filter(F.coalesce(F.trim("name"), F.lit("")) != "").select("pos", "name", F.posexplode("phones").alias("k", "phone")).withColumn("phone_key", phone_key(F.col("phone"))).filter(F.length("phone_key") >= 7)
    first = phones.groupBy("phone_key").agg(F.min_by("name", F.struct("pos", "k")).alias("import_name"))
    df = contacts.withColumn("phone_key", phone_key(F.coalesce("phone", F.lit("")))).join(first, "phone_key", "left")
    kind = F.when(F.col("phone_key") == "", "no_phone").when(F.col("import_name").isNull(), "no_match").when(F.coalesce("system_name", F.lit("")) == F.col("import_name"), "same").otherwise("matched")
    return df.withColumn("class", kind)


def with_fallback(votes: DataFrame, polls: DataFrame) -> DataFrame:
    """Votes with their poll: that of the same chat, else the newest of the same message id in any chat."""
    newest = polls.groupBy(F.col("msg_id").alias("poll_msg_id")).agg(F.max_by(F.struct("chat_jid", "created_ts"), F.struct("created_ts", "chat_jid")).alias("any"))
    exact = polls.select("chat_jid", F.col("msg_id").alias("poll_msg_id"), F.struct("chat_jid", "created_ts").alias("own")).dropDuplicates(["chat_jid", "poll_msg_id"])
    out = votes.join(exact, ["chat_jid", "poll_msg_id"], "left").join(newest, "poll_msg_id", "left").withColumn("poll", F.coalesce("own", "any"))
    return out.withColumns({"poll_chat_jid": F.col("poll.chat_jid"), "poll_created_ts": F.col("poll.created_ts"), "exact": F.col("own").isNotNull()}).drop("own", "any", "poll")


def canonical(df: DataFrame, column: str, identity_map: DataFrame) -> DataFrame:
    """df with the column's ids replaced by the phone ids that the map (lid, pn) knows for them. The map is reduced to one row an id first, so that no row is doubled."""
    one = identity_map.groupBy(F.col("lid").alias(column)).agg(F.min("pn").alias("__pn"))
    return df.join(one, column, "left").withColumn(column, F.coalesce("__pn", column)).drop("__pn").select(*df.columns)


def expand_aliases(ids: list[str], identity_map: DataFrame) -> list[str]:
    """A few ids with their other forms, for a filter: only rows of these ids are read."""
    found = identity_map.filter(F.col("lid").isin(ids) | F.col("pn").isin(ids)).select("lid", "pn").distinct().collect() if ids else []
    return list(dict.fromkeys([*ids, *(x for r in found for x in (r.lid, r.pn) if x)]))


def best_candidates(*sources: DataFrame, limit: int = 10) -> DataFrame:
    """Candidates (jid, name, detail, kind_rank, score) of several sources: one row an id, the higher score and then the lower rank; best first."""
    every = reduce(DataFrame.unionByName, sources).filter((F.col("score") > 0) & (F.trim("jid") != ""))
    best = every.groupBy("jid").agg(F.max_by(F.struct("name", "detail", "kind_rank", "score"), F.struct(F.col("score"), -F.col("kind_rank"), F.col("name"), F.col("detail"))).alias("b")).select("jid", "b.*")
    out = best.orderBy(F.col("score").desc(), "kind_rank", F.lower("name"), "jid")
    return out.limit(limit) if limit > 0 else out


def union_ids(*columns: tuple[DataFrame, str], ends: str = "") -> DataFrame:
    """The distinct ids of several columns. Each column is made distinct first: partial results are small before they meet."""
    parts = [df.select(F.col(c).alias("jid")).filter(F.col("jid").endswith(ends) if ends else F.col("jid").isNotNull()).distinct() for df, c in columns]
    return reduce(DataFrame.union, parts).distinct()


def missing_from(current: DataFrame, snapshot: DataFrame, key: str, left_at: int) -> DataFrame:
    """Groups still joined that a fresh snapshot doesn't have, marked as left."""
    return current.filter(F.coalesce("left_at", F.lit(0)) == 0).join(snapshot.select(key).distinct(), key, "left_anti").withColumn("left_at", F.lit(left_at).cast("bigint"))


def merged_options(new: Column, old: Column) -> Column:
    """The new options in order, then those of old that are not among them."""
    return F.concat(new, F.array_except(old, new))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order; order must tell the rows of a key apart. One partial aggregate, no window."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def displaced_media(messages: DataFrame, moved: DataFrame) -> DataFrame:
    """Local paths that a merge of chats (source, target) would lose: a message of both with different paths."""
    paths = messages.filter(F.coalesce("local_path", F.lit("")) != "").select("chat_jid", "msg_id", "local_path")
    a = paths.join(moved.select(F.col("source").alias("chat_jid"), "target"), "chat_jid").select("target", "msg_id", F.col("local_path").alias("source_path"))
    b = paths.select(F.col("chat_jid").alias("target"), "msg_id", F.col("local_path").alias("target_path"))
    return a.join(b, ["target", "msg_id"]).filter("source_path <> target_path")


def first_candidates(candidates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first candidate of each key; order must tell those of a key apart. One partial aggregate, no window."""
    rest = [c for c in candidates.columns if c not in key]
    return candidates.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*").select(*candidates.columns)
