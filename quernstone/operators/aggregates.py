"""Counts, coverage, activity, extremes, tallies and running counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.values import contains_any
from quernstone.operators.hot import BUCKET, bucketed, preceding, running_count
from quernstone.operators.reads import limited


def store_stats(messages: DataFrame, chats: DataFrame, contacts: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of counts over everything, tombstones and left groups too, and the newest message's time."""
    one = messages.agg(F.count("*").alias("messages"), F.coalesce(F.max("ts"), F.lit(0)).alias("last_message_ts"))
    for name, df in (("chats", chats), ("contacts", contacts), ("groups", groups)):
        one = one.join(F.broadcast(df.agg(F.count("*").alias(name))), F.lit(True))  # one row each
    return one


def coverage(chats: DataFrame, messages: DataFrame, *, query: str = "", kind: str = "", include_blocked: bool = False, limit: int = 0) -> DataFrame:
    """Per chat the number, first and last time of its messages; ready with any, blocked without. Counted before the join, so that a large chat is one row in it."""
    counts = messages.groupBy("chat_jid").agg(F.count("*").alias("message_count"), F.min("ts").alias("oldest_ts"), F.max("ts").alias("newest_ts"))
    df = chats.select("jid", "name", "kind").join(counts, F.col("jid") == F.col("chat_jid"), "left").drop("chat_jid")
    df = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("message_count", "oldest_ts", "newest_ts")}).withColumn("status", F.when(F.col("message_count") > 0, "ready").otherwise("blocked"))
    if query.strip():
        df = df.filter(contains_any(query.strip(), F.col("name"), F.col("jid")))
    if kind:
        df = df.filter(F.col("kind") == kind)
    if not include_blocked:
        df = df.filter("status = 'ready'")
    return limited(df.orderBy(F.col("newest_ts").desc(), "jid"), limit)


def activity(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats with activity_ts, the later of their own time and that of their newest message."""
    newest = messages.groupBy("chat_jid").agg(F.max("ts").alias("newest"))
    df = chats.join(newest, F.col("jid") == F.col("chat_jid"), "left").drop("chat_jid")
    return df.withColumn("activity_ts", F.greatest(F.coalesce("newest", F.lit(0)), F.coalesce("last_message_ts", F.lit(0)))).drop("newest")


def stale_chats(chats: DataFrame, messages: DataFrame, cutoff: int) -> DataFrame:
    return activity(chats, messages).filter((F.col("activity_ts") > 0) & (F.col("activity_ts") < cutoff)).orderBy("activity_ts", "jid")


def prunable_groups(groups: DataFrame, chats: DataFrame, messages: DataFrame, cutoff: int, left_only: bool) -> DataFrame:
    """Groups left before the cutoff; unless left_only, also those still joined whose last activity is older."""
    activity_of = activity(chats, messages).select(F.col("jid").alias("chat_jid"), "activity_ts")
    df = groups.join(activity_of, F.col("jid") == F.col("chat_jid"), "left").drop("chat_jid").withColumn("activity_ts", F.coalesce("activity_ts", F.lit(0)))
    left = (F.col("left_at") > 0) & (F.col("left_at") < cutoff)
    idle = (F.coalesce("left_at", F.lit(0)) == 0) & (F.col("activity_ts") > 0) & (F.col("activity_ts") < cutoff)
    df = df.filter(left if left_only else left | idle).withColumn("order_ts", F.when(F.col("left_at") > 0, F.col("left_at")).otherwise(F.col("activity_ts")))
    return df.orderBy("order_ts", "jid")


def extremes(messages: DataFrame) -> DataFrame:
    """Per chat its oldest and newest message by (ts, rowid)."""
    key, value = F.struct("ts", "rowid"), F.struct("msg_id", "ts")
    out = messages.groupBy("chat_jid").agg(F.min_by(value, key).alias("o"), F.max_by(value, key).alias("n"))
    return out.select("chat_jid", F.col("o.msg_id").alias("oldest_msg_id"), F.col("o.ts").alias("oldest_ts"), F.col("n.msg_id").alias("newest_msg_id"), F.col("n.ts").alias("newest_ts"))


def tags(contact_tags: DataFrame) -> DataFrame:
    """Per contact its distinct tags in order. Sets are merged map-side: a contact with many rows moves few."""
    return contact_tags.groupBy("jid").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def latest_votes(votes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last vote of each key by order, retractions (an empty choice) left out afterwards."""
    rest = [c for c in votes.columns if c not in key]
    last = votes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
    return last.select(*key, "v.*").filter("choice <> ''")


def tally(polls: DataFrame, latest: DataFrame, options: list[str]) -> DataFrame:
    """Votes for each option of each poll, 0 without any; what was chosen beside the options counts too."""
    counts = latest.groupBy("poll_msg_id", F.col("choice").alias("option")).agg(F.count("*").alias("votes"))
    offered = polls.select(F.col("msg_id").alias("poll_msg_id"), F.explode(F.array(*map(F.lit, options))).alias("option"))
    return offered.join(counts, ["poll_msg_id", "option"], "full_outer").withColumn("votes", F.coalesce("votes", F.lit(0)))


def unread_fold(events: DataFrame, *, key: str = "chat_jid", order: str = "seq", plus: str = "plus", sets: str = "sets", keeps: str = "keeps", width: int = 100_000) -> DataFrame:
    """Running unread count per key. plus marks an increment, sets an explicit value (null: none), keeps a mark-unread, which holds the count but makes it 1 at least.

    Within a stretch of order that begins with an explicit value, count = value + increments + the most that a mark had to
    lift. A bucket without one turns the count c it begins with into max(c + U, V), its increments and the level of its
    marks; such steps are combined bucket by bucket in a table of a row a bucket. No task sees a whole key, and nothing is
    folded in Python."""
    in_bucket = [key, BUCKET]
    rows = bucketed(events, order, width)
    seg = rows.withColumn("__s", F.count(F.col(sets)).over(Window.partitionBy(*in_bucket).orderBy(order)))
    v = Window.partitionBy(*in_bucket, "__s").orderBy(order)
    seg = seg.withColumns({"__base": F.first(F.col(sets), ignorenulls=True).over(v), "__up": F.sum(F.col(plus).cast("bigint")).over(v)})
    seg = seg.withColumn("__low", F.max(F.when(F.col(keeps), 1 - F.coalesce("__base", F.lit(0)) - F.col("__up"))).over(v))
    own = F.col("__base") + F.col("__up") + F.greatest(F.coalesce("__low", F.lit(0)), F.lit(0))
    ends = seg.groupBy(*in_bucket).agg(F.max_by(F.struct(own.alias("fixed"), F.col("__up").alias("u"), (F.col("__up") + F.col("__low")).alias("v")), order).alias("e")).select(*in_bucket, "e.*")
    buckets = Window.partitionBy(key).orderBy(BUCKET)
    ends = ends.withColumn("s", F.count("fixed").over(buckets))
    w = Window.partitionBy(key, "s").orderBy(BUCKET)
    free = F.col("fixed").isNull()
    ends = ends.withColumns({"base": F.coalesce(F.first("fixed", ignorenulls=True).over(w), F.lit(0)), "p": F.sum(F.when(free, F.col("u")).otherwise(0)).over(w)})
    ends = ends.withColumn("end", F.col("p") + F.greatest("base", F.max(F.when(free, F.col("v") - F.col("p"))).over(w)))
    carried = ends.select(*in_bucket, F.coalesce(F.lag("end").over(buckets), F.lit(0)).alias("__in"))
    count = F.coalesce(own, F.greatest(F.col("__in") + F.col("__up"), F.col("__up") + F.col("__low")))
    return seg.join(carried, in_bucket).withColumn("unread_count", count.cast("bigint")).select(*events.columns, "unread_count")


def sessions(events: DataFrame, gap: int, *, key: str = "chat_jid", ts: str = "ts", order: str = "seq") -> DataFrame:
    """Stretches of a key's events without a pause of more than gap seconds: session, start, stop, events."""
    before = preceding(events.select(key, ts, order), key, [ts, order], F.col(ts), "__before")
    numbered = running_count(before, key, [ts, order], F.coalesce(F.col(ts) - F.col("__before") > gap, F.lit(False)), "session")
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("stop_ts"), F.count("*").alias("events"))


def checkpoint_lag(ledger: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """How far each view is behind the head of the ledger."""
    head = ledger.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    return checkpoints.join(F.broadcast(head), F.lit(True)).withColumn("lag", F.col("head") - F.col("last_seq"))
