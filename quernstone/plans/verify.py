"""Invariants of the archive: each check a DataFrame of violations (check, key, seq, event_id, detail), all in one union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.joins import missing
from quernstone.plans.ledger import strong_components

# The codes of the checks.
CHECKS = (
    "message_without_chat", "fts_missing_row", "fts_extra_row", "participant_without_group", "checkpoint_ahead_of_head", "checkpoint_lag", "checkpoint_frontier_fork",
    "raw_hash_mismatch", "dangling_causal_ref", "causal_cycle", "scrub_with_raw", "event_without_raw_or_scrub", "unread_inconsistent",
)


def violation(df: DataFrame, check: str, key: Column, *, seq: Column | None = None, event_id: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(check).alias("check"), key.cast("string").alias("key"), (seq if seq is not None else none).cast("bigint").alias("seq"),
        (event_id if event_id is not None else none).cast("string").alias("event_id"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"),
    )


def check_messages(messages: DataFrame, chats: DataFrame) -> DataFrame:
    lost = missing(messages, chats, [("chat_jid", "jid")])
    return violation(lost, "message_without_chat", F.concat_ws("/", "chat_jid", "msg_id"))


def check_index(messages: DataFrame, indexed: DataFrame) -> list[DataFrame]:
    """Live messages without a row (rowid) in the index, and rows of the index without a live message."""
    live = messages.filter(F.col("deleted_at").isNull()).select("rowid")
    key = F.concat(F.lit("rowid:"), "rowid")
    return [violation(live.join(indexed, "rowid", "left_anti"), "fts_missing_row", key), violation(indexed.select("rowid").join(live, "rowid", "left_anti"), "fts_extra_row", key)]


def check_roster(roster: DataFrame, groups: DataFrame) -> DataFrame:
    return violation(missing(roster, groups, [("group_jid", "jid")]), "participant_without_group", F.concat_ws("/", "group_jid", "user_jid"))


def check_checkpoints(checkpoints: DataFrame, ledger: DataFrame, views: list[str]) -> list[DataFrame]:
    """Views in use: none beyond the head, none behind it, none apart from the first by name."""
    used = checkpoints.filter(F.col("view").isin(views))
    head = ledger.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"))
    first = used.agg(F.min_by("last_seq", "view").alias("first"))
    at = used.join(F.broadcast(head), F.lit(True)).join(F.broadcast(first), F.lit(True))  # one row each
    out = []
    for check, cond, other in (("checkpoint_ahead_of_head", "last_seq > head", "head"), ("checkpoint_lag", "last_seq < head", "head"), ("checkpoint_frontier_fork", "last_seq <> first", "first")):
        out.append(violation(at.filter(cond), check, F.col("view"), seq=F.col("last_seq"), detail=F.concat_ws("/", "last_seq", other)))
    return out


def check_raw(ledger: DataFrame, raw: DataFrame) -> list[DataFrame]:
    """Bytes that don't have their hash; scrubs that keep bytes; other events without bytes, unless they are snapshots, which never had any."""
    both = ledger.join(raw.select("event_id", "raw_bytes"), "event_id", "left")
    tests = {
        "raw_hash_mismatch": F.sha2("raw_bytes", 256) != F.col("raw_hash"), "scrub_with_raw": F.col("raw_bytes").isNotNull() & (F.col("event_type") == "scrub"),
        "event_without_raw_or_scrub": F.col("raw_bytes").isNull() & (F.col("event_type") != "scrub") & (F.col("source") != "legacy_snapshot"),
    }
    return [violation(both.filter(t), check, F.lit(""), seq=F.col("seq"), event_id=F.col("event_id")) for check, t in tests.items()]


def check_links(links: DataFrame, ledger: DataFrame) -> list[DataFrame]:
    """Links (event_id, ref_index, target_id) whose target is not in the log; and links that make cycles, one row a strong component."""
    lost = links.join(ledger.select(F.col("event_id").alias("target_id")), "target_id", "left_anti")
    knots = strong_components(links.select(F.col("event_id").alias("a"), F.col("target_id").alias("b"))).groupBy("component").agg(F.min("node").alias("node"), F.count("*").alias("n"))
    return [
        violation(lost, "dangling_causal_ref", F.concat_ws("#", "event_id", "ref_index"), event_id=F.col("event_id"), detail=F.col("target_id")),
        violation(knots, "causal_cycle", F.col("node"), event_id=F.col("node"), detail=F.col("n")),
    ]


def check_unread(chats: DataFrame) -> DataFrame:
    """A count without the marker, or a negative count. The marker alone is sound: a chat can be marked as unread."""
    return violation(chats.filter((F.col("unread_count") < 0) | (~F.col("unread") & (F.col("unread_count") > 0))), "unread_inconsistent", F.col("jid"), detail=F.col("unread_count"))


def verify(*, messages: DataFrame, chats: DataFrame, groups: DataFrame, roster: DataFrame, indexed: DataFrame, ledger: DataFrame, raw: DataFrame, links: DataFrame, checkpoints: DataFrame, views: list[str]) -> DataFrame:
    """Every violation of every check; empty for a sound archive."""
    parts = [
        check_messages(messages, chats), *check_index(messages, indexed), check_roster(roster, groups), *check_checkpoints(checkpoints, ledger, views),
        *check_raw(ledger, raw), *check_links(links, ledger), check_unread(chats),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit(ledger: DataFrame, raw: DataFrame) -> DataFrame:
    """Issues of single events: (issue, seq, event_id). Stacked from one scan joined once with the raw bytes."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    both = ledger.join(raw.select("event_id", "raw_bytes"), "event_id", "left")
    h = F.coalesce("raw_hash", F.lit(""))
    tests = {
        "missing_event_id": blank("event_id"), "missing_source": blank("source"), "missing_event_type": blank("event_type"), "missing_dedup_key": blank("dedup_key"), "hash_length": F.length(h) != 64,
        "hash_not_hex": (F.length(h) == 64) & ~h.rlike("^[0-9a-fA-F]*$"), "hash_mismatch": F.col("raw_bytes").isNotNull() & h.rlike("^[0-9a-fA-F]{64}$") & (F.sha2("raw_bytes", 256) != F.lower(h)), "raw_missing": F.col("raw_bytes").isNull(),
    }
    issues = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))
    return both.select(F.explode(issues).alias("issue"), "seq", "event_id")


def attributed_diff(diff: DataFrame, ledger: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a diff with the event they come from: that of the row's snapshot key, else the latest of its message."""
    snap = ledger.filter(F.col("dedup_key").isNotNull()).groupBy("dedup_key").agg(F.max_by("event_id", "seq").alias("by_key"))
    out = diff.withColumn("dedup_key", F.concat_ws(":", "table", *key)).join(snap, "dedup_key", "left")
    if {"chat_jid", "msg_id"} <= set(key):
        last = ledger.filter(F.col("msg_id").isNotNull()).groupBy("chat_jid", "msg_id").agg(F.max_by("event_id", "seq").alias("by_message"))
        out = out.join(last, ["chat_jid", "msg_id"], "left")
        return out.withColumn("event_id", F.coalesce("by_key", "by_message")).drop("by_key", "by_message", "dedup_key")
    return out.withColumnRenamed("by_key", "event_id").drop("dedup_key")
