"""Events of the log as they are written, read into typed arrivals for the views.

The log's rows are those of ``ingest``: seq, source, event_type, chat_jid, msg_id, sender_jid, event_ts, raw, flags, and perhaps more, which
no decoder looks at. What an event says stands in its raw bytes: an envelope, or canonical JSON, by its type and source. Each function
reads the types of one table and gives the columns that the table's fold takes, with seq, the arrival's number. Snapshot events hold a whole row
of an old table; ``rebased`` puts them in place of all that came before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import messages as envelopes
from quernstone.functions import values as v
from quernstone.operators.joins import latest
from quernstone.plans.ingest import FROM_ME, STATUS_CHAT
from quernstone.plans.ingest import SNAPSHOT_TYPES as SNAPSHOTS
from quernstone.sources.catalog import schema

# Canonical JSON by what it is about; what a receipt of one's own reading and the parts of a state are called.
STATE = "type string, chat string, sender string, from_me boolean, msg_id string, state boolean, end_ts_ms bigint, count bigint, timestamp_ms bigint"
CONTACT = "jid string, phone string, push_name string, full_name string, first_name string, business_name string, system_name string"
GROUP = "jid string, name string, owner_jid string, created_ts bigint, is_parent boolean, linked_parent_jid string, left_at bigint, participants array<struct<user_jid:string,role:string>>"
POLL = "chat_jid string, msg_id string, sender_jid string, question string, options array<string>, selectable_count int, created_ts bigint"
OPTION = "chat_jid string, poll_msg_id string, option string"
VOTE = "chat_jid string, poll_msg_id string, voter_jid string, vote_msg_id string, selected array<string>, unknown_hashes array<string>, voted_ts_ms bigint, deleted boolean"
STAR = "chat_jid string, chat string, msg_id string, sender_jid string, sender string, from_me boolean, starred boolean, state boolean, starred_ts bigint, timestamp_ms bigint"
CALL = "chat_jid string, chat_name string, sender_jid string, sender_name string, call_id string, msg_id string, event_type string, direction string, media string, outcome string, reason string, call_type string, duration_secs bigint, ts bigint, participants array<struct<jid:string,outcome:string>>, deleted boolean"
READ_SELF, UNREAD_COUNT, CALL_LOG = "read-self", "unread_count", "call_log"
LEGACY = "legacy_snapshot"


def written(events: DataFrame) -> bool:
    """Whether the events are rows of the log, with raw bytes."""
    return "raw" in events.columns


def read(events: DataFrame, *types: str, ddl: str | None = None) -> DataFrame:
    """Events of the types, in the log's own columns, with p, what they say. Snapshots are left out."""
    df = events.filter(F.col("event_type").isin(*types) & ~F.coalesce(F.col("source") == LEGACY, F.lit(False)))
    flags = F.coalesce(F.col("flags"), F.lit(0)) if "flags" in events.columns else F.lit(0)
    columns = ["seq", "source", "event_type", "chat_jid", "msg_id", "sender_jid", "event_ts"]
    return df.select(*columns, (flags.bitwiseAND(F.lit(FROM_ME)) > 0).alias("from_me"), *([F.from_json(F.col("raw").cast("string"), ddl).alias("p")] if ddl else [F.col("raw")]))


def _either(own: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), other)


def snapshots(events: DataFrame, table: str) -> DataFrame:
    """Rows of an old table, in its columns, with the seq of the event that holds each. Binary columns are in base64; flags may be 0 and 1."""
    fields = schema(table).fields
    kind = lambda f: "string" if f.dataType.simpleString() in ("binary", "boolean") else f.dataType.simpleString()
    ddl = f"table string, row struct<{','.join(f'{f.name}:{kind(f)}' for f in fields)}>"
    text = F.coalesce(*[F.col(c).cast("string") for c in ("snapshot", "raw", "payload") if c in events.columns])
    rows = events.filter((F.col("source") == LEGACY) & F.col("event_type").isin(SNAPSHOTS[table], f"snapshot_{table}")).select("seq", F.from_json(text, ddl).alias("p")).filter(F.col("p.table") == table)

    def value(f) -> Column:
        c = F.col(f"p.row.{f.name}")
        return (F.unbase64(c) if kind(f) != f.dataType.simpleString() and f.dataType.simpleString() == "binary" else c.cast(f.dataType)).alias(f.name)

    return rows.select("seq", *[value(f) for f in fields])


def rebased(arrivals: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """arrivals with the last snapshot (old, with seq) of each key as its first one; what came before it is replaced by it."""
    since = old.groupBy(*key).agg(F.max("seq").alias("__since"))
    kept = arrivals.join(since, key, "left").filter(F.col("__since").isNull() | (F.col("seq") > F.col("__since"))).select(*arrivals.columns)
    return kept.unionByName(latest(old, key, ["seq"]).select(*[c for c in old.columns if c in arrivals.columns]), allowMissingColumns=True)


# Messages


def _parsed(events: DataFrame, kind: str) -> DataFrame:
    """Messages with the contents of their envelopes; chat, id, sender and time are those of the event."""
    own = {"__chat": "chat_jid", "__msg": "msg_id", "__sender": "sender_jid", "__mine": "from_me", "__ts": "event_ts"}
    rows = read(events, kind).withColumns({k: F.col(c) for k, c in own.items()}).withColumn("__push", F.when(F.col("source").isin("history", "on_demand_history"), F.get_json_object(F.col("raw").cast("string"), "$.pushName")))
    return envelopes.decoded(rows, keep=("seq", "__push", *own)).filter("error IS NULL")


def messages(events: DataFrame) -> DataFrame:
    """Arrivals of messages: each delivery, edit and revocation, and each deletion for oneself. Names are those that the event itself has; ``views.named`` looks up others."""
    p, c = _parsed(events, "message"), F.col
    media = lambda name: F.col(f"media.{name}")
    base = v.base_text(c("text"), F.coalesce(media("type"), F.lit("")))
    push = F.when(~F.trim("__push").isin("", "-"), F.trim("__push"))
    said = p.select(
        "seq", c("__chat").alias("chat_jid"), c("__msg").alias("msg_id"), c("__sender").alias("sender_jid"), F.when(c("__mine"), "me").otherwise(push).alias("sender_name"), c("__ts").alias("ts"), c("__mine").alias("from_me"), "text",
        F.when(c("revoked"), v.REVOKED).otherwise(v.display_text(base, c("reaction_to_id"), c("reaction_emoji"), F.lit(None).cast("string"), c("reply_to_id"), c("reply_to_display"))).alias("display_text"),
        c("reply_to_id").alias("quoted_msg_id"), c("reply_to_sender").alias("quoted_sender_jid"), "is_forwarded", c("forwarding_score").cast("int").alias("forwarding_score"), "reaction_to_id", "reaction_emoji",
        media("type").alias("media_type"), media("caption").alias("media_caption"), *[media(n).alias(n) for n in ("filename", "mime_type", "direct_path")], *[F.unbase64(media(n)).alias(n) for n in ("media_key", "file_sha256", "file_enc_sha256")], media("file_length").alias("file_length"),
        "revoked", F.lit(False).alias("deleted_for_me"), F.when(c("revoked"), c("__ts")).alias("deleted_at"), F.when(c("revoked"), "revoke").alias("deletion_reason"), "edited", F.when(c("edited"), c("__ts")).otherwise(0).cast("bigint").alias("edited_ts"),
        F.when(F.size("buttons") > 0, c("buttons")).alias("buttons"),
    )
    s = read(events, "delete_for_me", ddl=STATE)
    at = F.coalesce(F.when(c("p.timestamp_ms") > 0, F.floor(c("p.timestamp_ms") / 1000)), c("event_ts"))
    gone = s.select(
        "seq", _either(c("p.chat"), c("chat_jid")).alias("chat_jid"), F.coalesce("msg_id", "p.msg_id").alias("msg_id"), c("p.sender").alias("sender_jid"), at.alias("ts"), F.coalesce("p.from_me", F.lit(False)).alias("from_me"), F.lit(v.DELETED_FOR_ME).alias("display_text"),
        F.lit(False).alias("revoked"), F.lit(True).alias("deleted_for_me"), at.alias("deleted_at"), F.lit("delete-for-me").alias("deletion_reason"), F.lit(False).alias("edited"), F.lit(0).cast("bigint").alias("edited_ts"),
    )
    every = said.unionByName(gone, allowMissingColumns=True)
    have = {f.name: f.dataType for f in schema("messages").fields}
    more = [F.lit(None).cast(have[n]).alias(n) for n in ("rowid", "chat_name", "local_path", "downloaded_at", "media_unavailable_at")]
    return rebased(every.select("*", *more), snapshots(events, "messages"), ["chat_jid", "msg_id"])


def purges(events: DataFrame) -> DataFrame:
    """(chat_jid, msg_id, purged_at) of scrubs and of purges that snapshots tell of."""
    return read(events, "scrub").select("chat_jid", "msg_id", F.col("event_ts").alias("purged_at")).unionByName(snapshots(events, "message_payload_purges").select("chat_jid", "msg_id", "purged_at"))


def locations(events: DataFrame) -> DataFrame:
    found = _parsed(events, "message").filter("location IS NOT NULL").select(F.col("__chat").alias("chat_jid"), F.col("__msg").alias("msg_id"), "location.*", "seq")
    return rebased(found, snapshots(events, "message_locations"), ["chat_jid", "msg_id"])


def status(events: DataFrame) -> DataFrame:
    return _parsed(events, "status_message").select(F.col("__msg").alias("msg_id"), F.col("__sender").alias("sender_jid"), F.col("__ts").alias("ts"), "text", "seq")


# Chats


def chats(events: DataFrame) -> DataFrame:
    """Arrivals of chats: what messages, calls and state changes say of theirs. (chat_jid, name, ts, archived, pinned, muted_until, seq); null says nothing."""
    c = F.col
    no = {n: F.lit(None).cast(t).alias(n) for n, t in {"name": "string", "ts": "bigint", "archived": "boolean", "pinned": "boolean", "muted_until": "bigint"}.items()}

    def arrivals(df: DataFrame, chat: Column, **given: Column) -> DataFrame:
        return df.select(chat.alias("chat_jid"), *[given[n].alias(n) if n in given else x for n, x in no.items()], "seq")

    said = arrivals(read(events, "message").filter(c("chat_jid") != STATUS_CHAT), c("chat_jid"), ts=c("event_ts"))
    called = arrivals(read(events, "call", ddl=CALL).filter(~F.coalesce("p.deleted", F.lit(False))), c("chat_jid"), name=F.nullif(F.trim("p.chat_name"), F.lit("")), ts=c("p.ts"))
    state, kind = read(events, "archive", "pin", "mute", "mark_read", ddl=STATE), c("event_type")
    on = F.coalesce("p.state", F.lit(False))
    changed = arrivals(state, _either(c("p.chat"), c("chat_jid")), archived=F.when(kind == "archive", on), pinned=F.when(kind == "pin", on), muted_until=F.when(kind == "mute", F.coalesce("p.end_ts_ms", F.lit(0))))
    cleared = arrivals(_own_receipts(events), _either(c("p.chat"), c("chat_jid")))
    old = snapshots(events, "chats").withColumnsRenamed({"jid": "chat_jid", "last_message_ts": "ts"})
    full = {n: F.coalesce(c(n), F.lit(False)) for n in ("archived", "pinned")} | {"muted_until": F.coalesce("muted_until", F.lit(0))}
    return rebased(said.unionByName(called).unionByName(changed).unionByName(cleared), old.withColumns(full), ["chat_jid"])


def _own_receipts(events: DataFrame) -> DataFrame:
    return read(events, "receipt", ddl="type string, chat string").filter(F.col("p.type") == READ_SELF)


def unread(events: DataFrame) -> DataFrame:
    """(chat_jid, seq, plus, sets, keeps) for the unread fold: the first delivery of a message counts if it is live and not one's own; a count or a reading
    sets the number, by a state change, by one's own receipt of another device or by a snapshot; marking as unread keeps it."""
    c, none, no = F.col, F.lit(None).cast("bigint"), F.lit(False)
    said = read(events, "message").filter(c("chat_jid") != STATUS_CHAT).groupBy("chat_jid", "msg_id").agg(F.min("seq").alias("seq"), F.min_by(F.coalesce((c("source") == "live") & ~c("from_me"), no), "seq").alias("plus"))
    marks = read(events, "mark_read", ddl=STATE)
    counted, seen = c("p.type") == UNREAD_COUNT, F.coalesce("p.state", no)
    marked = marks.select(_either(c("p.chat"), c("chat_jid")).alias("chat_jid"), "seq", no.alias("plus"), F.when(counted, F.greatest(F.coalesce("p.count", F.lit(0)), F.lit(0))).when(seen, 0).cast("bigint").alias("sets"), (~counted & ~seen).alias("keeps"))
    cleared = _own_receipts(events).select(_either(c("p.chat"), c("chat_jid")).alias("chat_jid"), "seq", no.alias("plus"), F.lit(0).cast("bigint").alias("sets"), no.alias("keeps"))
    old = snapshots(events, "chats").select(c("jid").alias("chat_jid"), "seq", no.alias("plus"), F.when(c("unread"), F.greatest(F.coalesce("unread_count", F.lit(0)), F.lit(1))).otherwise(0).cast("bigint").alias("sets"), no.alias("keeps"))
    return said.select("chat_jid", "seq", "plus", none.alias("sets"), no.alias("keeps")).unionByName(marked).unionByName(cleared).unionByName(old)


# People and groups


def contacts(events: DataFrame) -> DataFrame:
    """(jid, names, updated_at, seq)."""
    made = read(events, "contact", ddl=CONTACT).select("p.*", F.col("event_ts").alias("updated_at"), "seq").withColumn("jid", v.tidy(F.col("jid")))
    return rebased(made, snapshots(events, "contacts"), ["jid"])


def names_cleared(events: DataFrame) -> DataFrame:
    return read(events, "clear_system_names").select("seq")


def groups(events: DataFrame) -> DataFrame:
    """(jid, facts, updated_at, left, seq). An event that names a time of leaving and no members says only that."""
    made = read(events, "group", ddl=GROUP).select("p.*", F.col("event_ts").alias("updated_at"), "seq")
    members = F.coalesce(F.size("participants"), F.lit(0)) > 0
    left = F.coalesce(F.col("left_at") > 0, F.lit(False)) & ~members
    made = made.withColumn("left", left).withColumns({"left_at": F.when(F.col("left"), F.col("left_at")), "jid": F.trim("jid")})
    old = snapshots(events, "groups").withColumns({"participants": F.lit(None).cast("array<struct<user_jid:string,role:string>>"), "left": F.lit(False)})
    return rebased(made, old, ["jid"])


def rosters(events: DataFrame) -> DataFrame:
    """(group_jid, participants, seq): whole rosters; the rows of a snapshot are one."""
    none = F.array().cast("array<struct<user_jid:string,role:string>>")
    made = read(events, "group", ddl=GROUP).select(F.trim("p.jid").alias("group_jid"), F.coalesce("p.participants", none).alias("participants"), F.col("p.left_at").alias("left_at"), "seq")
    told = made.filter(~(F.coalesce(F.col("left_at") > 0, F.lit(False)) & (F.size("participants") == 0))).drop("left_at")
    old = snapshots(events, "group_participants").groupBy("group_jid").agg(F.collect_list(F.struct("user_jid", "role")).alias("participants"), F.max("seq").alias("seq"))
    return told.unionByName(old)


# Polls, stars, calls, identities


def polls(events: DataFrame) -> DataFrame:
    """(chat_jid, msg_id, sender_jid, question, options, selectable_count, created_ts, seq)."""
    made = read(events, "poll", ddl=POLL).select("chat_jid", "p.msg_id", "p.sender_jid", "p.question", "p.options", F.coalesce("p.selectable_count", F.lit(0)).alias("selectable_count"), "p.created_ts", "seq")
    return rebased(made, snapshots(events, "polls"), ["chat_jid", "msg_id"])


def poll_options(events: DataFrame) -> DataFrame:
    """(chat_jid, msg_id, options, seq): options added to a poll."""
    return read(events, "poll_option", ddl=OPTION).select("chat_jid", F.col("p.poll_msg_id").alias("msg_id"), F.array("p.option").alias("options"), "seq")


def votes(events: DataFrame) -> DataFrame:
    """(chat_jid, poll_msg_id, voter_jid, vote_msg_id, selected, unknown_hashes, ts in milliseconds, retracted, seq)."""
    none = F.array().cast("array<string>")
    made = read(events, "poll_vote", ddl=VOTE).select(
        "chat_jid", "p.poll_msg_id", "p.voter_jid", "p.vote_msg_id", F.coalesce("p.selected", none).alias("selected"), F.coalesce("p.unknown_hashes", none).alias("unknown_hashes"),
        F.coalesce("p.voted_ts_ms", F.col("event_ts") * 1000).alias("ts"), F.coalesce("p.deleted", F.lit(False)).alias("retracted"), "seq",
    )
    return rebased(made, snapshots(events, "poll_votes").withColumn("retracted", F.lit(False)), ["chat_jid", "poll_msg_id", "voter_jid"])


def stars(events: DataFrame) -> DataFrame:
    """(chat_jid, msg_id, sender_jid, from_me, starred, starred_at, seq), of stars and of state changes."""
    c = F.col
    made = read(events, "star", ddl=STAR).select(
        "chat_jid", F.coalesce("p.msg_id", "msg_id").alias("msg_id"), F.coalesce("p.sender_jid", "p.sender").alias("sender_jid"), F.coalesce("p.from_me", F.lit(False)).alias("from_me"), F.coalesce("p.starred", "p.state", F.lit(False)).alias("starred"),
        F.coalesce("p.starred_ts", F.floor(c("p.timestamp_ms") / 1000), c("event_ts")).alias("starred_at"), "seq",
    )
    return rebased(made, snapshots(events, "starred").withColumn("starred", F.lit(True)), ["chat_jid", "msg_id"])


def calls(events: DataFrame) -> DataFrame:
    """Arrivals of calls in the table's columns, with seq. A deletion takes away the log entries of its chat, of its direction if it names one, that came before it."""
    c, rows = F.col, read(events, "call", ddl=CALL)
    gone = F.coalesce("p.deleted", F.lit(False))
    fields = ["chat_name", "sender_jid", "sender_name", "call_id", "msg_id", "event_type", "direction", "media", "outcome", "reason", "call_type", "duration_secs", "ts", "participants"]
    made = rows.filter(~gone).select("chat_jid", *[c(f"p.{n}").alias(n) for n in fields], "seq")
    made = made.unionByName(snapshots(events, "call_events").drop("rowid"))
    way = F.coalesce(F.trim("p.direction"), F.lit(""))
    ends = rows.filter(gone).groupBy("chat_jid").agg(F.max(F.when(way == "", c("seq"))).alias("__all"), F.max(F.when(way == "inbound", c("seq"))).alias("__in"), F.max(F.when(way == "outbound", c("seq"))).alias("__out"))
    end = F.greatest("__all", F.when(c("direction") == "inbound", c("__in")).when(c("direction") == "outbound", c("__out")))
    joined = made.join(ends, "chat_jid", "left")
    return joined.filter((F.coalesce("event_type", F.lit("")) != CALL_LOG) | (c("seq") > F.coalesce(end, F.lit(-1)))).select(*made.columns)


def identities(events: DataFrame) -> DataFrame:
    return read(events, "identity_resolution", ddl="lid string, pn string").select("p.lid", "p.pn", "seq")
