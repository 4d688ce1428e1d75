"""What happened as rows of the log: one canonical JSON and one deduplication key a kind of event.

Each function maps a table of facts to rows (event_id, source, event_type, chat_jid, msg_id, sender_jid, event_ts, dedup_key, raw, raw_hash, flags, refs):
the same fact from another path, or again, has the same key and bytes, and so one event. Field orders and names of the
canonical JSON are part of the log's format; absent fields are left out where the format says so. All built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import values as v

REFS = "array<struct<kind:string,target:string>>"
FROM_ME, FULL_SYNC = 1, 2
STATUS_CHAT = "status@broadcast"


def _some(c: Column) -> Column:
    """null where the format leaves the field out."""
    return F.when(c.cast("string").isin("", "0", "false"), None).otherwise(c)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def canonical(**fields: Column) -> Column:
    """Canonical JSON of the fields in their order, nulls left out."""
    return v.json_escaped(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))


def events(df: DataFrame, *, source: Column | str, event_type: Column | str, key: Column, raw: Column | None, chat: Column, msg_id: Column | None = None, sender: Column | None = None, ts: Column, refs: Column | None = None, flags: Column | None = None, key_of: Column | None = None) -> DataFrame:
    """Rows of the log. Without raw (scrubs keep no bytes) the hash is that of the key."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")
    made = df.select(
        lit(source).alias("source"), lit(event_type).alias("event_type"), chat.alias("chat_jid"), (msg_id if msg_id is not None else none).alias("msg_id"), (sender if sender is not None else none).alias("sender_jid"), ts.cast("bigint").alias("event_ts"),
        key.alias("dedup_key"), (raw if raw is not None else none).alias("raw"), (flags if flags is not None else F.lit(0)).cast("bigint").alias("flags"), (refs if refs is not None else F.array().cast(REFS)).alias("refs"), (key_of if key_of is not None else none).alias("message_key"),
    )
    hashed = made.withColumn("raw_hash", v.raw_hash(F.coalesce("raw", "dedup_key")))
    return hashed.withColumn("event_id", v.event_id(F.col("dedup_key"), F.col("raw_hash")))


def to_message(chat: Column, msg_id: Column, sender: Column, from_me: Column) -> Column:
    """A reference to a message by its key."""
    return F.struct(F.lit("message_key").alias("kind"), v.message_key(chat, from_me, msg_id, sender).alias("target"))


def messages(df: DataFrame) -> DataFrame:
    """Parsed messages (functions.messages) with raw, their envelope as text, ingest_source and from_full_sync."""
    c, in_group = F.col, F.col("chat_jid").endswith("@g.us")
    key = v.message_key(c("chat_jid"), c("from_me"), c("msg_id"), F.when(in_group & ~c("from_me"), c("sender_jid")))
    none = F.lit(None).cast("string")
    refs = F.array_compact(F.array(
        F.when(_text(c("reply_to_id")) != "", to_message(c("chat_jid"), c("reply_to_id"), c("reply_to_sender"), F.lit(False))),
        F.when((_text(c("reaction_to_id")) != "") & (c("reaction_to_id") != _text(c("reply_to_id"))), to_message(c("chat_jid"), c("reaction_to_id"), none, F.lit(False))),
    ))
    flags = F.when(c("from_me"), FROM_ME).otherwise(0) + F.when(_bool(c("from_full_sync")), FULL_SYNC).otherwise(0)
    kind = F.when(c("chat_jid") == STATUS_CHAT, "status_message").otherwise("message")
    return events(df, source=c("ingest_source"), event_type=kind, key=v.dedup_key("message", key), raw=c("raw"), chat=c("chat_jid"), msg_id=c("msg_id"), sender=c("sender_jid"), ts=c("ts"), refs=refs, flags=flags, key_of=key)


def receipts(df: DataFrame) -> DataFrame:
    """type, chat_jid, sender_jid, message_sender, message_ids, ts_ms. The order of ids doesn't matter."""
    c, ids = F.col, F.array_sort(F.coalesce("message_ids", F.array().cast("array<string>")))
    raw = canonical(type=c("type"), chat=c("chat_jid"), sender=_some(c("sender_jid")), message_sender=_some(c("message_sender")), message_ids=ids, timestamp_ms=c("ts_ms"))
    parts = F.concat(F.array(*[_text(x.cast("string")) for x in (c("type"), c("chat_jid"), c("sender_jid"), c("message_sender"), c("ts_ms"))]), ids)
    key = F.concat(F.lit("dd:"), canonical(scope=F.lit("receipt"), parts=parts))
    refs = F.transform("message_ids", lambda i: to_message(F.col("chat_jid"), i, F.col("message_sender"), F.lit(False)))
    return events(df, source="receipt", event_type="receipt", key=key, raw=raw, chat=c("chat_jid"), ts=F.floor(c("ts_ms") / 1000), refs=F.coalesce(refs, F.array().cast(REFS)))


# Kinds of state changes and which of their facts make up their key.
STATES = {
    "star": ("chat_jid", "sender_jid", "from_me", "msg_id", "ts_ms", "state"), "delete_for_me": ("chat_jid", "sender_jid", "from_me", "msg_id", "ts_ms", "delete_media"), "archive": ("chat_jid", "ts_ms", "state", "range"),
    "pin": ("chat_jid", "ts_ms", "state"), "mute": ("chat_jid", "ts_ms", "state", "end_ts_ms"), "mark_read": ("chat_jid", "ts_ms", "state"),
}


def state_json(df_type: Column) -> Column:
    """The canonical JSON of a state change, by its kind's own fields."""
    c = F.col
    own = lambda kinds, x: F.when(df_type.isin(*kinds), _some(x))
    on_message = ("star", "delete_for_me")
    return canonical(
        type=df_type, chat=_some(_text(c("chat_jid"))), sender=own(on_message, _text(c("sender_jid"))), from_me=own(on_message, _bool(c("from_me"))), msg_id=own(on_message, _text(c("msg_id"))), state=own([k for k in STATES if k != "delete_for_me"], _bool(c("state"))),
        end_ts_ms=own(("mute",), F.coalesce(c("end_ts_ms"), F.lit(0))), range=F.when(df_type == "archive", _bool(c("range")).cast("string")), delete_media=own(("delete_for_me",), _bool(c("delete_media"))), timestamp_ms=F.coalesce(c("ts_ms"), F.lit(0)),
    )


def state_changes(df: DataFrame) -> DataFrame:
    """type (one of STATES; rows of others are left out), chat_jid, sender_jid, from_me, msg_id, state, end_ts_ms, range (whether the change named a range), delete_media, ts_ms."""
    kind, df = F.col("type"), df.filter(F.col("type").isin(*STATES))
    # Booleans are written out; absent ones are false, absent numbers 0.
    flag = lambda n: n in ("from_me", "state", "range", "delete_media")
    part = lambda n: (_bool(F.col(n)) if flag(n) else F.coalesce(F.col(n), F.lit(0)) if n.endswith("_ms") else _text(F.col(n))).cast("string")
    key = F.coalesce(*[F.when(kind == k, v.dedup_key(k, *[part(n) for n in names])) for k, names in STATES.items()])
    on_message = kind.isin("star", "delete_for_me")
    refs = F.when(on_message, F.array(to_message(F.col("chat_jid"), F.col("msg_id"), F.col("sender_jid"), F.col("from_me")))).otherwise(F.array().cast(REFS))
    only = lambda n: F.when(on_message, F.col(n))
    return events(df, source="app_state", event_type=kind, key=key, raw=state_json(kind), chat=F.col("chat_jid"), msg_id=only("msg_id"), sender=only("sender_jid"), ts=F.floor(F.col("ts_ms") / 1000), refs=refs)


def unread_states(df: DataFrame) -> DataFrame:
    """chat_jid, count, marked_unread: what a history says of a chat. No time is part of it, so that the same state again is the same event."""
    c, count = F.col, F.coalesce(F.col("count"), F.lit(0))
    marked = _bool(c("marked_unread"))
    raw = canonical(type=F.when(count > 0, "unread_count").otherwise("mark_read"), chat=c("chat_jid"), state=F.when((count <= 0) & ~marked, True), count=F.when(count > 0, count), timestamp_ms=F.lit(0))
    return events(df, source="history", event_type="mark_read", key=v.dedup_key("unread", c("chat_jid"), count, marked.cast("string")), raw=raw, chat=c("chat_jid"), ts=F.lit(0))


# Types of snapshot events by table.
SNAPSHOT_TYPES = {
    "messages": "snapshot_messages", "chats": "snapshot_chats", "contacts": "snapshot_contacts", "groups": "snapshot_groups", "group_participants": "snapshot_roster", "starred": "snapshot_starred", "call_events": "snapshot_calls",
    "status_messages": "snapshot_status", "polls": "snapshot_polls", "poll_votes": "snapshot_poll_votes", "message_locations": "snapshot_locations", "message_payload_purges": "snapshot_purges",
}


_NAMES = ("phone", "push_name", "full_name", "first_name", "business_name")


def contacts(df: DataFrame) -> DataFrame:
    """jid, phone, push_name, full_name, first_name, business_name, ts: a contact as seen."""
    jid = v.tidy(F.col("jid"))
    raw = canonical(jid=jid, **{n: _some(_text(F.col(n))) for n in _NAMES})
    return events(df, source="live", event_type="contact", key=v.dedup_key("contact", jid, *[F.col(n) for n in _NAMES]), raw=raw, chat=jid, ts=F.col("ts"))


def system_names(df: DataFrame) -> DataFrame:
    """jid, system_name, ts: a name given in the phone book."""
    jid = v.tidy(F.col("jid"))
    return events(df, source="system_contacts", event_type="contact", key=v.dedup_key("system_name", jid, F.col("system_name")), raw=canonical(jid=jid, system_name=_some(_text(F.col("system_name")))), chat=jid, ts=F.col("ts"))


def system_names_cleared(df: DataFrame) -> DataFrame:
    """ts: all names of the phone book taken back."""
    ts = F.col("ts").cast("bigint")
    return events(df, source="system_contacts", event_type="clear_system_names", key=v.dedup_key("clear_system_names", ts), raw=canonical(type=F.lit("clear_system_names"), ts=ts), chat=F.lit(None).cast("string"), ts=ts)


def polls(df: DataFrame) -> DataFrame:
    """source, chat_jid, msg_id, sender_jid, question, options, selectable_count, created_ts."""
    c = F.col
    raw = canonical(chat_jid=c("chat_jid"), msg_id=c("msg_id"), sender_jid=_some(_text(c("sender_jid"))), question=_some(_text(c("question"))), options=F.coalesce("options", F.array().cast("array<string>")), selectable_count=_some(c("selectable_count")), created_ts=_some(c("created_ts")))
    return events(df, source=c("source"), event_type="poll", key=v.dedup_key("poll", c("chat_jid"), c("msg_id")), raw=raw, chat=c("chat_jid"), ts=c("created_ts"))


def _on_poll() -> Column:
    return F.array(to_message(F.col("chat_jid"), F.col("poll_msg_id"), F.lit(None).cast("string"), F.lit(False)))


def poll_options(df: DataFrame) -> DataFrame:
    """source, chat_jid, poll_msg_id, option, ts."""
    c = F.col
    return events(df, source=c("source"), event_type="poll_option", key=v.dedup_key("poll-option", c("chat_jid"), c("poll_msg_id"), c("option")), raw=canonical(chat_jid=c("chat_jid"), poll_msg_id=c("poll_msg_id"), option=_text(c("option"))), chat=c("chat_jid"), ts=c("ts"), refs=_on_poll())


def poll_votes(df: DataFrame) -> DataFrame:
    """source, chat_jid, poll_msg_id, voter_jid, vote_msg_id, selected, unknown_hashes, voted_ts_ms. A vote for nothing takes the vote back."""
    c, none = F.col, F.array().cast("array<string>")
    unknown = F.coalesce("unknown_hashes", none)
    gone = (F.size(F.coalesce("selected", none)) == 0) & (F.size(unknown) == 0)
    raw = canonical(
        chat_jid=c("chat_jid"), poll_msg_id=c("poll_msg_id"), voter_jid=c("voter_jid"), vote_msg_id=F.when(~gone, _some(_text(c("vote_msg_id")))), selected=F.coalesce("selected", none), unknown_hashes=F.when(F.size(unknown) > 0, unknown), voted_ts_ms=c("voted_ts_ms"),
        deleted=F.when(gone, True),
    )
    parts = (c("chat_jid"), c("poll_msg_id"), c("voter_jid"), c("voted_ts_ms"))
    key = F.when(gone, v.dedup_key("poll-vote-delete", *parts)).otherwise(v.dedup_key("poll-vote", *parts))
    return events(df, source=c("source"), event_type="poll_vote", key=key, raw=raw, chat=c("chat_jid"), ts=F.floor(c("voted_ts_ms") / 1000), refs=_on_poll())


def stars(df: DataFrame) -> DataFrame:
    """source, chat_jid, msg_id, sender_jid, from_me, starred, starred_ts."""
    c = F.col
    raw = canonical(chat_jid=c("chat_jid"), msg_id=c("msg_id"), sender_jid=_some(_text(c("sender_jid"))), from_me=_some(_bool(c("from_me"))), starred=_bool(c("starred")), starred_ts=_some(c("starred_ts")))
    return events(df, source=c("source"), event_type="star", key=v.dedup_key("star", c("chat_jid"), c("msg_id"), _bool(c("starred")).cast("string"), c("starred_ts")), raw=raw, chat=c("chat_jid"), ts=c("starred_ts"))


_CALL = ("chat_name", "sender_jid", "sender_name", "call_id", "msg_id", "event_type", "direction", "media", "outcome", "reason", "call_type", "duration_secs", "ts")


def calls(df: DataFrame) -> DataFrame:
    """source, chat_jid and the fields of a call (functions.calls) that df has, deleted (optional)."""
    have = {n: F.col(n) if n in df.columns else F.lit(0 if n in ("duration_secs", "ts") else "") for n in _CALL}
    gone = _bool(F.col("deleted")) if "deleted" in df.columns else F.lit(False)
    who = F.when(F.size("participants") > 0, F.transform("participants", lambda p: F.struct(p["jid"].alias("jid"), _some(_text(p["outcome"])).alias("outcome")))) if "participants" in df.columns else F.lit(None).cast("array<struct<jid:string,outcome:string>>")
    raw = canonical(chat_jid=F.col("chat_jid"), **{n: _some(F.coalesce(c, F.lit(0 if n in ("duration_secs", "ts") else ""))) for n, c in have.items()}, participants=who, deleted=_some(gone))
    ts = F.coalesce(have["ts"], F.lit(0))
    key = v.dedup_key("call-event", F.col("chat_jid"), have["call_id"], have["event_type"], ts, gone.cast("string"))
    return events(df, source=F.col("source"), event_type="call", key=key, raw=raw, chat=F.col("chat_jid"), ts=ts)


def groups(df: DataFrame) -> DataFrame:
    """source, jid, name, owner_jid, created_ts, is_parent, linked_parent_jid, left_at, participants: array<struct<user_jid,is_admin,is_super_admin>>, ts. The roster is sorted, so that its order doesn't matter."""
    c = F.col
    role = lambda p: F.when(_bool(p["is_super_admin"]), "superadmin").when(_bool(p["is_admin"]), "admin").otherwise("member")
    who = F.array_sort(F.transform("participants", lambda p: F.struct(p["user_jid"].alias("user_jid"), role(p).alias("role"))))
    raw = canonical(jid=c("jid"), name=_some(_text(c("name"))), owner_jid=_some(_text(c("owner_jid"))), created_ts=_some(c("created_ts")), is_parent=_some(_bool(c("is_parent"))), linked_parent_jid=F.when(~_bool(c("is_parent")), _some(_text(c("linked_parent_jid")))), left_at=_some(c("left_at")), participants=F.when(F.size(who) > 0, who))
    return events(df, source=c("source"), event_type="group", key=v.dedup_key("group", c("jid"), v.raw_hash(raw)), raw=raw, chat=c("jid"), ts=c("ts"))


def identities(df: DataFrame) -> DataFrame:
    """source, lid, pn, resolved_ts: one person's two ids. Pairs with a blank, or of the same id twice, say nothing and are left out."""
    lid, pn = v.tidy(F.col("lid")), v.tidy(F.col("pn"))
    some = df.filter((lid != "") & (pn != "") & (lid != pn))
    return events(some, source=F.col("source"), event_type="identity_resolution", key=v.dedup_key("identity", lid, pn), raw=canonical(lid=lid, pn=pn, resolved_ts=_some(F.col("resolved_ts"))), chat=lid, ts=F.col("resolved_ts"))


def scrubs(df: DataFrame) -> DataFrame:
    """chat_jid, msg_id, ts: payloads to erase. They keep no bytes. Rows with a blank are left out."""
    chat, msg = v.tidy(F.col("chat_jid")), v.tidy(F.col("msg_id"))
    return events(df.filter((chat != "") & (msg != "")), source="scrub", event_type="scrub", key=v.dedup_key("scrub", chat, msg), raw=None, chat=chat, msg_id=msg, ts=F.col("ts"))


def snapshots(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Rows of an old table as events, one each: the row as JSON, binary columns in base64. decode.snapshots reads them back."""
    plain = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    raw = F.to_json(F.struct(F.lit(table).alias("table"), F.struct(*plain).alias("row")))
    keys = v.dedup_key("snapshot", F.lit(table), *[F.col(c).cast("string") for c in key])
    of = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    return events(df, source="legacy_snapshot", event_type=SNAPSHOT_TYPES[table], key=keys, raw=raw, chat=F.coalesce(of("chat_jid"), of("group_jid"), of("jid")), msg_id=F.coalesce(of("msg_id"), of("poll_msg_id")), ts=F.lit(0))


def historical(known: DataFrame, messages: DataFrame, purges: DataFrame, ts: Column) -> DataFrame:
    """What to append for hidden ids (lid) whose phone ids (pn) are known: an identity event each, and a scrub for each message under
    such an id that has been purged but still has local media. Both have keys of their own, so that a second pass adds nothing."""
    ids = identities(known.select(F.lit("identity_resolution").alias("source"), "lid", "pn", ts.cast("bigint").alias("resolved_ts")))
    kept = messages.filter(F.coalesce("local_path", F.lit("")) != "").join(known.select(F.col("lid").alias("chat_jid")).distinct(), "chat_jid", "left_semi")
    return all_of(ids, scrubs(kept.join(purges.select("chat_jid", "msg_id").distinct(), ["chat_jid", "msg_id"], "left_semi").select("chat_jid", "msg_id", ts.alias("ts"))))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
