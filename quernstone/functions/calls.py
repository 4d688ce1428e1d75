"""Calls: events as they happen, records of the call log, and their deletions, read into rows of one shape.

Rows: chat_jid, sender_jid, call_id, event_type, direction, media, outcome, reason, call_type, duration_secs, ts (seconds, null if unknown),
participants. All built-in expressions over one row at a time; absent texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.values import bare_jid, enum_word, epoch_of_any_unit

# Kinds of call events and the names they are stored under.
KINDS = {
    "CallOffer": "offer", "CallAccept": "accept", "CallPreAccept": "pre_accept", "CallTransport": "transport", "CallOfferNotice": "offer_notice", "CallRelayLatency": "relay_latency",
    "CallTerminate": "terminate", "CallReject": "reject",
}
#: Kinds that come from the other side if nobody is named.
INCOMING = ("offer", "offer_notice", "relay_latency")
RECORD = (
    "struct<callResult:string,isDndMode:boolean,silenceReason:string,duration:bigint,startTime:bigint,isIncoming:boolean,isVideo:boolean,callCreatorJID:string,groupJID:string,"
    "participants:array<struct<userJID:string,callResult:string>>,callID:string,callType:string>"
)
_NOBODY = "array<struct<jid:string,outcome:string>>"


def _trim(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r"))


def node_media(node: Column) -> Column:
    """audio or video by a call's node (JSON with tag, attrs, content): its own attributes first, then tags and attributes within it in their order; empty if neither is named."""
    own = [enum_word(F.get_json_object(node, f"$.attrs['{k}']")) for k in ("media", "type", "call-creator-media")]
    within = F.lower(F.regexp_extract(F.coalesce(F.get_json_object(node, "$.content"), F.lit("")), r'(?i)"(?:tag|media|type|call-creator-media)"\s*:\s*"\s*(audio|video)\s*"', 1))
    return F.coalesce(*[F.when(c.isin("audio", "video"), c) for c in own], within)


def live_events(df: DataFrame) -> DataFrame:
    """Events as they happen: kind, from_jid, group_jid, creator_jid, call_id, reason, media, call_type, node (JSON), ts, self_jid. Rows of other kinds are left out."""
    event = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("kind")]
    notice = event == "offer_notice"
    creator, me = F.nullif(_trim(F.col("creator_jid")), F.lit("")), F.nullif(_trim(F.col("self_jid")), F.lit(""))
    direction = F.when(creator.isNotNull() & me.isNotNull(), F.when(bare_jid(creator) == bare_jid(me), "outbound").otherwise("inbound")).when(event.isin(*INCOMING), "inbound").otherwise("unknown")
    return df.filter(event.isNotNull()).select(
        F.coalesce(F.nullif(F.col("group_jid"), F.lit("")), F.col("from_jid")).alias("chat_jid"), F.coalesce(creator, F.col("from_jid")).alias("sender_jid"), _trim(F.col("call_id")).alias("call_id"), event.alias("event_type"), direction.alias("direction"),
        F.coalesce(F.when(notice, enum_word(F.col("media"))).otherwise(node_media(F.col("node"))), F.lit("")).alias("media"), F.lit("").alias("outcome"), F.when(event == "terminate", F.coalesce(enum_word(F.col("reason")), F.lit(""))).otherwise("").alias("reason"),
        F.when(notice, F.coalesce(enum_word(F.col("call_type")), F.lit(""))).otherwise("").alias("call_type"), F.lit(0).cast("bigint").alias("duration_secs"), "ts", F.array().cast(_NOBODY).alias("participants"),
    )


def outcome_word(result: Column) -> Column:
    word = F.coalesce(enum_word(result), F.lit(""))
    return F.when(word == "acceptedelsewhere", "accepted_elsewhere").otherwise(word)


def records(df: DataFrame) -> DataFrame:
    """Records of the call log: record (JSON), self_jids (one's own ids), ts_ms (when the record came, for records without a time).

    The chat is the group; else whoever began the call, unless it was oneself; else the first other participant; else oneself. Records that name nobody are left out."""
    r = F.col("r")
    own = F.transform(F.coalesce("self_jids", F.array().cast("array<string>")), bare_jid)
    is_self = lambda j: F.array_contains(own, bare_jid(j))
    rows = df.select("self_jids", "ts_ms", F.from_json("record", RECORD).alias("r"))
    creator, group = F.nullif(_trim(r["callCreatorJID"]), F.lit("")), F.nullif(_trim(r["groupJID"]), F.lit(""))
    who = F.filter(F.coalesce(r["participants"], F.array().cast("array<struct<userJID:string,callResult:string>>")), lambda p: _trim(p["userJID"]) != "")
    first, other = F.get(who, F.lit(0))["userJID"], F.get(F.filter(who, lambda p: ~is_self(p["userJID"])), F.lit(0))["userJID"]
    in_group = F.coalesce(group.endswith("@g.us"), F.lit(False))
    chat = F.when(in_group, group).otherwise(F.coalesce(F.when(~is_self(creator), creator), other, creator, first))
    sender = F.coalesce(creator, F.when(~in_group & other.isNull(), first), F.lit(""))
    reason = F.coalesce(enum_word(r["silenceReason"]), F.lit(""))
    ts = F.coalesce(epoch_of_any_unit(r["startTime"]) / 1_000_000, F.when(F.col("ts_ms") > 0, F.col("ts_ms") / 1000))
    return rows.select(
        chat.alias("chat_jid"), sender.alias("sender_jid"), _trim(r["callID"]).alias("call_id"), F.lit("call_log").alias("event_type"), F.when(r["isIncoming"], "inbound").otherwise("outbound").alias("direction"), F.when(r["isVideo"], "video").otherwise("audio").alias("media"),
        outcome_word(r["callResult"]).alias("outcome"), F.when((reason != "") & (reason != "none"), reason).when(r["isDndMode"], "dnd").otherwise("").alias("reason"), F.coalesce(enum_word(r["callType"]), F.lit("")).alias("call_type"), F.coalesce(r["duration"], F.lit(0)).alias("duration_secs"),
        F.floor(ts).cast("bigint").alias("ts"), F.transform(who, lambda p: F.struct(_trim(p["userJID"]).alias("jid"), outcome_word(p["callResult"]).alias("outcome"))).alias("participants"),
    ).filter("chat_jid IS NOT NULL")


def deletions(df: DataFrame) -> DataFrame:
    """Deletions from the call log: peer_jid, is_incoming, to chat_jid and direction. Those that name nobody are left out."""
    peer = _trim(F.col("peer_jid"))
    return df.filter(peer != "").select(peer.alias("chat_jid"), F.when(F.col("is_incoming"), "inbound").otherwise("outbound").alias("direction"))
