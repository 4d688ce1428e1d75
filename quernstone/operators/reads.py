"""Lists, filters, lookups and neighbours over the archive's tables.

Every limit stands behind a total order; a limit of 0 or less is none. ``now`` is always given by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.values import contains_any, is_muted, is_unmuted
from quernstone.operators.hot import following, running_count

MESSAGE_KEY = ["chat_jid", "msg_id"]
TYPES = ("text", "image", "video", "audio", "document")
DEFAULT_LIMIT = 50


def limited(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    out = df.offset(offset) if offset > 0 else df
    return out.limit(limit) if limit and limit > 0 else out


def live(messages: DataFrame) -> DataFrame:
    """Without tombstones."""
    return messages.filter(messages["deleted_at"].isNull())


def given(values: list[str] | str | None) -> list[str]:
    """Trimmed, without blanks and repeats, in order."""
    values = [values] if isinstance(values, str) else values or []
    return list(dict.fromkeys(v.strip() for v in values if v and v.strip()))


def only(df: DataFrame, column: str, values: list[str] | str | None) -> DataFrame:
    """Rows whose column is one of the values; no value is no filter."""
    wanted = given(values)
    return df.filter(df[column].isin(wanted)) if wanted else df


def flagged(df: DataFrame, **flags: bool | None) -> DataFrame:
    """Rows whose flags are as given; None is no filter."""
    for column, value in flags.items():
        if value is not None:
            df = df.filter(df[column] if value else ~df[column])
    return df


def between(df: DataFrame, after: int | None = None, before: int | None = None, column: str = "ts") -> DataFrame:
    """Strictly after and strictly before."""
    if after is not None:
        df = df.filter(df[column] > after)
    return df if before is None else df.filter(df[column] < before)


def of_type(messages: DataFrame, kind: str | None = None, has_media: bool = False) -> DataFrame:
    kind = (kind or "").strip().lower()
    if kind and kind not in TYPES:
        raise ValueError(f"type must be one of {', '.join(TYPES)}")
    if has_media and kind == "text":
        raise ValueError("has_media can't go with type text")
    media = F.lower(F.coalesce(messages["media_type"], F.lit("")))
    if has_media:
        messages = messages.filter(media != "")
    if kind:
        messages = messages.filter(media == ("" if kind == "text" else kind))
    return messages


def with_dimensions(messages: DataFrame, chats: DataFrame, starred: DataFrame) -> DataFrame:
    """messages with the current name of their chat, falling back to that kept with the message if there is one, and whether they are starred."""
    names = chats.select(F.col("jid").alias("chat_jid"), F.col("name").alias("current_name"))
    stars = starred.select(*MESSAGE_KEY, F.lit(True).alias("starred")).distinct()
    out = messages.join(names, "chat_jid", "left").join(stars, MESSAGE_KEY, "left")
    own = F.col("chat_name") if "chat_name" in messages.columns else F.lit(None).cast("string")
    return out.withColumn("chat_name", F.coalesce(F.nullif("current_name", F.lit("")), own, F.lit(""))).withColumn("starred", F.coalesce("starred", F.lit(False))).drop("current_name")


def filtered(
    messages: DataFrame, starred: DataFrame | None = None, *, chats: list[str] | str | None = None, sender: str | None = None, from_me: bool | None = None, after: int | None = None, before: int | None = None,
    kind: str | None = None, has_media: bool = False, forwarded: bool = False, only_starred: bool = False,
) -> DataFrame:
    """The filters that listing and searching share, over live messages."""
    df = between(only(only(of_type(live(messages), kind, has_media), "chat_jid", chats), "sender_jid", sender), after, before)
    df = flagged(df, from_me=from_me, is_forwarded=True if forwarded else None)
    return df.join(starred.select(*MESSAGE_KEY).distinct(), MESSAGE_KEY, "left_semi") if only_starred else df


def list_messages(messages: DataFrame, *, ascending: bool = False, limit: int = DEFAULT_LIMIT, **filters) -> DataFrame:
    """The newest (or oldest) messages; ties by rowid. Filters come before the limit, and nothing wide is joined before it."""
    df = filtered(messages, **filters)
    order = [F.col("ts").asc(), F.col("rowid").asc()] if ascending else [F.col("ts").desc(), F.col("rowid").desc()]
    return limited(df.orderBy(*order), limit)


def search_like(messages: DataFrame, chats: DataFrame, query: str, *, limit: int = DEFAULT_LIMIT, columns: tuple[str, ...] = ("text", "display_text", "media_caption", "filename", "sender_name"), **filters) -> DataFrame:
    """Messages with the query inside any of the columns or the current name of their chat; newest first."""
    df = filtered(messages, **filters)
    named = chats.filter(contains_any(query, F.col("name"))).select(F.col("jid").alias("chat_jid"), F.lit(True).alias("by_chat")).distinct()
    hit = contains_any(query, *[F.col(c) for c in columns if c in df.columns]) | F.coalesce("by_chat", F.lit(False))
    return limited(df.join(named, "chat_jid", "left").filter(hit).drop("by_chat").orderBy(F.col("ts").desc(), F.col("rowid").desc()), limit)


def next_messages(messages: DataFrame) -> DataFrame:
    """Each message with the one that follows it in its chat by (ts, rowid): next_msg_id, next_ts. Tombstones count."""
    out = following(messages, "chat_jid", ["ts", "rowid"], F.struct("msg_id", "ts"), "n")
    return out.withColumns({"next_msg_id": F.col("n.msg_id"), "next_ts": F.col("n.ts")}).drop("n")


def context(messages: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """For each anchor (chat_jid, msg_id), which may be a tombstone, the live messages around it in order: anchor, offset, and the message. The anchor itself stands at 0.

    Neighbours are looked up by running numbers of the live rows of chats that have an anchor, not by joining each anchor with its whole chat."""
    asked = anchors.select(*MESSAGE_KEY).distinct()
    there = messages.join(asked.select("chat_jid").distinct(), "chat_jid", "left_semi").join(asked.withColumn("asked", F.lit(True)), MESSAGE_KEY, "left")
    one = F.struct("msg_id", "ts", "rowid")
    is_live = F.col("deleted_at").isNull()
    placed = running_count(there, "chat_jid", ["ts", "rowid"], is_live, "alive").withColumn("m", F.when(is_live, one))
    # The k live rows before an anchor are those numbered alive - k and on; numbers of live rows make the lookup an equi-join.
    a = placed.filter("asked").select("chat_jid", F.col("msg_id").alias("anchor"), one.alias("m"), (F.col("alive") - is_live.cast("int")).alias("ahead"), is_live.cast("int").alias("own"))
    around = a.select("chat_jid", "anchor", F.explode(F.concat(
        F.transform(F.sequence(F.lit(1), F.lit(max(before, 1))), lambda k: F.struct((-k).alias("offset"), (F.col("ahead") - k + 1).alias("alive"), (k <= before).alias("wanted"))),
        F.transform(F.sequence(F.lit(1), F.lit(max(after, 1))), lambda k: F.struct(k.alias("offset"), (F.col("ahead") + F.col("own") + k).alias("alive"), (k <= after).alias("wanted"))))).alias("x")).select("chat_jid", "anchor", "x.*").filter("wanted")
    found = around.join(placed.filter(is_live).select("chat_jid", "alive", "m"), ["chat_jid", "alive"]).select("chat_jid", "anchor", F.col("offset"), "m")
    return found.unionByName(a.select("chat_jid", "anchor", F.lit(0).alias("offset"), "m")).select("chat_jid", "anchor", "offset", "m.*")


def chats_list(chats: DataFrame, query: str = "", *, archived: bool | None = None, pinned: bool | None = None, muted: bool | None = None, unread: bool | None = None, now: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Pinned chats first, then by activity; ties by id."""
    df = flagged(chats, archived=archived, pinned=pinned, unread=unread)
    if muted is not None:
        df = df.filter((is_muted if muted else is_unmuted)(F.col("muted_until"), F.lit(now)))
    if query.strip():
        df = df.filter(contains_any(query.strip(), F.col("name"), F.col("jid")))
    return limited(df.orderBy(F.col("pinned").desc(), F.col("last_message_ts").desc(), "jid"), limit)


def contacts_search(contacts: DataFrame, query: str, *, columns: tuple[str, ...] = ("alias", "system_name", "full_name", "push_name", "business_name", "first_name", "phone", "jid"), name: Column | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Contacts with the query in any of their names, phone or id, by the name they are listed under."""
    hits = contacts.filter(contains_any(query, *[F.col(c) for c in columns]))
    return limited(hits.withColumn("shown", F.coalesce(name, F.col("jid")) if name is not None else F.col("jid")).orderBy("shown", "jid"), limit)


def pending_media(messages: DataFrame, chat: str = "") -> DataFrame:
    """Live media that can be fetched and hasn't been."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    df = live(messages).filter(some("media_type") & some("direct_path") & (F.col("media_key_length") > 0) & ~some("local_path") & (F.coalesce("media_unavailable_at", F.lit(0)) == 0))
    return only(df, "chat_jid", chat)


def visible_polls(polls: DataFrame, messages: DataFrame, purges: DataFrame, *, chat: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    """Polls whose message isn't a tombstone (or isn't there) and isn't purged; newest first. Two anti-joins, no disjunction."""
    gone = messages.filter(F.col("deleted_at").isNotNull()).select(*MESSAGE_KEY)
    df = only(polls, "chat_jid", chat).join(gone, MESSAGE_KEY, "left_anti").join(purges.select(*MESSAGE_KEY), MESSAGE_KEY, "left_anti")
    return limited(df.orderBy(F.col("created_ts").desc(), "chat_jid", "msg_id"), limit, offset)


def participants(roster: DataFrame) -> DataFrame:
    """Superadmins, admins, then the others, by id within."""
    rank = F.when(F.col("role") == "superadmin", 0).when(F.col("role") == "admin", 1).otherwise(2)
    return roster.withColumn("rank", rank).orderBy("group_jid", "rank", "user_jid")


def after_cursor(messages: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next live rows by rowid; deletions need a reconciliation of their own."""
    return limited(live(messages).filter(F.col("rowid") > cursor).orderBy("rowid"), limit)


def raw_of(events: DataFrame, raw: DataFrame, key: str = "event_id") -> DataFrame:
    """The stored bytes of many events by one join, with their encoding; events without bytes are left out."""
    return events.select(key).distinct().join(raw, key)
