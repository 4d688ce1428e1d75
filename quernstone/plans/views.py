"""Every table as a pure function of the event log: rebuilding, replaying and shadowing are the same call.

Events are rows of the log as ``ingest`` writes them, read by ``decode``. A log of another make, without raw bytes, may say what
happened in a column payload (JSON, one shape a type, times in seconds; PAYLOADS) instead. A view reads only the types it needs; with the log
partitioned by event_type that prunes the scan. Columns beside those of the log are not looked at. A row of a view depends on the events
of its chat (of a contact: its id) alone, so that ``named`` and ``shown`` look up names and quoted texts afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import values as v
from quernstone.functions.values import chat_kind
from quernstone.operators import folds, identity
from quernstone.operators.aggregates import unread_fold
from quernstone.operators.hot import numbered
from quernstone.operators.joins import latest
from quernstone.plans import decode
from quernstone.sources.catalog import schema

#: Event type -> DDL of its payload.
PAYLOADS = {
    "message": "sender_name string, from_me boolean, text string, display_text string, quoted_msg_id string, reaction_to_id string, reaction_emoji string, media_type string, media_caption string, filename string, direct_path string, is_forwarded boolean, edited boolean, edited_ts bigint, revoked boolean, deleted_for_me boolean, deleted_at bigint, deletion_reason string",
    "chat_state": "archived boolean, pinned boolean, muted_until bigint, name string",
    "contact": "phone string, push_name string, full_name string, first_name string, business_name string, system_name string",
    "group": "name string, owner_jid string, created_ts bigint, participants array<struct<user_jid:string,role:string>>",
    "poll": "question string, options array<string>, selectable_count int",
    "vote": "selected array<string>, ts bigint",
    "star": "starred boolean",
    "call": "call_id string, call_type string, direction string, outcome string, duration_secs bigint",
    "unread": "count bigint",
    "location": "latitude double, longitude double, name string, address string, is_live boolean",
}


def of(events: DataFrame, *types: str, payload: str | None = None) -> DataFrame:
    """Events of the types with their payload's fields."""
    df = events.filter(F.col("event_type").isin(*types))
    if payload:
        df = df.withColumn("p", F.from_json("payload", PAYLOADS[payload])).select(*[c for c in events.columns if c != "payload"], "p.*")
    return df


#: What a scrub takes away.
ERASED = [
    "chat_name", "sender_jid", "sender_name", "text", "display_text", "quoted_msg_id", "quoted_sender_jid", "reaction_to_id", "reaction_emoji", "media_type", "media_caption", "filename", "mime_type", "direct_path", "media_key", "file_sha256",
    "file_enc_sha256", "file_length", "local_path", "downloaded_at", "media_unavailable_at", "buttons",
]


def messages(events: DataFrame) -> DataFrame:
    """Messages, folded; scrubbed ones keep key and tombstone, whatever comes later."""
    if decode.written(events):
        return folds.scrubbed(folds.fold_messages(decode.messages(events)), purges(events), ERASED)
    made = of(events, "message", "edit", "revoke", "delete_for_me", payload="message").withColumnRenamed("event_ts", "ts")
    revoke, mine = F.col("event_type") == "revoke", F.col("event_type") == "delete_for_me"
    made = made.withColumns({
        "revoked": F.coalesce("revoked", revoke), "deleted_for_me": F.coalesce("deleted_for_me", mine), "deleted_at": F.coalesce("deleted_at", F.when(revoke | mine, F.col("ts"))),
        "deletion_reason": F.coalesce("deletion_reason", F.when(mine, "delete-for-me").when(revoke, "revoke")), "edited": F.coalesce("edited", F.col("event_type") == "edit"), "edited_ts": F.coalesce("edited_ts", F.when(F.col("event_type") == "edit", F.col("ts")), F.lit(0).cast("bigint")),
    }).select(*[c for c in made.columns if c in schema("messages").names or c in ("chat_jid", "msg_id", "seq")])
    folded = folds.fold_messages(made)
    return folds.scrubbed(folded, purges(events), ["text", "display_text", "media_caption", "filename", "direct_path", "reaction_emoji"])


def purges(events: DataFrame) -> DataFrame:
    if decode.written(events):
        return decode.purges(events).groupBy("chat_jid", "msg_id").agg(F.min("purged_at").alias("purged_at"))
    return of(events, "scrub").groupBy("chat_jid", "msg_id").agg(F.min("event_ts").alias("purged_at"))


def chats(events: DataFrame) -> DataFrame:
    """Kind by id, name, newest time, last flags, running unread. A name is that of the group or contact, else the last that a call told, else the id."""
    if decode.written(events):
        made = decode.chats(events)
        state = made.groupBy("chat_jid").agg(folds.last_filled("name")(F.col("seq")).alias("name"), F.max("ts").alias("last_message_ts"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("archived", "pinned", "muted_until")])
        names = _best_names(contacts(events)).unionByName(groups(events).select(F.col("jid").alias("chat_jid"), F.col("name").alias("given"))).filter("trim(given) <> ''")
        state = state.join(names.groupBy("chat_jid").agg(F.max("given").alias("given")), "chat_jid", "left").withColumn("name", F.coalesce("given", "name"))
        return _chat_rows(state.join(unread(events), "chat_jid", "left"))
    seen = of(events, "message", "call").groupBy("chat_jid").agg(F.max("event_ts").alias("last_message_ts"))
    made = of(events, "chat_state", payload="chat_state")
    names = made.groupBy("chat_jid").agg(folds.last_filled("name")(F.col("seq")).alias("name"))
    state = folds.chat_state(made).join(names, "chat_jid")
    return _chat_rows(seen.join(state, "chat_jid", "full_outer").join(unread(events), "chat_jid", "full_outer"))


def _best_names(contacts: DataFrame) -> DataFrame:
    """(chat_jid, given): a contact's full name, else first, business or push name; a push name of a dash is none."""
    name = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("full_name", "first_name", "business_name")], F.when(~F.trim("push_name").isin("", "-"), F.trim("push_name")))
    return contacts.select(F.col("jid").alias("chat_jid"), name.alias("given"))


def _chat_rows(out: DataFrame) -> DataFrame:
    return out.select(
        F.col("chat_jid").alias("jid"), chat_kind(F.col("chat_jid")).alias("kind"), F.coalesce("name", "chat_jid").alias("name"), F.coalesce("last_message_ts", F.lit(0)).alias("last_message_ts"), F.coalesce("archived", F.lit(False)).alias("archived"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("muted_until", F.lit(0)).alias("muted_until"), (F.coalesce("unread_count", F.lit(0)) > 0).alias("unread"), F.coalesce("unread_count", F.lit(0)).cast("int").alias("unread_count"),
    )


def unread(events: DataFrame) -> DataFrame:
    """The unread count of each chat at the end of the log. Only the first delivery of a message counts, if it is live and not one's
    own; whatever else refers to the message, before it or after, is no delivery."""
    if decode.written(events):
        return unread_fold(decode.unread(events)).groupBy("chat_jid").agg(F.max_by("unread_count", "seq").alias("unread_count"))
    mine = F.coalesce(F.get_json_object("payload", "$.from_me") == "true", F.lit(False))
    said = of(events, "message").groupBy("chat_jid", "msg_id").agg(F.min("seq").alias("seq"), F.min_by(F.coalesce((F.col("source") == "live") & ~mine, F.lit(False)), "seq").alias("plus"))
    none = F.lit(None).cast("bigint")
    said = said.select("chat_jid", "seq", "plus", none.alias("sets"), F.lit(False).alias("keeps"))
    kind, n = F.col("event_type"), F.get_json_object("payload", "$.count").cast("bigint")
    sets = F.when(kind == "unread", F.greatest(n, F.lit(0))).when(kind.isin("mark_read", "receipt"), F.lit(0)).cast("bigint")
    marks = of(events, "mark_read", "mark_unread", "unread", "receipt").select("chat_jid", "seq", F.lit(False).alias("plus"), sets.alias("sets"), (kind == "mark_unread").alias("keeps"))
    return unread_fold(said.unionByName(marks)).groupBy("chat_jid").agg(F.max_by("unread_count", "seq").alias("unread_count"))


def contacts(events: DataFrame) -> DataFrame:
    """Last filled names; a phone book's names only since it was last cleared."""
    if decode.written(events):
        cleared, made = decode.names_cleared(events), decode.contacts(events)
    else:
        cleared, made = of(events, "contact_clear"), of(events, "contact", payload="contact").withColumnsRenamed({"sender_jid": "jid", "event_ts": "updated_at"})
    cleared = cleared.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cleared"))
    made = made.join(F.broadcast(cleared), F.lit(True))  # one row
    names = [folds.last_filled(c)(F.col("seq")).alias(c) for c in ("phone", "push_name", "full_name", "first_name", "business_name")]
    system = F.max_by(F.when(F.col("seq") > F.col("cleared"), F.col("system_name")), F.when(F.col("system_name").isNotNull(), F.col("seq"))).alias("system_name")
    return made.groupBy("jid").agg(*names, system, F.max_by("updated_at", "seq").alias("updated_at"))


def groups(events: DataFrame) -> DataFrame:
    if decode.written(events):
        made = decode.groups(events)
        news, order = ~F.col("left"), F.col("seq")
        last = lambda c: F.max_by(F.struct(c), F.when(news, order))[c].alias(c)
        some = lambda c, ok: F.max_by(F.when(news & ok, F.col(c)), F.when(news & ok, order)).alias(c)
        return made.groupBy("jid").agg(
            *[some(c, F.col(c) != "") for c in ("name", "owner_jid")], some("created_ts", F.col("created_ts") > 0), F.coalesce(last("is_parent"), F.lit(False)).alias("is_parent"), F.nullif(F.when(~F.coalesce(last("is_parent"), F.lit(False)), last("linked_parent_jid")), F.lit("")).alias("linked_parent_jid"),
            F.max_by("updated_at", "seq").alias("updated_at"), F.max_by("left_at", "seq").alias("left_at"),
        )
    made = of(events, "group", payload="group").withColumnRenamed("event_ts", "updated_at")
    meta = folds.fold(made, ["chat_jid"], {"name": folds.last_filled, "owner_jid": folds.last_filled, "created_ts": folds.last_positive, "updated_at": folds.last})
    last = made.groupBy("chat_jid").agg(F.max("seq").alias("s"))
    left = of(events, "group_leave").groupBy("chat_jid").agg(F.max_by("event_ts", "seq").alias("t"), F.max("seq").alias("l"))
    out = meta.join(last, "chat_jid").join(left, "chat_jid", "left")
    return out.withColumn("left_at", F.when(F.col("l") > F.col("s"), F.col("t"))).withColumnRenamed("chat_jid", "jid").drop("s", "t", "l")


def roster(events: DataFrame) -> DataFrame:
    if decode.written(events):
        return folds.latest_roster(decode.rosters(events))
    made = of(events, "group", payload="group").filter("participants IS NOT NULL")
    return folds.latest_roster(made.select(F.col("chat_jid").alias("group_jid"), "participants", "seq"))


def polls(events: DataFrame) -> DataFrame:
    """Polls with options added later, in order, once each."""
    if decode.written(events):
        own, more = decode.polls(events), decode.poll_options(events)
        base = folds.fold_polls(own).join(own.groupBy("chat_jid", "msg_id").agg(folds.last_filled("sender_jid")(F.col("seq")).alias("sender_jid")), ["chat_jid", "msg_id"])
    else:
        made = of(events, "poll", "poll_option", payload="poll").withColumnRenamed("event_ts", "created_ts")
        own, more = made.filter("event_type = 'poll'"), made.filter("event_type = 'poll_option'")
        base = folds.fold_polls(own.select("chat_jid", "msg_id", "question", "options", "selectable_count", "created_ts", "seq"))
    added = more.groupBy("chat_jid", "msg_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "options"))), lambda x: x["options"])).alias("more"))
    out = base.join(added, ["chat_jid", "msg_id"], "left")
    return out.withColumn("options", F.array_distinct(F.concat("options", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")


def votes(events: DataFrame) -> DataFrame:
    """Standing votes; a selection of nothing takes the vote back. Times in milliseconds: the sender's, else the message's."""
    if decode.written(events):
        return folds.fold_votes(decode.votes(events)).drop("seq")
    made = of(events, "vote", payload="vote").withColumn("ts", F.coalesce(F.when(F.col("ts") > 0, F.col("ts")), F.col("event_ts") * 1000))
    arrivals = made.select("chat_jid", F.col("msg_id").alias("poll_msg_id"), F.col("sender_jid").alias("voter_jid"), "selected", "ts", "seq", (F.size(F.coalesce("selected", F.array().cast("array<string>"))) == 0).alias("retracted"))
    return folds.fold_votes(arrivals).drop("seq")


def starred(events: DataFrame) -> DataFrame:
    if decode.written(events):
        return latest(decode.stars(events), ["chat_jid", "msg_id"], ["seq"]).filter("starred").drop("starred", "seq")
    made = of(events, "star", payload="star").withColumnRenamed("event_ts", "starred_at").select("chat_jid", "msg_id", "sender_jid", "starred", "starred_at", "seq")
    return latest(made, ["chat_jid", "msg_id"], ["seq"]).filter("starred").drop("starred", "seq")


def status(events: DataFrame) -> DataFrame:
    if decode.written(events):
        return latest(decode.status(events), ["msg_id"], ["seq"]).drop("seq")
    made = of(events, "status").select("msg_id", "sender_jid", F.col("event_ts").alias("ts"), F.get_json_object("payload", "$.text").alias("text"), "seq")
    return latest(made, ["msg_id"], ["seq"]).drop("seq")


def calls(events: DataFrame) -> DataFrame:
    """Call events, folded; a deletion removes the log entries of its chat that came before it, live events stay."""
    if decode.written(events):
        return folds.fold_calls(decode.calls(events))
    made = of(events, "call", "call_log", payload="call").withColumnRenamed("event_ts", "ts")
    gone = of(events, "call_delete").groupBy("chat_jid").agg(F.max("seq").alias("gone"))
    kept = made.join(gone, "chat_jid", "left").filter((F.col("event_type") != "call_log") | (F.col("seq") > F.coalesce("gone", F.lit(-1)))).drop("gone", "source", "msg_id")
    return folds.fold_calls(kept.select("chat_jid", "call_id", "event_type", "sender_jid", "call_type", "direction", "outcome", "duration_secs", "ts", "seq"))


def locations(events: DataFrame) -> DataFrame:
    if decode.written(events):
        return folds.guarded_fold(decode.locations(events), purges(events), ["chat_jid", "msg_id"])
    made = of(events, "location", payload="location").select("chat_jid", "msg_id", "latitude", "longitude", "name", "address", "is_live", "seq")
    return folds.guarded_fold(made, purges(events), ["chat_jid", "msg_id"])


def statements(events: DataFrame) -> DataFrame:
    """(lid, pn, seq): every word of the log on people's two ids."""
    made = decode.identities(events) if decode.written(events) else of(events, "identity_resolution").select(F.get_json_object("payload", "$.lid").alias("lid"), F.get_json_object("payload", "$.pn").alias("pn"), "seq")
    return made.filter("lid <> '' AND pn <> '' AND lid <> pn")


def identities(events: DataFrame) -> DataFrame:
    """(lid, pn, since): what the log says of people's two ids; the last word on an id counts, since the first."""
    return statements(events).groupBy("lid").agg(F.max_by("pn", "seq").alias("pn"), F.min("seq").alias("since"))


def with_identities_at(events: DataFrame, columns: tuple[str, ...] = ("chat_jid", "sender_jid")) -> DataFrame:
    """Events with hidden ids replaced by what the log had said of them when they came: an id that is later given to another person keeps
    the former one for the events before. Chains of ids are followed as they stood at the time."""
    leads = identity.jumps(statements(events))
    for c in columns:
        events = identity.at_the_time(events, c, leads)
    return events


def with_identities(events: DataFrame, columns: tuple[str, ...] = ("chat_jid", "sender_jid")) -> DataFrame:
    """Events with the hidden ids replaced that the log had resolved before them. Earlier ones keep theirs: their rows are merged afterwards."""
    known = identities(events)
    for c in columns:
        m = known.select(F.col("lid").alias("__lid"), F.col("pn").alias("__pn"), F.col("since").alias("__since"))
        events = events.join(m, (F.col(c) == F.col("__lid")) & (F.col("seq") > F.col("__since")), "left").withColumn(c, F.coalesce("__pn", c)).drop("__lid", "__pn", "__since")
    return events


def identified(events: DataFrame) -> dict[str, DataFrame]:
    """Messages, votes, roster, and of a written log locations, polls and purges too, with people's ids resolved: later events under the phone id, rows of earlier
    ones merged into it. Votes, polls and locations of messages that are purged under either id go."""
    known, mapped = identities(events).select("lid", "pn"), with_identities(events)
    out = {"messages": identity.merge_messages(messages(mapped), known), "poll_votes": identity.merge_votes(votes(mapped), known), "group_participants": identity.merge_roster(roster(mapped).withColumn("updated_at", F.lit(0)), known)}
    if decode.written(events):
        gone = purges(mapped)
        out["message_payload_purges"] = identity.merge_purges(gone, known)
        out["message_locations"] = identity.merge_locations(locations(mapped), known, gone)
        out["polls"] = identity.merge_polls(polls(mapped), known, gone)
        out["poll_votes"] = identity.unpurged(out["poll_votes"], out["message_payload_purges"], "poll_msg_id")
    return out


def named(messages: DataFrame, chats: DataFrame, contacts: DataFrame) -> DataFrame:
    """messages with the names of their chats, and of senders that are known contacts; others keep the names that came with them."""
    of_chat = chats.select(F.col("jid").alias("chat_jid"), F.col("name").alias("__chat"))
    of_sender = _best_names(contacts).select(F.col("chat_jid").alias("sender_jid"), F.col("given").alias("__sender"))
    out = messages.join(of_chat, "chat_jid", "left").join(of_sender, "sender_jid", "left")
    both = {"chat_name": F.coalesce("__chat", "chat_name"), "sender_name": F.when(F.col("from_me"), "me").otherwise(F.coalesce("__sender", "sender_name"))}
    return out.withColumns(both).select(*messages.columns)


def shown(messages: DataFrame) -> DataFrame:
    """messages with the texts that reactions, and replies without a quotation of their own, refer to, taken from what these show."""
    c = F.col
    target = messages.select("chat_jid", c("msg_id").alias("__id"), v.target_text(c("display_text"), c("text"), c("media_type")).alias("__t"))
    react = F.coalesce(F.trim("reaction_to_id"), F.lit("")) != ""
    bare = F.coalesce(F.trim("quoted_msg_id"), F.lit("")) != ""
    wanted = F.when(react, c("reaction_to_id")).when(bare & c("display_text").startswith("> message\n"), c("quoted_msg_id"))
    out = messages.withColumn("__id", F.when(c("deleted_at").isNull(), wanted)).join(target, ["chat_jid", "__id"], "left")
    base = v.base_text(c("text"), F.coalesce("media_type", F.lit("")))
    text = F.when(c("__id").isNull() | c("__t").isNull(), c("display_text")).otherwise(v.display_text(base, c("reaction_to_id"), c("reaction_emoji"), c("__t"), c("quoted_msg_id"), c("__t")))
    return out.withColumn("display_text", text).select(*messages.columns)


VIEWS = {"messages": messages, "chats": chats, "contacts": contacts, "groups": groups, "group_participants": roster, "polls": polls, "poll_votes": votes, "starred": starred, "call_events": calls, "message_locations": locations, "message_payload_purges": purges}


def rebuild(events: DataFrame) -> dict[str, DataFrame]:
    """All views from the log alone."""
    return {name: view(events) for name, view in VIEWS.items()}


def snapshot_events(df: DataFrame, table: str, key: list[str], first_seq: int = 1) -> DataFrame:
    """One event for each row of an old table: its row as JSON, binary columns in base64, numbered by key. The views read them back (decode.snapshots)."""
    plain = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    row = F.to_json(F.struct(F.lit(table).alias("table"), F.struct(*plain).alias("row")))
    keys = F.concat_ws(":", F.lit(table), *[F.col(c).cast("string") for c in key])
    rows = df.select(row.alias("payload"), keys.alias("dedup_key"), F.lit(f"snapshot_{table}").alias("event_type"), F.lit("legacy_snapshot").alias("source"))
    return numbered(rows, [F.col("dedup_key"), F.col("payload")], "seq", first_seq)
