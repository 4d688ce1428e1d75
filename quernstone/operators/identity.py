"""Merging of rows kept under two ids of one person: folded first, then merged, with policies of their own; and what an id belonged to at a time.

Purges, media paths, locations and polls are taken in their table's columns: missing ones count as null, others are left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators import hot
from quernstone.operators.joins import canonical
from quernstone.sources.catalog import conformed, durable

#: Where a span ends that nothing ends.
OPEN = 2**63 - 1
#: Spans are led on only in rounds that compare no more pairs of them than this, or than so many times the spans.
PAIRS, GROWTH = 100_000, 4


def _named(df: DataFrame, column: str, identity_map: DataFrame) -> DataFrame:
    """df with __own (whether the row stood under the phone id already) and its id replaced."""
    was = df.withColumn("__was", F.col(column))
    out = canonical(was, column, identity_map)
    return out.withColumn("__own", F.col("__was").eqNullSafe(F.col(column)).cast("int")).drop("__was")


def _first_filled(column: str):
    """The destination's value if filled, else that of the others, the least first."""
    some = F.col(column).cast("string") != ""
    return F.min_by(F.when(some, F.col(column)), F.when(some, F.struct(-F.col("__own"), F.col(column)))).alias(column)


def merge_chats(chats: DataFrame, identity_map: DataFrame) -> DataFrame:
    """The destination's name unless it is blank, its own id, or an address; newest time; either marker; counts added."""
    df = _named(chats, "jid", identity_map)
    real = (F.coalesce(F.trim("name"), F.lit("")) != "") & (F.col("name") != F.col("jid")) & ~F.col("name").contains("@")
    rank = F.struct(F.when(real, 0).otherwise(1).alias("r"), (-F.col("__own")).alias("o"), F.col("name").alias("n"))
    return df.groupBy("jid").agg(
        F.min_by("kind", F.struct(-F.col("__own"), "kind")).alias("kind"), F.min_by("name", rank).alias("name"), F.max("last_message_ts").alias("last_message_ts"), F.max("archived").alias("archived"), F.max("pinned").alias("pinned"),
        F.max("muted_until").alias("muted_until"), F.max("unread").alias("unread"), F.sum("unread_count").cast("bigint").alias("unread_count"),
    )


def merge_messages(messages: DataFrame, identity_map: DataFrame) -> DataFrame:
    """First filled value of most columns, the destination's before; newest ts; edited of either; newest edit. Senders are renamed too."""
    df = _named(canonical(messages, "sender_jid", identity_map) if "sender_jid" in messages.columns else messages, "chat_jid", identity_map)
    special = {
        "ts": F.max("ts"), "edited": F.max("edited"), "edited_ts": F.max("edited_ts"), "from_me": F.max_by("from_me", F.struct("__own", "from_me")), "revoked": F.max("revoked"), "deleted_for_me": F.max("deleted_for_me"), "is_forwarded": F.max("is_forwarded"),
        "forwarding_score": F.max("forwarding_score"), "rowid": F.min("rowid"), "deleted_at": F.min("deleted_at"),
    }
    columns = [c for c in messages.columns if c not in ("chat_jid", "msg_id", "media_unavailable_at")]
    return df.groupBy("chat_jid", "msg_id").agg(*[special[c].alias(c) if c in special else _first_filled(c) for c in columns])


def merge_roster(roster: DataFrame, identity_map: DataFrame) -> DataFrame:
    """The role of the newest row; equal times: the destination's."""
    df = _named(roster, "user_jid", identity_map)
    return df.groupBy("group_jid", "user_jid").agg(F.max_by("role", F.struct("updated_at", "__own", "role")).alias("role"), F.max("updated_at").alias("updated_at"))


def merge_votes(votes: DataFrame, identity_map: DataFrame) -> DataFrame:
    """The newest vote of each voter; equal times: the destination's."""
    df = _named(canonical(votes, "chat_jid", identity_map), "voter_jid", identity_map)
    rest = [c for c in votes.columns if c not in ("chat_jid", "poll_msg_id", "voter_jid")]
    return df.groupBy("chat_jid", "poll_msg_id", "voter_jid").agg(F.max_by(F.struct(*rest), F.struct("ts", "__own", *[c for c in rest if c != "ts"])).alias("v")).select("chat_jid", "poll_msg_id", "voter_jid", "v.*")


def merge_purges(purges: DataFrame, identity_map: DataFrame) -> DataFrame:
    """The first times at which a message's content was purged and it was deleted (times that are null don't count); the destination's reason unless it is blank."""
    df = _named(conformed(purges, "message_payload_purges"), "chat_jid", identity_map)
    return df.groupBy("chat_jid", "msg_id").agg(F.min("purged_at").alias("purged_at"), F.min("deleted_at").alias("deleted_at"), _first_filled("deletion_reason"))


def unpurged(df: DataFrame, purges: DataFrame, message: str = "msg_id") -> DataFrame:
    """Rows whose message (column message, of chat_jid) is not purged; both sides under the ids of after the merge."""
    return df.join(purges.select("chat_jid", F.col("msg_id").alias(message)).distinct(), ["chat_jid", message], "left_anti")


def merge_media_aliases(aliases: DataFrame, identity_map: DataFrame) -> DataFrame:
    """Every path that a message's media has; the destination's time of a path that both have, if it has one."""
    return _named(conformed(aliases, "message_local_media_aliases"), "chat_jid", identity_map).groupBy("chat_jid", "msg_id", "local_path").agg(_first_filled("downloaded_at"))


def _arriving(column: str):
    """The filled value of those that come to the destination, else its own; the least first."""
    some = F.col(column).cast("string") != ""
    return F.min_by(F.when(some, F.col(column)), F.when(some, F.struct(F.col("__own"), F.col(column)))).alias(column)


def merge_locations(locations: DataFrame, identity_map: DataFrame, purges: DataFrame) -> DataFrame:
    """Place and kind of the row that comes to the destination, its name and address unless blank; none of purged messages (purges: of before the merge).
    If several come, the least place counts."""
    df = _named(conformed(locations, "message_locations"), "chat_jid", identity_map)
    place = F.struct("latitude", "longitude", "is_live")
    one = df.groupBy("chat_jid", "msg_id").agg(F.min_by(place, F.struct("__own", place)).alias("__p"), _arriving("name"), _arriving("address"))
    out = one.select("chat_jid", "msg_id", "__p.latitude", "__p.longitude", "name", "address", "__p.is_live")
    return unpurged(out, merge_purges(purges, identity_map))


def merge_polls(polls: DataFrame, identity_map: DataFrame, purges: DataFrame) -> DataFrame:
    """Question and choices allowed of the row that comes to the destination; its options, then those that only the destination has; the newest time; none of
    purged messages. Senders are renamed too, but not in group chats. If several come, the least one counts, and options follow in that order."""
    direct = ~F.coalesce(F.col("chat_jid").endswith("@g.us"), F.lit(False))
    renamed = canonical(conformed(polls, "polls").withColumn("__sender", F.col("sender_jid")), "__sender", identity_map)
    df = _named(renamed.withColumn("sender_jid", F.when(direct, F.col("__sender")).otherwise(F.col("sender_jid"))).drop("__sender"), "chat_jid", identity_map)
    body = F.struct("question", "selectable_count")
    rank = F.struct("__own", body.alias("body"), F.coalesce("options", F.array().cast("array<string>")).alias("options"))
    one = df.groupBy("chat_jid", "msg_id").agg(
        _arriving("sender_jid"), F.min_by(body, rank).alias("__b"), F.max("created_ts").alias("created_ts"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_set(rank)), lambda x: x["options"]))).alias("options"),
    )
    out = one.select("chat_jid", "msg_id", "sender_jid", "__b.question", "options", "__b.selectable_count", "created_ts")
    return unpurged(out, merge_purges(purges, identity_map))


def spans(known: DataFrame) -> DataFrame:
    """(lid, pn, since, until) from statements (lid, pn, seq) that an id belongs to another from then on: the newest holds until the next one.

    Statements that say again what holds already, and those that lack a side or name one id twice, say nothing; of those with one seq the greatest pn counts."""
    said = known.filter((F.col("lid") != "") & (F.col("pn") != "") & (F.col("lid") != F.col("pn"))).groupBy("lid", "seq").agg(F.max("pn").alias("pn"))
    news = hot.preceding(said, "lid", ["seq"], F.col("pn"), "__was").filter(~F.col("__was").eqNullSafe(F.col("pn")))
    until = F.coalesce(F.col("__next"), F.lit(OPEN)).cast("bigint").alias("until")
    return hot.following(news, "lid", ["seq"], F.col("seq"), "__next").select("lid", "pn", F.col("seq").cast("bigint").alias("since"), until)


def _joined(near: DataFrame, far: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of near led on through far where far's ids have one at the time, and the parts of near that end where they are. The spans of an id follow
    each other from its first on, so that only what comes before the first is left."""
    on = far.select(F.col("lid").alias("pn"), F.col("pn").alias("__to"), F.col("since").alias("__s"), F.col("until").alias("__u"))
    met = near.join(on, "pn").filter((F.col("__s") < F.col("until")) & (F.col("since") < F.col("__u")))
    led = met.select("lid", F.col("__to").alias("pn"), F.greatest("since", "__s").alias("since"), F.least("until", "__u").alias("until"))
    first = far.groupBy(F.col("lid").alias("pn")).agg(F.min("since").alias("__first"))
    rest = near.join(first, "pn", "left").withColumn("until", F.least("until", F.coalesce("__first", F.lit(OPEN)))).filter(F.col("since") < F.col("until"))
    return led, rest.select("lid", "pn", "since", "until")


def followed(known: DataFrame) -> DataFrame:
    """spans whose pn is the end of the chain at that time: an id of an id is led on, in rounds that double the length of the chains.

    While ids lead back to each other in a ring, they and all that lead there stand for themselves (pn is lid)."""
    direct = durable(spans(known), "spans")
    now, reach, most = direct, 1, direct.count()
    while True:
        led, rest = _joined(now, now)
        led = durable(led, "spans")
        if led.isEmpty():
            return now
        if reach > most:  # a chain has no more links than there are spans
            ring = led.select("lid", F.col("lid").alias("pn"), "since", "until")
            return durable(rest.unionByName(ring), "spans")
        now, reach = durable(rest.unionByName(led), "spans"), 2 * reach


def as_of(df: DataFrame, column: str, chains: DataFrame, order: str = "seq", width: int = hot.WIDTH) -> DataFrame:
    """df with the id in column replaced by what it belonged to when the row came (after since, up to until), as followed has it. Rows of one id are cut into
    buckets of order, so that no task holds a hot id; null ids stay null."""
    row = F.struct(*[F.col(c) for c in df.columns])
    none: Column = F.lit(None)
    rows = df.select(F.col(column).alias("__k"), F.col(order).cast("bigint").alias("__o"), F.lit(0).alias("__kind"), row.alias("__row"), none.cast("string").alias("__pn"))
    said = chains.select(F.col("lid").alias("__k"), F.col("since").alias("__o"), F.lit(1).alias("__kind"), none.cast(rows.schema["__row"].dataType).alias("__row"), F.col("pn").alias("__pn"))
    # A key of null would be lost in the join between buckets: such rows have nothing to look up.
    found = hot.latest(rows.filter("__k IS NOT NULL").unionByName(said), "__k", ["__o", "__kind"], F.col("__pn"), "__to", width).filter("__kind = 0")
    out = found.unionByName(rows.filter("__k IS NULL").withColumn("__to", none.cast("string")))
    return out.select(*[F.coalesce(F.col("__to"), F.col("__row")[c]).alias(c) if c == column else F.col("__row")[c].alias(c) for c in df.columns])


def _compared(now: DataFrame) -> int:
    """Pairs of spans that leading them on compares."""
    to, own = now.groupBy("pn").agg(F.count("*").alias("__to")), now.groupBy(F.col("lid").alias("pn")).agg(F.count("*").alias("__own"))
    return to.join(own, "pn").agg(F.sum(F.col("__to") * F.col("__own"))).first()[0] or 0


def jumps(known: DataFrame) -> DataFrame:
    """spans whose pn lies further on in the chain, at its end or before: rounds as in followed while they stay in proportion to what is known. Where many ids lead
    through one that changes often, they end, since a span for each change of any id on a chain is the product of both."""
    now = durable(spans(known), "spans")
    most, reach = now.count(), 1
    while reach <= most and 0 < _compared(now) <= max(PAIRS, GROWTH * most):
        led, rest = _joined(now, now)
        now, reach = durable(rest.unionByName(led), "spans"), 2 * reach
    return now


def ends(asked: DataFrame, leads: DataFrame, width: int = hot.WIDTH) -> DataFrame:
    """(id, at, end) of the (id, at) asked for that belong to another id then, from jumps: jump after jump, all at once, and only of those that still move.

    Ids that come back to one they were seen at (the last whose jump's number is a power of two) are in a ring or lead to one: they stand for themselves."""
    none = F.lit(None).cast("string")
    said = leads.select(F.col("lid").alias("now"), F.col("since").alias("at"), F.lit(1).alias("kind"), none.alias("id"), none.alias("seen"), "pn")
    moving = asked.select(F.col("id").alias("now"), "at", F.lit(0).alias("kind"), "id", F.col("id").alias("seen"), none.alias("pn"))
    step, found = 0, []
    while True:
        jumped = durable(hot.latest(moving.unionByName(said), "now", ["at", "kind"], F.col("pn"), "to", width).filter("kind = 0").select("id", "at", "now", "seen", "to"), "jumped")
        found.append(jumped.filter("to IS NULL AND now <> id").select("id", "at", F.col("now").alias("end")))
        on, step = jumped.filter("to <> seen"), step + 1
        if on.isEmpty():
            return reduce(DataFrame.unionByName, found)
        seen = "to" if step & (step - 1) == 0 else "seen"
        moving = on.select(F.col("to").alias("now"), "at", F.lit(0).alias("kind"), "id", F.col(seen).alias("seen"), none.alias("pn"))


def at_the_time(df: DataFrame, column: str, leads: DataFrame, order: str = "seq", width: int = hot.WIDTH) -> DataFrame:
    """df as by as_of over followed, from jumps: only ids and times move along the chains, and rows meet their ends once."""
    rows = df.select(F.col(column).alias("id"), F.col(order).cast("bigint").alias("at"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    found = ends(rows.select("id", "at").filter("id IS NOT NULL").distinct(), leads, width)
    out = rows.join(found, ["id", "at"], "left")
    return out.select(*[F.coalesce(F.col("end"), F.col("row")[c]).alias(c) if c == column else F.col("row")[c].alias(c) for c in df.columns])
