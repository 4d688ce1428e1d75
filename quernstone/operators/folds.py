"""Merging of re-delivered and changed rows: every table's state as an ordered fold of its arrivals.

Three tiers, the cheapest that is exact: (1) policies of single columns, as grouped aggregates; (2) state with resets,
as windows (see aggregates.unread_fold); (3) policies that look across columns and are not associative (messages, calls):
a fold over the key's ordered list inside Catalyst. A list holds the deliveries of one message or call, which are few;
exact repeats are dropped before, map-side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.values import DELETED_FOR_ME, REVOKED

# Tier 1


def last(column: str) -> Callable[[Column], Column]:
    """The last arrival's value, null or not."""
    return lambda order: F.max_by(F.struct(column), order)[column]


def last_filled(column: str) -> Callable[[Column], Column]:
    """The last value that is neither null nor empty."""
    some = F.col(column).cast("string") != ""
    return lambda order: F.max_by(F.when(some, F.col(column)), F.when(some, order))


def last_positive(column: str) -> Callable[[Column], Column]:
    return lambda order: F.max_by(F.when(F.col(column) > 0, F.col(column)), F.when(F.col(column) > 0, order))


def first_filled(column: str) -> Callable[[Column], Column]:
    some = F.col(column).cast("string") != ""
    return lambda order: F.min_by(F.when(some, F.col(column)), F.when(some, order))


def greatest(column: str) -> Callable[[Column], Column]:
    return lambda order: F.max(column)


def least(column: str) -> Callable[[Column], Column]:
    return lambda order: F.min(column)


def total(column: str) -> Callable[[Column], Column]:
    return lambda order: F.sum(column)


def any_of(column: str) -> Callable[[Column], Column]:
    return lambda order: F.max(column)


#: entity -> column -> policy
POLICIES = {
    "chats": {"kind": last, "name": last_filled, "last_message_ts": greatest},
    "chat_metadata": {"kind": last, "name": last_filled},
    "contacts": {"phone": last_filled, "push_name": last_filled, "full_name": last_filled, "first_name": last_filled, "business_name": last_filled, "updated_at": last},
    "groups": {"name": last_filled, "owner_jid": last_filled, "created_ts": last_positive, "is_parent": last, "linked_parent_jid": last, "updated_at": last},
    "starred": {"sender_jid": last_filled, "from_me": last, "starred_at": last},
    "locations": {"latitude": last, "longitude": last, "name": last, "address": last, "is_live": last},
    "purges": {"purged_at": least, "deleted_at": least, "deletion_reason": first_filled},
}


def fold(arrivals: DataFrame, key: list[str], policies: dict[str, Callable], order: str = "seq") -> DataFrame:
    """One row a key; order is the arrival's number, distinct within a key. Columns without a policy are dropped."""
    return arrivals.groupBy(*key).agg(*[policy(column)(F.col(order)).alias(column) for column, policy in policies.items() if column in arrivals.columns])


def fold_entity(arrivals: DataFrame, entity: str, key: list[str], order: str = "seq") -> DataFrame:
    out = fold(arrivals, key, POLICIES[entity], order)
    return out.withColumn("left_at", F.lit(None).cast("bigint")) if entity == "groups" else out


def latest_roster(snapshots: DataFrame, order: str = "seq") -> DataFrame:
    """Members of each group's last snapshot (group_jid, participants of user_jid and role); a blank role is member. Only the last snapshot is unfolded."""
    whole = snapshots.groupBy("group_jid").agg(F.max_by("participants", order).alias("p"))
    members = whole.select("group_jid", F.explode("p").alias("m")).select("group_jid", "m.user_jid", F.coalesce(F.nullif(F.trim("m.role"), F.lit("")), F.lit("member")).alias("role"))
    return members.dropDuplicates(["group_jid", "user_jid"])


def fold_polls(arrivals: DataFrame, order: str = "seq") -> DataFrame:
    """Last wins; options are those of the last in order, then those of earlier ones from newest to oldest."""
    keys = ["chat_jid", "msg_id"]
    agg = arrivals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "options")), asc=False).alias("o"), *[F.max_by(c, order).alias(c) for c in ("question", "selectable_count", "created_ts") if c in arrivals.columns])
    return agg.withColumn("options", F.array_distinct(F.flatten(F.transform("o", lambda x: F.coalesce(x["options"], F.array().cast("array<string>")))))).drop("o")


def fold_votes(arrivals: DataFrame, order: str = "seq") -> DataFrame:
    """The vote of the greatest time, ties to the later arrival. A retraction (marked retracted) removes what stands when it comes, if that is no newer; a later vote stands again."""
    keys = ["chat_jid", "poll_msg_id", "voter_jid"]
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col("ts").cast("bigint").alias("ts"), F.col("retracted").alias("r"))))
    agg = arrivals.groupBy(*keys).agg(steps.alias("steps"))
    none = F.struct(F.lit(None).cast("bigint").alias("o"), F.lit(None).cast("bigint").alias("ts"))

    def step(held: Column, x: Column) -> Column:
        new = F.struct(x["o"].alias("o"), x["ts"].alias("ts"))
        return F.when(x["r"], F.when(held["ts"] <= x["ts"], none).otherwise(held)).when(held["ts"].isNull() | (x["ts"] >= held["ts"]), new).otherwise(held)

    won = agg.select(*keys, F.aggregate("steps", none, step)["o"].alias(order)).filter(F.col(order).isNotNull())
    return arrivals.join(won, [*keys, order]).drop("retracted")


# Tier 3


def ordered_fold(arrivals: DataFrame, key: list[str], columns: list[str], merge: Callable[[Column, Column], dict[str, Column]], order: str = "seq") -> DataFrame:
    """merge(old, new) gives the next state's columns; the first arrival is the first state. Of columns that merge doesn't know the last arrival's value stays."""
    types = dict(arrivals.dtypes)
    lists = arrivals.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*columns).alias("__v")))), lambda x: x["__v"]).alias("__l"))

    def step(old: Column, new: Column) -> Column:
        now = merge(old, new)
        return F.struct(*[(now[c] if c in now else new[c]).cast(types[c]).alias(c) for c in columns])

    state = F.aggregate(F.slice("__l", 2, F.greatest(F.size("__l") - 1, F.lit(0))), F.element_at("__l", 1), step)
    return lists.select(*key, state.alias("__s")).select(*key, "__s.*")


def _nz(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def merge_message(columns: list[str]) -> Callable[[Column, Column], dict[str, Column]]:
    """The live merge of a message with a later arrival of it. A tombstone keeps what it has and takes only what it lacks; a stale arrival changes nothing but what is sticky; else the arrival wins."""

    def merge(old: Column, new: Column) -> dict[str, Column]:
        yes = lambda c: F.coalesce(c, F.lit(False))
        old_dead, new_dead = old["deleted_at"].isNotNull(), new["deleted_at"].isNotNull()
        tomb = old_dead | new_dead
        oe, ne = yes(old["edited"]), yes(new["edited"])
        stale = (oe & ~ne) | (oe & ne & yes(new["edited_ts"] < old["edited_ts"])) | (~oe & ~ne & yes(new["ts"] < old["ts"]))
        marked = yes(old["revoked"]) | yes(old["deleted_for_me"]) | yes(new["revoked"]) | yes(new["deleted_for_me"])
        stale_meta = stale & ~marked
        placeholder = lambda c: c.isin(REVOKED, DELETED_FOR_ME)
        out: dict[str, Column] = {}

        def put(names: tuple[str, ...], dead: Callable, when_stale: Column, fresh: Callable) -> None:
            for c in names:
                if c in columns:
                    o, n = old[c], new[c]
                    out[c] = F.when(tomb, dead(o, n)).when(when_stale, o).otherwise(fresh(o, n))

        keep_old = lambda o, n: F.when(_nz(o), o).otherwise(n)
        take_new = lambda o, n: n
        fill_new = lambda o, n: F.when(_nz(n), n).otherwise(o)
        put(("sender_jid",), keep_old, stale_meta, take_new)
        put(("sender_name", "reaction_to_id", "reaction_emoji"), keep_old, stale_meta, fill_new)
        put(("text", "media_type", "media_caption"), keep_old, stale, take_new)
        put(("filename", "mime_type", "direct_path", "quoted_msg_id", "quoted_sender_jid"), keep_old, stale, fill_new)
        put(("display_text",), lambda o, n: F.when(_nz(o) & ~placeholder(o), o).otherwise(n), stale, fill_new)
        either = lambda o, n: yes(o) | yes(n)
        put(("is_forwarded",), either, stale_meta, take_new)
        put(("forwarding_score",), lambda o, n: F.greatest(o, n), stale_meta, take_new)
        put(("buttons",), lambda o, n: F.coalesce(o, n), stale, take_new)
        held = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
        put(("media_key", "file_sha256", "file_enc_sha256"), lambda o, n: F.when(held(o), o).otherwise(n), stale, lambda o, n: F.when(held(n), n).otherwise(o))
        positive = lambda c: F.coalesce(c > 0, F.lit(False))
        put(("file_length", "media_key_length"), lambda o, n: F.when(positive(o), o).otherwise(n), stale, lambda o, n: F.when(positive(n), n).otherwise(o))
        for c in ("local_path", "downloaded_at", "rowid"):
            if c in columns:
                out[c] = old[c]
        if "chat_name" in columns:
            out["chat_name"] = fill_new(old["chat_name"], new["chat_name"])
        if "from_me" in columns:
            out["from_me"] = F.when(tomb, either(old["from_me"], new["from_me"])).when(stale & ~tomb, old["from_me"]).otherwise(new["from_me"])
        if "media_unavailable_at" in columns:
            other = (_nz(new["direct_path"]) & ~new["direct_path"].eqNullSafe(old["direct_path"])) if "direct_path" in columns else F.lit(False)
            out["media_unavailable_at"] = F.when(~tomb & ~stale & other, None).otherwise(old["media_unavailable_at"])
        bare = ~_nz(old["text"]) if "text" in columns else F.lit(True)
        for c in ("media_type", "quoted_msg_id"):
            if c in columns:
                bare = bare & ~_nz(old[c])
        if "display_text" in columns:
            bare = bare & (~_nz(old["display_text"]) | placeholder(old["display_text"]))
        if "buttons" in columns:
            bare = bare & old["buttons"].isNull()
        gone = yes(new["revoked"]) | yes(new["deleted_for_me"])
        out["ts"] = (
            F.when(old_dead & ~new_dead & bare, new["ts"]).when(tomb, old["ts"]).when(ne, old["ts"]).when(oe & ~ne, new["ts"])
            .when(yes(new["ts"] < old["ts"]) & ~gone, old["ts"]).otherwise(new["ts"])
        )
        out["revoked"], out["deleted_for_me"] = either(old["revoked"], new["revoked"]), either(old["deleted_for_me"], new["deleted_for_me"])
        out["deleted_at"] = F.coalesce(old["deleted_at"], new["deleted_at"])
        if "deletion_reason" in columns:
            out["deletion_reason"] = F.when(old_dead, F.when(_nz(old["deletion_reason"]), old["deletion_reason"]).otherwise(new["deletion_reason"])).otherwise(new["deletion_reason"])
        out["edited"] = F.when(old_dead, oe).when(new_dead, False).when(ne, True).otherwise(oe)
        newer = ne & (~oe | yes(new["edited_ts"] > old["edited_ts"]))
        zero = F.lit(0)
        out["edited_ts"] = F.when(old_dead, old["edited_ts"]).when(new_dead, zero).when(newer, new["edited_ts"]).when(oe, old["edited_ts"]).otherwise(zero)
        return out

    return merge


def fold_messages(arrivals: DataFrame, purges: DataFrame | None = None, key: tuple[str, ...] = ("chat_jid", "msg_id"), order: str = "seq") -> DataFrame:
    """One row a message. Arrivals of a purged message are left out before anything is grouped."""
    keys = list(key)
    if purges is not None:
        arrivals = arrivals.join(purges.select(*keys).distinct(), keys, "left_anti")
    columns = [c for c in arrivals.columns if c not in (*keys, order)]
    return ordered_fold(arrivals, keys, columns, merge_message(columns), order)


def scrubbed(messages: DataFrame, purges: DataFrame, payload: list[str], key: tuple[str, ...] = ("chat_jid", "msg_id")) -> DataFrame:
    """messages with the payload columns of purged ones nulled; key and tombstone stay. The purge's time is the payload_purged_at."""
    one = purges.groupBy(*key).agg(F.min("purged_at").alias("__p"))
    out = messages.join(one, list(key), "left")
    cleared = {c: F.when(F.col("__p").isNull(), F.col(c)) for c in payload}
    return out.withColumns({**cleared, "payload_purged_at": F.col("__p"), "deleted_at": F.coalesce("deleted_at", "__p")}).drop("__p")


def fold_calls(arrivals: DataFrame, order: str = "seq") -> DataFrame:
    """Call events. While a (chat, call, type) has exactly one row, a new arrival updates it and moves its time; else it merges with the row of its time, or is added. Texts: last filled; duration: last positive. A missing call id becomes ``type:ts``."""
    named = arrivals.withColumn("call_id", F.coalesce(F.nullif(F.trim("call_id"), F.lit("")), F.concat_ws(":", "event_type", "ts")))
    keys = ["chat_jid", "call_id", "event_type"]
    rest = [c for c in named.columns if c not in (*keys, order)]
    types = dict(named.dtypes)
    lists = named.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*rest).alias("__v")))), lambda x: x["__v"]).alias("__l"))

    def merged(o: Column, n: Column) -> Column:
        pick = {c: n[c] if c == "ts" else F.when(n[c] > 0, n[c]).otherwise(o[c]) if types[c] in ("bigint", "int", "double") else F.when(_nz(n[c]), n[c]).otherwise(o[c]) if types[c] == "string" else F.coalesce(n[c], o[c]) for c in rest}
        return F.struct(*[pick[c].cast(types[c]).alias(c) for c in rest])

    def step(rows: Column, n: Column) -> Column:
        same = F.exists(rows, lambda r: r["ts"] == n["ts"])
        return F.when(F.size(rows) == 1, F.transform(rows, lambda r: merged(r, n))).when(same, F.transform(rows, lambda r: F.when(r["ts"] == n["ts"], merged(r, n)).otherwise(r))).otherwise(F.concat(rows, F.array(n)))

    state = F.aggregate(F.slice("__l", 2, F.greatest(F.size("__l") - 1, F.lit(0))), F.slice("__l", 1, 1), step)
    return lists.select(*keys, F.explode(state).alias("__s")).select(*keys, "__s.*")


def guarded_fold(arrivals: DataFrame, purges: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """The last arrival of each key that isn't purged."""
    rest = [c for c in arrivals.columns if c not in (*key, order)]
    kept = arrivals.join(purges.select(*key).distinct(), key, "left_anti")
    return kept.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__v")).select(*key, "__v.*")


# Commands


def set_columns(commands: DataFrame, key: list[str], columns: list[str], order: str = "seq") -> DataFrame:
    """The last value that a command set of each column; a null sets nothing."""
    return commands.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def chat_state(commands: DataFrame, order: str = "seq") -> DataFrame:
    """archived, pinned and muted_until of each chat by its commands. Archiving unpins what was pinned before."""
    on = lambda c: F.coalesce(F.max(F.when(F.col(c), F.col(order))), F.lit(-1))
    state = commands.groupBy("chat_jid").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in ("archived", "pinned", "muted_until")], (on("archived") > on("pinned")).alias("__unpinned"))
    return state.withColumn("pinned", F.coalesce("pinned", F.lit(False)) & ~F.col("__unpinned")).drop("__unpinned")


def standing(commands: DataFrame, key: list[str], there: str = "there", order: str = "seq") -> DataFrame:
    """Keys whose last command put them there: tags, aliases, stars."""
    return commands.groupBy(*key).agg(F.max_by(there, order).alias("__t")).filter("__t").drop("__t")


def media_marks(messages: DataFrame, downloaded: DataFrame, unavailable: DataFrame, key: str = "rowid") -> DataFrame:
    """messages after marks: a download (key, path, at) gives a path and time and takes the unavailable mark away; unavailable (key, since) sets it, unless there is a download too."""
    got = downloaded.groupBy(key).agg(F.max_by(F.struct("path", "at"), "at").alias("__got"))
    gone = unavailable.groupBy(key).agg(F.max("since").alias("__since"))
    out = messages.join(got, key, "left").join(gone, key, "left")
    marked = F.when(F.col("__got").isNull(), F.coalesce("__since", "media_unavailable_at"))
    return out.withColumns({"local_path": F.coalesce("__got.path", "local_path"), "downloaded_at": F.coalesce("__got.at", "downloaded_at") if "downloaded_at" in messages.columns else F.col("__got.at"), "media_unavailable_at": marked}).drop("__got", "__since")
