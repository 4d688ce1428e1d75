"""State changes, lifecycle, snapshots, identity and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import parse
from quernstone.functions import values as v
from quernstone.operators import aggregates as ag
from quernstone.operators import folds, hot, identity, search
from quernstone.operators import joins as jo
from quernstone.operators import reads as rd
from quernstone.plans import views
from quernstone.queries import Tables, query
from quernstone.sources.catalog import conformed

# Scans and parameters


@query("SELECT r_regionkey AS k, concat('{\"r_regionkey\":', r_regionkey, ',\"r_name\":\"', r_name, '\"}') AS json FROM region")
def sc03_scan_json(t: Tables) -> DataFrame:
    df = t("region")
    return df.select(F.col("r_regionkey").alias("k"), F.to_json(F.struct("*")).alias("json"))


@query("SELECT rowid, 'one' AS scope FROM messages WHERE chat_jid = 'c1' UNION ALL SELECT rowid, 'all' FROM messages", "messages")
def fi14_optional_parameter(t: Tables) -> DataFrame:
    parts = [rd.only(t.messages, "chat_jid", chat).select("rowid", F.lit(name).alias("scope")) for chat, name in (("c1", "one"), ("", "all"))]
    return parts[0].unionByName(parts[1])


@query("SELECT rowid FROM messages WHERE deleted_at IS NULL", "messages")
def so06_without_limit(t: Tables) -> DataFrame:
    return rd.list_messages(t.messages, limit=0).select("rowid")


@query("SELECT jid, name FROM (SELECT jid, name FROM groups WHERE updated_at % 2 = 0 UNION ALL SELECT jid, name FROM groups WHERE updated_at % 3 = 0) GROUP BY ALL", "groups")
def sc22_snapshot_refresh(t: Tables) -> DataFrame:
    g = t.groups
    arrivals = g.filter("updated_at % 2 = 0").withColumn("seq", F.lit(1)).unionByName(g.filter("updated_at % 3 = 0").withColumn("seq", F.lit(2)))
    return folds.fold_entity(arrivals.withColumn("is_parent", F.lit(False)), "groups", ["jid"]).select("jid", "name")


# States of chats, contacts, groups


def _commands(t: Tables) -> DataFrame:
    """Each event as a command on its chat."""
    return t.ledger.select("chat_jid", "seq", "event_type", "ts")


@query("""SELECT chat_jid, arg_max(event_type = 'click', seq) FILTER (WHERE event_type IN ('click', 'view')) AS archived, arg_max(CASE event_type WHEN 'purchase' THEN -1 ELSE seq END, seq) FILTER (WHERE event_type IN ('purchase', 'signup')) AS muted_until FROM ledger GROUP BY chat_jid""", "ledger")
def dm01_chat_setters(t: Tables) -> DataFrame:
    e = F.col("event_type")
    rows = _commands(t).withColumns({"archived": F.when(e.isin("click", "view"), e == "click"), "muted_until": F.when(e == "purchase", -1).when(e == "signup", F.col("seq"))})
    return folds.set_columns(rows, ["chat_jid"], ["archived", "muted_until"])


@query("SELECT chat_jid AS jid, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT chat_jid, concat('t', seq % 5) AS tag, arg_max(event_type, seq) AS what FROM ledger GROUP BY 1, 2) WHERE what <> 'error' GROUP BY 1", "ledger")
def dm02_tag_commands(t: Tables) -> DataFrame:
    rows = _commands(t).select(F.col("chat_jid").alias("jid"), F.concat(F.lit("t"), F.col("seq") % 5).alias("tag"), "seq", (F.col("event_type") != "error").alias("there"))
    return ag.tags(folds.standing(rows, ["jid", "tag"])).select("jid", F.array_join("tags", ",").alias("tags"))


@query("""WITH p AS (SELECT chat_jid, max(seq) FILTER (WHERE event_type = 'click') AS a, max(seq) FILTER (WHERE event_type = 'signup') AS b, arg_max(event_type = 'click', seq) FILTER (WHERE event_type IN ('click', 'view')) AS archived, arg_max(event_type = 'signup', seq) FILTER (WHERE event_type IN ('signup', 'purchase')) AS pinned FROM ledger GROUP BY 1)
SELECT chat_jid, archived, coalesce(pinned, false) AND NOT coalesce(a, -1) > coalesce(b, -1) AS pinned FROM p""", "ledger")
def dm01_archive_unpins(t: Tables) -> DataFrame:
    """Clicks archive, views bring back, sign-ups pin, purchases unpin."""
    e = F.col("event_type")
    rows = _commands(t).withColumns({"archived": F.when(e.isin("click", "view"), e == "click"), "pinned": F.when(e.isin("signup", "purchase"), e == "signup"), "muted_until": F.lit(None).cast("bigint")})
    return folds.chat_state(rows).select("chat_jid", "archived", "pinned")


@query("SELECT jid, 'joined' AS state, row_number() OVER (ORDER BY created_ts DESC, encode(jid)) AS place FROM groups WHERE left_at = 0 UNION ALL SELECT jid, 'left', row_number() OVER (ORDER BY left_at DESC, encode(jid)) FROM groups WHERE left_at > 0", "groups")
def dm04_group_lists(t: Tables) -> DataFrame:
    """Places in both lists."""
    parts = []
    for state, cond, by in (("joined", "left_at = 0", "created_ts"), ("left", "left_at > 0", "left_at")):
        parts.append(hot.numbered(t.groups.filter(cond), [F.col(by).desc(), F.col("jid").asc()], "place").select("jid", F.lit(state).alias("state"), "place"))
    return parts[0].unionByName(parts[1])


@query("SELECT group_jid, user_jid FROM group_participants WHERE group_jid NOT IN (SELECT jid FROM groups WHERE left_at > 0 AND left_at < 900000000)", "group_participants groups")
def dm05_group_cascade(t: Tables) -> DataFrame:
    old = t.groups.filter("left_at > 0 AND left_at < 900000000").select("jid")
    return jo.cascade(old, roster=(t.group_participants, "group_jid"))["roster"].select("group_jid", "user_jid")


@query("SELECT rowid, CASE WHEN rowid % 4 = 0 THEN concat('/got/', CAST(rowid AS varchar)) ELSE local_path END AS local_path, CASE WHEN rowid % 4 = 0 THEN NULL WHEN rowid % 4 = 1 THEN ts ELSE media_unavailable_at END AS media_unavailable_at FROM messages WHERE media_type <> ''", "messages")
def dm07_media_marks(t: Tables) -> DataFrame:
    m = t.messages.filter("media_type <> ''")
    got, gone = m.filter("rowid % 4 = 0").select("rowid", F.concat(F.lit("/got/"), "rowid").alias("path"), F.col("ts").alias("at")), m.filter("rowid % 4 = 1").select("rowid", F.col("ts").alias("since"))
    return folds.media_marks(m, got, gone).select("rowid", "local_path", "media_unavailable_at")


@query("SELECT msg_id, event_type AS text, seq FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY seq DESC) AS n FROM ledger) WHERE n = 1", "ledger")
def dm10_status_upsert(t: Tables) -> DataFrame:
    return jo.latest(t.ledger.select("msg_id", F.col("event_type").alias("text"), "seq"), ["msg_id"], ["seq"])


@query("SELECT jid, kind, name FROM (SELECT concat('c', user_id) AS jid, arg_max(event_type, event_id) AS kind, arg_max(props, event_id) FILTER (WHERE event_id % 2 = 0) AS name FROM events GROUP BY 1)")
def dm22_chat_metadata(t: Tables) -> DataFrame:
    rows = t.ledger.select(F.col("chat_jid").alias("jid"), "seq", F.col("event_type").alias("kind"), F.when(F.col("seq") % 2 == 0, F.col("raw")).otherwise("").alias("name"))
    return folds.fold_entity(rows, "chat_metadata", ["jid"])


@query("SELECT jid, CAST(NULL AS varchar) AS linked_parent_jid, name FROM groups", "groups")
def dm20_added_columns(t: Tables) -> DataFrame:
    return conformed(t.groups.drop("updated_at"), "groups").select("jid", "linked_parent_jid", "name")


@query(r"SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(string_split_regex(translate(lower(text), 'àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöøōřśšşťùúûüūůýÿžźż', 'aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorssstuuuuuuyyzzz'), '[^\p{L}\p{N}]+')) AS term FROM benchmark) WHERE term <> '' GROUP BY ALL")
def dm21_inverted_index(t: Tables) -> DataFrame:
    return search.index(t("benchmark"), ("text",), "item_id").select("item_id", "term", "tf")


# Purges


@query("SELECT chat_jid, msg_id, min(purged_at) AS purged_at FROM (SELECT chat_jid, concat('p', CAST(k % 100 AS varchar)) AS msg_id, purged_at FROM purges) GROUP BY ALL", "purges")
def st15_purge_fold(t: Tables) -> DataFrame:
    rows = t.purges.select("chat_jid", F.concat(F.lit("p"), F.col("k") % 100).alias("msg_id"), "purged_at", F.col("k").alias("seq"))
    return folds.fold_entity(rows, "purges", ["chat_jid", "msg_id"])


@query("SELECT chat_jid, msg_id, event_type AS name FROM (SELECT *, row_number() OVER (PARTITION BY chat_jid, msg_id ORDER BY seq DESC) AS n FROM ledger) WHERE n = 1 AND msg_id NOT IN (SELECT msg_id FROM ledger WHERE seq % 50 = 0)", "ledger")
def dm09_guarded_locations(t: Tables) -> DataFrame:
    gone = t.ledger.filter("seq % 50 = 0").select("msg_id").distinct()
    rows = t.ledger.select("chat_jid", "msg_id", F.col("event_type").alias("name"), "seq")
    every = rows.select("chat_jid", "msg_id").distinct().join(gone, "msg_id", "left_semi")
    return folds.guarded_fold(rows, every, ["chat_jid", "msg_id"])


# Snapshots and views


@query("""SELECT row_number() OVER (ORDER BY encode(dedup_key)) AS seq, dedup_key, payload FROM (SELECT concat('nation:', n_nationkey) AS dedup_key, concat('{"table":"nation","row":{"n_nationkey":', n_nationkey, ',"n_name":"', n_name, '","n_regionkey":', n_regionkey, '}}') AS payload FROM nation)""")
def st13_snapshot_events(t: Tables) -> DataFrame:
    return views.snapshot_events(t("nation"), "nation", ["n_nationkey"]).select("seq", "dedup_key", "payload")


def _log(t: Tables) -> DataFrame:
    """events as a log of the archive: clicks are messages, views votes, sign-ups stars, purchases polls, errors mark as read or are receipts, which name messages too."""
    e, kind = t.ledger, F.col("event_type")
    payload = (
        F.when(kind == "click", F.to_json(F.struct(F.col("raw").alias("text"), (F.col("seq") % 3 == 0).alias("from_me")))).when(kind == "view", F.to_json(F.struct(F.array(F.concat(F.lit("o"), F.col("seq") % 3)).alias("selected"), (F.col("seq") * 1000).alias("ts"))))
        .when(kind == "signup", F.to_json(F.struct((F.col("seq") % 4 > 0).alias("starred")))).when(kind == "purchase", F.to_json(F.struct(F.lit("?").alias("question"), F.array(F.lit("o0"), F.concat(F.lit("o"), F.col("seq") % 3)).alias("options"))))
    )
    name = F.when(kind == "click", "message").when(kind == "view", "vote").when(kind == "signup", "star").when(kind == "purchase", "poll").when(F.col("seq") % 2 == 0, "receipt").otherwise("mark_read")
    return e.select("seq", "source", name.alias("event_type"), "chat_jid", F.when(name != "mark_read", F.col("msg_id")).alias("msg_id"), F.concat(F.lit("s"), F.col("seq") % 5).alias("sender_jid"), F.col("ts").alias("event_ts"), F.coalesce(payload, F.lit("{}")).alias("payload"))


@query("SELECT chat_jid, msg_id, event_ts AS starred_at FROM (SELECT chat_jid, msg_id, ts AS event_ts, seq % 4 > 0 AS s, row_number() OVER (PARTITION BY chat_jid, msg_id ORDER BY seq DESC) AS n FROM ledger WHERE event_type = 'signup') WHERE n = 1 AND s", "ledger")
def st12_star_view(t: Tables) -> DataFrame:
    return views.starred(_log(t)).select("chat_jid", "msg_id", "starred_at")


@query("SELECT chat_jid, msg_id AS poll_msg_id, concat('s', seq % 5) AS voter_jid, concat('o', seq % 3) AS choice FROM (SELECT *, row_number() OVER (PARTITION BY chat_jid, msg_id, seq % 5 ORDER BY seq DESC) AS n FROM ledger WHERE event_type = 'view') WHERE n = 1", "ledger")
def st11_vote_view(t: Tables) -> DataFrame:
    return views.votes(_log(t)).select("chat_jid", "poll_msg_id", "voter_jid", F.array_join("selected", ",").alias("choice"))


@query("""WITH e AS (SELECT *, event_type = 'click' AND row_number() OVER (PARTITION BY chat_jid, event_type = 'error', CASE WHEN event_type = 'click' THEN msg_id END ORDER BY seq) = 1 AND source = 'live' AND seq % 3 <> 0 AS plus FROM ledger WHERE event_type IN ('click', 'error')),
r AS (SELECT chat_jid, max(seq) FILTER (WHERE event_type = 'error') AS s FROM e GROUP BY chat_jid)
SELECT e.chat_jid AS jid, CAST(sum(CASE WHEN plus AND seq > coalesce(s, -1) THEN 1 ELSE 0 END) AS bigint) AS unread_count FROM e JOIN r ON e.chat_jid = r.chat_jid GROUP BY 1""", "ledger")
def st31_unread_view(t: Tables) -> DataFrame:
    return views.unread(_log(t)).select(F.col("chat_jid").alias("jid"), "unread_count")


@query("SELECT chat_jid AS jid, 'unknown' AS kind, max(CASE WHEN event_type = 'click' THEN ts ELSE 0 END) AS last_message_ts FROM ledger WHERE event_type IN ('click', 'error') GROUP BY 1", "ledger")
def st08_chat_view(t: Tables) -> DataFrame:
    return views.chats(_log(t)).select("jid", "kind", "last_message_ts")


@query("""SELECT 'messages' AS "view", count(DISTINCT (chat_jid, msg_id)) AS n FROM ledger WHERE event_type = 'click' UNION ALL SELECT 'chats', count(DISTINCT chat_jid) FROM ledger WHERE event_type IN ('click', 'error')
UNION ALL SELECT 'polls', count(DISTINCT (chat_jid, msg_id)) FROM ledger WHERE event_type = 'purchase' UNION ALL SELECT 'poll_votes', count(DISTINCT (chat_jid, msg_id, seq % 5)) FROM ledger WHERE event_type = 'view'
UNION ALL SELECT 'starred', count(*) FROM (SELECT arg_max(seq % 4, seq) AS s FROM ledger WHERE event_type = 'signup' GROUP BY chat_jid, msg_id) WHERE s > 0""", "ledger")
def st06_rebuild(t: Tables) -> DataFrame:
    """Rows of each rebuilt view."""
    made = views.rebuild(_log(t))
    parts = [made[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n") for name in ("messages", "chats", "polls", "poll_votes", "starred")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Identity


@query("""WITH i AS (SELECT jid AS lid, concat('p', unread_count) AS pn FROM chats WHERE last_message_ts % 3 = 0), m AS (SELECT coalesce(i.pn, chat_jid) AS chat_jid, concat('m', CAST(rowid % 50 AS varchar)) AS msg_id, ts, is_forwarded AS edited FROM messages LEFT JOIN i ON chat_jid = i.lid)
SELECT chat_jid, msg_id, max(ts) AS ts, bool_or(edited) AS edited FROM m GROUP BY 1, 2""", "chats messages")
def dm24_merge_messages(t: Tables) -> DataFrame:
    known = t.chats.filter("last_message_ts % 3 = 0").select(F.col("jid").alias("lid"), F.concat(F.lit("p"), "unread_count").alias("pn"))
    rows = t.messages.select("chat_jid", F.concat(F.lit("m"), F.col("rowid") % 50).alias("msg_id"), "ts", F.col("is_forwarded").alias("edited"))
    return identity.merge_messages(rows, known)


@query("""WITH r AS (SELECT group_jid, concat('u', updated_at % 9) AS user_jid, role, updated_at FROM group_participants) SELECT group_jid, user_jid, arg_max(role, updated_at) AS role, max(updated_at) AS updated_at FROM r GROUP BY 1, 2""", "group_participants")
def dm11_merge_roster(t: Tables) -> DataFrame:
    known = t.group_participants.select(F.col("user_jid").alias("lid"), F.concat(F.lit("u"), F.col("updated_at") % 9).alias("pn"))
    return identity.merge_roster(t.group_participants, known)


_LED = """i AS (SELECT jid AS lid, concat('c', last_message_ts % 40) AS pn FROM chats WHERE last_message_ts % 3 = 0),
g AS (SELECT coalesce(pn, chat_jid) AS chat_jid, concat('m', k % 5) AS msg_id, CAST(coalesce(pn, chat_jid) = chat_jid AS int) AS own, purged_at, CASE k % 4 WHEN 0 THEN '' ELSE concat('r', k % 3) END AS reason, k FROM purges LEFT JOIN i ON chat_jid = lid WHERE k % 7 = 0)"""


def _led(t: Tables) -> DataFrame:
    """Every third chat is another's hidden id."""
    return t.chats.filter("last_message_ts % 3 = 0").select(F.col("jid").alias("lid"), F.concat(F.lit("c"), F.col("last_message_ts") % 40).alias("pn"))


def _purged(t: Tables) -> DataFrame:
    reason = F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("r"), F.col("k") % 3))
    return t.purges.filter("k % 7 = 0").select("chat_jid", F.concat(F.lit("m"), F.col("k") % 5).alias("msg_id"), "purged_at", (F.col("purged_at") - F.col("k") % 9).alias("deleted_at"), reason.alias("deletion_reason"))


@query(f"WITH {_LED} SELECT chat_jid, msg_id, min(purged_at) AS purged_at, min(purged_at - k % 9) AS deleted_at, arg_min(reason, concat(1 - own, reason)) FILTER (reason <> '') AS deletion_reason FROM g GROUP BY 1, 2", "chats purges")
def dm11_merge_purges(t: Tables) -> DataFrame:
    return identity.merge_purges(_purged(t), _led(t))


@query(f"""WITH {_LED}, m AS (SELECT coalesce(pn, chat_jid) AS chat_jid, concat('m', rowid % 5) AS msg_id, CAST(coalesce(pn, chat_jid) = chat_jid AS int) AS own, local_path, CASE WHEN rowid % 3 > 0 THEN ts END AS got FROM messages LEFT JOIN i ON chat_jid = lid WHERE local_path <> '')
SELECT chat_jid, msg_id, local_path, coalesce(min(got) FILTER (own = 1), min(got)) AS downloaded_at FROM m GROUP BY 1, 2, 3""", "chats purges messages")
def dm11_merge_media_aliases(t: Tables) -> DataFrame:
    rows = t.messages.filter("local_path <> ''").select("chat_jid", F.concat(F.lit("m"), F.col("rowid") % 5).alias("msg_id"), "local_path", F.when(F.col("rowid") % 3 > 0, F.col("ts")).alias("downloaded_at"))
    return identity.merge_media_aliases(rows, _led(t))


@query(f"""WITH {_LED}, m AS (SELECT coalesce(pn, chat_jid) AS chat_jid, concat('m', rowid % 5) AS msg_id, CAST(coalesce(pn, chat_jid) = chat_jid AS int) AS own, rowid, CASE WHEN rowid % 4 > 0 THEN sender_jid ELSE '' END AS name FROM messages LEFT JOIN i ON chat_jid = lid)
SELECT chat_jid, msg_id, CAST(arg_min(rowid, own * 1000000000000 + rowid) AS double) AS latitude, arg_min(name, concat(own, name)) FILTER (name <> '') AS name FROM m ANTI JOIN g USING (chat_jid, msg_id) GROUP BY 1, 2""", "chats purges messages")
def dm24_merge_locations(t: Tables) -> DataFrame:
    number = F.col("rowid").cast("double")
    rows = t.messages.select(
        "chat_jid", F.concat(F.lit("m"), F.col("rowid") % 5).alias("msg_id"), number.alias("latitude"), (-number).alias("longitude"), F.when(F.col("rowid") % 4 > 0, F.col("sender_jid")).otherwise("").alias("name"), F.lit("").alias("address"), F.lit(False).alias("is_live")
    )
    return identity.merge_locations(rows, _led(t), _purged(t)).select("chat_jid", "msg_id", "latitude", "name")


@query(f"""WITH {_LED}, m AS (SELECT coalesce(i.pn, p.chat_jid) AS chat_jid, concat('m', k % 5) AS msg_id, CAST(coalesce(i.pn, p.chat_jid) = p.chat_jid AS int) AS own, coalesce(j.pn, concat('c', k % 90)) AS sender, question, selectable_count AS n, created_ts, concat('o', k % 4) AS o
  FROM polls p LEFT JOIN i ON p.chat_jid = i.lid LEFT JOIN i j ON concat('c', k % 90) = j.lid),
o AS (SELECT chat_jid, msg_id, string_agg(o, ',' ORDER BY place) AS options FROM (SELECT chat_jid, msg_id, o, min(concat(own, '|', question, '|', n, '|', o)) AS place FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT m.chat_jid, m.msg_id, arg_min(sender, concat(own, sender)) AS sender_jid, arg_min(question, concat(own, question)) AS question, any_value(options) AS options, max(created_ts) AS created_ts
FROM m JOIN o ON m.chat_jid = o.chat_jid AND m.msg_id = o.msg_id WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.chat_jid = m.chat_jid AND g.msg_id = m.msg_id) GROUP BY 1, 2""", "chats purges polls")
def dm24_merge_polls(t: Tables) -> DataFrame:
    rows = t.polls.select(
        "chat_jid", F.concat(F.lit("m"), F.col("k") % 5).alias("msg_id"), F.concat(F.lit("c"), F.col("k") % 90).alias("sender_jid"), "question", F.array(F.concat(F.lit("o"), F.col("k") % 4)).alias("options"), "selectable_count", "created_ts"
    )
    return identity.merge_polls(rows, _led(t), _purged(t)).select("chat_jid", "msg_id", "sender_jid", "question", F.array_join("options", ",").alias("options"), "created_ts")


# Parsing


@query("SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'a,k' WHEN 1 THEN 'k' ELSE '' END AS left_over FROM events")
def pa04_unhandled(t: Tables) -> DataFrame:
    n = F.col("event_id") % 3
    return t("events").select(F.col("event_id").alias("seq"), parse.unhandled({"k": F.when(n < 2, 1), "a": F.when(n == 0, 1)}).alias("left_over"))


@query("SELECT event_id AS seq, props AS inner_text FROM events")
def pa02_unwrapping(t: Tables) -> DataFrame:
    inner = F.col("props")
    wrapped = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"edited":{"message":'), inner, F.lit("}}"))).otherwise(F.concat(F.lit('{"device":{"message":{"edited":{"message":'), inner, F.lit("}}}}")))
    return t("events").select(F.col("event_id").alias("seq"), F.regexp_replace(parse.unwrapped(wrapped, ("device", "edited")), ":", ": ").alias("inner_text"))


@query("SELECT p_partkey AS k, concat(p_name, chr(10), '[', p_brand, ']') AS text FROM part")
def pa12_interactive_text(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("k"), parse.interactive_text(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("text"))


@query("SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'missed' WHEN 1 THEN 'missed' ELSE event_type END AS outcome FROM events")
def pa05_call_outcome(t: Tables) -> DataFrame:
    n = F.col("event_id") % 4
    return t("events").select(F.col("event_id").alias("seq"), parse.call_outcome(F.when(n == 0, " No-Answer").when(n == 1, "TIMEOUT").otherwise(F.col("event_type"))).alias("outcome"))


@query("SELECT e.seq, coalesce(c.name, e.chat_jid) AS chat_name, e.event_type FROM ledger e LEFT JOIN chats c ON e.chat_jid = c.jid WHERE e.event_type = 'click'", "ledger chats")
def pa16_subscriber_payload(t: Tables) -> DataFrame:
    names = t.chats.select(F.col("jid").alias("chat_jid"), "name")
    return t.ledger.filter("event_type = 'click'").join(names, "chat_jid", "left").select("seq", v.filled(F.col("name"), F.col("chat_jid")).alias("chat_name"), "event_type")
