"""Scans, filters, joins, aggregates, orders and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import values as v
from quernstone.operators import aggregates as ag
from quernstone.operators import hot
from quernstone.operators import joins as jo
from quernstone.operators import reads as rd
from quernstone.queries import Tables, query

NOW = 1_600_000_000
MID, LATE = 820_000_000, 850_000_000
SOME = "chat_jid IN ('c1', 'c2', 'c3', 'c5', 'c8', 'c13', 'c21', 'c34')"
ANCHORS = "rowid % 97 = 0"


def _m(df: DataFrame) -> DataFrame:
    return df.select("chat_jid", "msg_id", "rowid", "ts")


# Scans


@query("SELECT seq, chat_jid, event_type FROM ledger WHERE seq > 100 AND seq <= 900", "ledger")
def sc04_log_tail(t: Tables) -> DataFrame:
    return t.ledger.filter("seq > 100 AND seq <= 900").select("seq", "chat_jid", "event_type")


@query("SELECT m.msg_id, m.ts, c.name AS chat_name, m.deleted_at, s.msg_id IS NOT NULL AS starred FROM messages m LEFT JOIN chats c ON m.chat_jid = c.jid LEFT JOIN (SELECT * FROM starred WHERE k % 9 = 0) s ON m.chat_jid = s.chat_jid AND m.msg_id = s.msg_id WHERE m.rowid = 34", "messages chats starred")
def sc05_get_message(t: Tables) -> DataFrame:
    one = t.messages.filter("rowid = 34")
    return rd.with_dimensions(one, t.chats, t.starred.filter("k % 9 = 0")).select("msg_id", "ts", "chat_name", "deleted_at", "starred")


@query("SELECT jid, kind, name, pinned FROM chats WHERE jid = 'c7'", "chats")
def sc06_get_chat(t: Tables) -> DataFrame:
    return t.chats.filter("jid = 'c7'").select("jid", "kind", "name", "pinned")


@query("SELECT e.seq, 'json' AS encoding, e.raw AS raw_text FROM ledger e JOIN (SELECT seq FROM ledger WHERE seq % 5 > 0) r ON e.seq = r.seq", "ledger")
def sc07_raw_lookup(t: Tables) -> DataFrame:
    raw = t.ledger.filter("seq % 5 > 0").select("seq", F.lit("json").alias("encoding"), F.col("raw").alias("raw_text"))
    return rd.raw_of(t.ledger, raw, "seq")


@query("SELECT rowid, msg_id FROM messages WHERE rowid > 50 AND deleted_at IS NULL ORDER BY rowid LIMIT 200", "messages")
def sc08_row_cursor(t: Tables) -> DataFrame:
    return rd.after_cursor(t.messages, 50, 200).select("rowid", "msg_id")


@query("SELECT count(*) AS pages, CAST(sum(length(html)) AS bigint) AS chars FROM pages WHERE octet_length(encode(html)) <= 1048576")
def sc12_page_cap(t: Tables) -> DataFrame:
    return t("pages").filter(F.octet_length("html") <= 1 << 20).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query("SELECT jid, name FROM (SELECT jid, CASE WHEN name <> '' THEN name END AS name FROM groups WHERE left_at = 0) g WHERE NOT EXISTS (SELECT 1 FROM groups s WHERE s.jid = g.jid AND s.updated_at % 4 > 0)", "groups")
def sc22_absent_from_snapshot(t: Tables) -> DataFrame:
    return jo.missing_from(t.groups, t.groups.filter("updated_at % 4 > 0"), "jid", 1).select("jid", "name")


# Filters


@query("SELECT rowid, chat_jid, coalesce(sender_name, '') AS sender_name, coalesce(text, '') AS text, coalesce(deleted_at, 0) AS deleted_at FROM messages", "messages")
def fi01_projection(t: Tables) -> DataFrame:
    return t.messages.select("rowid", "chat_jid", v.shown(F.col("sender_name")).alias("sender_name"), v.shown(F.col("text")).alias("text"), v.shown(F.col("deleted_at"), 0).alias("deleted_at"))


@query("SELECT rowid FROM messages WHERE deleted_at IS NULL", "messages")
def fi02_tombstones(t: Tables) -> DataFrame:
    return rd.live(t.messages).select("rowid")


@query(f"SELECT rowid, ts FROM messages WHERE ts > {MID} AND ts < {LATE}", "messages")
def fi03_time_bounds(t: Tables) -> DataFrame:
    return rd.between(t.messages, MID, LATE).select("rowid", "ts")


@query("SELECT rowid, chat_jid FROM messages WHERE chat_jid IN ('c1', 'c2', 'c4')", "messages")
def fi04_set_filter(t: Tables) -> DataFrame:
    return rd.only(t.messages, "chat_jid", [" c1", "c2", "", "c1", "c4 "]).select("rowid", "chat_jid")


@query("SELECT jid FROM chats WHERE archived AND NOT pinned", "chats")
def fi05_tri_state(t: Tables) -> DataFrame:
    return rd.flagged(t.chats, archived=True, pinned=False, unread=None).select("jid")


@query(f"SELECT jid, muted_until, muted_until = -1 OR muted_until > {NOW} AS muted FROM chats WHERE muted_until = -1 OR muted_until > {NOW} OR muted_until = 0 OR muted_until BETWEEN 1 AND {NOW}", "chats")
def fi06_muted(t: Tables) -> DataFrame:
    until, now = F.col("muted_until"), F.lit(NOW)
    return t.chats.filter(v.is_muted(until, now) | v.is_unmuted(until, now)).select("jid", "muted_until", v.is_muted(until, now).alias("muted"))


@query("SELECT rowid, 'document' AS kind FROM messages WHERE deleted_at IS NULL AND media_type = 'document' UNION ALL SELECT rowid, 'text' FROM messages WHERE deleted_at IS NULL AND media_type = ''", "messages")
def fi07_media_type(t: Tables) -> DataFrame:
    parts = [rd.of_type(rd.live(t.messages), kind).select("rowid", F.lit(kind).alias("kind")) for kind in ("document", "text")]
    return parts[0].unionByName(parts[1])


@query("SELECT m.rowid FROM messages m WHERE m.deleted_at IS NULL AND m.is_forwarded AND EXISTS (SELECT 1 FROM starred s WHERE s.k % 5 < 2 AND s.chat_jid = m.chat_jid AND s.msg_id = m.msg_id)", "messages starred")
def fi08_forwarded_starred(t: Tables) -> DataFrame:
    return rd.filtered(t.messages, t.starred.filter("k % 5 < 2"), forwarded=True, only_starred=True).select("rowid")


@query("""SELECT m.rowid FROM messages m LEFT JOIN chats c ON m.chat_jid = c.jid WHERE m.deleted_at IS NULL AND
  (contains(lower(coalesce(m.text, '')), '100% of _1') OR contains(lower(coalesce(m.display_text, '')), '100% of _1') OR contains(lower(coalesce(m.media_caption, '')), '100% of _1') OR contains(lower(coalesce(m.filename, '')), '100% of _1')
   OR contains(lower(coalesce(m.sender_name, '')), '100% of _1') OR contains(lower(coalesce(c.name, '')), '100% of _1'))""", "messages chats")
def fi09_like_search(t: Tables) -> DataFrame:
    return rd.search_like(t.messages, t.chats, "100% OF _1", limit=0).select("rowid")


@query("SELECT jid FROM contacts WHERE contains(lower(concat_ws('|', alias, system_name, full_name, push_name, business_name, first_name, phone, jid)), 'ltd')", "contacts")
def fi10_contact_search(t: Tables) -> DataFrame:
    return rd.contacts_search(t.contacts, "LTD", limit=0).select("jid")


@query("SELECT jid, suffix(jid, '7') AS ends FROM chats WHERE NOT suffix(jid, '0')", "chats")
def fi11_suffix(t: Tables) -> DataFrame:
    return t.chats.filter(~F.col("jid").endswith("0")).select("jid", F.col("jid").endswith("7").alias("ends"))


@query("SELECT rowid FROM messages WHERE deleted_at IS NULL AND media_type <> '' AND direct_path <> '' AND media_key_length > 0 AND local_path = '' AND coalesce(media_unavailable_at, 0) = 0", "messages")
def fi12_pending_media(t: Tables) -> DataFrame:
    return rd.pending_media(t.messages).select("rowid")


@query("SELECT rowid FROM messages WHERE ts > 820454400 OR (ts = 820454400 AND rowid > 5000)", "messages")
def fi13_row_value(t: Tables) -> DataFrame:
    return t.messages.filter(F.struct("ts", "rowid") > F.struct(F.lit(820454400).cast("bigint"), F.lit(5000).cast("bigint"))).select("rowid")


@query("SELECT jid, CASE WHEN trim(full_name) <> '' THEN trim(full_name) END AS full_name FROM contacts", "contacts")
def fi15_stored_keys(t: Tables) -> DataFrame:
    return t.contacts.select("jid", v.stored(F.col("full_name")).alias("full_name"))


# Joins


@query("SELECT m.rowid, coalesce(c.name, '') AS chat_name, s.msg_id IS NOT NULL AS starred FROM messages m LEFT JOIN (SELECT * FROM chats WHERE NOT pinned) c ON m.chat_jid = c.jid LEFT JOIN (SELECT * FROM starred WHERE k % 3 = 0) s ON m.chat_jid = s.chat_jid AND m.msg_id = s.msg_id", "messages chats starred")
def jo01_dimensions(t: Tables) -> DataFrame:
    return rd.with_dimensions(t.messages, t.chats.filter("NOT pinned"), t.starred.filter("k % 3 = 0")).select("rowid", "chat_name", "starred")


@query("SELECT m.rowid, s.starred_at FROM messages m JOIN starred s ON m.chat_jid = s.chat_jid AND m.msg_id = s.msg_id WHERE s.k % 3 = 0 AND m.deleted_at IS NULL ORDER BY s.starred_at DESC, m.rowid DESC LIMIT 50", "messages starred")
def jo02_starred_list(t: Tables) -> DataFrame:
    rows = rd.live(t.messages).select("rowid", *rd.MESSAGE_KEY).join(t.starred.filter("k % 3 = 0"), rd.MESSAGE_KEY)
    return rows.orderBy(F.col("starred_at").desc(), F.col("rowid").desc()).limit(50).select("rowid", "starred_at")


@query("SELECT rowid, lead(msg_id) OVER w AS next_msg_id, lead(ts) OVER w AS next_ts FROM messages WINDOW w AS (PARTITION BY chat_jid ORDER BY ts, rowid)", "messages")
def jo03_next_message(t: Tables) -> DataFrame:
    return rd.next_messages(_m(t.messages)).select("rowid", "next_msg_id", "next_ts")


@query(f"""WITH a AS (SELECT * FROM messages WHERE {ANCHORS}),
b AS (SELECT a.msg_id AS anchor, m.msg_id, m.ts, m.rowid, -row_number() OVER (PARTITION BY a.rowid ORDER BY m.ts DESC, m.rowid DESC) AS o FROM a JOIN messages m ON a.chat_jid = m.chat_jid AND m.deleted_at IS NULL AND (m.ts < a.ts OR (m.ts = a.ts AND m.rowid < a.rowid))),
f AS (SELECT a.msg_id AS anchor, m.msg_id, m.ts, m.rowid, row_number() OVER (PARTITION BY a.rowid ORDER BY m.ts, m.rowid) AS o FROM a JOIN messages m ON a.chat_jid = m.chat_jid AND m.deleted_at IS NULL AND (m.ts > a.ts OR (m.ts = a.ts AND m.rowid > a.rowid)))
SELECT anchor, CAST(o AS bigint) AS o, msg_id, ts FROM b WHERE o >= -3 UNION ALL SELECT anchor, CAST(o AS bigint), msg_id, ts FROM f WHERE o <= 2 UNION ALL SELECT msg_id, 0, msg_id, ts FROM a""", "messages")
def jo04_context(t: Tables) -> DataFrame:
    m = t.messages.select("chat_jid", "msg_id", "rowid", "ts", "deleted_at")
    return rd.context(m, m.filter(ANCHORS), 3, 2).select("anchor", F.col("offset").cast("bigint").alias("o"), "msg_id", "ts")


@query("SELECT m.rowid, m.chat_jid FROM messages m WHERE NOT EXISTS (SELECT 1 FROM chats c WHERE c.jid = m.chat_jid AND NOT c.pinned)", "messages chats")
def jo05_orphans(t: Tables) -> DataFrame:
    return jo.missing(t.messages, t.chats.filter("NOT pinned"), [("chat_jid", "jid")]).select("rowid", "chat_jid")


@query("SELECT p.msg_id FROM polls p WHERE NOT EXISTS (SELECT 1 FROM purges q WHERE q.k % 4 = 0 AND q.chat_jid = p.chat_jid AND q.msg_id = p.msg_id)", "polls purges")
def jo06_purge_guard(t: Tables) -> DataFrame:
    return jo.guarded(t.polls, t.purges.filter("k % 4 = 0"), [("chat_jid", "chat_jid"), ("msg_id", "msg_id")]).select("msg_id")


@query("SELECT m.msg_id, m.media_type FROM messages m WHERE media_type <> '' AND EXISTS (SELECT 1 FROM purges q WHERE q.k % 4 = 0 AND q.chat_jid = m.chat_jid AND q.msg_id = m.msg_id)", "messages purges")
def jo07_purged_media(t: Tables) -> DataFrame:
    return jo.purged(t.messages.filter("media_type <> ''"), t.purges.filter("k % 4 = 0"), rd.MESSAGE_KEY).select("msg_id", "media_type")


@query("SELECT 'messages' AS child, count(*) AS n FROM messages WHERE chat_jid NOT IN (SELECT jid FROM chats WHERE pinned) UNION ALL SELECT 'polls', count(*) FROM polls WHERE chat_jid NOT IN (SELECT jid FROM chats WHERE pinned)", "messages polls chats")
def jo08_cascade(t: Tables) -> DataFrame:
    kept = jo.cascade(t.chats.filter("pinned").select("jid"), messages=(t.messages, "chat_jid"), polls=(t.polls, "chat_jid"))
    a, b = (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n") for name, df in kept.items())
    return a.unionByName(b)


@query("SELECT p.msg_id, p.created_ts FROM polls p LEFT JOIN (SELECT * FROM messages WHERE rowid % 3 > 0) m ON p.chat_jid = m.chat_jid AND p.msg_id = m.msg_id WHERE (m.msg_id IS NULL OR m.deleted_at IS NULL) AND NOT EXISTS (SELECT 1 FROM purges q WHERE q.k % 7 = 0 AND q.chat_jid = p.chat_jid AND q.msg_id = p.msg_id)", "polls messages purges")
def jo09_visible_polls(t: Tables) -> DataFrame:
    return rd.visible_polls(t.polls, t.messages.filter("rowid % 3 > 0"), t.purges.filter("k % 7 = 0")).select("msg_id", "created_ts")


@query("""WITH a AS (SELECT jid, name, left_at FROM groups WHERE updated_at % 9 > 0), b AS (SELECT jid, CASE WHEN updated_at % 8 = 0 THEN concat(name, '!') ELSE name END AS name, CASE WHEN updated_at % 16 = 0 THEN NULL ELSE left_at END AS left_at FROM groups WHERE updated_at % 7 > 0)
SELECT coalesce(a.jid, b.jid) AS jid, CASE WHEN b.jid IS NULL THEN 'missing' WHEN a.jid IS NULL THEN 'extra' ELSE 'changed' END AS change,
  CASE WHEN a.jid IS NULL OR b.jid IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.name IS DISTINCT FROM b.name THEN 'name' END, CASE WHEN a.left_at IS DISTINCT FROM b.left_at THEN 'left_at' END) END AS "columns"
FROM a FULL JOIN b ON a.jid = b.jid WHERE a.jid IS NULL OR b.jid IS NULL OR a.name IS DISTINCT FROM b.name OR a.left_at IS DISTINCT FROM b.left_at""", "groups")
def jo12_keyed_diff(t: Tables) -> DataFrame:
    a = t.groups.filter("updated_at % 9 > 0").select("jid", "name", "left_at")
    b = t.groups.filter("updated_at % 7 > 0").selectExpr("jid", "CASE WHEN updated_at % 8 = 0 THEN concat(name, '!') ELSE name END AS name", "CASE WHEN updated_at % 16 = 0 THEN NULL ELSE left_at END AS left_at")
    return jo.keyed_diff(a, b, ["jid"]).drop("table")


@query("""WITH a AS (SELECT sender_jid, media_type, count(*) AS n FROM messages WHERE rowid % 5 > 0 GROUP BY ALL), b AS (SELECT sender_jid, media_type, count(*) AS n FROM messages WHERE rowid % 7 > 0 GROUP BY ALL)
SELECT coalesce(a.sender_jid, b.sender_jid) AS sender_jid, coalesce(a.media_type, b.media_type) AS media_type, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM a FULL JOIN b ON a.sender_jid = b.sender_jid AND a.media_type = b.media_type WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""", "messages")
def jo13_multiset_diff(t: Tables) -> DataFrame:
    return jo.multiset_diff(t.messages.filter("rowid % 5 > 0"), t.messages.filter("rowid % 7 > 0"), ["sender_jid", "media_type"])


@query("""WITH phones AS (SELECT s_suppkey AS pos, 0 AS k, s_name AS name, concat('0049-', CAST(1000000 + s_suppkey * 7 AS varchar(20))) AS phone FROM supplier UNION ALL SELECT s_suppkey, 1, s_name, concat('49', CAST(1000000 + s_suppkey * 3 AS varchar(20))) FROM supplier),
keyed AS (SELECT *, regexp_replace(regexp_replace(phone, '[^0-9]', '', 'g'), '^00', '') AS phone_key FROM phones),
first AS (SELECT phone_key, arg_min(name, pos * 10 + k) AS import_name FROM keyed WHERE length(phone_key) >= 7 GROUP BY phone_key),
own AS (SELECT jid, system_name, regexp_replace(phone, '[^0-9]', '', 'g') AS phone_key FROM contacts)
SELECT jid, import_name, CASE WHEN o.phone_key = '' THEN 'no_phone' WHEN import_name IS NULL THEN 'no_match' WHEN system_name = import_name THEN 'same' ELSE 'matched' END AS class FROM own o LEFT JOIN first f ON o.phone_key = f.phone_key""", "contacts")
def jo14_phone_import(t: Tables) -> DataFrame:
    imported = t("supplier").selectExpr("s_suppkey AS pos", "s_name AS name", "array(concat('0049-', CAST(1000000 + s_suppkey * 7 AS string)), concat('49', CAST(1000000 + s_suppkey * 3 AS string))) AS phones")
    return jo.phone_matches(t.contacts, imported, v.phone_key).select("jid", "import_name", "class")


@query("SELECT m.rowid, coalesce(i.pn, m.chat_jid) AS chat_jid FROM messages m LEFT JOIN (SELECT jid AS lid, phone AS pn FROM contacts WHERE updated_at % 30 = 0) i ON m.chat_jid = i.lid", "messages contacts")
def jo15_canonical_ids(t: Tables) -> DataFrame:
    known = t.contacts.filter("updated_at % 30 = 0").select(F.col("jid").alias("lid"), F.col("phone").alias("pn"))
    return jo.canonical(t.messages.select("rowid", "chat_jid"), "chat_jid", known)


@query("""WITH votes AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'c0' ELSE chat_jid END AS chat_jid, concat('m', CAST(k % 200 AS varchar(20))) AS poll_msg_id FROM polls), p AS (SELECT chat_jid, concat('m', CAST(k % 200 AS varchar(20))) AS msg_id, max(created_ts) AS created_ts FROM polls GROUP BY ALL),
n AS (SELECT msg_id, arg_max(chat_jid, (created_ts, chat_jid)) AS chat_jid, max(created_ts) AS created_ts FROM p GROUP BY msg_id)
SELECT v.k, coalesce(p.chat_jid, n.chat_jid) AS poll_chat_jid, coalesce(p.created_ts, n.created_ts) AS poll_created_ts, p.chat_jid IS NOT NULL AS exact FROM votes v LEFT JOIN p ON v.chat_jid = p.chat_jid AND v.poll_msg_id = p.msg_id LEFT JOIN n ON v.poll_msg_id = n.msg_id""", "polls")
def jo17_vote_fallback(t: Tables) -> DataFrame:
    votes = t.polls.selectExpr("k", "CASE WHEN k % 3 = 0 THEN 'c0' ELSE chat_jid END AS chat_jid", "concat('m', k % 200) AS poll_msg_id")
    polls = t.polls.selectExpr("chat_jid", "concat('m', k % 200) AS msg_id", "created_ts").groupBy("chat_jid", "msg_id").agg(F.max("created_ts").alias("created_ts"))
    return jo.with_fallback(votes, polls).select("k", "poll_chat_jid", "poll_created_ts", "exact")


@query("""WITH s(jid, name, kind_rank, score) AS (
  SELECT jid, system_name, 0, CASE WHEN lower(system_name) = '{q}' THEN 100 WHEN prefix(lower(system_name), '{q}') THEN 60 WHEN regexp_matches(lower(system_name), '(^|\\s){q}') THEN 30 WHEN contains(lower(system_name), '{q}') THEN 10 ELSE 0 END FROM contacts UNION ALL
  SELECT jid, name, 2, CASE WHEN lower(name) = '{q}' THEN 100 WHEN prefix(lower(name), '{q}') THEN 60 WHEN regexp_matches(lower(name), '(^|\\s){q}') THEN 30 WHEN contains(lower(name), '{q}') THEN 10 ELSE 0 END FROM chats),
r AS (SELECT *, row_number() OVER (PARTITION BY jid ORDER BY score DESC, kind_rank) AS n FROM s WHERE score > 0)
SELECT jid, name, kind_rank, score FROM r WHERE n = 1 ORDER BY score DESC, kind_rank, lower(name), jid LIMIT 40""".replace("{q}", "customer#0000000"), "contacts chats")
def jo19_resolve(t: Tables) -> DataFrame:
    q = "Customer#0000000"
    a = t.contacts.select("jid", F.col("system_name").alias("name"), F.lit("").alias("detail"), F.lit(0).alias("kind_rank"), v.match_score(q, F.col("system_name")).alias("score"))
    b = t.chats.select("jid", "name", F.lit("").alias("detail"), F.lit(2).alias("kind_rank"), v.match_score(q, F.col("name")).alias("score"))
    return jo.best_candidates(a, b, limit=40).drop("detail")


# Aggregates


@query("SELECT count(*) AS messages, coalesce(max(ts), 0) AS last_message_ts, (SELECT count(*) FROM chats) AS chats, (SELECT count(*) FROM contacts) AS contacts, (SELECT count(*) FROM groups) AS groups FROM messages", "messages chats contacts groups")
def ag02_store_stats(t: Tables) -> DataFrame:
    return ag.store_stats(t.messages, t.chats, t.contacts, t.groups)


@query("SELECT count(*) AS joined, (SELECT count(*) FROM groups WHERE left_at > 0) AS gone, (SELECT count(*) FROM contacts WHERE system_name <> '') AS named FROM groups WHERE left_at = 0", "groups contacts")
def ag01_counts(t: Tables) -> DataFrame:
    g = t.groups.agg(F.count_if(F.col("left_at") == 0).alias("joined"), F.count_if(F.col("left_at") > 0).alias("gone"))
    return g.join(F.broadcast(t.contacts.agg(F.count_if(F.col("system_name") != "").alias("named"))), F.lit(True))


@query("""SELECT c.jid, c.name, c.kind, count(m.rowid) AS message_count, coalesce(min(m.ts), 0) AS oldest_ts, coalesce(max(m.ts), 0) AS newest_ts, CASE WHEN count(m.rowid) > 0 THEN 'ready' ELSE 'blocked' END AS status
FROM chats c LEFT JOIN messages m ON c.jid = m.chat_jid GROUP BY c.jid, c.name, c.kind""", "chats messages")
def ag03_history_coverage(t: Tables) -> DataFrame:
    return ag.coverage(t.chats, t.messages, include_blocked=True)


@query(f"""WITH a AS (SELECT c.jid, greatest(coalesce(max(m.ts), 0), coalesce(c.last_message_ts, 0)) AS activity_ts FROM chats c LEFT JOIN messages m ON c.jid = m.chat_jid GROUP BY c.jid, c.last_message_ts) SELECT * FROM a WHERE activity_ts > 0 AND activity_ts < {LATE}""", "chats messages")
def ag04_stale_chats(t: Tables) -> DataFrame:
    return ag.stale_chats(t.chats, t.messages, LATE).select("jid", "activity_ts")


@query(f"""WITH c AS (SELECT concat('g', CAST(c_custkey AS varchar(20))) AS jid, 700000000 + c_custkey AS last FROM customer), m AS (SELECT concat('g', CAST(o_custkey AS varchar(20))) AS chat, max(CAST(floor(epoch(o_orderdate)) AS bigint)) AS ts FROM orders GROUP BY 1),
a AS (SELECT c.jid, greatest(coalesce(m.ts, 0), last) AS activity_ts FROM c LEFT JOIN m ON c.jid = m.chat)
SELECT g.jid, CASE WHEN left_at > 0 THEN left_at ELSE coalesce(activity_ts, 0) END AS order_ts FROM groups g LEFT JOIN a ON g.jid = a.jid WHERE (left_at > 0 AND left_at < 900000000) OR (left_at = 0 AND activity_ts > 0 AND activity_ts < 900000000)""", "groups")
def ag05_prunable_groups(t: Tables) -> DataFrame:
    chats = t("customer").selectExpr("concat('g', c_custkey) AS jid", "700000000 + c_custkey AS last_message_ts")
    messages = t("orders").select(F.concat(F.lit("g"), "o_custkey").alias("chat_jid"), v.wall_seconds(F.col("o_orderdate")).alias("ts"))
    return ag.prunable_groups(t.groups, chats, messages, 900_000_000, False).select("jid", "order_ts")


@query("SELECT chat_jid, arg_min(msg_id, (ts, rowid)) AS oldest_msg_id, min(ts) AS oldest_ts, arg_max(msg_id, (ts, rowid)) AS newest_msg_id, max(ts) AS newest_ts FROM messages GROUP BY chat_jid", "messages")
def ag06_oldest_latest(t: Tables) -> DataFrame:
    return ag.extremes(t.messages)


@query("SELECT DISTINCT chat_jid, media_type FROM messages", "messages")
def ag07_distinct(t: Tables) -> DataFrame:
    return t.messages.select("chat_jid", "media_type").distinct()


@query("SELECT jid, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM contact_tags GROUP BY jid", "contact_tags")
def ag08_tags(t: Tables) -> DataFrame:
    return ag.tags(t.contact_tags).select("jid", F.array_join("tags", ",").alias("tags"))


_LATEST = "v AS (SELECT poll_msg_id, voter_jid, choice, ts FROM (SELECT *, row_number() OVER (PARTITION BY poll_msg_id, voter_jid ORDER BY ts DESC, seq DESC, encode(tie) DESC, encode(choice) DESC) AS n FROM poll_votes) WHERE n = 1 AND choice <> '')"


def _latest(t: Tables) -> DataFrame:
    return ag.latest_votes(t.poll_votes, ["poll_msg_id", "voter_jid"], ["ts", "seq", "tie", "choice"])


@query(f"WITH {_LATEST}, c AS (SELECT poll_msg_id, choice AS option, count(*) AS votes FROM v GROUP BY ALL), o AS (SELECT msg_id AS poll_msg_id, option FROM polls, (VALUES ('A'), ('N'), ('Z')) x(option)) SELECT coalesce(o.poll_msg_id, c.poll_msg_id) AS poll_msg_id, coalesce(o.option, c.option) AS option, coalesce(votes, 0) AS votes FROM o FULL JOIN c ON o.poll_msg_id = c.poll_msg_id AND o.option = c.option", "poll_votes polls")
def ag09_vote_tally(t: Tables) -> DataFrame:
    return ag.tally(t.polls, _latest(t), ["A", "N", "Z"])


@query(f"WITH {_LATEST} SELECT * FROM v", "poll_votes")
def ag10_latest_vote(t: Tables) -> DataFrame:
    return _latest(t).select("poll_msg_id", "voter_jid", "choice", "ts")


@query("SELECT v.view_name AS \"view\", v.last_seq, (SELECT max(seq) FROM ledger) - v.last_seq AS lag FROM (VALUES ('chats', CAST(10 AS bigint)), ('messages', CAST(0 AS bigint))) v(view_name, last_seq)", "ledger")
def ag12_checkpoint_lag(t: Tables) -> DataFrame:
    checkpoints = t.spark.createDataFrame([("chats", 10), ("messages", 0)], "view string, last_seq bigint")
    return ag.checkpoint_lag(t.ledger, checkpoints).select("view", "last_seq", "lag")


@query("SELECT CASE WHEN phone = '' THEN 'no_phone' WHEN system_name = '' THEN 'no_match' ELSE 'matched' END AS class, count(*) AS n FROM contacts GROUP BY 1", "contacts")
def ag13_class_counts(t: Tables) -> DataFrame:
    kind = F.when(F.col("phone") == "", "no_phone").when(F.col("system_name") == "", "no_match").otherwise("matched")
    return t.contacts.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


# Windows


@query("SELECT rowid, count(*) OVER (PARTITION BY chat_jid ORDER BY ts, rowid ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS around FROM messages WHERE deleted_at IS NULL", "messages")
def wi03_row_frame(t: Tables) -> DataFrame:
    return hot.frame_count(rd.live(t.messages), "chat_jid", ["ts", "rowid"], 3, 2, "around").select("rowid", "around")


@query("SELECT chat_jid, sender_jid, rowid FROM (SELECT *, row_number() OVER (PARTITION BY chat_jid, sender_jid ORDER BY rowid) AS n FROM messages) WHERE n = 1", "messages")
def wi04_first_candidate(t: Tables) -> DataFrame:
    return jo.first_candidates(t.messages.select("chat_jid", "sender_jid", "rowid"), ["chat_jid", "sender_jid"], ["rowid"])


@query("SELECT chat_jid, msg_id, max(seq) AS seq FROM ledger GROUP BY ALL", "ledger")
def wi05_latest_event(t: Tables) -> DataFrame:
    return jo.latest(t.ledger.select("chat_jid", "msg_id", "seq"), ["chat_jid", "msg_id"], ["seq"])


@query("""WITH s AS (SELECT *, sum(CASE WHEN ts - prev > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY chat_jid ORDER BY ts, seq) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY chat_jid ORDER BY ts, seq) AS prev FROM ledger))
SELECT chat_jid, CAST(session AS bigint) AS session, min(ts) AS start_ts, max(ts) AS stop_ts, count(*) AS events FROM s GROUP BY chat_jid, session""", "ledger")
def st17_sessions(t: Tables) -> DataFrame:
    return ag.sessions(t.ledger, 86_400).withColumn("session", F.col("session").cast("bigint"))


# Orders


@query("SELECT rowid, ts, chat_jid FROM messages WHERE deleted_at IS NULL ORDER BY ts DESC, rowid DESC LIMIT 50", "messages")
def so01_message_list(t: Tables) -> DataFrame:
    return rd.list_messages(t.messages).select("rowid", "ts", "chat_jid")


@query("SELECT jid, pinned, last_message_ts FROM chats ORDER BY pinned DESC, last_message_ts DESC, jid LIMIT 60", "chats")
def so03_chat_order(t: Tables) -> DataFrame:
    return rd.chats_list(t.chats, limit=60).select("jid", "pinned", "last_message_ts")


def _listed(t: Tables) -> DataFrame:
    name = v.contact_name(*[F.col(c) for c in ("alias", "system_name", "full_name", "push_name", "business_name", "first_name")])
    return t.contacts.withColumn("shown", F.coalesce(name, "jid"))


_NAME = "coalesce(nullif(alias, ''), nullif(system_name, ''), nullif(full_name, ''), nullif(push_name, ''), nullif(business_name, ''), nullif(first_name, ''), jid)"


@query(f"SELECT jid, {_NAME} AS shown FROM contacts ORDER BY encode({_NAME}), encode(jid) LIMIT 70", "contacts")
def so04_name_order(t: Tables) -> DataFrame:
    return _listed(t).orderBy("shown", "jid").limit(70).select("jid", "shown")


@query("SELECT group_jid, user_jid, role, row_number() OVER (PARTITION BY group_jid ORDER BY CASE role WHEN 'superadmin' THEN 0 WHEN 'admin' THEN 1 ELSE 2 END, encode(user_jid)) AS place FROM group_participants", "group_participants")
def so05_role_order(t: Tables) -> DataFrame:
    w = Window.partitionBy("group_jid").orderBy("rank", "user_jid")
    return rd.participants(t.group_participants).select("group_jid", "user_jid", "role", F.row_number().over(w).cast("bigint").alias("place"))


@query("SELECT msg_id, created_ts FROM polls ORDER BY created_ts DESC, encode(chat_jid), encode(msg_id) LIMIT 30 OFFSET 20", "polls")
def so07_paging(t: Tables) -> DataFrame:
    none = t.messages.limit(0)
    return rd.visible_polls(t.polls, none, none, limit=30, offset=20).select("msg_id", "created_ts")


@query("SELECT rowid, ts FROM (SELECT rowid, ts FROM messages WHERE deleted_at IS NULL AND chat_jid = 'c1' ORDER BY ts DESC, rowid DESC LIMIT 5)", "messages")
def so09_chronological(t: Tables) -> DataFrame:
    return rd.list_messages(t.messages, chats="c1", limit=5).orderBy("ts", "rowid").select("rowid", "ts")


@query("""SELECT jid, message_count FROM (SELECT c.jid, count(m.rowid) AS message_count, coalesce(max(m.ts), 0) AS newest FROM chats c LEFT JOIN messages m ON c.jid = m.chat_jid GROUP BY c.jid) WHERE message_count > 0 ORDER BY newest DESC, encode(jid) LIMIT 25""", "chats messages")
def so10_filter_then_limit(t: Tables) -> DataFrame:
    return ag.coverage(t.chats, t.messages, limit=25).select("jid", "message_count")


# Sets


@query("SELECT jid FROM chats WHERE suffix(jid, '3') UNION SELECT chat_jid FROM messages WHERE suffix(chat_jid, '3') UNION SELECT user_jid FROM group_participants WHERE suffix(user_jid, '3') UNION SELECT voter_jid FROM poll_votes WHERE suffix(voter_jid, '3')", "chats messages group_participants poll_votes")
def se01_union_ids(t: Tables) -> DataFrame:
    return jo.union_ids((t.chats, "jid"), (t.messages, "chat_jid"), (t.group_participants, "user_jid"), (t.poll_votes, "voter_jid"), ends="3")


@query("SELECT local_path FROM messages WHERE local_path <> '' UNION SELECT concat('/alias', direct_path) FROM messages WHERE direct_path <> ''", "messages")
def se02_media_paths(t: Tables) -> DataFrame:
    m = t.messages
    return m.filter("local_path <> ''").select("local_path").union(m.filter("direct_path <> ''").select(F.concat(F.lit("/alias"), "direct_path"))).distinct()


@query("SELECT l_orderkey AS k, concat_ws(',', CASE WHEN l_linenumber % 2 = 0 THEN 'N,A' ELSE 'A,R' END, CASE WHEN l_returnflag NOT IN ('A', CASE WHEN l_linenumber % 2 = 0 THEN 'N' ELSE 'R' END) THEN l_returnflag END) AS options FROM lineitem")
def se05_option_union(t: Tables) -> DataFrame:
    new = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("N"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("R")))
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.array_join(jo.merged_options(new, F.array("l_returnflag")), ",").alias("options"))


@query("""WITH m AS (SELECT chat_jid, msg_id, concat('/p', CAST(k % 3 AS varchar(20))) AS local_path FROM purges), mv AS (SELECT jid AS source, concat('t', jid) AS target FROM chats WHERE pinned)
SELECT target, a.msg_id, a.local_path AS source_path, '/p9' AS target_path FROM m a JOIN mv ON a.chat_jid = mv.source""", "purges chats")
def dm12_displaced_media(t: Tables) -> DataFrame:
    m = t.purges.selectExpr("chat_jid", "msg_id", "concat('/p', k % 3) AS local_path")
    moved = t.chats.filter("pinned").select(F.col("jid").alias("source"), F.concat(F.lit("t"), "jid").alias("target"))
    there = m.select(F.concat(F.lit("t"), "chat_jid").alias("chat_jid"), "msg_id", F.lit("/p9").alias("local_path"))
    return jo.displaced_media(m.unionByName(there), moved)
