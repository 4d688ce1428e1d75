"""From facts to the log, and from the log to tables: what ingest writes, the views read. An event's number is its time here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import messages as envelopes
from quernstone.operators import search
from quernstone.plans import ingest, views
from quernstone.queries import Tables, query
from quernstone.queries.lifecycle import _folder
from quernstone.sources.catalog import durable


def _kind(t: Tables, *kinds: str) -> DataFrame:
    return t.ledger.filter(F.col("event_type").isin(*kinds)).withColumn("kind", F.col("event_type"))


def _log(*parts: DataFrame) -> DataFrame:
    """The log, written down: views read it several times, and of each type only what they need."""
    return durable(ingest.all_of(*parts).withColumn("seq", F.col("event_ts")), "log")


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _said(rows: DataFrame, msg: Column, body: Column, mine: Column, chat: Column | None = None) -> DataFrame:
    """Live envelopes as events."""
    made = rows.select((chat if chat is not None else F.col("chat_jid")).alias("chat_jid"), msg.alias("msg_id"), F.lit("s").alias("sender_jid"), mine.alias("from_me"), F.col("seq").alias("ts"), F.lit("").alias("push_name"), _none().alias("device_sent_to"), body.alias("message"), body.alias("raw"), F.lit(False).alias("from_full_sync"))
    return ingest.messages(envelopes.live(made))


@query("""WITH r AS (SELECT chat_jid, msg_id, min(seq) AS s FROM ledger WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.chat_jid, e.msg_id, coalesce(arg_max(concat('t', seq), seq) FILTER (WHERE event_type = 'click' AND (s IS NULL OR seq < s)), arg_min(concat('t', seq), seq) FILTER (WHERE event_type = 'click' AND seq > s), '') AS text, bool_or(event_type = 'purchase') AS revoked, min(s) AS deleted_at
FROM ledger e LEFT JOIN r ON e.chat_jid = r.chat_jid AND e.msg_id = r.msg_id WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2""", "ledger")
def st07_written_messages(t: Tables) -> DataFrame:
    """Clicks are messages, delivered again with other words, purchases take them back: envelopes to events to the table."""
    e = _kind(t, "click", "purchase")
    body = F.when(F.col("kind") == "click", F.to_json(F.struct(F.concat(F.lit("t"), "seq").alias("conversation")))).otherwise(F.to_json(F.struct(F.struct(F.lit("REVOKE").alias("type"), F.struct(F.col("msg_id").alias("ID")).alias("key")).alias("protocolMessage"))))
    return views.messages(_log(_said(e, F.col("msg_id"), body, F.lit(False)))).select("chat_jid", "msg_id", "text", "revoked", "deleted_at")


@query("""WITH e AS (SELECT *, concat('c', user_id % 40, '@s.whatsapp.net') AS jid, event_id AS seq FROM events),
z AS (SELECT jid, max(seq) AS s FROM e WHERE event_type = 'error' AND (seq % 2 = 0 OR seq % 3 = 0) GROUP BY 1)
SELECT e.jid, 'dm' AS kind, coalesce(max(CASE WHEN event_type = 'click' THEN seq END), 0) AS last_message_ts, coalesce(arg_max(seq % 2 = 0, seq) FILTER (WHERE event_type = 'view'), false) AS archived, coalesce(arg_max(seq % 2 = 0, seq) FILTER (WHERE event_type = 'signup'), false) AS pinned,
  coalesce(max(CASE WHEN event_type = 'purchase' THEN seq END), 0) AS muted_until, count(*) FILTER (WHERE event_type = 'click' AND seq % 3 > 0 AND seq > coalesce(s, 0)) AS unread_count
FROM e LEFT JOIN z ON e.jid = z.jid WHERE event_type IN ('click', 'view', 'signup', 'purchase') OR seq % 2 = 0 OR seq % 3 = 0 GROUP BY 1""")
def st08_written_chats(t: Tables) -> DataFrame:
    """Clicks are messages, views archive, sign-ups pin, purchases mute; errors mark as read, or are receipts, of which only those of one's own reading count."""
    c = F.col
    e = t("events").select(F.concat(F.lit("c"), c("user_id") % 40, F.lit("@s.whatsapp.net")).alias("chat_jid"), c("event_id").alias("seq"), c("event_type").alias("kind"))
    said = _said(e.filter("kind = 'click'"), F.concat(F.lit("m"), "seq"), F.lit('{"conversation":"x"}'), c("seq") % 3 == 0)
    state = F.when(c("kind") == "view", "archive").when(c("kind") == "signup", "pin").when(c("kind") == "purchase", "mute").when((c("kind") == "error") & (c("seq") % 2 == 0), "mark_read")
    on = (c("kind") == "error") | (c("seq") % 2 == 0)
    changed = ingest.state_changes(e.select(state.alias("type"), "chat_jid", _none().alias("sender_jid"), _none("boolean").alias("from_me"), _none().alias("msg_id"), on.alias("state"), c("seq").alias("end_ts_ms"), F.lit(True).alias("range"), _none("boolean").alias("delete_media"), (c("seq") * 1000).alias("ts_ms")))
    seen = e.filter("kind = 'error' AND seq % 2 > 0").select(F.when(c("seq") % 3 == 0, "read-self").otherwise("delivered").alias("type"), "chat_jid", F.lit("s").alias("sender_jid"), _none().alias("message_sender"), F.array(F.lit("m")).alias("message_ids"), (c("seq") * 1000).alias("ts_ms"))
    return views.chats(_log(said, changed, ingest.receipts(seen))).select("jid", "kind", "last_message_ts", "archived", "pinned", "muted_until", c("unread_count").cast("bigint").alias("unread_count"))


@query("""SELECT chat_jid, msg_id AS poll_msg_id, concat('s', seq % 5) AS voter_jid, concat('o', seq % 3) AS choice FROM (SELECT *, row_number() OVER (PARTITION BY chat_jid, msg_id, seq % 5 ORDER BY seq DESC) AS n FROM ledger WHERE event_type IN ('view', 'error')) WHERE n = 1 AND event_type = 'view'""", "ledger")
def st11_written_votes(t: Tables) -> DataFrame:
    """Views vote, errors take the vote back."""
    picked = F.when(F.col("kind") == "view", F.array(F.concat(F.lit("o"), F.col("seq") % 3))).otherwise(F.array().cast("array<string>"))
    rows = _kind(t, "view", "error").select(F.lit("live").alias("source"), "chat_jid", F.col("msg_id").alias("poll_msg_id"), F.concat(F.lit("s"), F.col("seq") % 5).alias("voter_jid"), F.concat(F.lit("v"), "seq").alias("vote_msg_id"), picked.alias("selected"), F.array().cast("array<string>").alias("unknown_hashes"), (F.col("seq") * 1000).alias("voted_ts_ms"))
    return views.votes(_log(ingest.poll_votes(rows))).select("chat_jid", "poll_msg_id", "voter_jid", F.array_join("selected", ",").alias("choice"))


@query("""WITH g AS (SELECT chat_jid, max(seq) AS s FROM ledger WHERE event_type = 'error' GROUP BY 1)
SELECT e.chat_jid, CAST(seq AS varchar) AS call_id, CASE WHEN event_type = 'click' THEN 'call_log' ELSE 'offer' END AS event_type, seq AS ts FROM ledger e LEFT JOIN g ON e.chat_jid = g.chat_jid WHERE event_type = 'view' OR (event_type = 'click' AND (seq % 2 = 0 OR seq > coalesce(s, 0)))""", "ledger")
def st12_written_calls(t: Tables) -> DataFrame:
    """Clicks are entries of the call log, views live offers; errors delete the entries of calls that came in, which every second one did."""
    c = F.col
    rows = _kind(t, "click", "view", "error").select(
        F.lit("live").alias("source"), "chat_jid", F.when(c("kind") != "error", c("seq").cast("string")).otherwise("").alias("call_id"), F.when(c("kind") == "click", "call_log").when(c("kind") == "view", "offer").otherwise("").alias("event_type"),
        F.when((c("kind") == "error") | (c("seq") % 2 == 1), "inbound").otherwise("outbound").alias("direction"), c("seq").alias("ts"), (c("kind") == "error").alias("deleted"),
    )
    return views.calls(_log(ingest.calls(rows))).select("chat_jid", "call_id", "event_type", "ts")


@query("""WITH z AS (SELECT max(seq) AS s FROM ledger WHERE event_type = 'error' AND seq % 100 = 0)
SELECT chat_jid AS jid, arg_max(concat('p', seq % 7), seq) FILTER (WHERE event_type = 'click') AS push_name, arg_max(concat('f', seq), seq) FILTER (WHERE event_type = 'click' AND seq % 2 = 0) AS full_name,
  CASE WHEN max(seq) FILTER (WHERE event_type = 'view') > coalesce(max(s), 0) THEN arg_max(concat('n', seq), seq) FILTER (WHERE event_type = 'view') END AS system_name, max(seq) AS updated_at
FROM ledger, z WHERE event_type IN ('click', 'view') GROUP BY 1""", "ledger")
def st09_written_contacts(t: Tables) -> DataFrame:
    """Clicks show contacts, some with a full name, views name them in the phone book, some errors clear that."""
    c, no = F.col, F.lit("")
    seen = _kind(t, "click").select(c("chat_jid").alias("jid"), no.alias("phone"), F.concat(F.lit("p"), c("seq") % 7).alias("push_name"), F.when(c("seq") % 2 == 0, F.concat(F.lit("f"), "seq")).otherwise("").alias("full_name"), no.alias("first_name"), no.alias("business_name"), c("seq").alias("ts"))
    named = _kind(t, "view").select(c("chat_jid").alias("jid"), F.concat(F.lit("n"), "seq").alias("system_name"), c("seq").alias("ts"))
    cleared = _kind(t, "error").filter("seq % 100 = 0").select(c("seq").alias("ts"))
    return views.contacts(_log(ingest.contacts(seen), ingest.system_names(named), ingest.system_names_cleared(cleared))).select("jid", "push_name", "full_name", "system_name", "updated_at")


@query("""WITH g AS (SELECT chat_jid, arg_max(source, seq) AS name, max(seq) AS s FROM ledger WHERE event_type = 'click' GROUP BY 1), l AS (SELECT chat_jid, max(seq) AS s FROM ledger WHERE event_type = 'error' GROUP BY 1)
SELECT g.chat_jid AS jid, name, CASE WHEN l.s > g.s THEN l.s END AS left_at, concat('u', g.s % 3, ':admin,w:member') AS members FROM g LEFT JOIN l ON g.chat_jid = l.chat_jid""", "ledger")
def st10_written_groups(t: Tables) -> DataFrame:
    """Clicks are news of groups with their rosters, errors leaving them."""
    c, no = F.col, F.lit(False)
    member = lambda j, a: F.struct(j.alias("user_jid"), F.lit(a).alias("is_admin"), no.alias("is_super_admin"))
    who = F.array(member(F.lit("w"), False), member(F.concat(F.lit("u"), c("seq") % 3), True))
    click = c("kind") == "click"
    rows = _kind(t, "click", "error").select(F.lit("live").alias("source"), c("chat_jid").alias("jid"), F.when(click, c("source")).otherwise("").alias("name"), F.lit("").alias("owner_jid"), F.lit(0).alias("created_ts"), no.alias("is_parent"), F.lit("").alias("linked_parent_jid"), F.when(click, 0).otherwise(c("seq")).cast("bigint").alias("left_at"), F.when(click, who).otherwise(F.slice(who, 1, 0)).alias("participants"), c("seq").alias("ts"))
    log = _log(ingest.groups(rows))
    members = views.roster(log).groupBy("group_jid").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "user_jid", "role"))), ",").alias("members"))
    return views.groups(log).join(members, F.col("jid") == F.col("group_jid")).select("jid", "name", "left_at", "members")


@query("""SELECT jid, kind, last_message_ts, CASE WHEN last_message_ts % 2 = 0 THEN NOT archived ELSE archived END AS archived, pinned, muted_until, CASE WHEN unread THEN greatest(unread_count, 1) ELSE 0 END AS unread_count
FROM (SELECT * REPLACE (CASE WHEN kind = 'group' THEN concat(jid, '@g.us') WHEN kind = 'dm' THEN concat(jid, '@s.whatsapp.net') ELSE concat(jid, '@broadcast') END AS jid) FROM chats)""", "chats")
def st13_replayed_chats(t: Tables) -> DataFrame:
    """The chats as snapshot events, replayed; every second one is archived or brought back afterwards."""
    c = F.col
    server = F.when(c("kind") == "group", "@g.us").when(c("kind") == "dm", "@s.whatsapp.net").otherwise("@broadcast")
    old = t.chats.withColumn("jid", F.concat("jid", server)).withColumn("unread_count", c("unread_count").cast("int"))
    later = old.filter("last_message_ts % 2 = 0").select(F.lit("archive").alias("type"), c("jid").alias("chat_jid"), _none().alias("sender_jid"), _none("boolean").alias("from_me"), _none().alias("msg_id"), (~c("archived")).alias("state"), F.lit(0).alias("end_ts_ms"), F.lit(True).alias("range"), _none("boolean").alias("delete_media"), F.lit(9000).alias("ts_ms"))
    return views.chats(_log(ingest.snapshots(old, "chats", ["jid"]), ingest.state_changes(later))).select("jid", "kind", "last_message_ts", "archived", "pinned", "muted_until", c("unread_count").cast("bigint").alias("unread_count"))


# Search in any script

_WORDS = ("한국어", "Tiếng", "हिन्दी", "Ελλάδα", "ёжик", "Йод", "naïve", "東京")
_WORD = f"element_at(array({', '.join(repr(w) for w in _WORDS)}), CAST(p_partkey % {len(_WORDS)} + 1 AS int))"


@query(f"SELECT p_partkey AS k, list_extract([{', '.join(repr(w) for w in _WORDS)}], CAST(p_partkey % {len(_WORDS)} + 1 AS int)) AS word, how FROM part, (SELECT unnest(['scan', 'index']) AS how)")
def fn15_any_script(t: Tables) -> DataFrame:
    """A word of each of some scripts, written into the names of parts: as it stands there it finds just its rows, by a scan and by an index."""
    rows, path = t("part").select(F.col("p_partkey").alias("k"), F.expr(f"concat(p_name, ' «', {_WORD}, '», ', p_brand)").alias("text")), _folder(t, "index")
    search.write_index(rows, path, ("text",), "k")
    found = []
    for word in _WORDS:
        for how, got in (("scan", search.bm25(rows, word, columns=("text",), key="k", limit=0)), ("index", search.search_index(t.spark, path, word, key="k", limit=0))):
            found.append(got.select("k", F.lit(word).alias("word"), F.lit(how).alias("how")))
    return ingest.all_of(*found)
