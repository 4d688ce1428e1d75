"""Functions, search, folds, the event log, integrity and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import parse
from quernstone.functions import values as v
from quernstone.operators import aggregates as ag
from quernstone.operators import folds, identity, search
from quernstone.operators import joins as jo
from quernstone.plans import ledger as lg
from quernstone.plans import verify as vf
from quernstone.queries import Tables, query
from quernstone.sources import bindings
from quernstone.sources.catalog import shared_dir
from quernstone.streaming import log as sl
from quernstone.streaming import shared_log

# Functions


@query("SELECT rowid, CASE WHEN ts > 0 THEN ts ELSE 0 END AS seconds FROM messages", "messages")
def fn01_seconds(t: Tables) -> DataFrame:
    return t.messages.select("rowid", F.coalesce(F.unix_seconds(v.from_seconds(F.col("ts"))), F.lit(0)).cast("bigint").alias("seconds"))


@query("SELECT k, n, CASE WHEN n <= 0 THEN NULL WHEN n < 100000000000 THEN n * 1000000 WHEN n < 100000000000000 THEN n * 1000 ELSE n END AS micros FROM (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN -o_orderkey WHEN 1 THEN 900000000 + o_orderkey WHEN 2 THEN 900000000000 + o_orderkey ELSE 900000000000000 + o_orderkey END AS n FROM orders)")
def fn02_epoch_units(t: Tables) -> DataFrame:
    n = F.expr("CASE o_orderkey % 4 WHEN 0 THEN -o_orderkey WHEN 1 THEN 900000000 + o_orderkey WHEN 2 THEN 900000000000 + o_orderkey ELSE 900000000000000 + o_orderkey END")
    return t("orders").select(F.col("o_orderkey").alias("k"), n.alias("n"), v.epoch_of_any_unit(n).alias("micros"))


@query("SELECT DISTINCT d, CAST(floor(epoch(CAST(d AS timestamp))) AS bigint) AS seconds FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)")
def fn03_dates(t: Tables) -> DataFrame:
    return t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct().select("d", v.parse_instant(F.col("d")).alias("seconds"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_partkey % 5 = 0 THEN -1 ELSE 1600000000 + l_partkey % 5 END AS bigint) AS muted_until FROM lineitem")
def fn04_mute_end(t: Tables) -> DataFrame:
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), v.mute_end(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 5, F.lit(1_600_000_000)).alias("muted_until"))


@query("SELECT DISTINCT s, CASE WHEN s <= 0 THEN '' WHEN s < 60 THEN concat(s, 's') WHEN s % 60 = 0 THEN concat(s // 60, 'm') ELSE concat(s // 60, 'm', lpad(CAST(s % 60 AS varchar), 2, '0'), 's') END AS shown FROM (SELECT o_orderkey % 400 AS s FROM orders)")
def fn05_duration(t: Tables) -> DataFrame:
    s = F.col("o_orderkey") % 400
    return t("orders").select(s.alias("s")).distinct().select("s", v.duration(F.col("s")).alias("shown"))


@query("SELECT jid, coalesce(nullif(alias, ''), nullif(system_name, ''), nullif(full_name, ''), nullif(push_name, ''), nullif(business_name, ''), nullif(first_name, '')) AS name FROM contacts", "contacts")
def fn06_contact_name(t: Tables) -> DataFrame:
    return t.contacts.select("jid", v.contact_name(*[F.col(c) for c in ("alias", "system_name", "full_name", "push_name", "business_name", "first_name")]).alias("name"))


@query("SELECT jid, coalesce(nullif(trim(full_name), ''), nullif(trim(first_name), ''), nullif(trim(business_name), ''), nullif(nullif(trim(push_name), ''), '-'), jid) AS name FROM contacts", "contacts")
def fn07_sender_name(t: Tables) -> DataFrame:
    c = F.col
    return t.contacts.select("jid", v.sender_name(c("full_name"), c("first_name"), c("business_name"), c("push_name"), F.lit(None).cast("string"), c("jid")).alias("name"))


_TARGET = "coalesce(nullif(trim(display_text), ''), nullif(trim(text), ''), CASE WHEN media_type <> '' THEN concat('Sent ', media_type) END)"


@query(f"""WITH x AS (SELECT *, {_TARGET} AS target, coalesce(CASE WHEN media_type <> '' THEN concat('Sent ', media_type) END, nullif(trim(text), ''), '(message)') AS own FROM messages)
SELECT m.rowid, CASE WHEN m.reaction_to_id <> '' OR m.reaction_emoji <> '' THEN concat('Reacted ', CASE WHEN m.reaction_emoji <> '' THEN concat(m.reaction_emoji, ' ') ELSE '' END, 'to ', coalesce(r.target, 'message'))
  WHEN m.quoted_msg_id <> '' THEN concat('> ', coalesce(q.target, 'message'), chr(10), m.own) ELSE m.own END AS shown
FROM x m LEFT JOIN x r ON m.reaction_to_id = r.msg_id AND m.chat_jid = r.chat_jid LEFT JOIN x q ON m.quoted_msg_id = q.msg_id AND m.chat_jid = q.chat_jid""", "messages")
def fn08_display_text(t: Tables) -> DataFrame:
    m = t.messages
    shown = m.select("chat_jid", "msg_id", v.target_text(F.col("display_text"), F.col("text"), F.col("media_type")).alias("target"))
    r, q = (shown.withColumnsRenamed({"msg_id": c, "target": f"{c}_text"}) for c in ("reaction_to_id", "quoted_msg_id"))
    joined = m.join(r, ["chat_jid", "reaction_to_id"], "left").join(q, ["chat_jid", "quoted_msg_id"], "left")
    text = v.display_text(v.base_text(F.col("text"), F.col("media_type")), F.col("reaction_to_id"), F.col("reaction_emoji"), F.col("reaction_to_id_text"), F.col("quoted_msg_id"), F.col("quoted_msg_id_text"))
    return joined.select("rowid", text.alias("shown"))


@query("SELECT rowid, CASE WHEN deleted_for_me THEN 'This message was deleted for me' WHEN revoked THEN 'This message was deleted' ELSE coalesce(nullif(trim(display_text), ''), nullif(trim(text), ''), CASE WHEN media_type <> '' THEN concat('Sent ', media_type) END, '') END AS line FROM messages", "messages")
def fn09_line_text(t: Tables) -> DataFrame:
    c = F.col
    return t.messages.select("rowid", v.line_text(c("deleted_for_me"), c("revoked"), c("display_text"), c("text"), c("media_type")).alias("line"))


@query("SELECT rowid, CASE WHEN media_type = '' THEN 'message' WHEN media_type = 'document' THEN 'document' ELSE media_type END AS label FROM messages", "messages")
def fn10_media_label(t: Tables) -> DataFrame:
    return t.messages.select("rowid", v.media_label(F.col("media_type")).alias("label"))


@query("SELECT rowid, CASE WHEN deleted_for_me THEN 'delete-for-me' WHEN revoked THEN 'revoke' END AS reason, CASE WHEN revoked THEN CASE WHEN deleted_at > 0 THEN deleted_at WHEN ts > 0 THEN ts ELSE 1 END END AS at FROM messages", "messages")
def fn11_deletion(t: Tables) -> DataFrame:
    c = F.col
    return t.messages.select("rowid", v.deletion(c("deleted_for_me"), c("revoked"), F.lit("")).alias("reason"), v.deletion_time(c("revoked"), c("deleted_at"), c("ts"), F.lit(1).cast("bigint")).alias("at"))


@query("SELECT jid, regexp_replace(phone, '[^0-9]', '', 'g') AS digits, regexp_matches(phone, '^\\+?[0-9 ().-]*$') AS is_phone, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 THEN regexp_replace(phone, '[^0-9]', '', 'g') END AS valid FROM contacts", "contacts")
def fn12_phones(t: Tables) -> DataFrame:
    p = F.col("phone")
    return t.contacts.select("jid", v.digits(p).alias("digits"), v.looks_like_phone(p).alias("is_phone"), v.valid_phone(p).alias("valid"))


@query("SELECT j, CASE s WHEN 'g.us' THEN 'group' WHEN 'newsletter' THEN 'newsletter' WHEN 'broadcast' THEN 'broadcast' WHEN 's.whatsapp.net' THEN 'dm' ELSE 'unknown' END AS kind, CASE WHEN s IN ('s.whatsapp.net', 'lid') THEN concat(c_custkey, '@', s) ELSE j END AS bare FROM (SELECT c_custkey, s, concat(c_custkey, ':', c_custkey % 9, '@', s) AS j FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'g.us' WHEN 1 THEN 's.whatsapp.net' WHEN 2 THEN 'lid' WHEN 3 THEN 'newsletter' ELSE 'broadcast' END AS s FROM customer))")
def fn13_jids(t: Tables) -> DataFrame:
    s = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'g.us' WHEN 1 THEN 's.whatsapp.net' WHEN 2 THEN 'lid' WHEN 3 THEN 'newsletter' ELSE 'broadcast' END")
    j = F.concat(F.col("c_custkey"), F.lit(":"), F.col("c_custkey") % 9, F.lit("@"), s)
    return t("customer").select(j.alias("j")).select("j", v.chat_kind(F.col("j")).alias("kind"), v.bare_jid(F.col("j")).alias("bare"))


@query("SELECT p_partkey AS k, CASE WHEN lower(p_type) = '{q}' THEN 100 WHEN prefix(lower(p_type), '{q}') THEN 60 WHEN contains(lower(p_type), ' {q}') THEN 30 WHEN contains(lower(p_type), '{q}') THEN 10 ELSE 0 END AS score FROM part".replace("{q}", "st"))
def fn14_match_score(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("k"), v.match_score(" ST ", F.col("p_type")).alias("score"))


@query("SELECT item_id, len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM benchmark WHERE text IS NOT NULL")
def fn15_tokens(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.size(search.tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query()
def fn16_snippets(t: Tables) -> DataFrame:
    """No SQL: dots and brackets of a snippet have no short form there; tests hold it against plain Python."""
    return t("documents").select("doc_id", search.snippet(F.col("text"), "the and").alias("snippet"))


_BM25 = r"""WITH docs AS (SELECT doc_id, string_split_regex(translate(lower(text), 'àáâãäåāăąçćčďèéêëēėęěìíîïīįñńňòóôõöøōřśšşťùúûüūůýÿžźż', 'aaaaaaaaacccdeeeeeeeeiiiiiinnnooooooorssstuuuuuuyyzzz'), '[^\p{L}\p{N}]+') AS t FROM documents),
c AS (SELECT doc_id, len(list_filter(t, lambda x: x <> '')) AS l, len(list_filter(t, lambda x: x = 'the')) AS a, len(list_filter(t, lambda x: x = 'and')) AS b FROM docs),
s AS (SELECT count(*)::DOUBLE AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)) + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)), 6) AS score
FROM c, s WHERE a > 0 AND b > 0"""


@query(_BM25)
def fn17_bm25(t: Tables) -> DataFrame:
    return search.bm25(t("documents"), "The AND", columns=("text",), key="doc_id", limit=0).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, score FROM ({_BM25}) ORDER BY score DESC, doc_id DESC LIMIT 40")
def so02_relevance(t: Tables) -> DataFrame:
    """The best forty, from a written index."""
    path = f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
    search.write_index(t("documents"), path, ("text",), "doc_id")
    found = search.search_index(t.spark, path, "The AND", key="doc_id", limit=0).select("doc_id", F.round("score", 6).alias("score"))
    return found.orderBy(F.col("score").desc(), F.col("doc_id").desc()).limit(40)


@query(r"""SELECT page_id, array_to_string(list_transform(list_filter(string_split_regex(html, '\s+'), lambda x: x <> ''), lambda x: concat('"', replace(x, '"', '""'), '"')), ' ') AS quoted FROM pages""")
def fn15_quoted_query(t: Tables) -> DataFrame:
    return t("pages").select("page_id", search.quoted_column(F.col("html")).alias("quoted"))


@query(r"SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f]', '', 'g') AS body FROM documents")
def fn18_clean_body(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", v.clean_body(F.col("text")).alias("body"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 79), '…') ELSE text END AS cut FROM documents")
def fn19_truncate(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", v.truncated(F.col("text"), 80).alias("cut"))


@query(r"""SELECT page_id, replace(translate(trim(url), '/\:*?"<>| ', '__________'), '..', '_') AS segment FROM pages""")
def fn20_path_segment(t: Tables) -> DataFrame:
    return t("pages").select("page_id", v.path_segment(F.col("url")).alias("segment"))


@query("SELECT page_id, url AS found FROM pages")
def fn21_first_url(t: Tables) -> DataFrame:
    text = F.concat(F.lit("see ("), F.col("url"), F.lit("). and http:///no or https://other.example"))
    return t("pages").select("page_id", parse.first_url(text).alias("found"))


@query()
def fn22_page_metadata(t: Tables) -> DataFrame:
    """No SQL: it takes an HTML parser."""
    return parse.page_metadata(t("pages")).select("page_id", "title", "description", "image")


@query("SELECT s_suppkey AS k, concat('Contact: ', s_name, ' (+', 10000000 + s_suppkey, ', 5)') AS shown FROM supplier")
def fn23_cards(t: Tables) -> DataFrame:
    text = F.concat(F.lit("BEGIN:VCARD\r\nFN:"), F.substring("s_name", 1, 4), F.lit("\r\n "), F.expr("substring(s_name, 5, 100)"), F.lit("\r\nTEL;TYPE=CELL:+"), F.col("s_suppkey") + 10_000_000, F.lit("\nTEL:5\nTEL:5\nEND:VCARD"))
    return t("supplier").select(F.col("s_suppkey").alias("k"), parse.card_text(parse.card(text)).alias("shown"))


@query("SELECT o_orderkey AS k, translate(lower(trim(o_orderpriority)), '- ', '__') AS word FROM orders")
def fn24_enum_words(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("k"), v.enum_word(F.col("o_orderpriority")).alias("word"))


_DEDUP = """concat('dd:{"scope":"event","parts":["', user_id, '","', event_type, '","', replace(replace(props, '\\', '\\\\'), '"', '\\"'), '"]}')"""


@query(f"SELECT event_id AS seq, concat('evt_', substr(sha256(concat({_DEDUP}, chr(10), sha256(props))), 1, 32)) AS id FROM events")
def fn25_event_id(t: Tables) -> DataFrame:
    return _events(t).select("seq", F.col("event_id").alias("id"))


@query("""SELECT rowid, concat('{"chat":"', chat_jid, '","from_me":', CASE WHEN from_me THEN 'true' ELSE 'false' END, ',"id":"', msg_id, '"', CASE WHEN sender_name <> '' THEN concat(',"participant":"', sender_name, '"') ELSE '' END, '}') AS key FROM messages""", "messages")
def fn26_message_key(t: Tables) -> DataFrame:
    c = F.col
    return t.messages.select("rowid", v.message_key(c("chat_jid"), c("from_me"), c("msg_id"), c("sender_name")).alias("key"))


@query("SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def fn27_json_read(t: Tables) -> DataFrame:
    return t("events").select(F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat(l_returnflag, ',', l_linestatus) END AS selected, CASE WHEN l_linenumber % 3 = 1 THEN 1 ELSE 0 END AS unknown FROM lineitem")
def fn28_vote_selection(t: Tables) -> DataFrame:
    pair = F.concat(F.lit('["'), F.col("l_returnflag"), F.lit('","'), F.col("l_linestatus"), F.lit('"]'))
    text = F.when(F.col("l_linenumber") % 3 == 0, "[]").when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit('{"selected":'), pair, F.lit(',"unknown_hashes":["x"]}'))).otherwise(pair)
    s = v.vote_selection(text)
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.array_join(s["selected"], ",").alias("selected"), F.size(s["unknown_hashes"]).alias("unknown"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE '' END AS selected, CASE WHEN l_returnflag IN ('A', 'N') THEN '' ELSE sha256(l_returnflag) END AS unknown FROM lineitem")
def fn29_hash_options(t: Tables) -> DataFrame:
    s = v.match_hashes(F.array(F.lit("A"), F.lit("N")), F.array(F.sha2("l_returnflag", 256)))
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.array_join(s["selected"], ",").alias("selected"), F.array_join(s["unknown_hashes"], ",").alias("unknown"))


@query("SELECT chat_jid, string_agg(msg_id, ',' ORDER BY encode(msg_id)) AS ids FROM (SELECT DISTINCT chat_jid, msg_id FROM ledger) GROUP BY chat_jid", "ledger")
def fn30_sorted_ids(t: Tables) -> DataFrame:
    return t.ledger.groupBy("chat_jid").agg(F.array_join(F.array_sort(F.collect_set("msg_id")), ",").alias("ids"))


@query("SELECT c_custkey AS k, c_acctbal / 50 BETWEEN -90 AND 90 AND c_acctbal / 40 BETWEEN -180 AND 180 AS valid FROM customer")
def fn31_coordinates(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("k"), v.valid_coordinates(F.col("c_acctbal") / 50, F.col("c_acctbal") / 40).alias("valid"))


# Folds


def _steps(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.ledger.withColumns({"plus": e.isin("click", "view"), "sets": F.when(e.isin("purchase", "signup"), F.col("seq") % 3), "keeps": e == "error"})


@query("""WITH RECURSIVE s AS (SELECT seq, chat_jid, event_type IN ('click', 'view') AS p, CASE WHEN event_type IN ('purchase', 'signup') THEN seq % 3 END AS x, event_type = 'error' AS k, row_number() OVER (PARTITION BY chat_jid ORDER BY seq) AS n FROM (SELECT event_id AS seq, concat('c', user_id) AS chat_jid, event_type FROM events)),
r AS (SELECT seq, chat_jid, n, CASE WHEN x IS NOT NULL THEN x WHEN k THEN 1 WHEN p THEN 1 ELSE 0 END AS c FROM s WHERE n = 1
  UNION ALL SELECT s.seq, s.chat_jid, s.n, CASE WHEN s.x IS NOT NULL THEN s.x WHEN s.k THEN greatest(r.c, 1) WHEN s.p THEN r.c + 1 ELSE r.c END FROM r JOIN s ON r.chat_jid = s.chat_jid AND s.n = r.n + 1)
SELECT seq, chat_jid, CAST(c AS bigint) AS unread_count FROM r""")
def ag11_unread_fold(t: Tables) -> DataFrame:
    return ag.unread_fold(_steps(t)).select("seq", "chat_jid", "unread_count")


@query("""WITH a AS (SELECT concat('c', user_id) AS jid, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS name, CAST(floor(epoch(ts)) AS bigint) AS ts FROM events)
SELECT jid, arg_max(name, seq) FILTER (WHERE name <> '') AS name, max(ts) AS last_message_ts FROM a GROUP BY jid""")
def sc20_upsert_chats(t: Tables) -> DataFrame:
    arrivals = t.ledger.select(F.col("chat_jid").alias("jid"), "seq", F.when(F.col("seq") % 3 == 0, "").otherwise(F.col("event_type")).alias("name"), F.col("ts").alias("last_message_ts"))
    return folds.fold_entity(arrivals, "chats", ["jid"]).select("jid", "name", "last_message_ts")


@query("""WITH a AS (SELECT concat('c', user_id) AS jid, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN '' ELSE event_type END AS full_name, CASE WHEN event_id % 5 = 0 THEN props ELSE '' END AS push_name FROM events)
SELECT jid, arg_max(full_name, seq) FILTER (WHERE full_name <> '') AS full_name, arg_max(push_name, seq) FILTER (WHERE push_name <> '') AS push_name, max(seq) AS updated_at FROM a GROUP BY jid""")
def st09_contact_fold(t: Tables) -> DataFrame:
    name = F.expr("CASE WHEN seq % 4 = 0 THEN NULL WHEN seq % 4 = 1 THEN '' ELSE event_type END")
    arrivals = t.ledger.select(F.col("chat_jid").alias("jid"), "seq", name.alias("full_name"), F.when(F.col("seq") % 5 == 0, F.col("raw")).otherwise("").alias("push_name"), F.col("seq").alias("updated_at"))
    return folds.fold_entity(arrivals, "contacts", ["jid"])


@query("SELECT group_jid, user_jid, role FROM (SELECT concat('g', user_id % 40) AS group_jid, max(event_id) AS s FROM events GROUP BY 1) g, (VALUES (0, 'admin'), (1, 'member')) x(n, role), LATERAL (SELECT concat('u', (g.s + x.n) % 7) AS user_jid) u")
def st10_roster(t: Tables) -> DataFrame:
    member = lambda n, role: F.struct(F.concat(F.lit("u"), (F.col("seq") + n) % 7).alias("user_jid"), F.lit(role).alias("role"))
    snaps = t("events").selectExpr("concat('g', user_id % 40) AS group_jid", "event_id AS seq").withColumn("participants", F.array(member(0, "admin"), member(1, " ")))
    return folds.latest_roster(snaps)


@query("""WITH l AS (SELECT chat_jid, msg_id, max(seq) AS seq FROM ledger GROUP BY ALL) SELECT l.chat_jid, l.msg_id, e.ts AS starred_at FROM l JOIN ledger e ON l.seq = e.seq WHERE e.event_type <> 'error'""", "ledger")
def st12_starred_fold(t: Tables) -> DataFrame:
    rows = t.ledger.select("chat_jid", "msg_id", "seq", F.col("ts").alias("starred_at"), (F.col("event_type") != "error").alias("on"))
    return jo.latest(rows, ["chat_jid", "msg_id"], ["seq"]).filter("on").select("chat_jid", "msg_id", "starred_at")


@query()
def st07_message_fold(t: Tables) -> DataFrame:
    """No SQL: the merge looks across columns and isn't associative; tests hold it against a plain Python fold."""
    e = t.ledger
    text = F.when(F.col("seq") % 6 == 0, "").otherwise(F.concat("event_type", F.lit(" "), "raw"))
    rows = e.select(
        "chat_jid", "msg_id", "seq", "ts", F.col("event_type").alias("sender_jid"), text.alias("text"), F.lit("").alias("media_type"), F.lit("").alias("quoted_msg_id"), F.lit("").alias("display_text"), (F.col("seq") % 5 == 0).alias("edited"),
        F.when(F.col("seq") % 5 == 0, F.col("ts")).otherwise(0).alias("edited_ts"), (F.col("seq") % 19 == 0).alias("revoked"), F.lit(False).alias("deleted_for_me"), F.when(F.col("seq") % 19 == 0, F.col("ts")).alias("deleted_at"), F.when(F.col("seq") % 19 == 0, "revoke").alias("deletion_reason"), (F.col("seq") % 2 == 0).alias("from_me"),
    )
    return folds.fold_messages(rows)


@query("""WITH RECURSIVE v AS (SELECT concat('c', user_id) AS c, event_id % 50 AS p, event_id % 7 AS v, CAST(floor(epoch(ts)) AS bigint) AS ts, event_id AS seq, event_type AS choice, event_type = 'error' AS r FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY c, p, v ORDER BY seq) AS n FROM v),
f AS (SELECT c, p, v, n, CASE WHEN NOT r THEN seq END AS hs, CASE WHEN NOT r THEN ts END AS ht FROM s WHERE n = 1
  UNION ALL SELECT s.c, s.p, s.v, s.n, CASE WHEN s.r THEN CASE WHEN f.ht <= s.ts THEN NULL ELSE f.hs END WHEN f.ht IS NULL OR s.ts >= f.ht THEN s.seq ELSE f.hs END, CASE WHEN s.r THEN CASE WHEN f.ht <= s.ts THEN NULL ELSE f.ht END WHEN f.ht IS NULL OR s.ts >= f.ht THEN s.ts ELSE f.ht END
    FROM f JOIN s ON f.c = s.c AND f.p = s.p AND f.v = s.v AND s.n = f.n + 1),
l AS (SELECT c, p, v, arg_max(coalesce(hs, -1), n) AS seq FROM f GROUP BY 1, 2, 3)
SELECT s.c AS chat_jid, concat('p', s.p) AS poll_msg_id, concat('v', s.v) AS voter_jid, s.ts, s.seq, s.choice FROM l JOIN s ON l.seq = s.seq""")
def st11_vote_fold(t: Tables) -> DataFrame:
    """Errors take votes back."""
    rows = t.ledger.select("chat_jid", F.concat(F.lit("p"), F.col("seq") % 50).alias("poll_msg_id"), F.concat(F.lit("v"), F.col("seq") % 7).alias("voter_jid"), "ts", "seq", F.col("event_type").alias("choice"), (F.col("event_type") == "error").alias("retracted"))
    return folds.fold_votes(rows)


@query("SELECT m.rowid, CASE WHEN p.purged_at IS NULL THEN m.text END AS text, p.purged_at AS payload_purged_at FROM messages m LEFT JOIN (SELECT * FROM purges WHERE k % 6 = 0) p ON m.chat_jid = p.chat_jid AND m.msg_id = p.msg_id", "messages purges")
def st15_scrub(t: Tables) -> DataFrame:
    m = t.messages.select("rowid", "chat_jid", "msg_id", "text", "deleted_at")
    return folds.scrubbed(m, t.purges.filter("k % 6 = 0"), ["text"]).select("rowid", "text", "payload_purged_at")


@query("""WITH c AS (SELECT CASE WHEN last_message_ts % 3 = 0 THEN concat('p', unread_count) ELSE jid END AS pn, last_message_ts AS ts, unread, unread_count AS n FROM chats) SELECT pn AS jid, max(ts) AS last_message_ts, bool_or(unread) AS unread, CAST(sum(n) AS bigint) AS unread_count FROM c GROUP BY pn""", "chats")
def dm11_merge_chats(t: Tables) -> DataFrame:
    known = t.chats.filter("last_message_ts % 3 = 0").select(F.col("jid").alias("lid"), F.concat(F.lit("p"), "unread_count").alias("pn"))
    return identity.merge_chats(t.chats, known).select("jid", "last_message_ts", "unread", "unread_count")


# The event log


def _events(t: Tables) -> DataFrame:
    """The log with keys: an event is a user's, by type and content; it refers to the user's event before and to a message of another."""
    e = t("events").select(F.col("event_id").alias("seq"), F.concat(F.lit("c"), "user_id").alias("chat_jid"), "event_type", F.col("props").alias("raw"), "user_id", v.wall_seconds(F.col("ts")).alias("ts"))
    keyed = lg.with_ids(e.withColumn("dedup_key", v.dedup_key("event", F.col("user_id"), F.col("event_type"), F.col("raw"))))
    return keyed.withColumn("message_key", F.concat(F.lit("k"), F.col("seq") % 997))


_EVENTS = f"e AS (SELECT event_id AS seq, concat('c', user_id) AS chat_jid, event_type, props AS raw, concat('evt_', substr(sha256(concat({_DEDUP}, chr(10), sha256(props))), 1, 32)) AS id, concat('k', event_id % 997) AS message_key FROM events)"


@query(f"WITH {_EVENTS} SELECT min(seq) AS seq, id FROM e GROUP BY id")
def st01_dedup_append(t: Tables) -> DataFrame:
    return lg.new_events(_events(t)).select("seq", F.col("event_id").alias("id"))


@query(f"WITH {_EVENTS} SELECT min(seq) AS seq, id FROM e WHERE id NOT IN (SELECT id FROM e WHERE seq % 3 = 0) GROUP BY id")
def sc19_append_to_log(t: Tables) -> DataFrame:
    e = _events(t)
    return lg.new_events(e, e.filter("seq % 3 = 0")).select("seq", F.col("event_id").alias("id"))


def _with_refs(t: Tables) -> DataFrame:
    e = lg.new_events(_events(t))
    by_key = F.struct(F.lit("message_key").alias("kind"), F.concat(F.lit("k"), (F.col("seq") * 7 + 12) % 1200).alias("target"))
    return e.withColumn("refs", F.when(F.col("seq") % 4 == 0, F.array(by_key)).otherwise(F.array().cast("array<struct<kind:string,target:string>>")))


_REFS = f"{_EVENTS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM e) WHERE n = 1), k AS (SELECT message_key, min(seq) AS target_seq, arg_min(id, seq) AS target_id FROM u GROUP BY message_key), f AS (SELECT seq, id, concat('k', (seq * 7 + 12) % 1200) AS target FROM u WHERE seq % 4 = 0)"


@query(f"WITH {_REFS} SELECT f.seq, CASE WHEN target_seq < f.seq THEN target_id END AS target_id FROM f LEFT JOIN k ON f.target = k.message_key")
def st02_forward_refs(t: Tables) -> DataFrame:
    return lg.resolved(_with_refs(t), forward_only=True).select("seq", "target_id")


@query(f"WITH {_REFS} SELECT u.seq, CASE WHEN f.seq IS NOT NULL AND NOT coalesce(target_seq < f.seq, false) THEN 1 ELSE 0 END AS flags FROM u LEFT JOIN f ON u.seq = f.seq LEFT JOIN k ON f.target = k.message_key")
def st02_dangling_flag(t: Tables) -> DataFrame:
    return lg.with_causes(_with_refs(t)).select("seq", F.col("flags").cast("int").alias("flags"))


# An event refers to one other at most: a way that comes back goes round a ring, and ways from a ring stay in it.
_RINGS = f"""{_REFS}, g AS (SELECT f.seq, f.id AS a, target_id AS b, target_seq < f.seq AS early, e.event_type AS kind FROM f JOIN k ON f.target = k.message_key JOIN u e ON e.seq = f.seq),
c AS (SELECT a AS root, b FROM g UNION SELECT c.root, g.b FROM c JOIN g ON c.b = g.a),
ring AS (SELECT c.root, max(c.b) AS ring FROM c WHERE c.root IN (SELECT root FROM c WHERE root = b) GROUP BY c.root),
refused AS (SELECT max(g.seq) AS seq FROM g JOIN ring r ON g.a = r.root WHERE NOT early GROUP BY r.ring)"""


@query(f"WITH RECURSIVE {_RINGS} SELECT count(*) AS nodes FROM ring")
def jo11_cyclic_nodes(t: Tables) -> DataFrame:
    return lg.strong_components(lg.edges(_with_refs(t))).agg(F.count("*").alias("nodes"))


@query(f"WITH RECURSIVE {_RINGS} SELECT c.root AS start, c.b AS node FROM c JOIN u ON c.root = u.id WHERE u.event_type = 'signup'")
def jo11_reachable(t: Tables) -> DataFrame:
    log = _with_refs(t)
    return lg.reachable(lg.edges(log), log.filter("event_type = 'signup'").select(F.col("event_id").alias("start")))


@query(f"WITH {_REFS} SELECT f.seq, 0 AS ref_index, f.target, target_id FROM f LEFT JOIN k ON f.target = k.message_key")
def jo10_references(t: Tables) -> DataFrame:
    return lg.resolved(_with_refs(t)).select("seq", "ref_index", "target", "target_id")


@query(f"WITH RECURSIVE {_RINGS} SELECT a AS event_id, 0 AS ref_index, b AS target_id FROM g WHERE seq NOT IN (SELECT seq FROM refused)")
def st03_causal_links(t: Tables) -> DataFrame:
    return lg.causal_links(_with_refs(t))


@query(f"""WITH RECURSIVE {_RINGS}, linked AS (SELECT seq FROM g WHERE kind = 'click' AND seq NOT IN (SELECT seq FROM refused)),
alone AS (SELECT max(g.seq) AS seq FROM g JOIN ring r ON g.a = r.root WHERE NOT early AND g.seq NOT IN (SELECT seq FROM linked) GROUP BY r.ring HAVING count(*) = 1)
SELECT f.seq, CASE WHEN g.seq IS NULL THEN 'dangling' WHEN f.seq IN (SELECT seq FROM alone) THEN 'cyclic' ELSE 'pending' END AS state FROM f LEFT JOIN g ON f.seq = g.seq WHERE f.seq NOT IN (SELECT seq FROM linked)""")
def st04_reference_states(t: Tables) -> DataFrame:
    """References without a link, after a link pass of which only the links of clicks were kept."""
    log = _with_refs(t)
    kept = lg.causal_links(log).join(log.filter("event_type = 'click'").select("event_id"), "event_id", "left_semi")
    return lg.reference_states(log, kept).select("seq", "state")


@query(f"WITH {_EVENTS} SELECT m.chat_jid, m.n, max_by(e.id, e.seq) AS id FROM (SELECT concat('c', user_id) AS chat_jid, user_id AS n FROM events GROUP BY user_id) m LEFT JOIN e ON m.chat_jid = e.chat_jid AND e.seq % 2 = 0 GROUP BY m.chat_jid, m.n")
def st24_attribution(t: Tables) -> DataFrame:
    e = _events(t)
    effects = e.select("chat_jid", F.col("user_id").alias("n"), F.lit("x").alias("msg_id")).distinct()
    return lg.attributed(effects, e.filter("seq % 2 = 0").withColumn("msg_id", F.lit("x"))).select("chat_jid", "n", F.col("event_id").alias("id"))


# Integrity


_BOUND = bindings.sql("messages", "chats", "groups", "group_participants")


@query(f"""WITH RECURSIVE {_BOUND}, {_RINGS}, x AS (SELECT u.seq, u.event_type, CASE event_id % 4 WHEN 0 THEN 'legacy_snapshot' ELSE 'live' END AS source FROM u JOIN events ON u.seq = event_id), h AS (SELECT max(seq) AS head FROM u)
SELECT 'message_without_chat' AS "check", count(*) AS n FROM messages m WHERE NOT EXISTS (SELECT 1 FROM chats c WHERE c.jid = m.chat_jid AND NOT c.archived)
UNION ALL SELECT 'fts_missing_row', count(*) FROM messages WHERE deleted_at IS NULL AND media_type = 'image'
UNION ALL SELECT 'fts_extra_row', count(*) FROM messages WHERE deleted_at IS NOT NULL AND media_type <> 'image'
UNION ALL SELECT 'participant_without_group', count(*) FROM group_participants p WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.jid = p.group_jid AND g.left_at = 0)
UNION ALL SELECT 'checkpoint_ahead_of_head', count(*) FROM region WHERE r_regionkey > 3
UNION ALL SELECT 'checkpoint_lag', count(*) FROM region WHERE r_regionkey < 3
UNION ALL SELECT 'checkpoint_frontier_fork', count(*) FROM region WHERE r_regionkey <> (SELECT r_regionkey FROM region ORDER BY encode(r_name) LIMIT 1)
UNION ALL SELECT 'raw_hash_mismatch', count(*) FROM x WHERE event_type = 'error'
UNION ALL SELECT 'dangling_causal_ref', count(*) FROM f LEFT JOIN k ON f.target = k.message_key WHERE target_id IS NULL
UNION ALL SELECT 'causal_cycle', count(DISTINCT ring) FROM ring
UNION ALL SELECT 'scrub_with_raw', count(*) FROM x WHERE event_type = 'purchase'
UNION ALL SELECT 'event_without_raw_or_scrub', count(*) FROM x WHERE event_type = 'signup' AND source <> 'legacy_snapshot'
UNION ALL SELECT 'unread_inconsistent', count(*) FROM chats WHERE unread_count < 0 OR (NOT unread AND unread_count > 0)""")
def dm16_verify(t: Tables) -> DataFrame:
    """All thirteen checks over an archive with faults of each kind: purchases play scrubs, sign-ups lack their bytes, errors have others."""
    log = _with_refs(t).withColumn("source", F.when(F.col("seq") % 4 == 0, "legacy_snapshot").otherwise("live"))
    raw = log.filter("event_type <> 'signup'").select("event_id", F.when(F.col("event_type") == "error", F.lit("other")).otherwise(F.col("raw")).cast("binary").alias("raw_bytes"))
    links = lg.resolved(log).select("event_id", "ref_index", F.coalesce("target_id", F.lit("nowhere")).alias("target_id"))
    head = log.agg(F.max("seq").alias("h"))
    checkpoints = t("region").join(F.broadcast(head), F.lit(True)).select(F.col("r_name").alias("view"), (F.col("h") + F.col("r_regionkey") - 3).alias("last_seq"))
    found = vf.verify(
        messages=t.messages, chats=t.chats.filter("NOT archived"), groups=t.groups.filter("left_at = 0"), roster=t.group_participants, indexed=t.messages.filter("media_type <> 'image'"),
        ledger=log.withColumn("event_type", F.when(F.col("event_type") == "purchase", "scrub").otherwise(F.col("event_type"))), raw=raw, links=links, checkpoints=checkpoints, views=[r.r_name for r in t("region").collect()],
    ).filter("check <> 'unread_inconsistent'")
    found = found.unionByName(vf.check_unread(t.chats))
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query("""SELECT issue, count(*) AS n FROM (SELECT CASE WHEN seq % 10 = 1 THEN 'hash_length' WHEN seq % 10 = 2 THEN 'hash_not_hex' WHEN seq % 10 = 3 THEN 'hash_mismatch' WHEN seq % 10 = 4 THEN 'raw_missing' WHEN seq % 10 = 5 THEN 'missing_source' END AS issue FROM ledger) WHERE issue IS NOT NULL GROUP BY issue""", "ledger")
def dm17_audit(t: Tables) -> DataFrame:
    e = _events(t).withColumn("source", F.when(F.col("seq") % 10 == 5, "").otherwise("live"))
    part = F.col("seq") % 10
    bad = e.withColumn("raw_hash", F.when(part == 1, "ab").when(part == 2, F.repeat(F.lit("z"), 64)).when(part == 3, F.repeat(F.lit("0"), 64)).otherwise(F.col("raw_hash"))).withColumn("event_id", F.col("seq").cast("string"))
    raw = bad.filter(part != 4).select("event_id", F.col("raw").cast("binary").alias("raw_bytes"))
    return vf.audit(bad, raw).groupBy("issue").agg(F.count("*").alias("n"))


# Streams


@query(f"WITH {_EVENTS} SELECT event_type, count(*) AS n FROM (SELECT DISTINCT id, event_type FROM e) GROUP BY event_type")
def st05_stream_append(t: Tables) -> DataFrame:
    """The events as a stream, appended to a log of its own, read back."""
    folder = f"{_stream_dir(t)}"
    e = _events(t)
    kept = e.select("seq", "dedup_key", "raw", "event_type", F.lit("live").alias("source"))
    kept.write.parquet(f"{folder}/in")
    sl.append(sl.source(t.spark, f"{folder}/in", kept.schema, files_per_batch=4), f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/log/events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"WITH {_EVENTS}, f AS (SELECT min((seq + 2) % 3 * 1000000000000 + seq) AS k FROM e GROUP BY id) SELECT k % 1000000000000 AS arrival, row_number() OVER (ORDER BY k) AS seq FROM f")
def st29_shared_log(t: Tables) -> DataFrame:
    """Two streams of the events into one log, numbered without a gap; the second one's batch is sent twice."""
    folder, e = _stream_dir(t), _events(t).withColumn("source", F.lit("live")).withColumnRenamed("seq", "arrival")
    for stream, batch, rest in (("a", 0, 1), ("a", 1, 2), ("b", 0, 0), ("b", 0, 0)):
        shared_log.append_batch(e.filter(F.col("arrival") % 3 == rest).drop("raw_hash", "event_id"), folder, stream, batch)
    return shared_log.read(t.spark, folder).select("arrival", "seq")


def _stream_dir(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL".replace("time_bucket(INTERVAL '1 day', ts) AS day", "CAST(floor(epoch(ts) / 86400) AS bigint) AS day"))
def st25_windows(t: Tables) -> DataFrame:
    e = t("events").select("event_type", F.timestamp_seconds(v.wall_seconds(F.col("ts"))).alias("ts"))
    return sl.windowed_counts(e, "1 day").select(F.floor(F.unix_seconds("start") / 86400).cast("bigint").alias("day"), "event_type", "n")


@query("SELECT event_id AS seq FROM events WHERE event_type = 'click'")
def st23_notifications(t: Tables) -> DataFrame:
    kinds = t("events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "message").otherwise("state").alias("event_type"), F.col("props").alias("payload"))
    return sl.notifications(kinds).select("seq")
