"""Envelopes, calls and facts read into rows and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import calls, messages
from quernstone.plans import ingest
from quernstone.queries import Tables, query

def _none():
    return F.lit(None).cast("string")



def _j(text: str) -> str:
    """A template of JSON with {expr} places as a SQL concat: JSON's own braces are written as << and >>."""
    parts, rest = [], text
    while "{" in rest:
        head, _, tail = rest.partition("{")
        x, _, rest = tail.partition("}")
        parts += [head, None, x]
    parts.append(rest)
    out, k = [], 0
    while k < len(parts):
        if parts[k] is None:
            out.append(f"CAST({parts[k + 1]} AS varchar(99))")
            k += 2
        else:
            if parts[k]:
                out.append("'" + parts[k].replace("<<", "{").replace(">>", "}").replace("'", "''") + "'")
            k += 1
    return f"concat({', '.join(out)})"


def _expr(sql: str):
    """The same expression for Spark."""
    return F.expr(sql.replace("varchar(99)", "string").replace("\\", "\\\\"))


# Messages

_BODY = f"""CASE o_orderkey % 6 WHEN 0 THEN {_j('<<"conversation":"{o_orderpriority}">>')}
WHEN 1 THEN {_j('<<"extendedTextMessage":<<"text":"{o_orderpriority}","contextInfo":<<"stanzaID":" m{o_orderkey} ","participant":"s1","isForwarded":true,"quotedMessage":<<"imageMessage":<<"caption":"c">>>>>>>>>>')}
WHEN 2 THEN {_j('<<"imageMessage":<<"caption":"{o_orderstatus}","fileLength":{o_custkey}>>>>')} WHEN 3 THEN '{{"audioMessage":{{}}}}'
WHEN 4 THEN {_j('<<"protocolMessage":<<"type":"REVOKE","key":<<"ID":"r{o_orderkey}">>>>>>')}
ELSE {_j('<<"deviceSentMessage":<<"destinationJID":"d{o_custkey}","message":<<"editedMessage":<<"message":<<"associatedChildMessage":<<"message":<<"editedMessage":<<"message":<<"associatedChildMessage":<<"message":<<"conversation":"deep">>>>>>>>>>>>>>>>>>>>>>')} END"""


@query("""SELECT CASE o_orderkey % 6 WHEN 5 THEN concat('d', o_custkey) ELSE concat('c', o_custkey) END AS chat_jid, CASE o_orderkey % 6 WHEN 4 THEN concat('r', o_orderkey) ELSE concat('m', o_orderkey) END AS msg_id, o_orderkey % 6 = 5 AS from_me,
CASE o_orderkey % 6 WHEN 2 THEN o_orderstatus WHEN 3 THEN '[Audio]' WHEN 4 THEN '' WHEN 5 THEN 'deep' ELSE o_orderpriority END AS text, CASE o_orderkey % 6 WHEN 2 THEN 'image' WHEN 3 THEN 'audio' END AS media_type, CASE o_orderkey % 6 WHEN 2 THEN o_custkey WHEN 3 THEN 0 END AS file_length,
CASE o_orderkey % 6 WHEN 1 THEN concat('m', o_orderkey) ELSE '' END AS reply_to_id, CASE o_orderkey % 6 WHEN 1 THEN 'Sent image' ELSE '' END AS reply_to_display, o_orderkey % 6 = 1 AS is_forwarded, o_orderkey % 6 = 5 AS edited, o_orderkey % 6 = 4 AS revoked, '' AS unhandled FROM orders""")
def pa01_live_messages(t: Tables) -> DataFrame:
    rows = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("chat_jid"), F.concat(F.lit("m"), "o_orderkey").alias("msg_id"), F.lit("s").alias("sender_jid"), F.lit(False).alias("from_me"), F.lit(0).alias("ts"), F.lit("").alias("push_name"), _none().alias("device_sent_to"), _expr(_BODY).alias("message"))
    got = messages.live(rows)
    return got.select("chat_jid", "msg_id", "from_me", "text", F.col("media.type").alias("media_type"), F.col("media.file_length").alias("file_length"), "reply_to_id", "reply_to_display", "is_forwarded", "edited", "revoked", "unhandled")


_INFO = _j('<<"key":<<"remoteJID":"c{o_custkey}","fromMe":{o_orderkey % 2 = 0},"ID":"m{o_orderkey}">>,"participant":"{CASE WHEN o_orderkey % 3 = 0 THEN \'p\' ELSE \'\' END}","messageTimestamp":{o_orderkey},"message":<<"conversation":"{o_orderstatus}">>>>')


@query("SELECT concat('m', o_orderkey) AS msg_id, CASE WHEN o_orderkey % 3 = 0 THEN 'p' ELSE concat('c', o_custkey) END AS sender_jid, o_orderkey % 2 = 0 AS from_me, o_orderkey AS ts, o_orderstatus AS text FROM orders")
def pa01_history_messages(t: Tables) -> DataFrame:
    return messages.history(t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("chat_jid"), _expr(_INFO).alias("info"))).select("msg_id", "sender_jid", "from_me", "ts", "text")


@query("SELECT concat('c', o_custkey) AS chat_jid, concat('m', o_orderkey) AS msg_id, o_orderkey AS ts FROM orders")
def sc11_history_batch(t: Tables) -> DataFrame:
    """Conversations of all customers as nested batches, taken apart again."""
    rows = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), _expr(_INFO).alias("info"), (F.col("o_custkey") % 7).alias("batch"))
    chats = rows.groupBy("batch", "id").agg(F.collect_list("info").alias("messages")).select("batch", F.struct("id", F.lit(0).alias("unread_count"), F.lit(False).alias("marked_unread"), "messages").alias("c"))
    batches = chats.groupBy("batch").agg(F.collect_list("c").alias("conversations"))
    return messages.history(messages.history_batch(batches).select("chat_jid", "info")).select("chat_jid", "msg_id", "ts")


_CONTENT = f"""CASE p_partkey % 8 WHEN 0 THEN {_j('<<"pollCreationMessageV3":<<"name":"{p_brand}","options":[<<"optionName":"a">>,<<"optionName":"{p_size}">>]>>>>')} WHEN 1 THEN {_j('<<"locationMessage":<<"degreesLatitude":{p_size},"degreesLongitude":2.5,"name":" {p_brand} ">>>>')}
WHEN 2 THEN {_j('<<"reactionMessage":<<"text":"+1","key":<<"ID":"m{p_partkey}">>>>>>')} WHEN 3 THEN {_j('<<"albumMessage":<<"expectedImageCount":{p_size}>>>>')} WHEN 4 THEN {_j('<<"listMessage":<<"title":"{p_brand}","buttonText":"open","sections":[<<"rows":[<<"title":"one">>,<<"title":" ">>,<<"title":"{p_size}">>]>>]>>>>')}
WHEN 5 THEN {_j('<<"contactMessage":<<"displayName":"{p_brand}","vcard":"TEL:{p_size}">>>>')} WHEN 6 THEN {_j('<<"templateMessage":<<"hydratedTemplate":<<"hydratedContentText":"{p_brand}","hydratedFooterText":"{p_size}","hydratedButtons":[<<"urlButton":<<"displayText":"go","URL":"u">>>>]>>>>>>')}
ELSE {_j('<<"odd{p_partkey % 3}Message":<<>>,"messageContextInfo":<<>>>>')} END"""


@query("""SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN concat('Poll: ', p_brand) WHEN 3 THEN concat('[Album: ', p_size, ' images]') WHEN 4 THEN p_brand WHEN 5 THEN concat('Contact: ', p_brand, ' (', p_size, ')') WHEN 6 THEN concat(p_brand, chr(10), '[', p_size, ']') ELSE '' END AS text,
CASE p_partkey % 8 WHEN 0 THEN concat('a,', p_size) END AS options, CASE p_partkey % 8 WHEN 1 THEN CAST(p_size AS double) END AS latitude, CASE p_partkey % 8 WHEN 1 THEN 'location' END AS media_type, CASE p_partkey % 8 WHEN 2 THEN concat('m', p_partkey) ELSE '' END AS reaction_to_id,
CASE p_partkey % 8 WHEN 4 THEN concat('list:open:0,list_row:one:1,list_row:', p_size, ':2') WHEN 6 THEN 'url:go:1' ELSE '' END AS buttons, CASE p_partkey % 8 WHEN 7 THEN concat('odd', p_partkey % 3, 'Message') ELSE '' END AS unhandled FROM part""")
def pa03_contents(t: Tables) -> DataFrame:
    rows = t("part").select(F.col("p_partkey").alias("k"), F.lit("c").alias("chat_jid"), F.lit("m").alias("msg_id"), F.lit("s").alias("sender_jid"), F.lit(False).alias("from_me"), _expr(_CONTENT).alias("message"))
    shown = F.array_join(F.transform("buttons", lambda b: F.concat_ws(":", b["type"], b["display_text"], b["index"].cast("string"))), ",")
    return messages.parsed(rows).select("k", "text", F.array_join("poll.options", ",").alias("options"), F.col("location.latitude").alias("latitude"), F.col("media.type").alias("media_type"), "reaction_to_id", shown.alias("buttons"), "unhandled")


_QUOTED = f"""CASE p_partkey % 5 WHEN 0 THEN {_j('<<"conversation":" {p_brand} ">>')} WHEN 1 THEN '{{"videoMessage":{{"gifPlayback":true}}}}' WHEN 2 THEN {_j('<<"pollCreationMessage":<<"name":"{p_brand}">>>>')} WHEN 3 THEN {_j('<<"groupStatusMentionMessage":<<"message":<<"listMessage":<<"description":"{p_size}">>>>>>>>')} ELSE {_j('<<"groupInviteMessage":<<"groupName":"{p_brand}">>>>')} END"""
_QUOTE = "concat('{\"stickerMessage\":{\"contextInfo\":{\"stanzaID\":\"q\",\"participant\":\"p\",\"forwardingScore\":', CAST(p_size % 2 AS varchar(99)), ',\"quotedMessage\":', " + _QUOTED + ", '}}}')"


@query("SELECT p_partkey AS k, 'q' AS reply_to_id, 'p' AS reply_to_sender, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN 'Sent gif' WHEN 2 THEN concat('Poll: ', p_brand) WHEN 3 THEN CAST(p_size AS varchar) ELSE concat('Group invite: ', p_brand) END AS reply_to_display, p_size % 2 = 1 AS is_forwarded, p_size % 2 AS forwarding_score FROM part")
def pa13_quotes(t: Tables) -> DataFrame:
    rows = t("part").select(F.col("p_partkey").alias("k"), F.lit("c").alias("chat_jid"), F.lit("m").alias("msg_id"), F.lit("s").alias("sender_jid"), F.lit(False).alias("from_me"), _expr(_QUOTE).alias("message"))
    return messages.parsed(rows).select("k", "reply_to_id", "reply_to_sender", "reply_to_display", "is_forwarded", "forwarding_score")


@query("SELECT concat('m', o_orderkey) AS msg_id, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE o_orderstatus END AS text, CASE WHEN o_orderkey % 4 = 3 THEN 'no bytes' END AS error, o_orderkey AS ts FROM orders")
def pa06_offline_decode(t: Tables) -> DataFrame:
    """Live and history events from their bytes; those of every fourth have been scrubbed."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, _expr(_INFO)).when(k % 4 < 3, _expr(_j('<<"conversation":"{o_orderstatus}">>'))).cast("binary")
    rows = t("orders").select(F.when(k % 4 == 0, "history").otherwise("live").alias("source"), F.lit("c").alias("chat_jid"), F.concat(F.lit("m"), k).alias("msg_id"), F.lit("s").alias("sender_jid"), F.lit(False).alias("from_me"), k.alias("event_ts"), raw.alias("raw"))
    return messages.decoded(rows).select("msg_id", "text", "error", "ts")


# Calls


@query("""SELECT l_orderkey AS k, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'terminate' WHEN 1 THEN 'offer' ELSE 'offer_notice' END AS event_type, CASE WHEN l_suppkey % 3 = 0 THEN 'g@g.us' ELSE '7@s.whatsapp.net' END AS chat_jid,
CASE WHEN l_partkey % 2 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'outbound' ELSE 'inbound' END WHEN l_linenumber % 3 = 0 THEN 'unknown' ELSE 'inbound' END AS direction, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'video' ELSE 'audio' END AS media,
CASE l_linenumber % 3 WHEN 0 THEN 'timed_out' ELSE '' END AS reason FROM lineitem""")
def pa14_call_events(t: Tables) -> DataFrame:
    n, c = F.col("l_linenumber") % 3, F.col
    rows = t("lineitem").select(
        F.when(n == 0, "CallTerminate").when(n == 1, "CallOffer").otherwise("CallOfferNotice").alias("kind"), F.lit("7@s.whatsapp.net").alias("from_jid"), F.when(c("l_suppkey") % 3 == 0, "g@g.us").otherwise("").alias("group_jid"),
        F.when(c("l_partkey") % 2 == 0, F.when(c("l_suppkey") % 2 == 0, "1:4@s.whatsapp.net").otherwise("2@s.whatsapp.net")).alias("creator_jid"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("call_id"), F.lit(" Timed-Out").alias("reason"), F.lit("AUDIO").alias("media"), F.lit("group").alias("call_type"),
        F.when(n == 1, '{"tag":"call","attrs":{"x":"1"},"content":[{"tag":"offer","content":[{"tag":"video"}]}]}').alias("node"), F.lit(5).alias("ts"), F.lit("1@s.whatsapp.net").alias("self_jid"),
    )
    at = F.split("call_id", "/")
    return calls.live_events(rows).select(at[0].cast("bigint").alias("k"), at[1].cast("int").alias("n"), "event_type", "chat_jid", "direction", "media", "reason")


_RECORD = _j(
    '<<"callResult":"{CASE WHEN o_orderkey % 2 = 0 THEN \'ACCEPTEDELSEWHERE\' ELSE \'MISSED\' END}","silenceReason":"NONE","isDndMode":{o_orderkey % 5 = 0},"duration":{o_custkey},"startTime":{CASE o_orderkey % 3 WHEN 0 THEN 1600000000 WHEN 1 THEN 1600000000000 ELSE 0 END},"isIncoming":{o_orderkey % 2 = 0},'
    '"callCreatorJID":"{CASE o_orderkey % 4 WHEN 0 THEN \'1@s\' WHEN 1 THEN \'2@s\' ELSE \'\' END}","groupJID":"{CASE WHEN o_orderkey % 7 = 0 THEN \'g@g.us\' ELSE \'\' END}","participants":[<<"userJID":"1@s","callResult":"MISSED">>,<<"userJID":"{CASE WHEN o_orderkey % 3 = 0 THEN \'\' ELSE \'3@s\' END}">>],"callID":"{o_orderkey}">>'
)


@query("""WITH r AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN '1@s' WHEN 1 THEN '2@s' END AS creator, CASE WHEN o_orderkey % 3 <> 0 THEN '3@s' END AS other, o_orderkey % 7 = 0 AS in_group FROM orders)
SELECT CAST(o_orderkey AS varchar) AS call_id, CASE WHEN in_group THEN 'g@g.us' WHEN creator = '2@s' THEN creator ELSE coalesce(other, creator, '1@s') END AS chat_jid, coalesce(creator, CASE WHEN NOT in_group AND other IS NULL THEN '1@s' ELSE '' END) AS sender_jid,
CASE WHEN o_orderkey % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction, CASE WHEN o_orderkey % 2 = 0 THEN 'accepted_elsewhere' ELSE 'missed' END AS outcome, CASE WHEN o_orderkey % 5 = 0 THEN 'dnd' ELSE '' END AS reason, o_custkey AS duration_secs,
CASE o_orderkey % 3 WHEN 2 THEN 77 ELSE 1600000000 END AS ts, CASE WHEN other IS NULL THEN 1 ELSE 2 END AS n FROM r""")
def pa05_call_records(t: Tables) -> DataFrame:
    rows = t("orders").select(_expr(_RECORD).alias("record"), F.array(F.lit("1@s"), F.lit("1@lid")).alias("self_jids"), F.lit(77_500).cast("bigint").alias("ts_ms"))
    return calls.records(rows).select("call_id", "chat_jid", "sender_jid", "direction", "outcome", "reason", "duration_secs", "ts", F.size("participants").alias("n"))


@query("SELECT concat('p', o_custkey) AS chat_jid, CASE WHEN o_orderkey % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction, count(*) AS n FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1, 2")
def pa14_call_deletions(t: Tables) -> DataFrame:
    rows = t("orders").select(F.when(F.col("o_custkey") % 2 == 1, F.concat(F.lit(" p"), "o_custkey")).otherwise(" ").alias("peer_jid"), (F.col("o_orderkey") % 2 == 0).alias("is_incoming"))
    return calls.deletions(rows).groupBy("chat_jid", "direction").agg(F.count("*").alias("n"))


# Events

_HASHED = "SELECT k, event_type, dedup_key, raw, concat('evt_', substr(sha256(concat(dedup_key, chr(10), sha256(raw))), 1, 32)) AS event_id FROM x"


def _made(df: DataFrame, k) -> DataFrame:
    return df.select(k.alias("k"), "event_type", "dedup_key", "raw", "event_id")


@query(f"""WITH b AS (SELECT o_orderkey AS k, concat('c', o_custkey) AS c, concat('m', o_orderkey) AS m, o_orderkey * 1000 AS ts, o_custkey % 2 = 0 AS s, CASE o_orderkey % 6 WHEN 0 THEN 'star' WHEN 1 THEN 'delete_for_me' WHEN 2 THEN 'archive' WHEN 3 THEN 'pin' WHEN 4 THEN 'mute' ELSE 'mark_read' END AS event_type FROM orders),
x AS (SELECT k, event_type, concat('dd:{{"scope":"', event_type, '","parts":["', c, '","', CASE event_type WHEN 'star' THEN concat('<b>","false","', m, '","', ts, '","', s) WHEN 'delete_for_me' THEN concat('<b>","false","', m, '","', ts, '","', s) WHEN 'archive' THEN concat(ts, '","', s, '","', s) WHEN 'mute' THEN concat(ts, '","', s, '","', k) ELSE concat(ts, '","', s) END, '"]}}') AS d,
  concat('{{"type":"', event_type, '","chat":"', c, '"', CASE WHEN event_type IN ('star', 'delete_for_me') THEN concat(',"sender":"<b>","msg_id":"', m, '"') ELSE '' END, CASE WHEN s AND event_type <> 'delete_for_me' THEN ',"state":true' ELSE '' END, CASE event_type WHEN 'mute' THEN concat(',"end_ts_ms":', k) ELSE '' END,
    CASE event_type WHEN 'archive' THEN concat(',"range":"', s, '"') ELSE '' END, CASE WHEN s AND event_type = 'delete_for_me' THEN ',"delete_media":true' ELSE '' END, ',"timestamp_ms":', ts, '}}') AS r FROM b),
y AS (SELECT k, event_type, replace(replace(d, '<', '\\u003c'), '>', '\\u003e') AS dedup_key, replace(replace(r, '<', '\\u003c'), '>', '\\u003e') AS raw FROM x) {_HASHED.replace("FROM x", "FROM y")}""")
def pa07_state_changes(t: Tables) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_custkey") % 2 == 0
    kind = F.element_at(F.array(*map(F.lit, ("star", "delete_for_me", "archive", "pin", "mute", "mark_read"))), (k % 6 + 1).cast("int"))
    rows = t("orders").select(kind.alias("type"), F.concat(F.lit("c"), "o_custkey").alias("chat_jid"), F.lit("<b>").alias("sender_jid"), F.lit(None).cast("boolean").alias("from_me"), F.concat(F.lit("m"), k).alias("msg_id"), s.alias("state"), k.alias("end_ts_ms"), s.alias("range"), s.alias("delete_media"), (k * 1000).alias("ts_ms"))
    return _made(ingest.state_changes(rows), F.col("event_ts"))


@query(f"""WITH b AS (SELECT l_orderkey * 8 + l_linenumber AS k, concat('c', l_suppkey) AS c, concat('m', l_orderkey) AS m, l_linenumber % 2 = 0 AS gone, l_returnflag AS o FROM lineitem),
x AS (SELECT k, 'poll_vote' AS event_type, concat('dd:{{"scope":"poll-vote', CASE WHEN gone THEN '-delete' ELSE '' END, '","parts":["', c, '","', m, '","v","', k * 1000, '"]}}') AS dedup_key, concat('{{"chat_jid":"', c, '","poll_msg_id":"', m, '","voter_jid":"v"', CASE WHEN gone THEN '' ELSE ',"vote_msg_id":"w"' END, ',"selected":[', CASE WHEN gone THEN '' ELSE concat('"', o, '"') END, '],"voted_ts_ms":', k * 1000, CASE WHEN gone THEN ',"deleted":true' ELSE '' END, '}}') AS raw FROM b) {_HASHED}""")
def pa08_poll_votes(t: Tables) -> DataFrame:
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    picked = F.when(F.col("l_linenumber") % 2 == 1, F.array("l_returnflag")).otherwise(F.array().cast("array<string>"))
    rows = t("lineitem").select(F.lit("live").alias("source"), F.concat(F.lit("c"), "l_suppkey").alias("chat_jid"), F.concat(F.lit("m"), "l_orderkey").alias("poll_msg_id"), F.lit("v").alias("voter_jid"), F.lit("w").alias("vote_msg_id"), picked.alias("selected"), F.array().cast("array<string>").alias("unknown_hashes"), (k * 1000).alias("voted_ts_ms"))
    return _made(ingest.poll_votes(rows), F.col("event_ts"))


@query(f"""WITH x AS (SELECT s_suppkey AS k, 'group' AS event_type, concat('{{"jid":"g', s_suppkey, '","name":"', s_name, '"', CASE WHEN s_suppkey > 0 THEN concat(',"created_ts":', s_suppkey) ELSE '' END, CASE WHEN s_suppkey % 2 = 0 THEN ',"is_parent":true' ELSE ',"linked_parent_jid":"l"' END, ',"participants":[{{"user_jid":"a","role":"superadmin"}},{{"user_jid":"b","role":"', CASE WHEN s_suppkey % 3 = 0 THEN 'admin' ELSE 'member' END, '"}}]}}') AS raw, s_suppkey FROM supplier),
y AS (SELECT k, event_type, raw, concat('dd:{{"scope":"group","parts":["g', s_suppkey, '","', sha256(raw), '"]}}') AS dedup_key FROM x) {_HASHED.replace("FROM x", "FROM y")}""")
def pa08_groups(t: Tables) -> DataFrame:
    k, no = F.col("s_suppkey"), F.lit(False)
    member = lambda j, a, s: F.struct(F.lit(j).alias("user_jid"), a.alias("is_admin"), s.alias("is_super_admin"))
    rows = t("supplier").select(F.lit("live").alias("source"), F.concat(F.lit("g"), k).alias("jid"), F.col("s_name").alias("name"), F.lit("").alias("owner_jid"), k.alias("created_ts"), (k % 2 == 0).alias("is_parent"), F.lit("l").alias("linked_parent_jid"), F.lit(0).alias("left_at"), F.array(member("b", k % 3 == 0, no), member("a", no, F.lit(True))).alias("participants"), k.alias("ts"))
    return _made(ingest.groups(rows), F.col("event_ts"))


@query(f"""WITH x AS (SELECT o_orderkey AS k, 'message' AS event_type, concat('dd:{{"scope":"message","parts":["', replace(concat('{{"chat":"g', o_custkey, '@g.us","from_me":false,"id":"m', o_orderkey, '","participant":"s"}}'), '"', '\\"'), '"]}}') AS dedup_key, concat('{{"conversation":"', o_orderstatus, '"}}') AS raw FROM orders) {_HASHED}""")
def pa08_messages(t: Tables) -> DataFrame:
    body = _expr(_j('<<"conversation":"{o_orderstatus}">>'))
    rows = t("orders").select(F.concat(F.lit("g"), "o_custkey", F.lit("@g.us")).alias("chat_jid"), F.concat(F.lit("m"), "o_orderkey").alias("msg_id"), F.lit("s").alias("sender_jid"), F.lit(False).alias("from_me"), F.col("o_orderkey").alias("ts"), F.lit("").alias("push_name"), _none().alias("device_sent_to"), body.alias("message"), body.alias("raw"), F.lit(False).alias("from_full_sync"))
    return _made(ingest.messages(messages.live(rows)), F.col("event_ts"))


@query(f"""WITH x AS (SELECT c_custkey AS k, 'contact' AS event_type, concat('dd:{{"scope":"contact","parts":["j', c_custkey, '","","', c_name, '","', c_mktsegment, '","",""]}}') AS dedup_key, concat('{{"jid":"j', c_custkey, '","push_name":"', c_name, '","full_name":"', c_mktsegment, '"}}') AS raw FROM customer
  UNION ALL SELECT -c_custkey, 'contact', concat('dd:{{"scope":"system_name","parts":["j', c_custkey, '","', c_name, '"]}}'), concat('{{"jid":"j', c_custkey, '","system_name":"', c_name, '"}}') FROM customer
  UNION ALL SELECT 0, 'clear_system_names', 'dd:{{"scope":"clear_system_names","parts":["9"]}}', '{{"type":"clear_system_names","ts":9}}') {_HASHED}""")
def pa15_contact_events(t: Tables) -> DataFrame:
    c = t("customer").select(F.concat(F.lit(" j"), "c_custkey").alias("jid"), _none().alias("phone"), F.col("c_name").alias("push_name"), F.col("c_mktsegment").alias("full_name"), F.lit("").alias("first_name"), F.lit("").alias("business_name"), F.col("c_name").alias("system_name"), F.col("c_custkey").alias("ts"))
    seen, named = ingest.contacts(c), ingest.system_names(c.withColumn("ts", -F.col("ts")))
    cleared = ingest.system_names_cleared(t.spark.range(1).select(F.lit(9).alias("ts")))
    return _made(ingest.all_of(seen, named), F.col("event_ts")).unionByName(_made(cleared, F.lit(0).cast("bigint")))
