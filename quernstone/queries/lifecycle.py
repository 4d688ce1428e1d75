"""Files in and out, marks and views over the log, projections from a checkpoint, identities as events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators import joins as jo
from quernstone.plans import ingest, projection, views
from quernstone.plans import verify as vf
from quernstone.queries import Tables, query
from quernstone.queries.states import _log
from quernstone.sources import contacts as contact_files
from quernstone.sources.catalog import Catalog, shared_dir
from quernstone.sources.export import export


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT s_name AS name, concat('+', s_suppkey) AS phone FROM supplier")
def sc09_contact_file(t: Tables) -> DataFrame:
    """Suppliers written as a contact file, an object a line, and read as one."""
    path = _folder(t, "contacts")
    t("supplier").select(F.to_json(F.struct(F.col("s_name").alias("full_name"), F.array(F.concat(F.lit("+"), "s_suppkey")).alias("phones"))).alias("value")).write.text(path)
    return contact_files.read(t.spark, path).select("name", F.col("phones")[0].alias("phone"))


@query("SELECT rowid, ts, chat_jid FROM (SELECT * FROM messages WHERE deleted_at IS NULL ORDER BY ts, rowid LIMIT 1000)", "messages")
def sc15_export(t: Tables) -> DataFrame:
    path = _folder(t, "export")
    export(t.messages, path)
    return t.spark.read.schema("rowid bigint, ts bigint, chat_jid string").json(path)


def _events(t: Tables, kinds: dict[str, str], payload, sender: str = "s") -> DataFrame:
    """The log with its types renamed, others left out."""
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    made = t.ledger.filter(F.col("event_type").isin(*kinds)).withColumn("payload", payload)
    return made.select("seq", "source", kind.alias("event_type"), "chat_jid", "msg_id", F.lit(sender).alias("sender_jid"), F.col("ts").alias("event_ts"), "payload")


@query("""WITH g AS (SELECT chat_jid, max(seq) AS s, arg_max(source, seq) AS name FROM ledger WHERE event_type = 'click' GROUP BY 1), l AS (SELECT chat_jid, max(seq) AS s, arg_max(ts, seq) AS t FROM ledger WHERE event_type = 'error' GROUP BY 1)
SELECT g.chat_jid AS jid, g.name, CASE WHEN l.s > g.s THEN l.t END AS left_at FROM g LEFT JOIN l ON g.chat_jid = l.chat_jid""", "ledger")
def dm03_group_view(t: Tables) -> DataFrame:
    """Clicks play news of groups, errors leaving them."""
    log = _events(t, {"click": "group", "error": "group_leave"}, F.to_json(F.struct(F.col("source").alias("name"))))
    return views.groups(log).select("jid", "name", "left_at")


@query("SELECT chat_jid, msg_id, bool_or(event_type = 'purchase') AS revoked, arg_min(ts, seq) FILTER (WHERE event_type = 'purchase') AS deleted_at FROM ledger WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2", "ledger")
def dm06_message_marks(t: Tables) -> DataFrame:
    """Clicks are messages, purchases revoke them, before they come or after."""
    log = _events(t, {"click": "message", "purchase": "revoke"}, F.to_json(F.struct(F.when(F.col("event_type") == "click", F.col("raw")).alias("text"))))
    return views.messages(log).select("chat_jid", "msg_id", "revoked", "deleted_at")


@query("""WITH l AS (SELECT chat_jid, msg_id, event_type, seq FROM (SELECT *, row_number() OVER (PARTITION BY chat_jid, msg_id ORDER BY seq DESC) AS n FROM ledger) WHERE n = 1)
SELECT chat_jid, msg_id, CASE event_type WHEN 'error' THEN 'missing' ELSE 'changed' END AS change, seq AS event_id FROM l WHERE event_type IN ('error', 'click')""", "ledger")
def dm18_attributed_diff(t: Tables) -> DataFrame:
    """A shadow that lacks some rows and changed others, each with the event it comes from."""
    log = t.ledger.select("chat_jid", "msg_id", "event_type", "seq", F.col("seq").alias("event_id"), F.concat(F.lit("d"), "seq").alias("dedup_key"))
    active = jo.latest(log.select("chat_jid", "msg_id", "event_type", "seq"), ["chat_jid", "msg_id"], ["seq"]).drop("seq")
    shadow = active.filter("event_type <> 'error'").withColumn("event_type", F.when(F.col("event_type") == "click", "other").otherwise(F.col("event_type")))
    return vf.attributed_diff(jo.keyed_diff(active, shadow, ["chat_jid", "msg_id"], "messages"), log, ["chat_jid", "msg_id"]).select("chat_jid", "msg_id", "change", "event_id")


@query("SELECT chat_jid, msg_id AS poll_msg_id, concat('o', seq % 3) AS choice FROM (SELECT *, row_number() OVER (PARTITION BY chat_jid, msg_id ORDER BY seq DESC) AS n FROM ledger WHERE event_type IN ('view', 'error')) WHERE n = 1 AND event_type = 'view'", "ledger")
def st27_vote_retraction(t: Tables) -> DataFrame:
    """Views vote, errors vote for nothing."""
    picked = F.when(F.col("event_type") == "view", F.array(F.concat(F.lit("o"), F.col("seq") % 3))).otherwise(F.array().cast("array<string>"))
    log = _events(t, {"view": "vote", "error": "vote"}, F.to_json(F.struct(picked.alias("selected"), (F.col("seq") * 1000).alias("ts"))))
    return views.votes(log).select("chat_jid", "poll_msg_id", F.array_join("selected", ",").alias("choice"))


@query("""WITH p AS (SELECT DISTINCT chat_jid, msg_id FROM ledger WHERE event_type = 'purchase'), o AS (SELECT chat_jid, msg_id, concat('o', seq % 3) AS option, min(seq) AS s FROM ledger WHERE event_type = 'signup' AND seq % 3 > 0 GROUP BY 1, 2, 3)
SELECT p.chat_jid, p.msg_id, concat_ws(',', 'o0', string_agg(option, ',' ORDER BY s)) AS options FROM p LEFT JOIN o ON p.chat_jid = o.chat_jid AND p.msg_id = o.msg_id GROUP BY 1, 2""", "ledger")
def st28_poll_options(t: Tables) -> DataFrame:
    """Purchases are polls with one option, sign-ups add options to them, some once more."""
    options = F.when(F.col("event_type") == "purchase", F.array(F.lit("o0"))).otherwise(F.array(F.concat(F.lit("o"), F.col("seq") % 3)))
    log = _events(t, {"purchase": "poll", "signup": "poll_option"}, F.to_json(F.struct(F.lit("?").alias("question"), options.alias("options"))))
    return views.polls(log).select("chat_jid", "msg_id", F.array_join("options", ",").alias("options"))


@query("SELECT chat_jid, msg_id, ts AS starred_at FROM (SELECT *, row_number() OVER (PARTITION BY chat_jid, msg_id ORDER BY seq DESC) AS n FROM ledger WHERE event_type = 'signup') WHERE n = 1 AND seq % 4 > 0", "ledger")
def st05_projection(t: Tables) -> DataFrame:
    """Stars brought up in three advances from checkpoints, the last of which finds nothing new."""
    catalog, log = Catalog(t.spark, _folder(t, "store"), writable=True), _log(t)
    half = log.agg(F.floor(F.max("seq") / 2).cast("bigint")).first()[0]
    for target in (half, None, None):
        projection.advance(catalog, ["starred", "polls"], log, target)
    return Catalog(t.spark, catalog.base).table("starred").select("chat_jid", "msg_id", "starred_at")


_KNOWN = "i AS (SELECT chat_jid AS lid, concat('p', max(seq) % 3) AS pn, min(seq) AS since FROM ledger WHERE event_type = 'error' GROUP BY chat_jid)"


@query(f"WITH {_KNOWN} SELECT e.seq, CASE WHEN e.seq > since THEN pn ELSE chat_jid END AS chat_jid FROM ledger e LEFT JOIN i ON chat_jid = lid WHERE e.event_type = 'click'", "ledger")
def st14_identity_events(t: Tables) -> DataFrame:
    """Errors say that a chat's id is a hidden one: later messages go to the phone id."""
    log = _events(t, {"click": "message", "error": "identity_resolution"}, F.to_json(F.struct(F.col("chat_jid").alias("lid"), F.concat(F.lit("p"), F.col("seq") % 3).alias("pn"))))
    return views.with_identities(log).filter("event_type = 'message'").select("seq", "chat_jid")


@query(f"WITH {_KNOWN} SELECT coalesce(pn, chat_jid) AS chat_jid, msg_id, max(ts) AS ts FROM ledger LEFT JOIN i ON chat_jid = lid WHERE event_type = 'click' GROUP BY 1, 2", "ledger")
def st14_identified_messages(t: Tables) -> DataFrame:
    """Messages of one person under two ids, merged; those before the ids were known too."""
    text = F.when(F.col("event_type") == "click", F.to_json(F.struct(F.col("raw").alias("text")))).otherwise(F.to_json(F.struct(F.col("chat_jid").alias("lid"), F.concat(F.lit("p"), F.col("seq") % 3).alias("pn"))))
    return views.identified(_events(t, {"click": "message", "error": "identity_resolution"}, text))["messages"].select("chat_jid", "msg_id", "ts")


@query("""WITH f AS (SELECT chat_jid AS lid, concat('p', seq % 3) AS pn, seq FROM ledger WHERE event_type = 'error' UNION ALL SELECT concat('p', seq % 3), concat('q', seq % 2), seq FROM ledger WHERE event_type = 'purchase'),
a AS (SELECT e.seq, coalesce(f.pn, e.chat_jid) AS id FROM (SELECT seq, chat_jid FROM ledger WHERE event_type = 'click') e ASOF LEFT JOIN f ON e.chat_jid = f.lid AND e.seq > f.seq)
SELECT a.seq, coalesce(f.pn, a.id) AS chat_jid FROM a ASOF LEFT JOIN f ON a.id = f.lid AND a.seq > f.seq""", "ledger")
def st14_identities_at_the_time(t: Tables) -> DataFrame:
    """Errors say what a chat's id belongs to, purchases what that belongs to; each click goes where both led when it came."""
    bought = F.col("event_type") == "purchase"
    said = F.struct(F.when(bought, F.concat(F.lit("p"), F.col("seq") % 3)).otherwise(F.col("chat_jid")).alias("lid"), F.when(bought, F.concat(F.lit("q"), F.col("seq") % 2)).otherwise(F.concat(F.lit("p"), F.col("seq") % 3)).alias("pn"))
    log = _events(t, {"click": "message", "error": "identity_resolution", "purchase": "identity_resolution"}, F.to_json(said))
    return views.with_identities_at(log, ("chat_jid",)).filter("event_type = 'message'").select("seq", "chat_jid")


@query("""WITH k AS (SELECT jid AS lid, concat('p', jid) AS pn FROM chats WHERE archived),
d AS (SELECT concat('dd:{"scope":"identity","parts":["', lid, '","', pn, '"]}') AS key, 'identity_resolution' AS event_type FROM k
  UNION ALL SELECT concat('dd:{"scope":"scrub","parts":["', m.chat_jid, '","', m.msg_id, '"]}'), 'scrub' FROM messages m JOIN k ON m.chat_jid = k.lid JOIN purges p ON m.chat_jid = p.chat_jid AND m.msg_id = p.msg_id AND p.k % 6 = 0 WHERE m.local_path <> '')
SELECT event_type, key AS dedup_key FROM d""", "chats messages purges")
def dm25_historical_identities(t: Tables) -> DataFrame:
    """Archived chats play hidden ids with a known phone: events that say so, and scrubs of their purged messages that kept media."""
    known = t.chats.filter("archived").select(F.col("jid").alias("lid"), F.concat(F.lit("p"), "jid").alias("pn"))
    return ingest.historical(known, t.messages, t.purges.filter("k % 6 = 0"), F.lit(7)).select("event_type", "dedup_key")
