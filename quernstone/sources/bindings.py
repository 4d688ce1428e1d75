"""The archive's tables, played by generated tables. One expression list serves Spark and, as text, the SQL oracle.

Every expression is plain SQL that both engines read alike; seconds of a timestamp are the one exception.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"

#: name -> (generated table, {column: expression}). {ts:x} stands for the whole seconds of the timestamp x.
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "chats": ("customer", {
        "jid": "concat('c', CAST(c_custkey AS varchar(20)))", "kind": "CASE WHEN c_custkey % 3 = 0 THEN 'group' WHEN c_custkey % 11 = 0 THEN 'broadcast' ELSE 'dm' END", "name": "c_name",
        "last_message_ts": "CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 700000000 + c_custkey * 7919 % 300000000 END", "archived": "c_custkey % 5 = 0", "pinned": "c_custkey % 7 = 0",
        "muted_until": "CASE c_custkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1700000000 + c_custkey ELSE 1500000000 END", "unread": "c_custkey % 3 = 1", "unread_count": "CAST(c_custkey % 6 AS bigint)",
    }),
    "contacts": ("customer", {
        "jid": "concat('c', CAST(c_custkey AS varchar(20)))", "phone": "concat('+49 ', CAST(1000000 + c_custkey AS varchar(20)))", "push_name": "CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE concat('p', CAST(c_custkey AS varchar(20))) END",
        "full_name": "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END", "first_name": "CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE NULL END", "business_name": "CASE WHEN c_custkey % 7 = 0 THEN concat(c_mktsegment, ' Ltd') ELSE '' END",
        "system_name": "CASE WHEN c_custkey % 11 = 0 THEN concat('Sys ', c_name) ELSE '' END", "alias": "CASE WHEN c_custkey % 13 = 0 THEN concat('al', CAST(c_custkey AS varchar(20))) ELSE NULL END", "updated_at": "c_custkey * 10",
    }),
    "contact_tags": ("orders", {"jid": "concat('c', CAST(o_custkey AS varchar(20)))", "tag": "lower(o_orderpriority)"}),
    "groups": ("supplier", {
        "jid": "concat('g', CAST(s_suppkey AS varchar(20)))", "name": "s_name", "owner_jid": "concat('c', CAST(s_nationkey AS varchar(20)))", "created_ts": "600000000 + s_suppkey * 104729 % 1000000",
        "left_at": "CASE WHEN s_suppkey % 6 = 0 THEN 800000000 + s_suppkey ELSE 0 END", "updated_at": "s_suppkey",
    }),
    "group_participants": ("supplier", {
        "group_jid": "concat('g', CAST(s_nationkey AS varchar(20)))", "user_jid": "concat('c', CAST(s_suppkey AS varchar(20)))", "role": "CASE s_suppkey % 5 WHEN 0 THEN 'superadmin' WHEN 1 THEN 'admin' ELSE 'member' END", "updated_at": "s_suppkey",
    }),
    "messages": ("orders", {
        "rowid": "o_orderkey", "chat_jid": "concat('c', CAST(o_custkey AS varchar(20)))", "msg_id": "concat('m', CAST(o_orderkey AS varchar(20)))", "sender_jid": "concat('s', CAST(o_orderkey % 40 AS varchar(20)))",
        "sender_name": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('Sender ', CAST(o_orderkey % 40 AS varchar(20))) END", "ts": "{ts:o_orderdate}", "from_me": "o_orderkey % 3 = 0",
        "text": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('order ', lower(o_orderpriority), ' 100% of _', CAST(o_orderkey % 1000 AS varchar(20))) END", "display_text": "CASE WHEN o_orderkey % 9 = 0 THEN concat('shown ', CAST(o_orderkey AS varchar(20))) ELSE '' END",
        "quoted_msg_id": "CASE WHEN o_orderkey % 8 = 0 THEN concat('m', CAST(o_orderkey - 8 AS varchar(20))) ELSE '' END", "is_forwarded": "o_orderkey % 12 = 0", "reaction_to_id": "CASE WHEN o_orderkey % 14 = 0 THEN concat('m', CAST(o_orderkey - 7 AS varchar(20))) ELSE '' END",
        "reaction_emoji": "CASE WHEN o_orderkey % 28 = 0 THEN '+1' ELSE '' END", "media_type": "CASE o_orderkey % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'document' ELSE '' END", "media_caption": "CASE WHEN o_orderkey % 6 = 0 THEN concat('caption ', o_orderstatus) ELSE '' END",
        "filename": "CASE WHEN o_orderkey % 6 = 1 THEN concat('file', CAST(o_orderkey AS varchar(20)), '.pdf') ELSE '' END", "direct_path": "CASE WHEN o_orderkey % 6 < 2 AND o_orderkey % 18 > 0 THEN '/d' ELSE '' END", "media_key_length": "CASE WHEN o_orderkey % 6 < 2 THEN 32 ELSE 0 END",
        "local_path": "CASE WHEN o_orderkey % 5 = 0 THEN concat('/media/', CAST(o_orderkey % 700 AS varchar(20))) ELSE '' END", "media_unavailable_at": "CASE WHEN o_orderkey % 42 = 0 THEN 5 ELSE NULL END",
        "deleted_at": "CASE WHEN o_orderkey % 17 = 0 THEN {ts:o_orderdate} + 60 ELSE NULL END", "revoked": "o_orderkey % 17 = 0", "deleted_for_me": "o_orderkey % 34 = 0",
    }),
    "starred": ("orders", {"chat_jid": "concat('c', CAST(o_custkey AS varchar(20)))", "msg_id": "concat('m', CAST(o_orderkey AS varchar(20)))", "starred_at": "{ts:o_orderdate} + 100", "k": "o_orderkey"}),
    "purges": ("orders", {"chat_jid": "concat('c', CAST(o_custkey AS varchar(20)))", "msg_id": "concat('m', CAST(o_orderkey AS varchar(20)))", "purged_at": "{ts:o_orderdate} + 200", "k": "o_orderkey"}),
    "polls": ("orders", {"chat_jid": "concat('c', CAST(o_custkey AS varchar(20)))", "msg_id": "concat('m', CAST(o_orderkey AS varchar(20)))", "question": "o_orderpriority", "selectable_count": "CAST(o_orderkey % 3 AS bigint)", "created_ts": "{ts:o_orderdate}", "k": "o_orderkey"}),
    "poll_votes": ("lineitem", {
        "poll_msg_id": "concat('m', CAST(l_orderkey AS varchar(20)))", "voter_jid": "concat('v', CAST(l_suppkey % 20 AS varchar(20)))", "choice": "CASE WHEN l_partkey % 10 = 0 THEN '' ELSE l_returnflag END", "ts": "{ts:l_shipdate} * 1000",
        "seq": "l_linenumber * 1000000 + l_partkey", "tie": "concat(l_linestatus, CAST(l_quantity AS varchar(20)), '/', CAST(l_extendedprice AS varchar(30)))",
    }),
    "ledger": ("events", {
        "seq": "event_id", "ts": "{ts:ts}", "chat_jid": "concat('c', CAST(user_id AS varchar(20)))", "event_type": "event_type", "source": "CASE event_id % 4 WHEN 0 THEN 'history' WHEN 1 THEN 'app_state' ELSE 'live' END",
        "raw": "props", "value": "value", "msg_id": "concat('e', CAST(event_id % 300 AS varchar(20)))",
    }),
}


def _parts(expression: str) -> list[str]:
    """Splits around {ts:x}: plain text at even places, x at odd ones."""
    out, rest = [], expression
    while "{ts:" in rest:
        head, _, tail = rest.partition("{ts:")
        x, _, rest = tail.partition("}")
        out += [head, x]
    return [*out, rest]


def _text(expression: str, seconds: str) -> str:
    return "".join(seconds.format(p) if k % 2 else p for k, p in enumerate(_parts(expression)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An archive table over the generated one that plays it."""
    base, columns = TABLES[name]
    seconds = f"timestampdiff(SECOND, timestamp_ntz'{_EPOCH}', {{}})"
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    return df.select(*[F.expr(_text(e, seconds).replace("varchar(20)", "string").replace("varchar(30)", "string")).alias(c) for c, e in columns.items()])


def sql(*names: str) -> str:
    """The same tables as common table expressions, without WITH."""
    seconds = "CAST(floor(epoch({})) AS bigint)"
    return ",\n".join(f"{n} AS (SELECT {', '.join(f'{_text(e, seconds)} AS {c}' for c, e in TABLES[n][1].items())} FROM {TABLES[n][0]})" for n in names)
