"""Manifests: tables are shared from snapshot to snapshot, and two writers can't overwrite each other."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.plans import ingest, projection, views
from quernstone.sources.catalog import Catalog, Conflict, conformed

CHAT = "1@s.whatsapp.net"


@pytest.fixture()
def store(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/store", writable=True)


def _rows(df):
    return sorted(map(str, df.collect()))


def _chats(spark, *names):
    return conformed(spark.createDataFrame([(n, n) for n in names], "jid string, name string"), "chats")


def _log(spark, n):
    c = F.col
    rows = spark.range(1, n + 1).select((c("id") * 1000).alias("ts_ms"), F.concat(F.lit("c"), c("id") % 3, F.lit("@s.whatsapp.net")).alias("chat_jid"), c("id"))
    none = F.lit(None).cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("archive", "pin", "mute", "mark_read", "star"))), (c("id") % 5 + 1).cast("int"))
    state = ingest.state_changes(rows.select(kind.alias("type"), "chat_jid", none.alias("sender_jid"), F.lit(False).alias("from_me"), F.concat(F.lit("m"), c("id") % 4).alias("msg_id"), (c("id") % 2 == 0).alias("state"), c("id").alias("end_ts_ms"), F.lit(True).alias("range"), F.lit(False).alias("delete_media"), "ts_ms"))
    seen = rows.filter("id % 7 = 0").select(c("chat_jid").alias("jid"), *[F.lit("").alias(x) for x in ("phone", "full_name", "first_name", "business_name")], F.concat(F.lit("p"), "id").alias("push_name"), (c("id") + n).alias("ts"))
    votes = rows.filter("id % 3 = 0").select(F.lit("live").alias("source"), "chat_jid", F.lit("p").alias("poll_msg_id"), F.concat(F.lit("v"), c("id") % 2).alias("voter_jid"), F.lit("w").alias("vote_msg_id"), F.array(F.concat(F.lit("o"), "id")).alias("selected"), F.array().cast("array<string>").alias("unknown_hashes"), ((c("id") + 2 * n) * 1000).alias("voted_ts_ms"))
    cleared = spark.createDataFrame([(3 * n + 1,)], "ts bigint")
    scrubs = rows.filter("id % 9 = 0").select("chat_jid", F.lit("m1").alias("msg_id"), (c("id") + 4 * n).alias("ts"))
    every = ingest.all_of(state, ingest.contacts(seen), ingest.poll_votes(votes), ingest.system_names_cleared(cleared), ingest.scrubs(scrubs))
    order = spark.createDataFrame([tuple(r) for r in every.select("event_id", "event_ts").collect()], "event_id string, t bigint")
    numbered = {e: k + 1 for k, (e, _) in enumerate(sorted(map(tuple, order.collect()), key=lambda x: (x[1], x[0])))}
    return every.join(spark.createDataFrame(list(numbered.items()), "event_id string, seq bigint"), "event_id")


def test_a_snapshot_of_one_table_keeps_the_others(spark, store):
    store.promote(store.write_snapshot({"chats": _chats(spark, "a"), "contacts": conformed(spark.createDataFrame([("k",)], "jid string"), "contacts")}))
    store.promote(store.write_snapshot({"chats": _chats(spark, "a", "b")}), checkpoints={"chats": 4})
    assert [r.jid for r in store.table("contacts").collect()] == ["k"] and store.table("chats").count() == 2 and store.table("polls").count() == 0
    assert (store.checkpoint("chats"), store.mode("chats"), store.mode("polls")) == (4, "active", "shadow")
    store.rollback()
    assert store.table("chats").count() == 1 and store.table("contacts").count() == 1 and store.checkpoint("chats") == 0
    store.rollback()
    assert store.table("chats").count() == 2 and store.checkpoint("chats") == 4


def test_of_two_writers_one_fails(spark, store):
    other = Catalog(spark, store.base, writable=True)
    store.set_checkpoint("chats", 1)
    seen = other.state()
    store.set_checkpoint("chats", 2)
    with pytest.raises(Conflict):
        other.promote(other.write_snapshot({"chats": _chats(spark, "x")}), since=seen)
    assert store.checkpoint("chats") == 2 and store.table("chats").count() == 0
    other.promote(other.write_snapshot({"chats": _chats(spark, "x")}))
    assert store.table("chats").count() == 1
    with pytest.raises(PermissionError):
        Catalog(spark, store.base).set_mode("chats", "active")


def test_a_state_file_of_version_one_is_read_and_carried_over(spark, store, tmp_path):
    store.write_snapshot({"chats": _chats(spark, "old"), "contacts": conformed(spark.createDataFrame([("k",)], "jid string"), "contacts")}, "s-1")
    (tmp_path / "store" / "STATE").write_text(json.dumps({"snapshot": "s-1", "checkpoints": {"chats": 3}}))
    assert store.table("chats").first().jid == "old" and store.checkpoint("chats") == 3
    store.promote(store.write_snapshot({"chats": _chats(spark, "new")}), checkpoints={"chats": 5})
    assert store.table("chats").first().jid == "new" and store.table("contacts").first().jid == "k"
    store.rollback()
    assert store.table("chats").first().jid == "old"


def test_written_views_advance_from_uneven_checkpoints(spark, store):
    log = _log(spark, 40).cache()
    names = ["chats", "contacts", "poll_votes", "starred", "message_payload_purges"]
    head = log.agg(F.max("seq")).first()[0]
    assert projection.advance(store, ["chats"], log, 11) == {"chats": (0, 11)}
    assert projection.advance(store, ["starred", "contacts"], log, 45) == {"starred": (0, 45), "contacts": (0, 45)}
    assert store.table("chats").count() > 0
    moved = projection.advance(store, names, log)
    assert moved == {"chats": (11, head), "contacts": (45, head), "poll_votes": (0, head), "starred": (45, head), "message_payload_purges": (0, head)}
    for name in names:
        want = conformed(views.VIEWS[name](log), name)
        assert _rows(store.table(name)) == _rows(want) and want.count(), name
    before = store.state()["number"]
    assert projection.advance(store, names, log) == {n: (head, head) for n in names} and store.state()["number"] == before
    assert set(projection.WRITTEN_KEYS) == set(views.VIEWS)
