import json
import random

from pyspark.sql import functions as F

from quernstone.operators import hot, identity
from quernstone.plans import views

KNOWN = "lid string, pn string, seq bigint"


def _led(known, who, seq):
    """What an id belongs to just before seq, one statement after the other; itself if the chain comes to a ring."""
    now, seen = who, {who}
    while True:
        said = [(s, pn) for lid, pn, s in known if lid == now and s < seq and lid != pn and lid and pn]
        if not said:
            return now
        now = max(said)[1]
        if now in seen:
            return who
        seen.add(now)


def test_as_of_equals_the_statements_read_one_by_one(spark):
    rng = random.Random(5)
    ids = [f"i{k}" for k in range(12)]
    for rings in (False, True):
        known = []
        for s in rng.sample(range(300), 40):
            a, b = rng.sample(range(12), 2)
            known.append((ids[a if rings else min(a, b)], ids[b if rings else max(a, b)], s))
        known += [(ids[0], ids[0], 7), (ids[3], ids[5], known[0][2])] + [("", ids[1], 4)]
        known = [(a, b, s) for a, b, s in known]
        rows = [(s, rng.choice([*ids, "other", None]) if s % 3 else ids[0], f"t{s}") for s in range(0, 330)]
        chains = identity.followed(spark.createDataFrame(known, KNOWN))
        got = identity.as_of(spark.createDataFrame(rows, "seq bigint, chat_jid string, __pn string"), "chat_jid", chains, width=20)
        assert got.columns == ["seq", "chat_jid", "__pn"]
        want = [(s, _led(known, who, s) if who is not None else None, x) for s, who, x in rows]
        assert sorted(map(tuple, got.collect())) == want


def test_a_long_chain_is_followed_in_few_rounds(spark, monkeypatch):
    rounds = []
    real = identity._joined
    monkeypatch.setattr(identity, "_joined", lambda a, b: (rounds.append(1), real(a, b))[1])
    n = 60
    known = spark.createDataFrame([(f"i{k:03}", f"i{k + 1:03}", k) for k in range(n)], KNOWN)
    ends = {(r.lid, r.since): r.pn for r in identity.followed(known).collect()}
    assert ends[("i000", n - 1)] == f"i{n:03}" and len(rounds) <= 7


def test_many_ids_through_one_that_changes_often_make_no_product(spark, monkeypatch):
    monkeypatch.setattr(identity, "PAIRS", 100, raising=False)
    made, real = [], identity.durable
    monkeypatch.setattr(identity, "durable", lambda df, name: (made.append(real(df, name)), made[-1])[1])
    n = 60
    known = [(f"u{k}", "p", k) for k in range(n)] + [("p", f"q{k % 2}", 1000 + k) for k in range(n)] + [("q1", "r", 5000)]
    log = [(s, "identity_resolution", None, json.dumps({"lid": a, "pn": b})) for a, b, s in known] + [(1000 + 97 * k, "message", f"u{k}", None) for k in range(n)]
    log = spark.createDataFrame([(10 * s + (kind == "message"), kind, c, p) for s, kind, c, p in log], "seq bigint, event_type string, chat_jid string, payload string")
    got = views.with_identities_at(log, ("chat_jid",)).filter("event_type = 'message'")
    assert sorted(map(tuple, got.select("seq", "chat_jid").collect())) == sorted((10 * (1000 + 97 * k) + 1, _led(known, f"u{k}", 1000 + 97 * k + 0.5)) for k in range(n))
    assert max(df.count() for df in made) <= 2 * len(known)


def test_jumps_lead_where_whole_chains_do(spark, monkeypatch):
    rng = random.Random(6)
    for pairs in (0, 10**6):
        monkeypatch.setattr(identity, "PAIRS", pairs)
        monkeypatch.setattr(identity, "GROWTH", 0)
        ids = [f"i{k}" for k in range(9)]
        known = [(*rng.sample(ids, 2), s) for s in rng.sample(range(200), 30)] + [(f"j{k}", f"j{k + 1}", k) for k in range(9)] + [("z", "j0", 3)]
        rows = [(s, rng.choice([*ids, "j0", "z", "other", None]), f"t{s}") for s in range(0, 230)] + [(None, "j0", "never")]
        df = spark.createDataFrame(rows, "seq bigint, chat_jid string, id string")
        got = identity.at_the_time(df, "chat_jid", identity.jumps(spark.createDataFrame(known, KNOWN)), width=20)
        want = [(s, _led(known, who, s) if who is not None and s is not None else who, x) for s, who, x in rows]
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    ring = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), ("x", "a", 0)], KNOWN)
    monkeypatch.setattr(identity, "PAIRS", 0)
    df = spark.createDataFrame([(s, who) for s in (3, 9) for who in "abcx"], "seq bigint, chat_jid string")
    assert sorted(map(tuple, identity.at_the_time(df, "chat_jid", identity.jumps(ring)).collect())) == [(3, "c")] * 4 + [(9, who) for who in "abcx"]


def test_spans_of_nothing_and_of_repeats(spark):
    none = spark.createDataFrame([], KNOWN)
    assert identity.followed(none).isEmpty()
    rows = spark.createDataFrame([(1, "a"), (2, None)], "seq bigint, chat_jid string")
    assert sorted(identity.as_of(rows, "chat_jid", identity.followed(none)).collect()) == sorted(rows.collect())
    said = spark.createDataFrame([("a", "p", 1), ("a", "p", 2), ("a", "q", 5), ("a", "p", 9), ("a", None, 10), (None, "p", 11)], KNOWN)
    assert [tuple(r) for r in identity.spans(said).orderBy("since").collect()] == [("a", "p", 1, 5), ("a", "q", 5, 9), ("a", "p", 9, identity.OPEN)]


def test_latest_over_buckets(spark):
    rows = [("k", s, "v" + str(s) if s % 7 == 0 else None) for s in range(100)] + [("l", 3, None)]
    got = hot.latest(spark.createDataFrame(rows, "k string, s bigint, v string"), "k", ["s"], F.col("v"), "before", width=10)
    assert {(r.k, r.s): r.before for r in got.collect()} == {(k, s): f"v{(s - 1) // 7 * 7}" if k == "k" and s else None for k, s, _ in rows}


def test_events_before_a_second_phone_keep_the_first(spark):
    log = spark.createDataFrame(
        [(1, "message", "l", None), (2, "identity_resolution", "l", '{"lid": "l", "pn": "p1"}'), (3, "message", "l", None), (4, "identity_resolution", "l", '{"lid": "l", "pn": "p2"}'), (5, "message", "l", None), (6, "message", "x", None)],
        "seq bigint, event_type string, chat_jid string, payload string",
    )
    got = views.with_identities_at(log.withColumn("sender_jid", F.col("chat_jid")))
    assert [(r.chat_jid, r.sender_jid) for r in got.filter("event_type = 'message'").orderBy("seq").collect()] == [("l", "l"), ("p1", "p1"), ("p2", "p2"), ("x", "x")]


def test_places_polls_paths_and_purges_come_together(spark):
    known = spark.createDataFrame([("l", "p")], "lid string, pn string")
    none = spark.createDataFrame([], "chat_jid string, msg_id string, purged_at bigint")
    purges = spark.createDataFrame([("l", "z", 5, 9, "why"), ("p", "z", 7, None, ""), ("x", "z", 1, 1, None)], "chat_jid string, msg_id string, purged_at bigint, deleted_at bigint, deletion_reason string")
    assert sorted(map(tuple, identity.merge_purges(purges, known).collect())) == [("p", "z", 5, 9, "why"), ("x", "z", 1, 1, None)]
    assert identity.merge_purges(none, known).isEmpty()
    paths = spark.createDataFrame([("l", "m", "/a", 1), ("p", "m", "/a", 8), ("l", "m", "/b", 2), ("p", "n", "/a", None), ("l", "n", "/a", 3)], "chat_jid string, msg_id string, local_path string, downloaded_at bigint")
    assert sorted(map(tuple, identity.merge_media_aliases(paths, known).collect())) == [("p", "m", "/a", 8), ("p", "m", "/b", 2), ("p", "n", "/a", 3)]
    at = [("l", "m", 1.0, 2.0, "", None, True), ("p", "m", 3.0, 4.0, "own", "street", False), ("l", "z", 0.0, 0.0, "n", "", False), ("p", "q", None, 4.0, None, None, None)]
    places = spark.createDataFrame(at, "chat_jid string, msg_id string, latitude double, longitude double, name string, address string, is_live boolean").withColumn("__own", F.lit(9))
    assert sorted(map(tuple, identity.merge_locations(places, known, purges).collect()), key=str) == [("p", "m", 1.0, 2.0, "own", "street", True), ("p", "q", None, 4.0, None, None, None)]
    asked = [("l", "m", "l", "new?", ["b", "c"], 2, 5), ("p", "m", "p", "old?", ["a", "b"], 1, 9), ("g@g.us", "m", "l", "g?", None, 0, 1), ("p", "z", "p", "gone", ["a"], 1, 1), ("x", "r", "", "r?", ["d", "d"], 1, None)]
    polls = spark.createDataFrame(asked, "chat_jid string, msg_id string, sender_jid string, question string, options array<string>, selectable_count int, created_ts bigint")
    assert sorted(tuple(r) for r in identity.merge_polls(polls, known, purges).collect()) == [("g@g.us", "m", "l", "g?", [], 0, 1), ("p", "m", "p", "new?", ["b", "c", "a"], 2, 9), ("x", "r", None, "r?", ["d"], 1, None)]
    votes = spark.createDataFrame([("p", "m", "v"), ("p", "z", "v")], "chat_jid string, poll_msg_id string, voter_jid string")
    assert [r.poll_msg_id for r in identity.unpurged(votes, identity.merge_purges(purges, known), "poll_msg_id").collect()] == ["m"]
