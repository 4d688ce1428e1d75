"""Literal cases and plain-Python doubles for what SQL can't say."""

import hashlib
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import parse
from quernstone.functions import values as v
from quernstone.operators import aggregates as ag
from quernstone.operators import folds, hot, identity, search
from quernstone.operators import joins as jo
from quernstone.operators import reads as rd
from quernstone.plans import ledger as lg
from quernstone.plans import projection
from quernstone.plans import verify as vf
from quernstone.plans import views
from quernstone.sources import contacts as contact_files
from quernstone.sources.catalog import SCHEMAS, Catalog, conformed
from quernstone.streaming import log as sl


def one(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


# Functions


def test_values(spark):
    s = F.lit
    assert one(spark, v.stored(s("  a ")), v.stored(s("  ")), v.duration(s(45)), v.duration(s(120)), v.duration(s(125)), v.duration(s(0))) == ["a", None, "45s", "2m", "2m05s", ""]
    assert one(spark, v.parse_instant(s("2024-01-02")), v.parse_instant(s("2024-01-02T00:00:01+01:00")), v.parse_instant(s("yesterday"))) == [1704153600, 1704150001, None]
    assert one(spark, v.phone_key(s("0049 (1) 23")), v.looks_like_phone(s("+1 (2)")), v.looks_like_phone(s("1+2")), v.looks_like_phone(s("a@b")), v.valid_phone(s("123")), v.valid_phone(s("1234567"))) == ["49123", True, False, False, None, "1234567"]
    assert one(spark, v.chat_kind(s("1@g.us")), v.chat_kind(s("1@x")), v.bare_jid(s("12:3@s.whatsapp.net")), v.bare_jid(s("12@g.us"))) == ["group", "unknown", "12@s.whatsapp.net", "12@g.us"]
    assert one(spark, v.call_text(s("video"), s(""), s("offer"), s(65)), v.call_text(s(""), s("missed"), s("call_log"), s(0), "App")) == ["video call offer (1m05s)", "App call missed"]
    assert one(spark, v.clean_line(s("a\x1b[31mb\x00\x01c\n")), v.clean_body(s("a\x1b[31mb\x00\nc")), v.truncated(s("abcdef"), 4), v.path_segment(s(" a/b..c ")), v.file_name(s(" "))) == ["a b c", "ab\nc", "abc…", "a_b_c", "file"]
    assert one(spark, v.message_key(s("c<"), s(True), s("m"), s(""))) == ['{"chat":"c\\u003c","from_me":true,"id":"m"}']
    assert one(spark, v.valid_coordinates(s(91.0), s(0.0)), v.valid_coordinates(s(float("nan")), s(0.0)), v.valid_coordinates(s(1.0), s(180.0))) == [False, False, True]


def test_match_scores(spark):
    assert one(spark, *[v.match_score("ann", F.lit(x)) for x in ("Ann", "Anna", "Mary Ann", "Joanna", "Bob", None)]) == [100, 60, 30, 10, 0, 0]


def test_urls_and_cards(spark):
    u = lambda x: parse.first_url(F.lit(x))
    assert one(spark, u("see (https://a.b/c_(d))."), u("http:///x https://ok.example/y!"), u("none"), u("[http://a.b/[c]]")) == ["https://a.b/c_(d)", "https://ok.example/y", None, "http://a.b/[c]"]
    card = parse.card(F.lit("BEGIN:VCARD\r\nFN:Ann\\, B\r\n ee\r\nTEL;TYPE=CELL:1\nTEL:2\nTEL:1\nEND:VCARD"))
    assert one(spark, parse.card_text(card), parse.card_text(parse.card(F.lit("TEL:5"))), parse.card_text(parse.card(F.lit(None).cast("string"), F.lit("Given")))) == ["Contact: Ann, Bee (1, 2)", "Contact: 5", "Contact: Given"]
    assert one(spark, parse.interactive_text(F.lit("h"), F.lit(" "), F.lit("f")), parse.unhandled({"b": F.lit(1), "a": F.lit(2), "c": F.lit(None)})) == ["h\n[f]", "a,b"]


def test_page_metadata(spark):
    html = '<head><title>T</title><meta name="twitter:title" content="x"><meta property="og:description" content=" a  b "><meta name="description" content="later"><meta property="og:image" content=""><meta name="twitter:image" content="i"></head>'
    rows = spark.createDataFrame([(1, html), (2, ""), (3, "<title>\n a  b </title>")], "page_id bigint, html string")
    assert [tuple(r) for r in parse.page_metadata(rows).orderBy("page_id").collect()] == [(1, "T", "a b", "i"), (2, "", "", ""), (3, "a b", "", "")]


def test_page_metadata_keeps_every_page(spark):
    rows = spark.createDataFrame([(1, None), (2, "<title>long</title>" + "x" * (1 << 20))], "page_id bigint, html string")
    assert [tuple(r) for r in parse.page_metadata(rows).orderBy("page_id").collect()] == [(1, "", "", ""), (2, "long", "", "")]


# Search


def test_search(spark):
    rows = [(1, "Quarterly report ready", None), (2, "the café report of the quarterly", None), (3, "report", None), (4, "quarterly REPORT report report", 9), (5, "a-b report", None)]
    df = spark.createDataFrame(rows, "rowid bigint, text string, deleted_at bigint")
    assert {r.rowid for r in search.bm25(df, "report QUARTERLY", columns=("text",)).collect()} == {1, 2}
    assert [r.rowid for r in search.bm25(df, "cafe", columns=("text",)).collect()] == [2]
    assert [r.rowid for r in search.bm25(df, "a-b", columns=("text",)).collect()] == [5]
    assert search.bm25(df, ' " ', columns=("text",)).count() == 0
    assert search.quoted('a "b" OR c') == '"a" """b""" "OR" "c"'
    index = {(r.term, r.rowid): r.tf for r in search.index(df, ("text",)).collect()}
    assert index["the", 2] == 2 and ("report", 4) not in index


def test_index_is_made_without_a_shuffle_and_written_in_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    fields = lambda: " ".join(rng.choice(["the", "and", "Über", "x-ray", "dog"]) for _ in range(rng.randint(0, 30)))
    rows = [(f"k{i}", rng.choice([None, fields()]), fields(), None) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, text string, filename string, deleted_at bigint").repartition(3).localCheckpoint()
    want = {}
    for k, *texts, _ in rows:
        words = [[w for w in (t or "").lower().replace("ü", "u").replace("-", " ").split()] for t in texts]
        for column, t in zip(("text", "filename"), words, strict=True):
            for w in set(t):
                want[w, k, column] = (sum(map(len, words)), [i for i, x in enumerate(t) if x == w], t.count(w))
    for tokens in (100, search.BLOCK_TOKENS):
        monkeypatch.setattr(search, "BLOCK_TOKENS", tokens)
        made = search.index(df, ("text", "filename"), "k")
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        got = made.collect()
        assert len(got) == len(want) and {(r.term, r.k, r.column): (r.length, r.positions, r.tf) for r in got} == want
    path = f"file://{tmp_path}/index"
    search.write_index(df, path, ("text", "filename"), "k", buckets=4)
    assert spark.read.parquet(f"{path}/postings").count() < len(want) / 4
    for q in ("the dog", "x-ray", "uber", "none"):
        best = lambda d: [(r.k, round(r.score, 9)) for r in d.collect()]
        assert best(search.search_index(spark, path, q, key="k", limit=0)) == best(search.bm25(df, q, columns=("text", "filename"), key="k", limit=0))


def test_snippet_against_python(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "dog", "cat", "the,", "x"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k bigint, t string").select("k", search.snippet(F.col("t"), "cat").alias("s")).collect()}
    for k, text in rows:
        w = text.split()
        hit = [x == "cat" for x in w]
        first = hit.index(True) if True in hit else 0
        start = max(0, min(first, len(w) - 12))
        shown = " ".join(f"[{x}]" if h else x for x, h in list(zip(w, hit, strict=True))[start : start + 12])
        assert got[k] == ("…" if start else "") + shown + ("…" if start + 12 < len(w) else "")


# Reads


def test_filters(spark):
    rows = [("c", f"m{i}", i, 100 + i // 2, None if i % 5 else 1, ["", "image", "document"][i % 3], i % 4 == 0, "100% literal" if i == 7 else "100X wildcard") for i in range(20)]
    m = spark.createDataFrame(rows, "chat_jid string, msg_id string, rowid bigint, ts bigint, deleted_at bigint, media_type string, is_forwarded boolean, text string")
    chats = spark.createDataFrame([("c", "Name")], "jid string, name string")
    assert [r.rowid for r in rd.list_messages(m, limit=3).collect()] == [19, 18, 17]
    assert [r.rowid for r in rd.search_like(m, chats, "100%", limit=0).collect()] == [7]
    assert rd.search_like(m, chats, "NAME", limit=0).count() == 16
    assert rd.list_messages(m, kind="image", limit=0).count() == len([i for i in range(20) if i % 3 == 1 and i % 5])
    with pytest.raises(ValueError):
        rd.of_type(m, "text", has_media=True)
    with pytest.raises(ValueError):
        rd.of_type(m, "gif")
    assert rd.given([" a", "", "a", "b "]) == ["a", "b"]
    around = rd.context(m, m.filter("rowid IN (10, 0)"), 2, 1)
    assert [(r.offset, r.rowid) for r in around.filter("anchor = 'm10'").orderBy("offset").collect()] == [(-2, 8), (-1, 9), (0, 10), (1, 11)]
    assert [(r.offset, r.rowid) for r in around.filter("anchor = 'm0'").orderBy("offset").collect()] == [(0, 0), (1, 1)]


# Folds


def _merge(old, new):
    """The message merge once more, in plain Python."""
    nz = lambda x: x is not None and x != ""
    tomb = old["deleted_at"] is not None or new["deleted_at"] is not None
    oe, ne = bool(old["edited"]), bool(new["edited"])
    stale = (oe and not ne) or (oe and ne and new["edited_ts"] < old["edited_ts"]) or (not oe and not ne and new["ts"] < old["ts"])
    meta = stale and not (old["revoked"] or old["deleted_for_me"] or new["revoked"] or new["deleted_for_me"])
    out = dict(old)
    keep = lambda c: old[c] if nz(old[c]) else new[c]
    fill = lambda c: new[c] if nz(new[c]) else old[c]
    out["sender_jid"] = keep("sender_jid") if tomb else old["sender_jid"] if meta else new["sender_jid"]
    out["sender_name"] = keep("sender_name") if tomb else old["sender_name"] if meta else fill("sender_name")
    for c in ("text", "media_type"):
        out[c] = keep(c) if tomb else old[c] if stale else new[c]
    for c in ("filename", "direct_path", "quoted_msg_id"):
        out[c] = keep(c) if tomb else old[c] if stale else fill(c)
    places = (v.REVOKED, v.DELETED_FOR_ME)
    out["display_text"] = (old["display_text"] if nz(old["display_text"]) and old["display_text"] not in places else new["display_text"]) if tomb else old["display_text"] if stale else fill("display_text")
    out["from_me"] = bool(old["from_me"] or new["from_me"]) if tomb else old["from_me"] if stale else new["from_me"]
    out["media_unavailable_at"] = None if not tomb and not stale and nz(new["direct_path"]) and new["direct_path"] != old["direct_path"] else old["media_unavailable_at"]
    bare = not nz(old["text"]) and not nz(old["media_type"]) and not nz(old["quoted_msg_id"]) and (not nz(old["display_text"]) or old["display_text"] in places)
    old_dead, new_dead = old["deleted_at"] is not None, new["deleted_at"] is not None
    if old_dead and not new_dead and bare:
        out["ts"] = new["ts"]
    elif tomb or ne:
        out["ts"] = old["ts"]
    elif oe:
        out["ts"] = new["ts"]
    elif new["ts"] < old["ts"] and not (new["revoked"] or new["deleted_for_me"]):
        out["ts"] = old["ts"]
    else:
        out["ts"] = new["ts"]
    out["revoked"], out["deleted_for_me"] = old["revoked"] or new["revoked"], old["deleted_for_me"] or new["deleted_for_me"]
    out["deleted_at"] = old["deleted_at"] if old_dead else new["deleted_at"]
    out["deletion_reason"] = (old["deletion_reason"] if nz(old["deletion_reason"]) else new["deletion_reason"]) if old_dead else new["deletion_reason"]
    out["edited"] = oe if old_dead else False if new_dead else True if ne else oe
    out["edited_ts"] = old["edited_ts"] if old_dead else 0 if new_dead else new["edited_ts"] if ne and (not oe or new["edited_ts"] > old["edited_ts"]) else old["edited_ts"] if oe else 0
    return out


DDL = "chat_jid string, msg_id string, seq bigint, sender_jid string, sender_name string, ts bigint, from_me boolean, text string, display_text string, quoted_msg_id string, media_type string, filename string, direct_path string, media_unavailable_at bigint, revoked boolean, deleted_for_me boolean, deleted_at bigint, deletion_reason string, edited boolean, edited_ts bigint"


def test_message_fold_equals_python(spark):
    rng = random.Random(11)
    names = [x.split()[0] for x in DDL.split(", ")]
    rows = []
    for seq in range(1500):
        dead, edited = rng.random() < 0.15, rng.random() < 0.3
        maybe = lambda *x: rng.choice([None, "", *x])
        rows.append(dict(zip(names, ("c", f"m{rng.randrange(120)}", seq, maybe("s1", "s2"), maybe("n1", "n2"), rng.randrange(6), rng.random() < 0.5, maybe("t1", "t2", "t3"), maybe("d1", v.REVOKED), maybe("q"), maybe("image"), maybe("f1"), maybe("p1", "p2"), rng.choice([None, 3]), dead and rng.random() < 0.5, dead and rng.random() < 0.5, rng.randrange(9) if dead else None, maybe("why") if dead else None, edited, rng.randrange(5) if edited else 0), strict=True)))
    want = {}
    for r in rows:
        body = {k: x for k, x in r.items() if k not in ("chat_jid", "msg_id", "seq")}
        want[r["msg_id"]] = _merge(want[r["msg_id"]], body) if r["msg_id"] in want else body
    df = spark.createDataFrame([tuple(r.values()) for r in rows], DDL).repartition(7)
    got = {r.msg_id: {k: x for k, x in r.asDict().items() if k not in ("chat_jid", "msg_id")} for r in folds.fold_messages(df).collect()}
    assert got == want
    gone = spark.createDataFrame([("c", "m1")], "chat_jid string, msg_id string")
    assert folds.fold_messages(df, gone).count() == len(want) - 1


def test_votes_and_unread_equal_python(spark):
    rng = random.Random(4)
    rows = [("c", f"p{rng.randrange(5)}", f"v{rng.randrange(4)}", rng.randrange(6), seq, rng.choice("AB"), rng.random() < 0.3) for seq in range(300)]
    want = {}
    for c, p, voter, ts, seq, choice, retracted in rows:
        held = want.get((p, voter))
        if retracted:
            if held and held[0] <= ts:
                del want[p, voter]
        elif not held or ts >= held[0]:
            want[p, voter] = (ts, seq, choice)
    got = folds.fold_votes(spark.createDataFrame(rows, "chat_jid string, poll_msg_id string, voter_jid string, ts bigint, seq bigint, choice string, retracted boolean")).collect()
    assert {(r.poll_msg_id, r.voter_jid): (r.ts, r.seq, r.choice) for r in got} == want
    steps = [("k" + str(rng.randrange(3)), seq, *rng.choice([(True, None, False), (True, None, False), (False, rng.choice([0, 0, 5]), False), (False, None, True)])) for seq in range(200)]
    count, want = {}, {}
    for k, seq, plus, sets, keeps in steps:
        c = count.get(k, 0)
        c = sets if sets is not None else max(c, 1) if keeps else c + plus
        count[k] = want[seq] = c
    df = spark.createDataFrame(steps, "chat_jid string, seq bigint, plus boolean, sets bigint, keeps boolean")
    for width in (1, 7, 40, 100_000):
        assert {r.seq: r.unread_count for r in ag.unread_fold(df, width=width).collect()} == want


def test_windows_in_buckets_equal_plain_ones(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice([None, *range(40)]), i, rng.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts bigint, i bigint, c boolean")
    w = Window.partitionBy("k").orderBy("ts", "i")
    want = sorted(map(tuple, df.select("i", F.lead("i").over(w), F.lag("i").over(w), F.sum(F.col("c").cast("bigint")).over(w)).collect()))
    for width in (1, 9, 1000):
        out = hot.following(df, "k", ["ts", "i"], F.col("i"), "n", width)
        out = hot.preceding(out, "k", ["ts", "i"], F.col("i"), "p", width)
        out = hot.running_count(out, "k", ["ts", "i"], F.col("c"), "r", width)
        assert sorted(map(tuple, out.select("i", "n", "p", "r").collect())) == want


def test_calls_polls_and_purges(spark):
    rows = [(1, "x", "", "offer", 10, "", 0), (2, "x", "id", "offer", 5, "busy", 0), (3, "x", "id", "offer", 9, "", 7), (4, "x", "id", "end", 9, "", 0)]
    calls = spark.createDataFrame(rows, "seq bigint, chat_jid string, call_id string, event_type string, ts bigint, outcome string, duration_secs bigint")
    got = {(r.call_id, r.event_type): (r.ts, r.outcome, r.duration_secs) for r in folds.fold_calls(calls).collect()}
    assert got == {("offer:10", "offer"): (10, "", 0), ("id", "offer"): (9, "busy", 7), ("id", "end"): (9, "", 0)}
    polls = spark.createDataFrame([(1, "c", "p", ["a", "b"]), (2, "c", "p", ["c", "a"])], "seq bigint, chat_jid string, msg_id string, options array<string>")
    assert folds.fold_polls(polls).first().options == ["c", "a", "b"]
    purges = spark.createDataFrame([(1, "c", "m", 9, 4, ""), (2, "c", "m", 7, 5, "why")], "seq bigint, chat_jid string, msg_id string, purged_at bigint, deleted_at bigint, deletion_reason string")
    assert tuple(folds.fold_entity(purges, "purges", ["chat_jid", "msg_id"]).first())[2:] == (7, 4, "why")


def test_identity_merges(spark):
    known = spark.createDataFrame([("1@lid", "49@s"), ("1@lid", "49@s")], "lid string, pn string")
    chats = spark.createDataFrame([("49@s", "dm", "49@s", 5, False, False, 0, False, 2), ("1@lid", "dm", "Ann", 9, False, True, 0, True, 3), ("x", "dm", "X", 1, False, False, 0, False, 0)], "jid string, kind string, name string, last_message_ts bigint, archived boolean, pinned boolean, muted_until bigint, unread boolean, unread_count int")
    got = {r.jid: (r.name, r.last_message_ts, r.pinned, r.unread, r.unread_count) for r in identity.merge_chats(chats, known).collect()}
    assert got == {"49@s": ("Ann", 9, True, True, 5), "x": ("X", 1, False, False, 0)}
    roster = spark.createDataFrame([("g", "49@s", "member", 1), ("g", "1@lid", "admin", 2)], "group_jid string, user_jid string, role string, updated_at bigint")
    assert [tuple(r) for r in identity.merge_roster(roster, known).collect()] == [("g", "49@s", "admin", 2)]
    messages = spark.createDataFrame([("49@s", "m", "1@lid", 3, True, ""), ("1@lid", "m", "", 5, False, "late text")], "chat_jid string, msg_id string, sender_jid string, ts bigint, from_me boolean, text string")
    assert [tuple(r) for r in identity.merge_messages(messages, known).collect()] == [("49@s", "m", "49@s", 5, True, "late text")]


# The log


def _graph(spark, edges, extra=()):
    ids = sorted({x for e in edges for x in e} | set(extra))
    refs = {i: [("event_id", f"e{b}") for a, b in edges if a == i] for i in ids}
    rows = [(i, f"e{i}", f"k{i}", refs[i], f"d{i}", "0" * 64, "live", "message", "c", f"m{i}") for i in ids]
    return spark.createDataFrame(rows, "seq bigint, event_id string, message_key string, refs array<struct<kind:string,target:string>>, dedup_key string, raw_hash string, source string, event_type string, chat_jid string, msg_id string")


def test_references_and_links(spark):
    # Two rings of two, joined by 2 -> 3, which is on neither.
    log = _graph(spark, [(5, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (6, 9), (1, 7)], extra=(9,)).filter("seq <> 9")
    parts = {r.node: r.component for r in lg.strong_components(lg.edges(log)).collect()}
    assert {n for n in parts} == {"e1", "e2", "e3", "e4"} and parts["e1"] == parts["e2"] != parts["e3"] == parts["e4"]
    states = {(r.event_id, r.target): r.state for r in lg.reference_states(log).collect()}
    assert {k for k, v in states.items() if v == "cyclic"} == {("e1", "e2"), ("e3", "e4")} and states["e6", "e9"] == "dangling" and states["e2", "e3"] == states["e1", "e7"] == "pending"
    links = lg.causal_links(log)
    assert {(r.event_id, r.target_id) for r in links.collect()} == {("e5", "e1"), ("e2", "e1"), ("e2", "e3"), ("e4", "e3"), ("e1", "e7")}
    assert {(r.event_id, r.state) for r in lg.reference_states(log, links).collect()} == {("e1", "cyclic"), ("e3", "cyclic"), ("e6", "dangling")}
    assert lg.causal_links(log, links).count() == 0
    causes = {r.seq: (r.causes, r.flags) for r in lg.with_causes(log).collect()}
    assert causes[5] == (["e1"], 0) and causes[1] == ([], 1) and causes[7] == ([], 0)
    way = lg.reachable(lg.edges(log), spark.createDataFrame([("e5",), ("e3",)], "start string"))
    assert {(r.start, r.node) for r in way.collect()} == {("e5", f"e{n}") for n in (1, 2, 3, 4, 7)} | {("e3", "e4"), ("e3", "e3")}


def test_links_are_refused_in_order(spark):
    """Random graphs against a plain pass: an edge is refused if its target leads back over causes and the links before it."""
    rng = random.Random(5)
    for _ in range(3):
        pairs = sorted({(rng.randrange(1, 15), rng.randrange(1, 15)) for _ in range(26)})
        log = _graph(spark, pairs)
        order = sorted((r.seq, r.ref_index, int(r.target[1:])) for r in lg.references(log).collect())
        after = {}
        for a, _, b in order:
            if b < a:
                after.setdefault(a, set()).add(b)
        leads = lambda x, goal: (seen := {x}) and any(goal in seen or not (new := {z for y in seen for z in after.get(y, ())} - seen) or seen.update(new) for _ in range(20)) and goal in seen
        want = []
        for a, i, b in order:
            if not leads(b, a):
                want.append((f"e{a}", i, f"e{b}"))
                after.setdefault(a, set()).add(b)
        assert sorted(map(tuple, lg.causal_links(log).collect())) == sorted(want)


def test_rejected_events_are_given_back(spark):
    rows = [("e1", "scrub", "scrub", "d", "0" * 64), ("e2", "nowhere", "message", "d", "0" * 64), ("", "live", "message", "d", "0" * 64), ("e4", None, "message", "d", "0" * 64), ("e5", "live", "", "d", "0" * 64), ("e6", "live", "message", None, "0" * 64), ("e7", "live", "message", "d", "x")]
    good, bad = lg.valid(spark.createDataFrame(rows, "event_id string, source string, event_type string, dedup_key string, raw_hash string"))
    assert [r.event_id for r in good.collect()] == ["e1"]
    assert {(r.event_id, r.fault) for r in bad.collect()} == {("e2", "source"), ("", "event_id"), ("e4", "source"), ("e5", "event_type"), ("e6", "dedup_key"), ("e7", "raw_hash")}


def _sound(spark):
    raw = b"x"
    h = hashlib.sha256(raw).hexdigest()
    log = _graph(spark, [(2, 1)]).withColumn("raw_hash", F.lit(h))
    return {
        "messages": spark.createDataFrame([(1, "c", "m1", "hello", None), (2, "c", "m2", "gone", 5)], "rowid bigint, chat_jid string, msg_id string, text string, deleted_at bigint"), "chats": spark.createDataFrame([("c", True, 1), ("d", True, 0)], "jid string, unread boolean, unread_count int"),
        "groups": spark.createDataFrame([("g",)], "jid string"), "roster": spark.createDataFrame([("g", "u")], "group_jid string, user_jid string"), "indexed": spark.createDataFrame([(1,)], "rowid bigint"),
        "ledger": log, "raw": log.select("event_id", F.lit(raw).alias("raw_bytes")), "links": lg.causal_links(log), "checkpoints": spark.createDataFrame([("messages", 2), ("chats", 2), ("old", 0)], "view string, last_seq bigint"),
    }


def _faults(spark, good):
    ck = lambda *rows: spark.createDataFrame(list(rows), "view string, last_seq bigint")
    link = lambda *rows: spark.createDataFrame(list(rows), "event_id string, ref_index int, target_id string")
    yield {"message_without_chat"}, {"chats": good["chats"].limit(0)}
    yield {"fts_missing_row"}, {"indexed": good["indexed"].limit(0)}
    yield {"fts_extra_row"}, {"indexed": spark.createDataFrame([(1,), (2,)], "rowid bigint")}
    yield {"fts_extra_row"}, {"indexed": spark.createDataFrame([(1,), (9,)], "rowid bigint")}
    yield {"participant_without_group"}, {"groups": good["groups"].limit(0)}
    yield {"checkpoint_ahead_of_head"}, {"checkpoints": ck(("messages", 9), ("chats", 9))}
    yield {"checkpoint_lag"}, {"checkpoints": ck(("messages", 1), ("chats", 1))}
    yield {"checkpoint_frontier_fork", "checkpoint_lag"}, {"checkpoints": ck(("messages", 1), ("chats", 2))}
    yield {"raw_hash_mismatch"}, {"raw": good["raw"].withColumn("raw_bytes", F.when(F.col("event_id") == "e1", F.lit(b"y")).otherwise(F.col("raw_bytes")))}
    yield {"event_without_raw_or_scrub"}, {"raw": good["raw"].filter("event_id <> 'e1'")}
    yield {"scrub_with_raw"}, {"ledger": good["ledger"].withColumn("event_type", F.lit("scrub"))}
    yield set(), {"ledger": good["ledger"].withColumn("source", F.lit("legacy_snapshot")), "raw": good["raw"].limit(0)}
    yield set(), {"ledger": good["ledger"].withColumn("event_type", F.lit("scrub")), "raw": good["raw"].limit(0)}
    yield {"dangling_causal_ref"}, {"links": link(("e2", 0, "nowhere"))}
    yield {"causal_cycle"}, {"links": link(("e2", 0, "e1"), ("e1", 0, "e2"))}
    yield {"unread_inconsistent"}, {"chats": spark.createDataFrame([("c", False, 1)], "jid string, unread boolean, unread_count int")}
    yield {"unread_inconsistent"}, {"chats": spark.createDataFrame([("c", True, -1)], "jid string, unread boolean, unread_count int")}


def test_verify_finds_exactly_the_fault(spark):
    good = _sound(spark)
    run = lambda **x: {r.check for r in vf.verify(**(good | x), views=["messages", "chats"]).select("check").distinct().collect()}
    assert run() == set() and {c for want, _ in _faults(spark, good) for c in want} == set(vf.CHECKS)
    for want, fault in _faults(spark, good):
        assert run(**fault) == want


def test_attributed_diff(spark):
    a = spark.createDataFrame([("c", "m1", "x"), ("c", "m2", "y")], "chat_jid string, msg_id string, text string")
    diff = jo.keyed_diff(a, a.filter("msg_id = 'm1'"), ["chat_jid", "msg_id"], "messages")
    got = vf.attributed_diff(diff, _graph(spark, [(2, 1)]), ["chat_jid", "msg_id"]).first()
    assert (got.change, got.event_id) == ("missing", "e2")
    assert jo.keyed_diff(a, a, ["chat_jid", "msg_id"]).count() == 0


def _event(seq, kind, chat="1@s.whatsapp.net", msg=None, sender=None, ts=None, source="live", **payload):
    return (seq, source, kind, chat, msg, sender, ts if ts is not None else seq, json.dumps(payload))


def test_views(spark):
    events = [
        _event(1, "message", msg="a", text="one", from_me=False), _event(2, "message", msg="a", text="one", source="live", from_me=False), _event(3, "edit", msg="a", text="two"), _event(4, "message", msg="b", text="mine", from_me=True),
        _event(5, "message", msg="c", text="old", source="history", from_me=False), _event(6, "mark_unread"), _event(7, "revoke", msg="b"), _event(8, "scrub", msg="c"), _event(9, "message", msg="c", text="again"),
        _event(10, "chat_state", pinned=True), _event(11, "chat_state", archived=True), _event(12, "contact", sender="p", full_name="F", system_name="S"), _event(13, "contact_clear"), _event(14, "contact", sender="p", full_name=""),
        _event(15, "group", chat="g@g.us", name="G", participants=[{"user_jid": "u", "role": "admin"}, {"user_jid": "w", "role": ""}]), _event(16, "group", chat="g@g.us", name="", participants=[{"user_jid": "w", "role": ""}]), _event(17, "group_leave", chat="g@g.us"),
        _event(18, "poll", msg="p", question="?", options=["x", "y"], selectable_count=1), _event(19, "poll_option", msg="p", options=["z", "x"]), _event(20, "vote", msg="p", sender="v", selected=["x"], ts=20), _event(21, "vote", msg="p", sender="v", selected=[], ts=21),
        _event(22, "vote", msg="p", sender="w", selected=["z"]), _event(23, "star", msg="a", starred=True), _event(24, "star", msg="b", starred=True), _event(25, "star", msg="b", starred=False), _event(26, "call_log", call_id="k", outcome="missed"), _event(27, "call_delete"), _event(28, "call", call_id="k", outcome="ok", duration_secs=3),
    ]
    log = spark.createDataFrame(events, "seq bigint, source string, event_type string, chat_jid string, msg_id string, sender_jid string, event_ts bigint, payload string").repartition(3)
    made = views.rebuild(log)
    m = {r.msg_id: r for r in made["messages"].collect()}
    assert (m["a"].text, m["a"].edited, m["a"].ts) == ("two", True, 2)
    assert m["b"].revoked and m["b"].deleted_at == 7 and m["c"].text is None and m["c"].payload_purged_at == 8
    chat = made["chats"].filter("jid like '1@%'").first()
    assert (chat.kind, chat.unread_count, chat.archived, chat.pinned) == ("dm", 1, True, False)
    assert tuple(made["contacts"].select("jid", "full_name", "system_name").first()) == ("p", "F", None)
    g = made["groups"].first()
    assert (g.name, g.left_at) == ("G", 17) and [tuple(r) for r in made["group_participants"].collect()] == [("g@g.us", "w", "member")]
    assert made["polls"].first().options == ["x", "y", "z"]
    assert [(r.voter_jid, r.selected) for r in made["poll_votes"].collect()] == [("w", ["z"])]
    assert [r.msg_id for r in made["starred"].collect()] == ["a"]
    assert [(r.event_type, r.duration_secs) for r in made["call_events"].collect()] == [("call", 3)]


# Storage and streams


def test_catalog(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    writer = Catalog(spark, base, writable=True)
    chats = spark.createDataFrame([("a", "dm", "A")], "jid string, kind string, name string")
    assert writer.table("chats").count() == 0
    first = writer.write_snapshot({"chats": chats})
    writer.promote(first)
    second = writer.write_snapshot({"chats": chats.union(chats)})
    reader = Catalog(spark, base)
    assert reader.table("chats").count() == 1
    with pytest.raises(ValueError):
        writer.promote(second, violations=chats)
    writer.promote(second)
    assert reader.table("chats").count() == 2 and reader.current() == second
    assert writer.rollback() == first and reader.table("chats").count() == 1
    with pytest.raises(PermissionError):
        reader.promote(first)
    with pytest.raises(ValueError):
        Catalog(spark, "a?b")
    assert conformed(chats, "chats").columns == [x.split()[0] for x in SCHEMAS["chats"].split(", ")]


def test_contact_files(spark, tmp_path):
    rows = [{"full_name": " Ann ", "phones": ["1"]}, {"first_name": "B", "last_name": "C"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("a", "b"):
        assert [r.name for r in contact_files.read(spark, f"file://{tmp_path}/{name}.json").collect()] == ["Ann", "B C"]


def test_stream_replay_equals_batch(spark, tmp_path):
    rows = [(i, f"d{i % 7}", f"raw{i % 14}", "live", "message") for i in range(60)] + [(99, "", "x", "live", "message"), (100, "d", "x", "nowhere", "message")]
    df = spark.createDataFrame(rows, "seq bigint, dedup_key string, raw string, source string, event_type string")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        sl.append(sl.source(spark, f"{tmp_path}/in", df.schema, files_per_batch=2), f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log/events")
    batch = lg.new_events(lg.valid(lg.with_ids(df))[0])
    assert sorted(r.event_id for r in log.collect()) == sorted(r.event_id for r in batch.collect()) and log.count() == 14


def test_stream_limit_loses_nothing(spark, tmp_path):
    rows = [(i, f"d{i}", f"raw{i}", "scrub" if i % 10 == 3 else "live", "message") for i in range(40)] + [(50, "d", "x", "nowhere", "message")]
    df = spark.createDataFrame(rows, "seq bigint, dedup_key string, raw string, source string, event_type string")
    df.repartitionByRange(8, "seq").write.parquet(f"{tmp_path}/in")
    run = lambda **x: sl.append(sl.source(spark, f"{tmp_path}/in", df.schema, files_per_batch=1), f"{tmp_path}/log", f"{tmp_path}/checkpoint", **x).awaitTermination()
    with pytest.raises(StreamingQueryException, match="LimitReached"):
        run(max_events=5)
    assert 5 <= spark.read.parquet(f"{tmp_path}/log/events").count() < 40
    run()
    assert {r.seq for r in spark.read.parquet(f"{tmp_path}/log/events").collect()} == set(range(40))
    assert [(r.seq, r.fault) for r in spark.read.parquet(f"{tmp_path}/log/rejected").collect()] == [(50, "source")]


def test_unread_counts_first_deliveries_whatever_came_before(spark):
    events = [_event(1, "receipt", msg="a"), _event(2, "message", msg="a", from_me=False), _event(3, "star", msg="b"), _event(4, "message", msg="b", from_me=False), _event(5, "message", msg="b", from_me=False), _event(6, "message", msg="d", from_me=True), _event(7, "message", msg="h", source="history"), _event(8, "message", msg="h")]
    log = spark.createDataFrame(events, "seq bigint, source string, event_type string, chat_jid string, msg_id string, sender_jid string, event_ts bigint, payload string")
    assert views.unread(log).first().unread_count == 2


def test_progress_log(tmp_path):
    """One line an event, progress at most once in the given time, milliseconds since 1970."""
    log = sl.ProgressLog(str(tmp_path / "log.ndjson"), every_seconds=3600)
    progress = SimpleNamespace(progress=SimpleNamespace(batchId=4, numInputRows=9))
    log.onQueryStarted(SimpleNamespace(id="q"))
    for _ in range(3):
        log.onQueryProgress(progress)
    log.onQueryTerminated(SimpleNamespace(id="q", exception=None))
    rows = [json.loads(x) for x in (tmp_path / "log.ndjson").read_text().splitlines()]
    assert [r["event"] for r in rows] == ["started", "progress", "ended"] and rows[1]["batch"] == 4 and rows[1]["rows"] == 9 and all(r["ts"] > 1_600_000_000_000 for r in rows)


def test_projection_errors_and_state(spark, tmp_path):
    """A checkpoint beyond the target and an empty stretch are errors that change nothing; checkpoints and modes move with a promotion and back."""
    events = [_event(1, "star", msg="a", starred=True), _event(2, "star", msg="b", starred=True), _event(3, "star", msg="a", starred=False)]
    log = spark.createDataFrame(events, "seq bigint, source string, event_type string, chat_jid string, msg_id string, sender_jid string, event_ts bigint, payload string")
    store = Catalog(spark, f"file://{tmp_path}/p", writable=True)
    assert (store.checkpoint("starred"), store.mode("starred")) == (0, "shadow")
    assert projection.advance(store, ["starred"], log, 2) == {"starred": (0, 2)}
    assert {r.msg_id for r in store.table("starred").collect()} == {"a", "b"} and store.mode("starred") == "active"
    assert projection.advance(store, ["starred"], log) == {"starred": (2, 3)} and {r.msg_id for r in store.table("starred").collect()} == {"b"}
    for target, part in ((1, log), (9, log.filter("seq < 4"))):
        with pytest.raises(projection.Truncated):
            projection.advance(store, ["starred"], part, target)
    assert store.checkpoint("starred") == 3
    store.rollback()
    assert store.checkpoint("starred") == 2 and {r.msg_id for r in store.table("starred").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        store.promote(store.write_snapshot({}), diff=log)
    store.set_mode("starred", "shadow")
    store.set_checkpoint("starred", 1)
    assert (store.mode("starred"), store.checkpoint("starred")) == ("shadow", 1)


def test_stream_windows_and_dedup(spark, tmp_path):
    rows = [(f"k{i % 5}", "h", 1_700_000_000 + i * 60, "message") for i in range(30)]
    df = spark.createDataFrame(rows, "dedup_key string, raw_hash string, t bigint, event_type string").withColumn("ts", F.timestamp_seconds("t"))
    df.write.parquet(f"{tmp_path}/in")
    stream = sl.source(spark, f"{tmp_path}/in", df.schema)
    for name, out, mode in (("dedup", sl.deduplicated(stream), "append"), ("windows", sl.windowed_counts(stream, "10 minutes", delay="0 seconds"), "complete")):
        out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("dedup").count() == 5
    assert {(r.start, r.n) for r in spark.table("windows").collect()} == {(r.start, r.n) for r in sl.windowed_counts(df, "10 minutes").collect()}
