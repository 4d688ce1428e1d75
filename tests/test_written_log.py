"""From facts to the log, and from the log to tables: what ingest writes the views read."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.functions import messages as envelopes
from quernstone.operators import search
from quernstone.operators.aggregates import unread_fold
from quernstone.plans import decode, ingest, views
from quernstone.sources.catalog import conformed

CHAT, GROUP, OTHER = "1@s.whatsapp.net", "g@g.us", "2@s.whatsapp.net"
COLUMNS = ["source", "event_type", "chat_jid", "msg_id", "sender_jid", "event_ts", "dedup_key", "raw", "raw_hash", "event_id", "flags", "refs", "message_key"]


class Log:
    """Facts become events one after the other, all of a kind in one run; extra columns ride along."""

    def __init__(self, spark):
        self.spark, self.given, self.n, self.known = spark, {}, 0, {}

    def facts(self, make, ddl, *rows):
        for row in rows:
            self.n += 1
            self.given.setdefault((make, ddl), []).append((self.n, row))
        return self

    def snapshot(self, df, table, key):
        rows = [tuple(r) for r in df.collect()]
        return self.facts(("snapshot", table, tuple(key)), df.schema.simpleString()[7:-1], *rows)

    def message(self, msg, body, *, chat=CHAT, sender=OTHER, mine=False, ts=0):
        raw = json.dumps(body)
        ddl = "chat_jid string, msg_id string, sender_jid string, from_me boolean, ts bigint, push_name string, device_sent_to string, message string, raw string, from_full_sync boolean"
        return self.facts(_live, ddl, (chat, msg, sender, mine, ts, "", None, raw, raw, False))

    def old_message(self, msg, text, *, chat=CHAT, ts=0, name="Pushy"):
        info = json.dumps({"key": {"remoteJID": chat, "fromMe": False, "ID": msg, "participant": OTHER}, "messageTimestamp": ts, "pushName": name, "message": {"conversation": text}})
        return self.facts(_history, "chat_jid string, info string, raw string, from_full_sync boolean", (chat, info, info, True))

    def state(self, kind, **fields):
        ddl = "type string, chat_jid string, sender_jid string, from_me boolean, msg_id string, state boolean, end_ts_ms bigint, range boolean, delete_media boolean, ts_ms bigint"
        given = {"chat_jid": CHAT, "ts_ms": 1000 * (self.n + 1)} | fields | {"type": kind}
        return self.facts(ingest.state_changes, ddl, tuple(given.get(c.split()[0]) for c in ddl.split(", ")))

    def receipt(self, kind, chat=CHAT):
        return self.facts(ingest.receipts, "type string, chat_jid string, sender_jid string, message_sender string, message_ids array<string>, ts_ms bigint", (kind, chat, OTHER, None, ["a"], 1000 * (self.n + 1)))

    def frame(self, upto=None):
        """The log, or its first events."""
        for (make, ddl), given in self.given.items():
            new = [(k, row) for k, row in given if k not in self.known]
            if new:
                df = self.spark.createDataFrame([row for _, row in new], ddl).coalesce(1)
                made = ingest.snapshots(df, make[1], list(make[2])) if isinstance(make, tuple) else make(df)
                self.known |= {k: tuple(r) for (k, _), r in zip(new, made.select(*COLUMNS).collect(), strict=True)}
        ddl = "source string, event_type string, chat_jid string, msg_id string, sender_jid string, event_ts bigint, dedup_key string, raw string, raw_hash string, event_id string, flags bigint, refs array<struct<kind:string,target:string>>, message_key string, seq bigint"
        rows = [(*self.known[k], k) for k in sorted(self.known) if upto is None or k <= upto]
        return self.spark.createDataFrame(rows, ddl).selectExpr("*", "'x' AS rules_version", "'clash' AS text", "7 AS name").repartition(3)


def _live(df):
    return ingest.messages(envelopes.live(df))


def _history(df):
    return ingest.messages(envelopes.history(df))


@pytest.fixture()
def log(spark):
    return Log(spark)


def _by(df, key):
    return {r[key]: r for r in df.collect()}


def test_messages(log):
    log.message("a", {"conversation": "one"}, ts=5).message("a", {"editedMessage": {"message": {"conversation": "two"}}}, ts=6).message("b", {"conversation": "mine"}, mine=True, ts=7)
    log.message("b", {"protocolMessage": {"type": "REVOKE", "key": {"ID": "b", "remoteJID": CHAT, "fromMe": True}}}, mine=True, ts=8)
    log.message("i", {"imageMessage": {"caption": "cap", "mimetype": "image/png", "mediaKey": "AAEC", "fileLength": 9}}, ts=9).message("r", {"reactionMessage": {"text": "+1", "key": {"ID": "a"}}}, ts=10)
    log.message("q", {"extendedTextMessage": {"text": "re", "contextInfo": {"stanzaID": "a", "participant": OTHER}}}, ts=11).message("l", {"locationMessage": {"degreesLatitude": 1.5, "degreesLongitude": 2.5, "name": "here"}}, ts=12)
    log.old_message("h", "long ago", ts=3).state("delete_for_me", msg_id="h", sender_jid=OTHER, from_me=False).message("s", {"conversation": "secret"}, ts=13).message("t", {"locationMessage": {"degreesLatitude": 1.0}}, ts=14)
    log.facts(ingest.scrubs, "chat_jid string, msg_id string, ts bigint", (CHAT, "s", 20), (CHAT, "t", 21))
    log.message("st", {"conversation": "status"}, chat="status@broadcast", ts=15)
    got = views.messages(log.frame())
    m = _by(got, "msg_id")
    assert set(m) == set("abirqlhst") and (m["a"].text, m["a"].edited, m["a"].edited_ts, m["a"].ts) == ("two", True, 6, 5)
    assert (m["b"].revoked, m["b"].deleted_at, m["b"].deletion_reason, m["b"].sender_name, m["b"].from_me) == (True, 8, "revoke", "me", True)
    assert (m["i"].media_type, m["i"].media_caption, m["i"].mime_type, bytes(m["i"].media_key), m["i"].file_length, m["i"].text) == ("image", "cap", "image/png", b"\0\1\2", 9, "cap")
    assert (m["h"].deleted_for_me, m["h"].text, m["h"].sender_name, m["h"].deletion_reason) == (True, "long ago", "Pushy", "delete-for-me")
    assert (m["s"].text, m["s"].sender_jid, m["s"].payload_purged_at) == (None, None, 20)
    shown = _by(views.shown(got), "msg_id")
    assert (shown["r"].display_text, shown["q"].display_text) == ("Reacted +1 to two", "> two\nre") and m["q"].display_text == "> message\nre"
    named = _by(views.named(got, views.chats(log.frame()), views.contacts(log.frame())), "msg_id")
    assert named["a"].chat_name == CHAT and named["h"].sender_name == "Pushy"
    assert [(r.msg_id, r.latitude, r.name) for r in views.locations(log.frame()).collect()] == [("l", 1.5, "here")]
    assert [(r.msg_id, r.text) for r in views.status(log.frame()).collect()] == [("st", "status")]
    assert conformed(got, "messages").count() == 9


def test_chats_and_unread(log):
    want = {}  # number of events -> unread messages after these; receipts of others say nothing about one's own reading
    log.message("a", {"conversation": "x"}, ts=5).message("b", {"conversation": "y"}, ts=6).receipt("delivered").receipt("read")
    want[log.n] = 2
    log.receipt("read-self")
    want[log.n] = 0
    log.message("c", {"conversation": "mine"}, mine=True, ts=7).old_message("d", "old").message("a", {"editedMessage": {"message": {"conversation": "z"}}}, ts=8)
    want[log.n] = 0
    log.state("mark_read", state=False)
    want[log.n] = 1
    log.message("e", {"conversation": "w"}, ts=9).state("mark_read", state=False)
    want[log.n] = 2
    log.state("mark_read", state=True).facts(ingest.unread_states, "chat_jid string, count bigint, marked_unread boolean", (CHAT, 7, False))
    log.state("archive", state=True, range=True).state("pin", state=True).state("archive", state=False, range=False).state("mute", state=True, end_ts_ms=77).message("g", {"conversation": "g"}, chat=GROUP, ts=4).message("st", {"conversation": "s"}, chat="status@broadcast")
    log.facts(ingest.groups, "source string, jid string, name string, owner_jid string, created_ts bigint, is_parent boolean, linked_parent_jid string, left_at bigint, participants array<struct<user_jid:string,is_admin:boolean,is_super_admin:boolean>>, ts bigint", ("live", GROUP, "Club", "", 0, False, "", 0, [], 1))
    log.facts(ingest.calls, "source string, chat_jid string, chat_name string, ts bigint, event_type string, call_id string", ("live", OTHER, "Caller", 40, "offer", "k"))
    every = unread_fold(decode.unread(log.frame())).filter(F.col("chat_jid") == CHAT).collect()
    for n, unread in want.items():
        assert max((r.seq, r.unread_count) for r in every if r.seq <= n)[1] == unread, n
    c = _by(views.chats(log.frame()), "jid")
    assert set(c) == {CHAT, GROUP, OTHER}
    mine = c[CHAT]
    assert (mine.kind, mine.name, mine.archived, mine.pinned, mine.muted_until, mine.unread, mine.unread_count, mine.last_message_ts) == ("dm", CHAT, False, True, 77, True, 7, 9)
    assert (c[GROUP].kind, c[GROUP].name, c[GROUP].unread_count) == ("group", "Club", 1) and (c[OTHER].name, c[OTHER].last_message_ts) == ("Caller", 40)


def test_contacts_and_groups(log):
    seen = "jid string, phone string, push_name string, full_name string, first_name string, business_name string, ts bigint"
    log.facts(ingest.contacts, seen, (CHAT, "+1", "pp", "", "", "", 3)).facts(ingest.system_names, "jid string, system_name string, ts bigint", (CHAT, "Sys", 4))
    assert _by(views.contacts(log.frame()), "jid")[CHAT].system_name == "Sys"
    log.facts(ingest.system_names_cleared, "ts bigint", (5,)).facts(ingest.contacts, seen, (CHAT, "", "", "Full", "", "", 6)).message("a", {"conversation": "x"}, sender=CHAT)
    c = _by(views.contacts(log.frame()), "jid")[CHAT]
    assert (c.phone, c.push_name, c.full_name, c.system_name, c.updated_at) == ("+1", "pp", "Full", None, 6)
    assert _by(views.chats(log.frame()), "jid")[CHAT].name == "Full"
    assert views.named(views.messages(log.frame()), views.chats(log.frame()), views.contacts(log.frame())).first().sender_name == "Full"
    ddl = "source string, jid string, name string, owner_jid string, created_ts bigint, is_parent boolean, linked_parent_jid string, left_at bigint, participants array<struct<user_jid:string,is_admin:boolean,is_super_admin:boolean>>, ts bigint"
    log.facts(ingest.groups, ddl, ("live", GROUP, "G", "o", 9, False, "par", 0, [("u", True, False), ("w", False, False)], 1)).facts(ingest.groups, ddl, ("live", GROUP, "", "", 0, False, "", 0, [("w", False, True)], 2))
    assert [tuple(r) for r in views.roster(log.frame()).collect()] == [(GROUP, "w", "superadmin")]
    log.facts(ingest.groups, ddl, ("live", GROUP, "", "", 0, False, "", 50, [], 3))
    g = views.groups(log.frame()).first()
    assert (g.name, g.owner_jid, g.created_ts, g.is_parent, g.linked_parent_jid, g.left_at, g.updated_at) == ("G", "o", 9, False, None, 50, 3)
    assert views.roster(log.frame()).count() == 1


def test_polls_votes_stars_calls(log):
    poll = "source string, chat_jid string, msg_id string, sender_jid string, question string, options array<string>, selectable_count int, created_ts bigint"
    vote = "source string, chat_jid string, poll_msg_id string, voter_jid string, vote_msg_id string, selected array<string>, unknown_hashes array<string>, voted_ts_ms bigint"
    log.facts(ingest.polls, poll, ("live", CHAT, "p", OTHER, "?", ["x", "y"], 1, 3)).facts(ingest.poll_options, "source string, chat_jid string, poll_msg_id string, option string, ts bigint", ("live", CHAT, "p", "z", 4), ("live", CHAT, "p", "x", 5))
    log.facts(ingest.poll_votes, vote, ("live", CHAT, "p", "v", "w1", ["x"], [], 10), ("live", CHAT, "p", "w", "w2", ["z"], ["h"], 11)).facts(ingest.poll_votes, vote, ("live", CHAT, "p", "v", "", [], [], 12))
    p = views.polls(log.frame()).first()
    assert (p.msg_id, p.sender_jid, p.question, p.options, p.selectable_count, p.created_ts) == ("p", OTHER, "?", ["x", "y", "z"], 1, 3)
    assert [(r.poll_msg_id, r.voter_jid, r.selected, r.unknown_hashes, r.ts) for r in views.votes(log.frame()).collect()] == [("p", "w", ["z"], ["h"], 11)]
    star = "source string, chat_jid string, msg_id string, sender_jid string, from_me boolean, starred boolean, starred_ts bigint"
    log.facts(ingest.stars, star, ("live", CHAT, "a", OTHER, False, True, 5), ("live", CHAT, "b", OTHER, False, True, 6)).facts(ingest.stars, star, ("live", CHAT, "b", OTHER, False, False, 7)).state("star", msg_id="c", sender_jid=OTHER, from_me=True, state=True, ts_ms=9000)
    assert sorted((r.msg_id, r.from_me, r.starred_at) for r in views.starred(log.frame()).collect()) == [("a", False, 5), ("c", True, 9)]
    call = "source string, chat_jid string, call_id string, event_type string, direction string, outcome string, duration_secs bigint, ts bigint, deleted boolean"
    log.facts(ingest.calls, call, ("history", CHAT, "k1", "call_log", "inbound", "missed", 0, 1, False), ("history", CHAT, "k2", "call_log", "outbound", "", 5, 2, False), ("live", CHAT, "k3", "offer", "inbound", "", 0, 3, False))
    log.facts(ingest.calls, call, ("app_state", CHAT, "", "", "inbound", "", 0, 0, True)).facts(ingest.calls, call, ("history", CHAT, "k1", "call_log", "inbound", "done", 8, 4, False))
    assert sorted((r.call_id, r.ts, r.outcome, r.duration_secs) for r in views.calls(log.frame()).collect()) == [("k1", 4, "done", 8), ("k2", 2, None, 5), ("k3", 3, None, None)]


def test_identities(log):
    log.message("a", {"conversation": "x"}, chat="9@lid", ts=1).facts(ingest.identities, "source string, lid string, pn string, resolved_ts bigint", ("identity_resolution", "9@lid", CHAT, 2)).message("b", {"conversation": "y"}, chat="9@lid", ts=3)
    assert sorted((r.chat_jid, r.msg_id) for r in views.identified(log.frame())["messages"].collect()) == [(CHAT, "a"), (CHAT, "b")]
    poll = "source string, chat_jid string, msg_id string, sender_jid string, question string, options array<string>, selectable_count int, created_ts bigint"
    vote = "source string, chat_jid string, poll_msg_id string, voter_jid string, vote_msg_id string, selected array<string>, unknown_hashes array<string>, voted_ts_ms bigint"
    log.facts(ingest.polls, poll, ("live", "9@lid", "p", "9@lid", "?", ["x"], 1, 3)).facts(ingest.poll_votes, vote, ("live", "9@lid", "p", "v", "w1", ["x"], [], 10))
    got = views.identified(log.frame())
    assert [(r.chat_jid, r.msg_id, r.sender_jid, r.options) for r in got["polls"].collect()] == [(CHAT, "p", CHAT, ["x"])]
    assert [(r.chat_jid, r.poll_msg_id, r.voter_jid) for r in got["poll_votes"].collect()] == [(CHAT, "p", "v")]
    assert got["message_locations"].isEmpty() and got["message_payload_purges"].isEmpty()


def test_snapshots_come_back_and_live_events_change_them(spark, log):
    log.message("a", {"conversation": "before the snapshot"}, ts=1)
    message = spark.createDataFrame([(CHAT, "a", "old text", 4, bytearray(b"\0\1"), False, "/p"), (CHAT, "z", "kept", 5, None, True, None)], "chat_jid string, msg_id string, text string, ts bigint, media_key binary, from_me boolean, local_path string")
    chat = spark.createDataFrame([(CHAT, "dm", "Named", 9, True, False, 0, True, 0), (OTHER, "dm", None, 3, False, True, -1, False, 4)], "jid string, kind string, name string, last_message_ts bigint, archived boolean, pinned boolean, muted_until bigint, unread boolean, unread_count int")
    tables = {
        "messages": (conformed(message, "messages"), ["chat_jid", "msg_id"], views.messages), "chats": (chat, ["jid"], views.chats), "contacts": (conformed(spark.createDataFrame([(CHAT, "P", "Sys", 2)], "jid string, push_name string, system_name string, updated_at bigint"), "contacts"), ["jid"], views.contacts),
        "groups": (conformed(spark.createDataFrame([(GROUP, "G", 7, False)], "jid string, name string, left_at bigint, is_parent boolean"), "groups"), ["jid"], views.groups), "group_participants": (conformed(spark.createDataFrame([(GROUP, "u", "admin"), (GROUP, "w", "member")], "group_jid string, user_jid string, role string"), "group_participants"), ["group_jid", "user_jid"], views.roster),
        "polls": (conformed(spark.createDataFrame([(CHAT, "p", "?", ["x"], 1)], "chat_jid string, msg_id string, question string, options array<string>, selectable_count int"), "polls"), ["chat_jid", "msg_id"], views.polls),
        "poll_votes": (conformed(spark.createDataFrame([(CHAT, "p", "v", ["x"], 50)], "chat_jid string, poll_msg_id string, voter_jid string, selected array<string>, ts bigint"), "poll_votes"), ["chat_jid", "poll_msg_id", "voter_jid"], views.votes),
        "starred": (conformed(spark.createDataFrame([(CHAT, "a", 5)], "chat_jid string, msg_id string, starred_at bigint"), "starred"), ["chat_jid", "msg_id"], views.starred),
        "call_events": (conformed(spark.createDataFrame([(CHAT, "k", "offer", 6, 0)], "chat_jid string, call_id string, event_type string, ts bigint, duration_secs bigint"), "call_events"), ["chat_jid", "call_id"], views.calls),
        "message_locations": (conformed(spark.createDataFrame([(CHAT, "z", 1.0, 2.0, True)], "chat_jid string, msg_id string, latitude double, longitude double, is_live boolean"), "message_locations"), ["chat_jid", "msg_id"], views.locations),
        "message_payload_purges": (conformed(spark.createDataFrame([(CHAT, "gone", 8)], "chat_jid string, msg_id string, purged_at bigint"), "message_payload_purges"), ["chat_jid", "msg_id"], views.purges),
    }
    for name, (df, key, _) in tables.items():
        log.snapshot(df, name, key)
    assert set(tables) | {"status_messages"} == set(decode.SNAPSHOTS)
    for name, (df, key, view) in tables.items():
        got = view(log.frame())
        shared = [c for c in df.columns if c in got.columns and c not in ("rowid", "unread_count", "name")] + (["unread_count"] if name == "chats" else [])
        rows = lambda d: sorted((str([bytes(x) if isinstance(x, bytearray) else x for x in r]) for r in d.select(*shared).collect()))  # noqa: B023, E731
        want = df.withColumn("unread_count", F.when(F.col("unread"), F.greatest("unread_count", F.lit(1))).otherwise(0).cast("int")) if name == "chats" else df
        assert set(key) <= set(shared) and rows(got) == rows(want), name
    log.message("a", {"editedMessage": {"message": {"conversation": "newer"}}}, ts=30).message("n", {"conversation": "new"}, ts=31).state("archive", state=False, range=False).state("star", msg_id="a", state=False, from_me=False)
    m = _by(views.messages(log.frame()), "msg_id")
    assert (m["a"].text, m["a"].local_path, m["z"].text, m["n"].text) == ("newer", "/p", "kept", "new")
    c = _by(views.chats(log.frame()), "jid")[CHAT]
    assert (c.archived, c.unread_count, c.last_message_ts) == (False, 2, 31) and views.starred(log.frame()).count() == 0
    log.snapshot(conformed(message, "messages").filter("msg_id = 'a'").withColumn("text", F.lit("again")), "messages", ["chat_jid", "msg_id"])
    assert _by(views.messages(log.frame()), "msg_id")["a"].text == "again"


def test_empty_log(spark, log):
    log.message("a", {"conversation": "x"})
    for name, df in views.rebuild(log.frame().limit(0)).items():
        assert df.count() == 0, name


def test_words_of_any_script_find_their_rows(spark, tmp_path):
    texts = ["안녕하세요 세계", "Tiếng Việt rất đẹp", "हिन्दी में लिखा", "Η Ελλάδα είναι ωραία ΟΔΟΣ οδός", "Ёлка и йод, Россия", "naïve façade Ærø", "東京タワー ガイド", "café noir", "İstanbul ǆ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "rowid int, text string")
    search.write_index(rows, f"file://{tmp_path}/index", ("text",))
    for k, text in enumerate(texts):
        for word in text.replace(",", "").split():
            for got in (search.bm25(rows, word), search.search_index(spark, f"file://{tmp_path}/index", word)) if word in (text.split()[0], text.split()[-1]) else ():
                assert k in [r.rowid for r in got.collect()], word
    terms = {r.rowid: r.t for r in rows.select("rowid", search.tokens(F.col("text")).alias("t")).collect()}
    for k, text in enumerate(texts):
        assert [t for piece in search.query_terms(text) for t in piece] == terms[k], text
    assert search.query_terms("Café Ёж οδός ΟΔΟΣ") == [["cafe"], ["еж"], ["οδοσ"], ["οδοσ"]]
