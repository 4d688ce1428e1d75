"""Envelopes and facts, by literal cases."""

import json

from pyspark.sql import functions as F

from quernstone.functions import messages as ms
from quernstone.functions import parse
from quernstone.plans import ingest

DDL = "chat_jid string, msg_id string, sender_jid string, from_me boolean, message string"


def _read(spark, *envelopes):
    rows = [("c", f"m{i}", "snd", False, e if isinstance(e, str) or e is None else json.dumps(e)) for i, e in enumerate(envelopes)]
    found = {r.msg_id: r for r in ms.parsed(spark.createDataFrame(rows, DDL).withColumn("place", F.col("msg_id"))).collect()}
    by = {r.place: r for r in found.values()}
    return [{k: x for k, x in by[f"m{i}"].asDict(recursive=True).items() if x not in (None, "", False, 0, []) and k not in ("place",)} for i in range(len(envelopes))]


def _deep(n):
    out = {"conversation": "deep"}
    for k in range(n):
        out = {"editedMessage": {"message": out}} if k % 2 else {"associatedChildMessage": {"message": out}}
    return out


def test_wrappers(spark):
    edit = {"protocolMessage": {"type": "MESSAGE_EDIT", "key": {"ID": "K9", "remoteJID": "r@s", "fromMe": True}, "editedMessage": {"extendedTextMessage": {"text": "new", "contextInfo": {"stanzaID": " q1 ", "participant": "p@s", "forwardingScore": 2, "quotedMessage": {"imageMessage": {"caption": "c"}}}}}}}
    comment = {"commentMessage": {"targetMessageKey": {"ID": "tgt", "participant": "z"}, "message": {"extendedTextMessage": {"text": "com", "contextInfo": {"stanzaID": "other", "participant": "o", "quotedMessage": {"conversation": "q"}}}}}}
    same = {"commentMessage": {"targetMessageKey": {"ID": "other"}, "message": {"extendedTextMessage": {"text": "com", "contextInfo": {"stanzaID": "other", "participant": "o", "quotedMessage": {"conversation": "q"}}}}}}
    got = _read(
        spark, {"conversation": "hi"}, {"deviceSentMessage": {"destinationJID": "x@g.us", "message": {"editedMessage": {"message": edit}}}}, {"protocolMessage": {"type": "REVOKE", "key": {"ID": "K1"}}, "conversation": "x"}, comment, same, _deep(11),
        {"protocolMessage": {"type": "MESSAGE_EDIT", "key": {"ID": "K2"}}}, {"deviceSentMessage": {"destinationJID": "y@s", "message": {"conversation": "copy"}}}, None, "no json", "",
    )
    base = {"chat_jid": "c", "sender_jid": "snd"}
    assert got[0] == base | {"msg_id": "m0", "text": "hi"}
    assert got[1] == {"chat_jid": "r@s", "msg_id": "K9", "sender_jid": "snd", "from_me": True, "text": "new", "reply_to_id": "q1", "reply_to_sender": "p@s", "reply_to_display": "Sent image", "is_forwarded": True, "forwarding_score": 2, "edited": True}
    assert got[2] == base | {"msg_id": "K1", "revoked": True}
    assert got[3] == base | {"msg_id": "m3", "text": "com", "reply_to_id": "tgt", "reply_to_sender": "z"}
    assert got[4] == base | {"msg_id": "m4", "text": "com", "reply_to_id": "other", "reply_to_sender": "o", "reply_to_display": "q"}
    assert got[5] == base | {"msg_id": "m5", "text": "deep", "edited": True}
    assert got[6] == base | {"msg_id": "K2", "edited": True, "unhandled": "protocolMessage"}
    assert got[7] == {"chat_jid": "y@s", "sender_jid": "snd", "msg_id": "m7", "text": "copy", "from_me": True}
    assert [got[k] for k in (8, 9, 10)] == [base | {"msg_id": f"m{k}"} for k in (8, 9, 10)]


def test_contents(spark):
    flow = [{"name": "cta_url", "buttonParamsJSON": '{"display_text":"D","url":"U"}'}, {"name": "x", "buttonParamsJSON": "{}"}, {"name": "quick_reply", "buttonParamsJSON": '{"display_text":"Q","id":"I"}'}, {"name": "quick_reply", "buttonParamsJSON": "broken"}]
    got = _read(
        spark, {"audioMessage": {"mimetype": "a/b", "fileLength": 5}, "conversation": "said"}, {"strangeMessage": {"a": 1}, "aaa": {}, "messageContextInfo": {}}, {"templateMessage": {"hydratedTemplate": {"hydratedTitleText": "T", "hydratedFooterText": "F", "hydratedButtons": [{"urlButton": {"displayText": " go ", "URL": "u"}}, {"index": 4, "callButton": {"displayText": "c", "phoneNumber": "1"}}]}}},
        {"interactiveMessage": {"body": {"text": "B"}, "nativeFlowMessage": {"buttons": flow}}}, {"pollCreationMessageV4": {"message": {"pollCreationMessageV3": {"name": "Q?", "options": [{"optionName": "a"}, {"optionName": "b"}], "selectableOptionsCount": 1}}}}, {"albumMessage": {"expectedImageCount": 2, "expectedVideoCount": 1}},
        {"contactsArrayMessage": {"contacts": [{"displayName": "A", "vcard": "TEL:1"}, {"displayName": "B"}]}}, {"callLogMesssage": {"isVideo": True, "callOutcome": "MISSED", "durationSecs": 3, "participants": [{"JID": " j ", "callOutcome": "REJECTED"}, {"JID": ""}]}}, {"liveLocationMessage": {"degreesLatitude": 1.5, "caption": " here "}},
        {"pollUpdateMessage": {"pollCreationMessageKey": {"ID": " p ", "remoteJID": "g"}, "senderTimestampMS": 9}}, {"secretEncryptedMessage": {"secretEncType": "POLL_ADD_OPTION", "targetMessageKey": {"ID": "p"}}}, {"videoMessage": {"caption": "v", "gifPlayback": True}, "stickerMessage": {}}, {"groupInviteMessage": {"groupName": "G"}},
    )
    assert got[0]["text"] == "said" and got[0]["media"]["caption"] == "said" and got[0]["media"]["file_length"] == 5 and got[1]["unhandled"] == "aaa,strangeMessage"
    assert got[2]["text"] == "T\n[F]" and [(b["type"], b["display_text"], b["url"], b["phone_number"], b["index"]) for b in got[2]["buttons"]] == [("url", "go", "u", "", 1), ("call", "c", "", "1", 5)]
    assert got[3]["text"] == "B" and [(b["type"], b["id"], b["index"]) for b in got[3]["buttons"]] == [("url", "", 1), ("quick_reply", "I", 3)]
    assert got[4]["poll"] == {"question": "Q?", "options": ["a", "b"], "selectable_count": 1} and got[4]["text"] == "Poll: Q?" and got[5]["text"] == "[Album: 2 images, 1 videos]" and got[6]["text"] == "Contacts:\nContact: A (1)\nContact: B"
    assert got[7]["call"] == {"media": "video", "outcome": "missed", "call_type": "", "duration_secs": 3, "participants": [{"jid": "j", "outcome": "rejected"}]}
    assert got[8]["location"] == {"latitude": 1.5, "longitude": 0.0, "name": "here", "address": "", "is_live": True} and got[8]["media"]["type"] == "live_location"
    assert got[9]["poll_vote"] == {"poll_msg_id": "p", "poll_chat_jid": "g", "poll_sender_jid": "", "sender_ts_ms": 9} and got[9]["text"] == "Poll vote" and got[10]["poll_option"]["poll_msg_id"] == "p"
    assert got[11]["media"]["type"] == "sticker" and got[11]["text"] == "v" and got[12]["text"] == "Group invite: G"


def test_the_same_fact_is_the_same_event(spark):
    rows = [("read", "c", "s", None, ["b", "a"], 5), ("read", "c", "s", "", ["a", "b"], 5), ("read", "c", "s", "x<y", ["a"], 5)]
    got = ingest.receipts(spark.createDataFrame(rows, "type string, chat_jid string, sender_jid string, message_sender string, message_ids array<string>, ts_ms bigint")).collect()
    assert got[0].event_id == got[1].event_id != got[2].event_id and got[0].raw == '{"type":"read","chat":"c","sender":"s","message_ids":["a","b"],"timestamp_ms":5}' and "\\u003c" in got[2].raw
    assert [r.target for r in got[0].refs] == ['{"chat":"c","from_me":false,"id":"b"}', '{"chat":"c","from_me":false,"id":"a"}']
    scrub = ingest.scrubs(spark.createDataFrame([(" c ", "m", 3), ("", "m", 3)], "chat_jid string, msg_id string, ts bigint")).collect()
    assert len(scrub) == 1 and scrub[0].raw is None and scrub[0].dedup_key == 'dd:{"scope":"scrub","parts":["c","m"]}' and len(scrub[0].raw_hash) == 64
    same = ingest.identities(spark.createDataFrame([("live", "1@lid", "2@s", 0), ("live", "x", " x ", 0)], "source string, lid string, pn string, resolved_ts bigint")).collect()
    assert [r.raw for r in same] == ['{"lid":"1@lid","pn":"2@s"}']
    states = ingest.unread_states(spark.createDataFrame([("c", 3, False), ("c", 0, True), ("c", None, None)], "chat_jid string, count bigint, marked_unread boolean")).collect()
    assert [r.raw for r in states] == ['{"type":"unread_count","chat":"c","count":3,"timestamp_ms":0}', '{"type":"mark_read","chat":"c","timestamp_ms":0}', '{"type":"mark_read","chat":"c","state":true,"timestamp_ms":0}']


def test_brackets_and_layers_without_a_cap(spark):
    url = "https://a.example/x" + "(" * 3 + ")" * 40
    nested = '{"w":{"message":' * 9 + '{"k":1}' + "}}" * 9
    r = spark.range(1).select(parse.first_url(F.lit(f"see {url}.")).alias("u"), parse.unwrapped(F.lit(nested), ("w",)).alias("m")).first()
    assert r.u == "https://a.example/x((()))" and r.m == '{"k":1}'
