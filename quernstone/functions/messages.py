"""Message envelopes, kept as JSON text, read into flat rows: wrappers, contents, buttons, polls, quotes.

An envelope is an object with one field for its kind of content (``conversation``, ``imageMessage``, ...), perhaps within wrappers of
the same shape. All is Column to Column and DataFrame to DataFrame over built-in expressions: a row is read by itself, nothing
moves. Blank and absent texts are empty; what holds nothing is null. Text that is no JSON object reads as an empty envelope.
"""

from __future__ import annotations

from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import parse
from quernstone.functions.values import enum_word

_KEY = "struct<remoteJID:string,fromMe:boolean,ID:string,participant:string>"
_CONTEXT = "contextInfo:struct<stanzaID:string,participant:string,quotedMessage:string,forwardingScore:int,isForwarded:boolean>"
_FILE = "caption:string,mimetype:string,directPath:string,mediaKey:string,fileSHA256:string,fileEncSHA256:string,fileLength:bigint"
_FLOW = "header:struct<title:string>,body:struct<text:string>,footer:struct<text:string>,nativeFlowMessage:struct<buttons:array<struct<name:string,buttonParamsJSON:string>>>"
_TEMPLATE = (
    "struct<hydratedTitleText:string,hydratedContentText:string,hydratedFooterText:string,hydratedButtons:array<struct<index:int,urlButton:struct<displayText:string,URL:string>,"
    "quickReplyButton:struct<displayText:string,ID:string>,callButton:struct<displayText:string,phoneNumber:string>>>>"
)
_POLL = f"struct<name:string,options:array<struct<optionName:string>>,selectableOptionsCount:int,{_CONTEXT}>"
_POLLS = ("pollCreationMessage", "pollCreationMessageV2", "pollCreationMessageV3", "pollCreationMessageV5", "pollCreationMessageV6")

# The fields of an envelope that hold content, in the order in which their quote context is looked for.
CONTENTS = {
    "extendedTextMessage": f"struct<text:string,{_CONTEXT}>", "imageMessage": f"struct<{_FILE},{_CONTEXT}>", "videoMessage": f"struct<{_FILE},gifPlayback:boolean,{_CONTEXT}>", "audioMessage": f"struct<{_FILE},{_CONTEXT}>",
    "documentMessage": f"struct<{_FILE},fileName:string,{_CONTEXT}>", "stickerMessage": f"struct<{_FILE},{_CONTEXT}>", "locationMessage": f"struct<degreesLatitude:double,degreesLongitude:double,name:string,address:string,{_CONTEXT}>",
    "liveLocationMessage": f"struct<degreesLatitude:double,degreesLongitude:double,caption:string,{_CONTEXT}>", "contactMessage": f"struct<displayName:string,vcard:string,{_CONTEXT}>",
    "contactsArrayMessage": f"struct<displayName:string,contacts:array<struct<displayName:string,vcard:string>>,{_CONTEXT}>",
    "templateMessage": f"struct<hydratedFourRowTemplate:{_TEMPLATE},hydratedTemplate:{_TEMPLATE},interactiveMessageTemplate:struct<{_FLOW}>,{_CONTEXT}>",
    "buttonsMessage": f"struct<text:string,contentText:string,footerText:string,buttons:array<struct<buttonID:string,buttonText:struct<displayText:string>>>,{_CONTEXT}>", "buttonsResponseMessage": f"struct<selectedDisplayText:string,{_CONTEXT}>",
    "interactiveMessage": f"struct<{_FLOW},{_CONTEXT}>", "interactiveResponseMessage": f"struct<body:struct<text:string>,{_CONTEXT}>",
    "listMessage": f"struct<title:string,description:string,buttonText:string,sections:array<struct<rows:array<struct<title:string,rowID:string,description:string>>>>,{_CONTEXT}>",
    "listResponseMessage": f"struct<title:string,singleSelectReply:struct<selectedRowID:string>,{_CONTEXT}>", "templateButtonReplyMessage": f"struct<selectedDisplayText:string,{_CONTEXT}>", **dict.fromkeys(_POLLS, _POLL),
    "groupInviteMessage": f"struct<groupName:string,caption:string,{_CONTEXT}>", "albumMessage": f"struct<expectedImageCount:int,expectedVideoCount:int,{_CONTEXT}>",
}
# Content without a quote context.
PLAIN = {
    "conversation": "string", "pollCreationMessageV4": "struct<message:struct<" + ",".join(f"{p}:{_POLL}" for p in _POLLS) + ">>", "reactionMessage": "struct<text:string,key:struct<ID:string>>", "encReactionMessage": "struct<targetMessageKey:struct<ID:string>>",
    "pollUpdateMessage": f"struct<pollCreationMessageKey:{_KEY},senderTimestampMS:bigint>", "pollAddOptionMessage": f"struct<pollCreationMessageKey:{_KEY},addOption:struct<optionName:string>>", "secretEncryptedMessage": f"struct<secretEncType:string,targetMessageKey:{_KEY}>",
    "callLogMesssage": "struct<isVideo:boolean,callOutcome:string,callType:string,durationSecs:bigint,participants:array<struct<JID:string,callOutcome:string>>>",
}
LEAF = "struct<" + ",".join(f"{k}:{v}" for k, v in (PLAIN | CONTENTS).items()) + ">"
_BUTTON = "array<struct<type:string,display_text:string,id:string,url:string,phone_number:string,description:string,response_type:string,index:int>>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _trim(c: Column) -> Column:
    return F.trim(_text(c), F.lit(" \t\n\r"))


def _first(*columns: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def _lines(*columns: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in columns])


def _bracketed(c: Column) -> Column:
    return F.when(_trim(c) != "", F.concat(F.lit("["), _trim(c), F.lit("]")))


# Wrappers


# The wrappers.
_WRAPPERS = (
    f"struct<deviceSentMessage:struct<destinationJID:string,message:string>,editedMessage:struct<message:string>,protocolMessage:struct<type:string,key:{_KEY},editedMessage:string>,"
    f"associatedChildMessage:struct<message:string>,groupStatusMentionMessage:struct<message:string>,commentMessage:struct<message:string,targetMessageKey:{_KEY}>>"
)


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unwrapped(message: Column) -> Column:
    """The innermost envelope and what its wrappers say: struct(message, from_me, chat, id, sender, comment_id, comment_sender, edited, revoked, done).

    As many steps are made as the text could have layers, none for a plain one: no wrapper is left, however deep. A step takes off one of: a
    copy for one's own other devices (which names the chat), an edit, a change by protocol (edit or revocation, which
    name the message), a child or mention, a comment (which names the message it is on)."""
    none = {k: F.lit(None).cast(t).alias(k) for k, t in {"from_me": "boolean", "chat": "string", "id": "string", "sender": "string", "comment_id": "string", "comment_sender": "string"}.items()}
    start = F.struct(message.alias("message"), *none.values(), F.lit(False).alias("edited"), F.lit(False).alias("revoked"), F.lit(False).alias("done"))
    named = lambda c: F.nullif(_trim(c), F.lit(""))

    def taken_off(s: Column, x: Column) -> Column:
        w, case = x["w"], x["case"]
        key, edited, comment = w["protocolMessage"]["key"], w["protocolMessage"]["editedMessage"], w["commentMessage"]
        by_key, first = case.isin("change", "gone"), (case == "comment") & s["comment_id"].isNull()
        given = lambda name, field: F.coalesce(F.when(by_key, named(key[field])), s[name]).alias(name)
        inner = (
            F.when(case == "device", w["deviceSentMessage"]["message"]).when(case == "edit", w["editedMessage"]["message"]).when(case == "change", F.coalesce(edited, s["message"]))
            .when(case == "inner", F.coalesce(w["associatedChildMessage"]["message"], w["groupStatusMentionMessage"]["message"])).when(case == "comment", comment["message"]).otherwise(s["message"])
        )
        return F.struct(
            inner.alias("message"), F.when(case == "device", True).when(by_key, F.coalesce(key["fromMe"], s["from_me"])).otherwise(s["from_me"]).alias("from_me"),
            F.when(case == "device", F.coalesce(named(w["deviceSentMessage"]["destinationJID"]), s["chat"])).when(by_key, F.coalesce(named(key["remoteJID"]), s["chat"])).otherwise(s["chat"]).alias("chat"),
            given("id", "ID"), given("sender", "participant"), F.when(first, named(comment["targetMessageKey"]["ID"])).otherwise(s["comment_id"]).alias("comment_id"),
            F.when(first, named(comment["targetMessageKey"]["participant"])).otherwise(s["comment_sender"]).alias("comment_sender"), (s["edited"] | case.isin("edit", "change")).alias("edited"), (s["revoked"] | (case == "gone")).alias("revoked"),
            (case.isin("end", "gone") | ((case == "change") & edited.isNull())).alias("done"),
        )

    def case_of(w: Column) -> Column:
        kind, key = w["protocolMessage"]["type"], w["protocolMessage"]["key"]
        return (
            F.when(w["deviceSentMessage"]["message"].isNotNull(), "device").when(w["editedMessage"]["message"].isNotNull(), "edit").when(kind.isin("MESSAGE_EDIT", "14"), "change").when(kind.isin("REVOKE", "0") & key.isNotNull(), "gone")
            .when(w["associatedChildMessage"]["message"].isNotNull() | w["groupStatusMentionMessage"]["message"].isNotNull(), "inner").when(w["commentMessage"]["message"].isNotNull(), "comment").otherwise("end")
        )

    def step(s: Column, _: Column) -> Column:
        found = _let(F.from_json(s["message"], _WRAPPERS), lambda w: F.struct(w.alias("w"), case_of(w).alias("case")))
        return F.when(s["done"], s).otherwise(_let(found, lambda x: taken_off(s, x)))

    layers = F.coalesce(F.regexp_count(message, F.lit('"(?:message|protocolMessage)"')), F.lit(0))
    return F.aggregate(F.when(layers > 0, F.sequence(F.lit(1), layers)).otherwise(F.array().cast("array<int>")), start, step)


# Contents, each of a leaf read as LEAF


def _poll(m: Column) -> Column:
    return F.coalesce(*[m[p] for p in _POLLS], *[m["pollCreationMessageV4"]["message"][p] for p in _POLLS])


def _contact_text(m: Column) -> Column:
    one, many = m["contactMessage"], m["contactsArrayMessage"]
    line = lambda c: parse.card_text(parse.card(c["vcard"], c["displayName"]))
    lines = F.filter(F.transform(many["contacts"], line), lambda x: x != "")
    several = (
        F.when(F.size(lines) > 1, F.concat(F.lit("Contacts:\n"), F.array_join(lines, "\n"))).when(F.size(lines) == 1, lines[0])
        .when(_trim(many["displayName"]) != "", F.concat(F.lit("Contacts: "), _trim(many["displayName"]))).otherwise("")
    )
    return F.when(one.isNotNull(), line(one)).when(many.isNotNull(), several)


def _flow_text(im: Column) -> Column:
    return _lines(_trim(im["header"]["title"]), _trim(im["body"]["text"]), _bracketed(im["footer"]["text"]))


def _hydrated(m: Column) -> Column:
    return F.coalesce(m["templateMessage"]["hydratedFourRowTemplate"], m["templateMessage"]["hydratedTemplate"])


def _invite_text(m: Column) -> Column:
    invite = m["groupInviteMessage"]
    return F.when(invite.isNotNull(), F.when(_trim(invite["caption"]) != "", invite["caption"]).when(_trim(invite["groupName"]) != "", F.concat(F.lit("Group invite: "), _trim(invite["groupName"]))).otherwise("[Group invite]"))


def _asks_option(m: Column) -> Column:
    return m["pollAddOptionMessage"].isNotNull() | F.coalesce(m["secretEncryptedMessage"]["secretEncType"] == "POLL_ADD_OPTION", F.lit(False))


def content_texts(m: Column) -> dict[str, Column]:
    """text, and caption: what was said beside a recording."""
    said = F.when(_text(m["conversation"]) != "", m["conversation"]).when(m["extendedTextMessage"].isNotNull(), _text(m["extendedTextMessage"]["text"])).otherwise(_text(_invite_text(m)))
    said = _first(said, _text(m["imageMessage"]["caption"]), _text(m["videoMessage"]["caption"]))
    first = _first(said, F.when(m["audioMessage"].isNotNull(), "[Audio]"), _text(m["documentMessage"]["caption"]))
    h, b, lr, poll, album = _hydrated(m), m["buttonsMessage"], m["listResponseMessage"], _poll(m), m["albumMessage"]
    template = F.when(h.isNotNull(), _lines(_trim(h["hydratedTitleText"]), _trim(h["hydratedContentText"]), _bracketed(h["hydratedFooterText"]))).otherwise(_flow_text(m["templateMessage"]["interactiveMessageTemplate"]))
    images, videos = (F.coalesce(album[c], F.lit(0)) for c in ("expectedImageCount", "expectedVideoCount"))
    counts = F.concat_ws(", ", F.when(images > 0, F.concat(images, F.lit(" images"))), F.when(videos > 0, F.concat(videos, F.lit(" videos"))))
    text = _first(
        F.coalesce(_contact_text(m), first), template, _lines(_trim(b["text"]), _trim(b["contentText"]), _bracketed(b["footerText"])), _text(m["buttonsResponseMessage"]["selectedDisplayText"]), _flow_text(m["interactiveMessage"]),
        _trim(m["interactiveResponseMessage"]["body"]["text"]), _lines(_trim(m["listMessage"]["title"]), _trim(m["listMessage"]["description"])), _trim(lr["title"]), _text(lr["singleSelectReply"]["selectedRowID"]),
        _text(m["templateButtonReplyMessage"]["selectedDisplayText"]), F.when(_trim(poll["name"]) != "", F.concat(F.lit("Poll: "), _trim(poll["name"]))), F.when(_asks_option(m), "Poll option added"), F.when(m["pollUpdateMessage"].isNotNull(), "Poll vote"),
        F.when(album.isNotNull(), F.when(counts != "", F.concat(F.lit("[Album: "), counts, F.lit("]"))).otherwise("[Album]")),
    )
    return {"text": text, "caption": said}


def media(m: Column, said: Column) -> Column:
    """struct(type, caption, filename, mime_type, direct_path, media_key, file_sha256, file_enc_sha256, file_length), null without any; the later kinds come before."""

    def of(kind: Column, x: Column, caption: Column, filename: Column | None = None, *, file: bool = True) -> Column:
        names = {"mime_type": "mimetype", "direct_path": "directPath", "media_key": "mediaKey", "file_sha256": "fileSHA256", "file_enc_sha256": "fileEncSHA256"}
        fields = [(_text(x[c]) if file else F.lit("")).alias(n) for n, c in names.items()]
        size = F.coalesce(x["fileLength"], F.lit(0)) if file else F.lit(0)
        return F.when(x.isNotNull(), F.struct(kind.alias("type"), _text(caption).alias("caption"), _text(filename if filename is not None else F.lit("")).alias("filename"), *fields, size.cast("bigint").alias("file_length")))

    video = F.when(m["videoMessage"]["gifPlayback"], "gif").otherwise("video")
    live, place, document = m["liveLocationMessage"], m["locationMessage"], m["documentMessage"]
    return F.coalesce(
        of(F.lit("location"), place, _trim(place["name"]), file=False), of(F.lit("live_location"), live, _trim(live["caption"]), file=False), of(F.lit("sticker"), m["stickerMessage"], F.lit("")), of(F.lit("document"), document, document["caption"], document["fileName"]),
        of(F.lit("audio"), m["audioMessage"], said), of(video, m["videoMessage"], m["videoMessage"]["caption"]), of(F.lit("image"), m["imageMessage"], m["imageMessage"]["caption"]),
    )


def location(m: Column) -> Column:
    a, b = m["locationMessage"], m["liveLocationMessage"]

    def of(x: Column, name: str, address: Column, live: bool) -> Column:
        degrees = [F.coalesce(x[c], F.lit(0.0)).alias(n) for c, n in (("degreesLatitude", "latitude"), ("degreesLongitude", "longitude"))]
        return F.when(x.isNotNull(), F.struct(*degrees, _trim(x[name]).alias("name"), address.alias("address"), F.lit(live).alias("is_live")))

    return F.coalesce(of(a, "name", _trim(a["address"]), False), of(b, "caption", F.lit(""), True))


def buttons(m: Column) -> Column:
    """What can be pressed, in order: template, buttons, native flow, list and its rows."""

    def made(kind: str, text: Column, index: Column, **more: Column) -> Column:
        fields = {"id": F.lit(""), "url": F.lit(""), "phone_number": F.lit(""), "description": F.lit(""), "response_type": F.lit("")} | more
        return F.struct(F.lit(kind).alias("type"), text.alias("display_text"), *[c.alias(n) for n, c in fields.items()], index.cast("int").alias("index"))

    def hydrated(b: Column, i: Column) -> Column:
        at = F.coalesce(b["index"], i) + 1
        url, reply, call = b["urlButton"], b["quickReplyButton"], b["callButton"]
        return (
            F.when(url.isNotNull(), made("url", _trim(url["displayText"]), at, url=_trim(url["URL"]))).when(reply.isNotNull(), made("quick_reply", _trim(reply["displayText"]), at, id=_trim(reply["ID"]), response_type=F.lit("template_button_reply")))
            .when(call.isNotNull(), made("call", _trim(call["displayText"]), at, phone_number=_trim(call["phoneNumber"])))
        )

    def flow(b: Column, i: Column) -> Column:
        get = lambda name: _text(F.get_json_object(b["buttonParamsJSON"], f"$.{name}"))
        shown, name = get("display_text"), _trim(b["name"])
        return (
            F.when((name == "cta_url") & ((shown != "") | (get("url") != "")), made("url", _trim(shown), i + 1, url=_trim(get("url")))).when((name == "quick_reply") & (shown != ""), made("quick_reply", _trim(shown), i + 1, id=_trim(get("id")), response_type=F.lit("interactive_response")))
            .when((name == "cta_call") & (shown != ""), made("call", _trim(shown), i + 1, phone_number=_trim(get("phone_number"))))
        )

    none = F.array().cast(_BUTTON)
    some = lambda c: F.coalesce(F.filter(c.cast(_BUTTON), lambda b: b.isNotNull()), none)
    template = F.when(_hydrated(m).isNotNull(), F.transform(_hydrated(m)["hydratedButtons"], hydrated)).otherwise(F.transform(m["templateMessage"]["interactiveMessageTemplate"]["nativeFlowMessage"]["buttons"], flow))
    shown = lambda b: _trim(b["buttonText"]["displayText"])
    plain = F.transform(m["buttonsMessage"]["buttons"], lambda b, i: F.when(shown(b) != "", made("quick_reply", shown(b), i + 1, id=_trim(b["buttonID"]), response_type=F.lit("buttons_response"))))
    head = _trim(m["listMessage"]["buttonText"])
    rows = F.filter(F.flatten(F.transform(m["listMessage"]["sections"], lambda s: F.coalesce(s["rows"], F.array().cast("array<struct<title:string,rowID:string,description:string>>")))), lambda r: _trim(r["title"]) != "")
    listed = F.transform(rows, lambda r, i: made("list_row", _trim(r["title"]), i + 1, id=_trim(r["rowID"]), description=_trim(r["description"]), response_type=F.lit("list_response")))
    opener = F.when(head != "", F.array(made("list", head, F.lit(0))))
    return F.concat(some(template), some(plain), some(F.transform(m["interactiveMessage"]["nativeFlowMessage"]["buttons"], flow)), some(opener), some(listed))


def quoted_text(envelope: Column) -> Column:
    """How a quoted message is shown; envelope is its JSON."""
    inner = F.aggregate(
        F.sequence(F.lit(0), F.coalesce(F.regexp_count(envelope, F.lit('"message"')), F.lit(0))), envelope,
        lambda m, _: F.coalesce(F.get_json_object(m, "$.associatedChildMessage.message"), F.get_json_object(m, "$.groupStatusMentionMessage.message"), m),
    )
    return _let(F.from_json(inner, LEAF), _shown)


def _shown(m: Column) -> Column:
    sent = reduce(lambda w, x: w.when(m[x[0]].isNotNull(), x[1]), (("audioMessage", "Sent audio"), ("documentMessage", "Sent document"), ("stickerMessage", "Sent sticker"), ("locationMessage", "Sent location"), ("liveLocationMessage", "Sent live location")),
        F.when(m["groupInviteMessage"].isNotNull(), _invite_text(m)).when(m["imageMessage"].isNotNull(), "Sent image").when(m["videoMessage"].isNotNull(), F.when(m["videoMessage"]["gifPlayback"], "Sent gif").otherwise("Sent video")))
    poll = _poll(m)
    sent = (
        sent.when(m["contactMessage"].isNotNull() | m["contactsArrayMessage"].isNotNull(), _contact_text(m)).when(poll.isNotNull(), F.when(_trim(poll["name"]) != "", F.concat(F.lit("Poll: "), _trim(poll["name"]))).otherwise("Poll"))
        .when(m["pollUpdateMessage"].isNotNull(), "Poll vote").when(_asks_option(m), "Poll option added")
    )
    said = _first(_trim(m["conversation"]), _trim(m["extendedTextMessage"]["text"]), _trim(_hydrated(m)["hydratedContentText"]), _trim(m["buttonsMessage"]["contentText"]))
    rest = (
        F.when(m["buttonsResponseMessage"].isNotNull(), _text(m["buttonsResponseMessage"]["selectedDisplayText"])).when(m["interactiveMessage"].isNotNull(), _flow_text(m["interactiveMessage"])).when(_trim(m["listMessage"]["description"]) != "", _trim(m["listMessage"]["description"]))
        .when(m["listResponseMessage"].isNotNull(), _trim(m["listResponseMessage"]["title"])).otherwise(_text(m["templateButtonReplyMessage"]["selectedDisplayText"]))
    )
    return _trim(F.coalesce(sent, _first(said, rest)))


def quote(m: Column) -> Column:
    """The context of the first content that has a place for one: struct(id, sender, text, score, forwarded)."""
    context = F.get(F.filter(F.array(*[F.when(m[c].isNotNull(), F.struct(F.lit(c).alias("of"), m[c]["contextInfo"].alias("c"))) for c in CONTENTS]), lambda x: x.isNotNull()), F.lit(0))["c"]

    def read(c: Column) -> Column:
        score = F.coalesce(c["forwardingScore"], F.lit(0))
        return F.struct(
            F.nullif(_trim(c["stanzaID"]), F.lit("")).alias("id"), F.nullif(_trim(c["participant"]), F.lit("")).alias("sender"), F.when(c["quotedMessage"].isNotNull(), quoted_text(c["quotedMessage"])).alias("text"),
            score.alias("score"), (F.coalesce(c["isForwarded"], F.lit(False)) | (score > 0)).alias("forwarded"),
        )

    return _let(context, read)


def call_of(m: Column) -> Column:
    c = m["callLogMesssage"]
    who = F.transform(F.filter(c["participants"], lambda p: _trim(p["JID"]) != ""), lambda p: F.struct(_trim(p["JID"]).alias("jid"), enum_word(_text(p["callOutcome"])).alias("outcome")))
    return F.when(c.isNotNull(), F.struct(F.when(c["isVideo"], "video").otherwise("audio").alias("media"), enum_word(_text(c["callOutcome"])).alias("outcome"), enum_word(_text(c["callType"])).alias("call_type"), F.coalesce(c["durationSecs"], F.lit(0)).alias("duration_secs"), who.alias("participants")))


# Messages


_columns: dict[object, dict] = {}


def _built() -> dict:
    """The columns of ``parsed``, over names that are always the same. They are thousands of calls to the JVM, so they are made once for each."""
    jvm = SparkContext._gateway
    if jvm not in _columns:
        _columns.clear()
        m, w = F.col("__m"), F.col("__w")
        texts = content_texts(m)
        q, poll, update, add, secret = F.col("__q"), _poll(m), m["pollUpdateMessage"], m["pollAddOptionMessage"], m["secretEncryptedMessage"]
        ref = lambda k: [_trim(k[c]).alias(n) for c, n in (("ID", "poll_msg_id"), ("remoteJID", "poll_chat_jid"), ("participant", "poll_sender_jid"))]
        option = F.when(add.isNotNull(), F.struct(*ref(add["pollCreationMessageKey"]), _trim(add["addOption"]["optionName"]).alias("option"))).when(F.coalesce(secret["secretEncType"] == "POLL_ADD_OPTION", F.lit(False)), F.struct(*ref(secret["targetMessageKey"]), F.lit("").alias("option")))
        named = w["comment_id"].isNotNull()
        other = named & ~F.coalesce(q["id"] == w["comment_id"], F.lit(False))
        ids = [
            F.coalesce(w["chat"], F.col("chat_jid")).alias("chat_jid"), F.coalesce(w["id"], F.col("msg_id")).alias("msg_id"), F.coalesce(w["sender"], F.col("sender_jid")).alias("sender_jid"), F.coalesce(w["from_me"], F.col("from_me"), F.lit(False)).alias("from_me"),
        ]
        contents = [
            F.when(w["revoked"], "").otherwise(F.col("text")).alias("text"), media(m, F.col("__said")).alias("media"), location(m).alias("location"), buttons(m).alias("buttons"),
            F.when(poll.isNotNull(), F.struct(_trim(poll["name"]).alias("question"), F.coalesce(F.transform(poll["options"], lambda o: _text(o["optionName"])), F.array().cast("array<string>")).alias("options"), F.coalesce(poll["selectableOptionsCount"], F.lit(0)).alias("selectable_count"))).alias("poll"),
            F.when(update.isNotNull(), F.struct(*ref(update["pollCreationMessageKey"]), F.coalesce(update["senderTimestampMS"], F.lit(0)).alias("sender_ts_ms"))).alias("poll_vote"), option.alias("poll_option"),
            call_of(m).alias("call"), _text(F.coalesce(m["reactionMessage"]["key"]["ID"], F.when(m["reactionMessage"].isNull(), m["encReactionMessage"]["targetMessageKey"]["ID"]))).alias("reaction_to_id"), _text(m["reactionMessage"]["text"]).alias("reaction_emoji"),
            _text(F.coalesce(w["comment_id"], q["id"])).alias("reply_to_id"), _text(F.when(named, F.coalesce(w["comment_sender"], F.when(~other, q["sender"]))).otherwise(q["sender"])).alias("reply_to_sender"), _text(F.when(~other, q["text"])).alias("reply_to_display"),
            F.coalesce(q["forwarded"], F.lit(False)).alias("is_forwarded"), F.coalesce(q["score"], F.lit(0)).alias("forwarding_score"), w["edited"].alias("edited"), w["revoked"].alias("revoked"), w["message"].alias("__leaf"),
        ]
        has = (_trim(F.col("text")) != "") | F.col("revoked") | (F.size("buttons") > 0) | (_trim(F.col("reaction_to_id")) != "") | (_trim(F.col("reaction_emoji")) != "")
        for c in ("media", "poll", "poll_vote", "poll_option", "call", "location"):
            has = has | F.col(c).isNotNull()
        left = F.array_join(F.array_sort(F.filter(F.json_object_keys("__leaf"), lambda k: k != "messageContextInfo")), ",")
        _columns[jvm] = {
            "unwrapped": unwrapped(F.col("message")).alias("__w"), "leaf": F.when(~F.col("__w.revoked"), F.from_json("__w.message", LEAF)).alias("__m"), "first": [_text(texts["text"]).alias("text"), texts["caption"].alias("__said"), quote(m).alias("__q")],
            "ids": ids, "contents": contents, "unhandled": F.when(has, "").otherwise(_text(left)),
        }
    return _columns[jvm]


def parsed(df: DataFrame) -> DataFrame:
    """df with the fields of its envelopes (column message, JSON). chat, id, sender and from_me are those of the row (chat_jid, msg_id, sender_jid,
    from_me) unless a wrapper names others. unhandled: the fields of an envelope of which nothing could be read."""
    keep, made = [c for c in df.columns if c != "message"], _built()
    rows = df.select(*keep, made["unwrapped"]).select(*keep, "__w", made["leaf"]).select(*keep, "__w", "__m", *made["first"])
    rest = [c for c in keep if c not in ("chat_jid", "msg_id", "sender_jid", "from_me", "starred")]
    out = rows.select(*rest, *made["ids"], *([F.col("starred")] if "starred" in keep else []), *made["contents"])
    return out.withColumn("unhandled", made["unhandled"]).drop("__leaf")


def live(df: DataFrame) -> DataFrame:
    """Messages as they came: chat_jid, msg_id, sender_jid, from_me, ts (seconds), push_name, device_sent_to (the chat of a copy from another own device), message."""
    to = F.nullif(_trim(F.col("device_sent_to")), F.lit(""))
    rest = df.withColumns({"chat_jid": F.coalesce(to, F.col("chat_jid")), "from_me": F.col("device_sent_to").isNotNull() | F.col("from_me"), "sender_jid": _text(F.col("sender_jid")), "ingest_source": F.lit("live")}).drop("device_sent_to")
    return parsed(rest)


HISTORY = f"struct<key:{_KEY},participant:string,messageTimestamp:bigint,starred:boolean,message:string>"


def history(df: DataFrame) -> DataFrame:
    """Messages of a history: chat_jid and info, the JSON of one with its key. The sender is its participant, else its key's, else the key's chat. starred is null if unknown."""
    info = F.from_json("info", HISTORY)
    rest = df.select(*[c for c in df.columns if c != "info"], info.alias("__i"))
    k = F.col("__i.key")
    rest = rest.select(
        *[c for c in df.columns if c != "info"], _text(k["ID"]).alias("msg_id"), _first(_trim(F.col("__i.participant")), _trim(k["participant"]), _trim(k["remoteJID"])).alias("sender_jid"), F.coalesce(k["fromMe"], F.lit(False)).alias("from_me"),
        F.coalesce("__i.messageTimestamp", F.lit(0)).cast("bigint").alias("ts"), F.col("__i.starred").alias("starred"), F.lit("history").alias("ingest_source"), F.col("__i.message").alias("message"),
    )
    return parsed(rest)


def history_batch(batches: DataFrame) -> DataFrame:
    """Batches of conversations: conversations array<struct<id, unread_count, marked_unread, messages: array<JSON of infos>>>, to (chat_jid, place, info) of each message in order.
    Conversations without an id and messages that are null are left out, as they name nothing."""
    each = batches.select(F.explode("conversations").alias("c")).select(F.trim("c.id").alias("chat_jid"), "c.messages").filter("chat_jid <> ''")
    return each.select("chat_jid", F.posexplode("messages").alias("place", "info")).filter("info IS NOT NULL")


def decoded(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Message events of the log (source, chat_jid, msg_id, sender_jid, from_me, event_ts, raw) parsed again from their bytes; the source says how. Events
    without bytes (scrubbed, or snapshots) can't be decoded: error says so, and their fields are empty. keep: other columns that stay."""
    made = events.withColumn("__text", F.col("raw").cast("string"))
    old = F.col("source").isin("history", "on_demand_history")
    info = F.from_json(F.when(old, F.col("__text")), HISTORY)
    k = info["key"]
    rows = made.select(
        *keep, "source", "chat_jid", F.when(old, _text(k["ID"])).otherwise(F.col("msg_id")).alias("msg_id"), F.when(old, _first(_trim(info["participant"]), _trim(k["participant"]), _trim(k["remoteJID"]))).otherwise(_text(F.col("sender_jid"))).alias("sender_jid"),
        F.when(old, F.coalesce(k["fromMe"], F.lit(False))).otherwise(F.col("from_me")).alias("from_me"), F.when(old, F.coalesce(info["messageTimestamp"], F.lit(0))).otherwise(F.col("event_ts")).alias("ts"),
        F.when(F.coalesce(F.length("__text"), F.lit(0)) == 0, "no bytes").alias("error"), F.when(old, info["message"]).otherwise(F.col("__text")).alias("message"),
    )
    return parsed(rows)
