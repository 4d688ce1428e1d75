"""Scalar expressions: codecs of absent values, times, phones, ids, names and display texts.

All are Column to Column, evaluated by Spark alone. "Blank" means null or only white space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode calls white space, as a trimming pattern.
_EDGES = r"^[\s\u0085\u00A0\u2000-\u200A\u2028\u2029\u3000]+|[\s\u0085\u00A0\u2000-\u200A\u2028\u2029\u3000]+$"


def tidy(c: Column) -> Column:
    """Trimmed of white space of any kind."""
    return F.regexp_replace(c, _EDGES, "")


def stored(c: Column) -> Column:
    """The stored form of a key or text: trimmed, blank becomes null."""
    return F.nullif(tidy(c), F.lit(""))


def shown(c: Column, default: str | int = "") -> Column:
    """The output form: null becomes the default."""
    return F.coalesce(c, F.lit(default))


def filled(*columns: Column) -> Column:
    """The first that isn't blank, trimmed; null if all are."""
    return F.coalesce(*[stored(c) for c in columns])


# Times


def to_seconds(ts: Column) -> Column:
    """Whole seconds of a timestamp; null becomes 0."""
    return F.coalesce(F.unix_seconds(ts.cast("timestamp")), F.lit(0).cast("bigint"))


def from_seconds(seconds: Column) -> Column:
    """A timestamp; 0, less and null are absent."""
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def wall_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def epoch_of_any_unit(n: Column) -> Column:
    """Microseconds since 1970 of a number in seconds (below 1e11), milliseconds (below 1e14) or microseconds; null if not positive."""
    return F.when(n <= 0, None).when(n < 100_000_000_000, n * 1_000_000).when(n < 100_000_000_000_000, n * 1000).otherwise(n)


def parse_instant(text: Column) -> Column:
    """Seconds of YYYY-MM-DD (midnight UTC) or an RFC 3339 time; null if neither."""
    text = tidy(text)
    rfc = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(F.upper(text)))
    day = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))
    return F.unix_seconds(F.coalesce(rfc, day))


def mute_end(muted: Column, seconds: Column, now: Column) -> Column:
    """The stored end of a mute: 0 is off, -1 forever (no positive length), else that many seconds from now."""
    return F.when(~muted, 0).when(seconds <= 0, -1).otherwise(now + seconds).cast("bigint")


def is_muted(until: Column, now: Column) -> Column:
    return (until == -1) | (until > now)


def is_unmuted(until: Column, now: Column) -> Column:
    """Not the negation: values below -1 are neither."""
    return (until == 0) | ((until > 0) & (until <= now))


def duration(seconds: Column) -> Column:
    """45s, 2m, 2m05s; empty if not positive."""
    minutes, rest = F.floor(seconds / 60).cast("bigint"), seconds % 60
    return (
        F.when(seconds.isNull() | (seconds <= 0), "").when(minutes == 0, F.concat(rest.cast("string"), F.lit("s")))
        .when(rest == 0, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m"), F.lpad(rest.cast("string"), 2, "0"), F.lit("s")))
    )


# Names


def contact_name(alias: Column, system: Column, full: Column, push: Column, business: Column, first: Column) -> Column:
    """The name a contact is listed under."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (alias, system, full, push, business, first)])


def sender_name(full: Column, first: Column, business: Column, push: Column, given: Column, jid: Column) -> Column:
    """The name a message is shown under: another order, and a push name of "-" is none."""
    real = lambda c: F.nullif(stored(c), F.lit("-"))
    return F.coalesce(stored(full), stored(first), stored(business), real(push), real(given), jid)


# Phones and ids


def looks_like_phone(text: Column) -> Column:
    """Digits, perhaps behind one plus, with blanks, dashes, brackets and dots among them."""
    return F.coalesce(tidy(text).rlike(r"^\+?[0-9 ().-]*$") & text.rlike("[0-9]"), F.lit(False))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def phone_key(text: Column) -> Column:
    """Digits without the international prefix 00."""
    return F.regexp_replace(digits(text), "^00", "")


def valid_phone(text: Column) -> Column:
    """Digits, if there are 7 to 15 of them."""
    d = digits(text)
    return F.when(F.length(d).between(7, 15), d)


#: Servers of ids and the kinds of chat they stand for.
SERVER_KINDS = {"g.us": "group", "newsletter": "newsletter", "broadcast": "broadcast", "s.whatsapp.net": "dm"}
USER_SERVERS = ("s.whatsapp.net", "lid")


def server(jid: Column) -> Column:
    return F.split_part(jid, F.lit("@"), F.lit(2))


def user(jid: Column) -> Column:
    return F.split_part(jid, F.lit("@"), F.lit(1))


def chat_kind(jid: Column) -> Column:
    return reduce(lambda c, kv: c.when(server(jid) == kv[0], kv[1]), list(SERVER_KINDS.items())[1:], F.when(server(jid) == "g.us", "group")).otherwise("unknown")


def bare_jid(jid: Column) -> Column:
    """Without the device behind the user, for servers of users."""
    return F.when(server(jid).isin(*USER_SERVERS), F.concat(F.regexp_replace(user(jid), "[:.][0-9:.]*$", ""), F.lit("@"), server(jid))).otherwise(jid)


def enum_word(text: Column) -> Column:
    """Lower-case, dashes and blanks as underscores."""
    return F.translate(F.lower(tidy(text)), "- ", "__")


# Display


def media_label(kind: Column) -> Column:
    k = F.lower(tidy(F.coalesce(kind, F.lit(""))))
    return F.when(k == "", "message").when(k == "live_location", "live location").otherwise(k)


def call_text(media: Column, outcome: Column, event: Column, seconds: Column, service: str = "") -> Column:
    """``service media call outcome (2m05s)``, without what is blank; the event stands in for the outcome unless it is a log entry."""
    result = F.coalesce(F.nullif(outcome, F.lit("")), F.when(event != "call_log", F.nullif(event, F.lit(""))))
    length = F.when(seconds > 0, F.concat(F.lit("("), duration(seconds), F.lit(")")))
    return F.concat_ws(" ", F.nullif(F.lit(service), F.lit("")), F.nullif(media, F.lit("")), F.lit("call"), result, length)


def base_text(text: Column, media: Column, call: Column | None = None) -> Column:
    """A call's text, else the label of its media, else its words, trimmed; empty if none."""
    own = F.when(stored(media).isNotNull(), F.concat(F.lit("Sent "), media_label(media))).otherwise(F.coalesce(stored(text), F.lit("")))
    return own if call is None else F.coalesce(call, own)


def target_text(display: Column, text: Column, media: Column) -> Column:
    """How a message is quoted by others; null if it has nothing to show."""
    return F.coalesce(stored(display), stored(text), F.when(stored(media).isNotNull(), F.concat(F.lit("Sent "), media_label(media))))


def display_text(base: Column, reaction_to: Column, emoji: Column, reaction_target: Column, reply_to: Column, quoted: Column) -> Column:
    """A reaction, else a reply over its quotation, else the base text; "(message)" if that is empty."""
    own = F.coalesce(F.nullif(base, F.lit("")), F.lit("(message)"))
    reacted = F.concat(F.lit("Reacted "), F.coalesce(F.concat(stored(emoji), F.lit(" ")), F.lit("")), F.lit("to "), F.coalesce(reaction_target, F.lit("message")))
    is_reaction = (F.coalesce(reaction_to, F.lit("")) != "") | stored(emoji).isNotNull()
    return F.when(is_reaction, reacted).when(F.coalesce(reply_to, F.lit("")) != "", F.concat(F.lit("> "), F.coalesce(stored(quoted), F.lit("message")), F.lit("\n"), own)).otherwise(own)


DELETED_FOR_ME, REVOKED = "This message was deleted for me", "This message was deleted"


def line_text(deleted_for_me: Column, revoked: Column, display: Column, text: Column, media: Column) -> Column:
    """What a listing prints for a message."""
    return F.when(deleted_for_me, DELETED_FOR_ME).when(revoked, REVOKED).otherwise(F.coalesce(stored(display), stored(text), F.when(stored(media).isNotNull(), F.concat(F.lit("Sent "), media_label(media))), F.lit("")))


def deletion(deleted_for_me: Column, revoked: Column, explicit: Column) -> Column:
    """The reason of a deletion; null if there is none."""
    return F.when(deleted_for_me, "delete-for-me").when(revoked, "revoke").otherwise(F.nullif(explicit, F.lit("")))


def deletion_time(deleted: Column, deleted_at: Column, ts: Column, now: Column) -> Column:
    positive = lambda c: F.when(c > 0, c)
    return F.when(deleted, F.coalesce(positive(deleted_at), positive(ts), now))


# Cleaning


_ESCAPES = "\x1b(?:\\[[^\x40-\x7e]*(?:[\x40-\x7e]|$)|\\][^\x07\x1b]*(?:\x07|\x1b\\\\|\x1b|$)|[^\\[\\]]|$)"


def clean_line(text: Column) -> Column:
    """One line for a terminal: escape sequences and runs of control characters become one blank; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, _ESCAPES, "\x00"), "[\\x00-\\x1f\\x7f-\\x9f]+", " "))


def clean_body(text: Column) -> Column:
    """Several lines for a terminal: newlines and tabs stay, other controls and escape sequences go."""
    return F.regexp_replace(F.regexp_replace(text, _ESCAPES, ""), "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]", "")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def path_segment(text: Column, empty: str = "unknown") -> Column:
    """A safe part of a path."""
    s = F.trim(F.regexp_replace(text, "[\\x00-\\x1f\\x7f-\\x9f]", ""))
    safe = F.replace(F.translate(s, '/\\:*?"<>| ', "__________"), F.lit(".."), F.lit("_"))
    return F.when(F.coalesce(s, F.lit("")) == "", empty).when(safe == ".", empty).otherwise(safe)


def file_name(text: Column) -> Column:
    return path_segment(text, "file")


def valid_coordinates(lat: Column, lng: Column) -> Column:
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


# Keys of events


def json_escaped(json: Column) -> Column:
    """Angle brackets and ampersands as \\u escapes, as some JSON writers put them."""
    return F.replace(F.replace(F.replace(json, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


def message_key(chat: Column, from_me: Column, msg_id: Column, participant: Column) -> Column:
    """Canonical JSON of a message's identity; a blank participant is left out."""
    return json_escaped(F.to_json(F.struct(F.coalesce(chat, F.lit("")).alias("chat"), F.coalesce(from_me, F.lit(False)).alias("from_me"), F.coalesce(msg_id, F.lit("")).alias("id"), F.nullif(participant, F.lit("")).alias("participant"))))


def dedup_key(scope: str, *parts: Column) -> Column:
    return F.concat(F.lit("dd:"), json_escaped(F.to_json(F.struct(F.lit(scope).alias("scope"), F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("parts")))))


def raw_hash(raw: Column) -> Column:
    return F.sha2(raw.cast("binary"), 256)


def event_id(dedup: Column, raw_sha256: Column) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat(dedup, F.lit("\n"), raw_sha256), 256), 1, 32))


# Lists in JSON


def string_list(json: Column) -> Column:
    """An array of strings; null if the text is no array."""
    return F.from_json(json, "array<string>")


def vote_selection(json: Column) -> Column:
    """A vote's selection: a bare array, or an object with selected and unknown_hashes."""
    both = F.from_json(json, "struct<selected:array<string>,unknown_hashes:array<string>>")
    none = F.array().cast("array<string>")
    bare = F.when(F.ltrim(json).startswith("["), string_list(json))
    return F.struct(F.coalesce(bare, both["selected"], none).alias("selected"), F.coalesce(F.when(bare.isNull(), both["unknown_hashes"]), none).alias("unknown_hashes"))


def match_hashes(options: Column, hashes: Column) -> Column:
    """Options whose SHA-256 is among the hashes, and the hashes that no option has."""
    own = F.transform(options, lambda o: F.sha2(o, 256))
    return F.struct(F.filter(options, lambda o: F.array_contains(hashes, F.sha2(o, 256))).alias("selected"), F.filter(hashes, lambda h: ~F.array_contains(own, h)).alias("unknown_hashes"))


# Matching


def match_score(query: str, *fields: Column) -> Column:
    """100 for a whole match, 60 for the beginning, 30 for the beginning of a word, 10 inside; the best of the fields, 0 if none."""
    q = query.strip().lower()
    if not q:
        return F.lit(0)

    def one(c: Column) -> Column:
        h = F.lower(tidy(F.coalesce(c, F.lit(""))))
        word = F.exists(F.split(h, r"\s+"), lambda w: F.startswith(w, F.lit(q)))
        return F.when(h == "", 0).when(h == q, 100).when(F.startswith(h, F.lit(q)), 60).when(word, 30).when(F.contains(h, F.lit(q)), 10).otherwise(0)

    scores = [one(c) for c in fields]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def contains_any(query: str, *columns: Column) -> Column:
    """Case-insensitive substring in any column; % and _ are ordinary characters."""
    q = F.lit(query.lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), q), F.lit(False)) for c in columns])
