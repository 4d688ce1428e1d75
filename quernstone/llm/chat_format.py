r"""Chat formatting: conversations of typed content parts become one marked-up string each.

A turn is ``### role: text</turn>`` and a newline. In roles and texts ``\``, ``#``, ``<``, and in roles also ``:``, are
written ``\\``, ``\h``, ``\l`` and ``\c``: no marker can occur inside, and reading back gives the text exactly.

Parts are visited in order. Text stands as it is. An image, audio or document part becomes a placeholder
``<image 1>``, numbered within its conversation; what it refers to is recorded under that placeholder, and the tokens
it will be expanded to are counted: an image a token for each patch of 14 x 14 pixels begun, audio 25 a second begun, a
document 600 a page; text counts its words. A part of another type stands as its text.

The loss mask is a list of (start, length) in code points, one for each turn of an assistant, over its text alone.

Turns go by number; those of one number by role, then text. A null text or part list is empty, a null role too. Rows of
a null id form a conversation of their own. A conversation is one string, so its turns meet in one row;
conversations are spread by id. Only built-in expressions are used. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
KINDS = ("image", "audio", "document")
#: Code points of the blocks in which a span is looked up.
BLOCK = 4096
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 600
#: Written by this module's own parts, where a text can't have it: a bare "<".
PLACE_OPEN, PLACE_CLOSE = "<", ">"
WORD = r"[^\x20\x09-\x0D]+"
PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Backslash pairs go first, into "#", which stands nowhere else in an escaped text."""
    rest = F.replace(F.replace(text, F.lit("\\\\"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.array_join(F.transform(F.split(rest, "\\\\h"), lambda x: F.replace(x, F.lit("#"), F.lit("\\"))), "#")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def _unescape_role(role: Column) -> Column:
    """As unescape, with colons parted off first behind the pairs."""
    rest = F.replace(F.replace(role, F.lit("\\\\"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    rest = F.replace(rest, F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(rest, "\\\\h"), lambda x: F.replace(x, F.lit("#"), F.lit("\\"))), "#")


def text_part(text: Column) -> Column:
    """A list of one text part."""
    null = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("uri"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"))
    return F.array(part).cast(PARTS)


def _tokens(p: Column) -> Column:
    side = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)) / PATCH)
    return (
        F.when(p["type"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["type"] == "audio", F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0))) * AUDIO_RATE)
        .when(p["type"] == "document", F.greatest(F.coalesce(p["pages"], F.lit(0)), F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.coalesce(F.regexp_count(p["text"], F.lit(WORD)), F.lit(0)))
        .cast("bigint")
    )


def _is_file(p: Column) -> Column:
    return F.coalesce(p["type"].isin(*KINDS), F.lit(False))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """turns: a row a turn, parts_col of type PARTS. Per conversation: conv_id, formatted, loss_spans, attachments, tokens, n_turns.

    Turns are written row by row; what depends on the turns before (numbers of files, offsets) are running sums over
    the conversation, so that the work grows in proportion to a conversation's length."""
    rows = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[parts_col], F.array().cast(PARTS)).alias("parts"))
    within = Window.partitionBy("conv_id")
    ordered = within.orderBy("turn", "role", "parts")
    ahead = ordered.rowsBetween(Window.unboundedPreceding, -1)
    files = F.size(F.filter("parts", _is_file))
    rows = rows.withColumns({"number": F.row_number().over(ordered), "before": F.coalesce(F.sum(files).over(ahead), F.lit(0))})

    # The visitor: each part becomes text or a placeholder that carries the number of files before it.
    def visit(acc: Column, p: Column) -> Column:
        mark = F.concat(F.lit(PLACE_OPEN), p["type"], F.lit(" "), (acc["n"] + 1).cast("string"), F.lit(PLACE_CLOSE))
        return F.struct(F.concat(acc["s"], F.when(_is_file(p), mark).otherwise(escape(p["text"]))).alias("s"), (acc["n"] + _is_file(p).cast("bigint")).alias("n"))

    body = F.aggregate("parts", F.struct(F.lit("").alias("s"), F.col("before").alias("n")), visit)["s"]
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit(MIDDLE))
    record = lambda p, k: F.struct(F.concat(F.lit(PLACE_OPEN), p["type"], F.lit(" "), (F.col("before") + k + 1).cast("string"), F.lit(PLACE_CLOSE)).alias("placeholder"), p["type"].alias("type"), p["uri"].alias("uri"), _tokens(p).alias("tokens"))
    written = rows.select(
        "conv_id", "number", head.alias("head"), body.alias("body"), (F.lower("role") == "assistant").alias("loss"), F.transform(F.filter("parts", _is_file), record).alias("files"),
        F.aggregate(F.transform("parts", _tokens), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens"),
    )
    size = F.length("head") + F.length("body") + len(CLOSE)
    upto = within.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(upto), F.lit(0)) + F.length("head")
    placed = written.select("conv_id", "tokens", F.struct("number", F.concat("head", "body", F.lit(CLOSE)).alias("text"), start.alias("start"), F.length("body").cast("bigint").alias("length"), "loss", "files").alias("piece"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_turns"))
    spans = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"), F.flatten(F.transform("pieces", lambda p: p["files"])).alias("attachments"), "tokens", "n_turns")


def read_back(chats: DataFrame) -> DataFrame:
    """chats with turns (role, text), read from formatted alone; placeholders stay as they are written."""
    parts = F.split(F.col("formatted"), CLOSE)
    # Each turn ends with the marker, so that the last part is empty.
    bodies = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(s: Column) -> Column:
        at = F.instr(s, MIDDLE)
        return F.struct(_unescape_role(F.substring(s, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))).alias("role"), unescape(F.substring(s, at + len(MIDDLE), F.length(s))).alias("text"))

    return chats.withColumn("turns", F.transform(bodies, turn))


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation, from formatted and loss_spans alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; then tokens, n_attachments."""
    back = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # A span is read from the blocks that it touches, not from the start of the conversation. The list of blocks is
    # named twice, lest the optimiser put its making inside the function over spans.
    back = back.withColumn("blocks", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))

    def cut(s: Column) -> Column:
        first, inner = F.floor(s["start"] / BLOCK).cast("int"), (s["start"] % BLOCK).cast("int")
        n = F.least(F.floor((inner + s["length"]) / BLOCK).cast("int") + 1, F.size("blocks") - first)
        return unescape(F.substring(F.array_join(F.slice("blocks", first + 1, n), ""), inner + 1, s["length"].cast("int")))

    back = back.withColumn("loss", F.array_join(F.transform("loss_spans", cut), ""))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "tokens", F.size("attachments").cast("bigint").alias("n_attachments"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l')) + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c')) + 14 AS chars,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens
  FROM turns),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, encode(role), encode(text)) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, encode(role), encode(text)) FILTER (WHERE lower(role) = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars, sum(tokens)::BIGINT AS tokens
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, tokens, 0::BIGINT AS n_attachments FROM joined
"""
