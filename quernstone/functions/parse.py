"""Parsing of pages, addresses, contact cards and nested messages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"https?://[^\s<>\"'`]+"


# Pages


class _Head(HTMLParser):
    """Title, description and image: the first that isn't blank, in the order of the page; a title element only if nothing stands yet."""

    # Names of meta properties and the field they fill.
    FIELDS = {
        "og:title": "title", "twitter:title": "title", "og:description": "description", "twitter:description": "description", "description": "description",
        "og:image": "image", "og:image:url": "image", "twitter:image": "image", "twitter:image:src": "image",
    }

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found = {"title": "", "description": "", "image": ""}
        self.title: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "title":
            self.title = []
        elif tag == "meta":
            own = {}
            for k, v in attrs:
                own.setdefault(k.lower(), v or "")
            field = self.FIELDS.get((own.get("property") or own.get("name") or "").lower())
            text = " ".join(own.get("content", "").split())
            if field and text and not self.found[field]:
                self.found[field] = text

    def handle_data(self, data: str) -> None:
        if self.title is not None:
            self.title.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self.title is not None:
            if not self.found["title"]:
                self.found["title"] = " ".join("".join(self.title).split())
            self.title = None


def page_metadata(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """pages with title, description and image, in Arrow batches. Every page is kept and read whole; without html all three are empty."""
    keep = [c for c in pages.columns if c not in (html_col, "title", "description", "image")]
    narrow = pages.select(*keep, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for text in rows["__html"]:
                head = _Head()
                head.feed(text or "")
                head.close()
                head.handle_endtag("title")
                found.append(head.found)
            more = pd.DataFrame(found, columns=["title", "description", "image"], index=rows.index)
            yield pd.concat([rows.drop(columns="__html"), more], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInPandas(run, (ddl + ", " if ddl else "") + "title string, description string, image string")


def first_url(text: Column) -> Column:
    """The first http address with a host, without closing punctuation and closing brackets that nothing opens. Null if none.

    Brackets are balanced from the end, however many stand there."""

    def cut(u: Column) -> Column:
        out = u
        for a, b in ("()", "[]", "{}"):
            opens, closes = (F.length(u) - F.length(F.replace(u, F.lit(x))) for x in (a, b))
            out = F.when(u.endswith(b) & (opens < closes), F.substring(u, F.lit(1), F.length(u) - 1)).otherwise(out)
        return out

    def trimmed(u: Column) -> Column:
        # A fold, not a chain: each step reads the last one's value once. It has a step for each bracket at the end.
        bare = F.regexp_replace(u, "[.,!?;:]+$", "")
        n = F.length(F.regexp_extract(bare, r"[)\]}]+$", 0))
        return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), bare, lambda x, _: cut(x))

    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({URL})"), 1), trimmed)
    return F.get(F.filter(found, lambda u: u.rlike("^https?://[^/?#]")), F.lit(0))


# Contact cards


def _unescaped(v: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(F.replace(v, F.lit("\\\\"), F.lit("\x00")), r"\\[nN]", "\n"), r"\\([,;])", "$1"), F.lit("\x00"), F.lit("\\"))


def card(text: Column, display_name: Column | None = None) -> Column:
    """A vCard as struct(name, phones): folded lines joined, FN and TEL unescaped, phones once each. A given display name comes before FN."""
    flat = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n+[ \t]+", "")
    lines = F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.upper(F.trim(F.split_part(F.split_part(x, F.lit(":"), F.lit(1)), F.lit(";"), F.lit(1)))).alias("k"), _unescaped(F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))).alias("v")))
    of = lambda k: F.transform(F.filter(pairs, lambda p: (p["k"] == k) & (p["v"] != "")), lambda p: p["v"])
    given = F.lit(None).cast("string") if display_name is None else F.nullif(F.trim(display_name), F.lit(""))
    return F.struct(F.coalesce(given, F.get(of("FN"), F.lit(0)), F.lit("")).alias("name"), F.array_distinct(of("TEL")).alias("phones"))


def card_text(c: Column) -> Column:
    """``Contact: name (phones)`` of a card; empty if it has neither."""
    phones = F.array_join(c["phones"], ", ")
    return F.when((c["name"] != "") & (F.size(c["phones"]) > 0), F.concat(F.lit("Contact: "), c["name"], F.lit(" ("), phones, F.lit(")"))).when(c["name"] != "", F.concat(F.lit("Contact: "), c["name"])).when(F.size(c["phones"]) > 0, F.concat(F.lit("Contact: "), phones)).otherwise("")


# Nested messages


def unwrapped(message: Column, wrappers: tuple[str, ...]) -> Column:
    """The innermost message: a struct may hold one of its own kind under any of the wrapper fields. message is JSON text, read as often as it names a wrapper."""

    def inner(m: Column) -> Column:
        return F.coalesce(*[F.get_json_object(m, f"$.{w}.message") for w in wrappers], *[F.get_json_object(m, f"$.{w}") for w in wrappers], m)

    n = F.coalesce(F.regexp_count(message, F.lit('"(?:' + "|".join(wrappers) + ')"')), F.lit(0))
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), message, lambda m, _: inner(m))


def interactive_text(header: Column, body: Column, footer: Column) -> Column:
    """Header, body and the footer in brackets, one a line, without blanks."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n", some(header), some(body), F.concat(F.lit("["), some(footer), F.lit("]")))


def unhandled(fields: dict[str, Column]) -> Column:
    """Names of the fields that hold something, sorted: what a parser left."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in fields.items()]))), ",")


def call_outcome(outcome: Column) -> Column:
    """A call's outcome as one word; what counts as missed is missed."""
    word = F.translate(F.lower(F.trim(outcome)), "- ", "__")
    return F.when(word.isin("missed", "timeout", "no_answer", "noanswer"), "missed").otherwise(word)
