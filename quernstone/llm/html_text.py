"""Main text of web pages by a maximum-scoring subsequence over words and tags.

A page is read as a sequence of tags and text. Elements that by their kind are never content (menus, page headers,
footers, sidebars, scripts, styles, by name, role or being hidden) count as nothing, with all they hold; so do forms,
unless they hold nearly all the page's words (a page that is one form). Each word
scores above zero and each tag below; one linear scan finds the contiguous stretch of the highest sum. Its text, without
the elements left out, is the result.

Names that authors give to elements (class and id) only weigh. A name's parts have learned odds of content; an
element leans by the mean of its names' log odds, text-level elements a little towards content. One that leans away is left
out if what would remain of the page has more words than its own times the odds: a page of nothing but a
``message`` keeps it, beside an article it goes.

Weights come from labelled pages: those with an ``article`` or ``main`` element, whose words and tags inside
are content and outside are not. At most ``LABELLED`` pages are used, those least by a hash of their id. A
word or tag is counted by where it stands (inside such an element, outside one on a page that has one, on a
page without) and by whether it is in a link. A name counts as content where its element holds most of an article and
little else, as not where it stands outside; short elements within an article say nothing, since adverts stand there too.
Without labelled pages the weights rest on the priors alone.

A block element or a line break ends a block. Character references are decoded, white space inside a block
becomes one space, empty blocks go, blocks are joined by a newline. Null and empty pages have an empty text.
Unclosed and stray tags are allowed; an element that is never closed ends with its parent, and one that
holds an article is never left out. Rows are handled one by one: repeats and ties need nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.store import durable, small_batches

LABELLED = 400

# Element names and words of class, id and role attributes.
RAW = frozenset("script style title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "applet aside audio button canvas datalist dialog footer head iframe input label map menu nav noscript object option optgroup script select style svg template textarea "
    "title video xmp noembed noframes".split()
)
# Never content beside a text, but some pages are one form from their first word to their last.
FORMS = frozenset(("form", "fieldset"))
AWAY = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial affiliate alert announcement author bio banner breadcrumb breadcrumbs captcha comment comments "
    "consent cookie cookies copyright dialog disclaimer discussion disqus donate dropdown flash footer gdpr hamburger header legal login logo masthead menu message meta modal nav navbar "
    "navigation newsletter notice notification pager paginate pagination paywall popover popup privacy promo promos promoted promotion rail reactions recirc recommend recommendations recommended register related "
    "replies reply responses search share sharing sidebar sidenav signup skip skiplink social sponsor sponsored sponsors subscribe subscription syndication tags teaser toast toc toolbar topbar "
    "trackback trending warning widget widgets".split()
)
# Names that lean away only as a whole: their parts also stand in names of layout (overflow-hidden).
WHOLE = frozenset(("hidden", "visually-hidden", "visuallyhidden"))
# Names of the comments of readers, which may well be longer than the article.
FAR = frozenset("comment comments discussion disqus replies responses".split())
TOWARDS = frozenset("article articlebody body content copy entry main post prose story text".split())
# Names of layout and state, which say nothing.
NEUTRAL = frozenset(
    "area active block bottom box card col column columns container desktop first full grid group has inline inner is item items large last layout left lg list loaded md middle mobile module no node "
    "odd even open outer page panel placeholder posts right row section site slot sm small the top unit view visible wide with without wrap wrapper".split()
)
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
CONTENT = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body"))
# What a new element of the first kind closes, if open.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
TEXT_TAGS = frozenset(
    "abbr b blockquote br caption cite code dd del dfn dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q s samp small span strong sub sup table tbody td th thead time tr u ul var".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

INSIDE, OUTSIDE, NONE = 0, 1, 2
#: Strength of the priors, in counts; least cost of a tag and gain of a word; costs and gains span these.
STRENGTH, TAG_LEAST, TAG_SPAN, WORD_LEAST, WORD_SPAN = 4.0, 0.01, 2.0, 0.001, 1.0
#: Prior shares of content by place, and of words in links.
PRIOR, PRIOR_LINK = {INSIDE: 0.98, OUTSIDE: 0.02, NONE: 0.6}, 0.4
#: Prior shares of tags that mark up text, and of others, on pages without an article.
PRIOR_TEXT, PRIOR_OTHER = 0.97, 0.85
#: Prior shares of content by names, and the log odds that text-level elements have ahead.
PRIOR_AWAY, PRIOR_FAR, PRIOR_TOWARDS, PRIOR_NAME, TEXT_AHEAD = 0.05, 0.01, 0.95, 0.8, 1.0


def _attributes(name: str, attributes: str) -> tuple[bool, list[str]]:
    """Whether an element is never content, by its kind, and the names its author gave it."""
    never, names = name in NEVER or name == "header", []
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), a or b or c
        if key == "hidden":
            never = True
        elif key in ("class", "id"):
            names += value.split()
        elif key == "role":
            never |= value.lower() in NEVER_ROLES
        elif key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            never = True
    return never, names


def _parts_of(name: str) -> list[str]:
    if name.lower() in WHOLE:
        return [name.lower()]
    return [x for x in _PARTS.split(_CAMEL.sub(" ", name).lower()) if x and not x.isdigit() and x not in NEUTRAL and x not in WHOLE and len(x) > 1]


def _name_prior(part: str) -> float:
    return PRIOR_FAR if part in FAR else PRIOR_AWAY if part in AWAY or part in WHOLE else PRIOR_TOWARDS if part in TOWARDS else PRIOR_NAME


def leaning(tag: str, names: list[str], odds: dict[str, float]) -> float:
    """Log odds that an element with these names is content; 0 without names that say anything."""
    total = 0.0
    for name in names:
        parts = _parts_of(name)
        # State such as has-sidebar speaks of another element.
        if parts and not re.match(r"(?:has|is|no|with|without)[-_A-Z]", name):
            total += sum(math.log(p / (1 - p)) for p in (odds.get(x) or _name_prior(x) for x in parts)) / len(parts)
    return total + TEXT_AHEAD if total and tag in TEXT_TAGS else total


@dataclass
class Page:
    """Tokens (tag name, or "" for text; text), elements (tag name, its names, never content, first token, last token, an article),
    and running counts: words before each token, articles and headings begun before it. A reader's comment is no article."""

    raw: list[tuple[str, str]]
    elements: list[tuple[str, list[str], bool, int, int, bool]]
    words: list[int]
    articles: list[int]
    headings: list[int]


def parse(page: str) -> Page:
    """In time linear in the page's length."""
    raw: list[tuple[str, str]] = []
    elements: list[list] = []
    stack: list[int] = []
    opened: Counter = Counter()
    pos, n, last_end = 0, len(page), page.rfind(">")
    lower = None

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = elements[stack.pop()]
            opened[e[0]] -= 1
            e[4] = len(raw)

    while pos < n:
        if pos > last_end:  # no tag ends any more
            raw.append(("", page[pos:] if not page.startswith("<!", pos) else ""))
            break
        m = _TOKEN.match(page, pos)
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            text = m[0]
            if text[:9] == "<![CDATA[":
                raw.append(("", html.escape(text[9:].removesuffix("]]>"))))
            elif text[:2] not in ("<!", "<?"):
                raw.append(("", text))
            continue
        name = name.lower()
        if m[1] or m[4]:
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if elements[stack[k]][0] == name))
            raw.append((name, ""))
            continue
        attributes = m[3] or m[6] or ""
        if name in BLOCKS and name != "br" and stack and elements[stack[-1]][0] == "p":
            close(len(stack) - 1)
        for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
            if elements[stack[k]][0] in CLOSES.get(name, ()):
                close(k)
        never, names = _attributes(name, attributes)
        elements.append([name, names, never, len(raw), None, name in CONTENT and not any(x in FAR for y in names for x in _parts_of(y))])
        raw.append((name, ""))
        if name in VOID or attributes.endswith("/"):
            elements[-1][4] = len(raw)
            continue
        stack.append(len(elements) - 1)
        opened[name] += 1
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", pos)
            pos = n if end < 0 else end
    close(0)
    words, articles, headings = [0], [0] * (len(raw) + 1), [0] * (len(raw) + 1)
    for name, text in raw:
        words.append(words[-1] + (len(text.split()) if not name else 0))
    for name, _, _, first, _, article in elements:
        articles[first + 1] += article
        headings[first + 1] += name in HEADINGS
    return Page(raw, [tuple(e) for e in elements], words, list(accumulate(articles)), list(accumulate(headings)))


def _running(marks: list[tuple[int, int]], size: int) -> list[int]:
    """How many of the stretches each token is in."""
    out = [0] * (size + 1)
    for first, last in marks:
        out[first] += 1
        out[last] -= 1
    return list(accumulate(out))


def _left_out(page: Page, odds: dict[str, float]) -> list[int]:
    """For each token, in how many elements it is that are left out."""
    size, p = len(page.raw), page
    within = _running([(f, z) for *_, f, z, article in p.elements if article], size)
    certain = [
        (first, last) for name, _, never, first, last, _ in p.elements
        if never and name not in ROOTS and p.articles[last] == p.articles[first + 1] and not (name == "header" and within[first] > 0 and p.headings[last] > p.headings[first])
    ]
    gone = _running(certain, size)
    kept = [0]  # words before each token that are not certainly left out
    for k in range(size):
        kept.append(kept[-1] + (p.words[k + 1] - p.words[k] if gone[k] <= 0 else 0))
    doubtful = []
    for name, names, never, first, last, _ in p.elements:
        if (not names and name not in FORMS) or never or gone[first] > 0 or name in ROOTS or p.articles[last] != p.articles[first]:
            continue
        lean = leaning(name, names, odds)
        if name in FORMS:
            lean = min(lean, 0.0) + math.log(PRIOR_AWAY / (1 - PRIOR_AWAY))
        if lean < 0:
            doubtful.append((first, last, kept[last] - kept[first], lean))
    # Outermost first; what stays gives its words to the rest and lets those inside be judged.
    apart = _running([(f, z) for f, z, _, _ in doubtful], size)
    inner = [0]
    for k in range(size):
        inner.append(inner[-1] + (kept[k + 1] - kept[k] if apart[k] == 1 else 0))
    rest = kept[-1] - sum(kept[k + 1] - kept[k] for k in range(size) if apart[k] > 0)
    out, end = [], 0
    for first, last, own, lean in doubtful:
        if first < end:
            continue
        if rest >= own * math.exp(lean):
            out.append((first, last))
            end = last
        else:
            rest += inner[last] - inner[first]
    return [a + b for a, b in zip(gone, _running(out, size), strict=True)]


def read(page: str | Page, odds: dict[str, float] | None = None) -> tuple[list[tuple], bool]:
    """The page's wanted tokens: ("t", text, place, in link) and ("/", tag name, place), elements left out without
    their contents, and whether it has an article."""
    p = parse(page) if isinstance(page, str) else page
    size = len(p.raw)
    drop = _left_out(p, odds or {})
    inside = _running([(first, last) for _, _, never, first, last, article in p.elements if article and not never and drop[first] <= 0], size)
    link = _running([(first, last) for name, _, _, first, last, _ in p.elements if name == "a"], size)
    any_article = any(inside)
    place_at = lambda k: INSIDE if k >= 0 and inside[k] > 0 else OUTSIDE if any_article else NONE
    out: list[tuple] = []
    for k, (name, text) in enumerate(p.raw):
        # The tag that begins an article still stands outside.
        place = place_at(k - 1 if name in CONTENT else k)
        if drop[k] > 0:
            if name in BLOCKS:
                out.append(("/", "|", place))  # what is left out still parts blocks
        elif name:
            out.append(("/", name, place))
        else:
            out.append(("t", text, place, link[k] > 0))
    return out, any_article


def _prior(tag: str, place: int) -> float:
    return PRIOR[place] if place != NONE else PRIOR_TEXT if tag in TEXT_TAGS else PRIOR[NONE] * PRIOR_LINK if tag == "a" else PRIOR_OTHER


def _learn_names(pages: list[Page]) -> dict[str, float]:
    """Shares of content of the parts of names."""
    seen: Counter = Counter()
    for p in pages:
        articles = [(f, z) for _, _, never, f, z, article in p.elements if article and not never]
        inside = _running(articles, len(p.raw))
        total = [0]
        for k in range(len(p.raw)):
            total.append(total[-1] + (p.words[k + 1] - p.words[k] if inside[k] > 0 else 0))
        if not total[-1]:
            continue
        for _, names, never, first, last, _ in p.elements:
            own, good = p.words[last] - p.words[first], total[last] - total[first]
            if not names or never or not own:
                continue
            if not good and inside[first] <= 0:
                content = False
            elif 2 * good > total[-1] and good > 0.9 * own:
                content = True
            else:
                continue
            for part in {x for name in names for x in _parts_of(name)}:
                seen[part, content] += 1
    made = {}
    for part in {x for x, _ in seen}:
        good, bad = seen[part, True], seen[part, False]
        made[part] = (good + STRENGTH * _name_prior(part)) / (good + bad + STRENGTH)
    return made


def learn(pages: list[str]) -> tuple[dict, dict, dict]:
    """Shares of content: by (tag, place), by (place, in link), and by part of a name."""
    tags, words = Counter(), Counter()
    parsed = [parse(page) for page in pages]
    odds = _learn_names(parsed)
    for page in parsed:
        tokens, labelled = read(page, odds)
        if not labelled:
            continue
        for x in tokens:
            content = x[2] == INSIDE
            if x[0] == "/":
                for place in (x[2], NONE):
                    tags[x[1], place, content] += 1
            elif n := len(x[1].split()):
                for place in (x[2], NONE):
                    words[place, x[3], content] += n

    def share(c: Counter, key: tuple, prior: float) -> float:
        good, bad = c[*key, True], c[*key, False]
        return (good + STRENGTH * prior) / (good + bad + STRENGTH)

    by_tag = {(t, p): share(tags, (t, p), _prior(t, p)) for t, p, _ in list(tags)}
    return by_tag, {(p, a): share(words, (p, a), PRIOR[p] * (PRIOR_LINK if a and p == NONE else 1)) for p in PRIOR for a in (False, True)}, odds


def scores(tokens: list[tuple], weights: tuple[dict, dict, dict]) -> list[float]:
    """Tags score below zero, words above."""
    tags, words, _ = weights
    out = []
    for x in tokens:
        if x[0] == "t":
            out.append(len(x[1].split()) * max(WORD_LEAST, WORD_SPAN * words[x[2], x[3]]))
        else:
            out.append(-TAG_LEAST if x[1] == "|" else -TAG_LEAST - TAG_SPAN * (1 - (tags.get((x[1], x[2])) or _prior(x[1], x[2]))))
    return out


def extract(page: str | None, weights: tuple[dict, dict, dict]) -> str:
    """The page's main text."""
    if not page:
        return ""
    tokens, _ = read(page, weights[2])
    best = total = 0.0
    start, region = 0, (0, 0)
    for k, score in enumerate(scores(tokens, weights)):
        total += score
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, region = total, (start, k + 1)
    lines, line = [], []
    for x in tokens[region[0] : region[1]]:
        if x[0] == "t":
            line.append(x[1])
        elif x[1] in BLOCKS or x[1] == "|":
            lines.append("".join(line))
            line = []
    lines.append("".join(line))
    done = (_SPACE.sub(" ", html.unescape(s)).strip() for s in lines)
    return "\n".join(s for s in done if s)


def fit(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", labelled: int = LABELLED) -> tuple[dict, dict, dict]:
    """Weights from at most labelled pages with an article or main element. They are chosen by hashes alone, then
    fetched, so that no partition sends its own candidates' html to the driver; repeated rows teach once."""
    keys = {"h": F.xxhash64(pages[id_col]), "g": F.xxhash64(pages[html_col])}
    having = pages.filter(pages[html_col].rlike("(?i)<(article|main)[\\s>]")).select(*[c.alias(k) for k, c in keys.items()], pages[html_col].alias("html"))
    chosen = durable(having.select("h", "g").orderBy("h", "g").limit(labelled), "labelled").distinct()
    # At most labelled pairs of hashes are broadcast, and as many pages come to the driver.
    rows = having.join(F.broadcast(chosen), ["h", "g"]).dropDuplicates(["h", "g"]).orderBy("h", "g").collect()
    return learn([r.html for r in rows])


def extract_pages(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(fit(pages, html_col=html_col, id_col=id_col))
    narrow = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            text = [extract(page, held.value) for page in rows["html"]]
            yield pd.DataFrame({"page_id": rows["page_id"], "url": rows["url"], "text": text, "n_chars": [len(x) for x in text]})

    types = dict(narrow.dtypes)
    return narrow.mapInPandas(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")
