"""Main text of HTML pages by two passes over blocks.

A page is cut into blocks at block tags. The first pass judges each block by itself: text in boilerplate containers
(by tag, role, class or id) and link-dense text is bad; long text with enough stop words is good; short text is left
open. How many stop words are enough depends on the page: where its long blocks hold few, as in a language not listed,
fewer do, and where no block is good the longest open ones are. A container's class or id must be a name as a whole, and
where the name is all there is against it, articles and long text with many stop words inside it stay. The second pass
gives open blocks the label of their nearest decided neighbours: that of both if they agree, else that of the nearer one;
on a page without any decided block they are good. What boilerplate containers hold, such as an advert, is no neighbour.
Where a page has an article or main element, what stands outside is not main text. Inside, blocks without stop words are
open and others judged as anywhere; the element's edge is a good neighbour where the decided block next to it is good.

Null and empty pages give an empty text. Character references are decoded, white space in a block becomes one space,
blocks are joined by a newline; nothing else is dropped or cut. Repeated rows are judged each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrykit.llm.common import table

#: A block of SHORT characters or fewer is open unless its links or its place decide; LONG ones need fewer stop words.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.15, 0.30, 0.4
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|iframe|textarea|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(template|svg|math|object|select|button)\b[^>]*>.*?</\2\s*>|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-z!/?][^<>]*\Z|[^<]+|<", re.S | re.I)
#: Tags that cut blocks, tags and names of boilerplate, stop words of the languages met.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = re.compile(
    r"ads?|advert\w*|adsense|banner|breadcrumbs?|captcha|comments?|consent|cookies?|copyright|disclaimer|discussion|disqus|footer|gdpr|legal|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|overlay|pager|pagination|popup|promo|promotion|recommended|related|repl(?:y|ies)|responses|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|teaser|toolbar|topbar|widget",
    re.I,
)
#: Words that may stand beside a name in a class without changing what it says, as in site-footer; with-sidebar is no sidebar.
PLACES = re.compile(r"area|articles?|bars?|block|bottom|box|buttons?|container|form|global|header|icons|inner|items?|left|links|list|main|media|outer|page|panel|posts?|primary|right|secondary|section|site|top|wrap|wrapper|\d+", re.I)
#: Names of what readers or lawyers write: such text may be long and dense and yet is not main text.
PROSE = re.compile(r"(?:^|[\s_-])(?:comments?|consent|cookies?|copyright|disclaimer|discussion|disqus|gdpr|legal|repl(?:y|ies)|responses)(?=$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his i if in into is it its more no not of on or our she so some than that the their them then there these they this to was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    al como con cuando de del desde donde el ella en entre era es esta este esto ha hasta la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también un una uno y ya
    """.split()
)
WORD = re.compile(r"[^\W\d_]+")


def is_name(token: str) -> bool:
    """A class or id that is a name of boilerplate, or one with words of place."""
    parts = [p for p in re.split(r"[_-]+", token) if p]
    named = [bool(NAMES.fullmatch(p)) for p in parts]
    return any(named) and all(n or PLACES.fullmatch(p) for n, p in zip(named, parts, strict=True))


def boilerplate(tag: str, attributes: str, in_article: bool) -> int:
    """0: none; 1: by a name alone, which an article or long text with stop words inside overrides; 2: for sure."""
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return 2
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes, re.I) or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return 2
    if tag in ("article", "main", "body", "html"):
        return 0
    if found.get("role", "").lower() in ROLES:
        return 2
    names = [t for a in ("class", "id") for t in found.get(a, "").split() if is_name(t)]
    return 2 if any(PROSE.search(t) for t in names) else int(bool(names))


def blocks(page: str) -> list[tuple[str, float, int, int]]:
    """(text, share of it in links, in boilerplate (0 to 2), number of its article or 0)."""
    found, text, linked, in_link, breaks = [], [], 0, 0, 0
    stack: list[tuple[str, int, int]] = []  # tag, boilerplate, article
    articles = 0

    def close() -> None:
        nonlocal linked, breaks
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            found.append((whole, min(1.0, linked / len(whole)), stack[-1][1] if stack else 0, stack[-1][2] if stack else 0))
        text.clear()
        linked, breaks = 0, 0

    for m in TOKEN.finditer(page):
        raw, tag = m[0], m[4]
        if tag is None:
            if raw[0] != "<" or raw == "<":
                text.append(raw)
                breaks = breaks if raw.isspace() else 0
                linked += len(" ".join(html.unescape(raw).split())) if in_link else 0
            elif m[1] or m[2]:
                text.append(" ")
            continue
        tag, end, attributes = tag.lower(), bool(m[3]), m[5]
        if tag == "br":
            text.append(" ")
            breaks += 1
            if breaks > 1:
                close()
        elif tag == "a":
            in_link = 0 if end else 1
        elif tag in BLOCKS or (not end and tag not in VOID and boilerplate(tag, attributes, bool(stack and stack[-1][2]))) or (end and any(s[0] == tag for s in stack)):
            close()
            if end:
                if any(s[0] == tag for s in stack):
                    while stack.pop()[0] != tag:
                        pass
            elif tag not in VOID and not attributes.endswith("/"):
                if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                    stack.pop()  # their end tags may be left out
                _, bad, article = stack[-1] if stack else ("", 0, 0)
                bad = max(bad, boilerplate(tag, attributes, bool(article)))
                if (tag in ("article", "main") or 'role="main"' in attributes) and not article:
                    bad = 0 if bad == 1 else bad
                    articles += 1
                    article = articles
                stack.append((tag, bad, article))
        elif tag in ("img", "input", "wbr", "hr"):
            text.append(" " if tag != "wbr" else "")
    close()
    return found


def density(text: str) -> float:
    """Share of stop words."""
    tokens = WORD.findall(text.lower())
    return sum(t in STOP_WORDS for t in tokens) / len(tokens) if tokens else 0.0


def usual_density(found: list[tuple[str, float, int, int]], densities: list[float]) -> float:
    """That of a page's long plain blocks together: text in a language or wording of few known stop words is judged by its own."""
    long = [(len(b[0]), d) for b, d in zip(found, densities, strict=True) if not b[2] and b[1] <= LINKS and len(b[0]) > SHORT]
    return sum(n * d for n, d in long) / sum(n for n, _ in long) if long else 0.0


def first_pass(found: list[tuple[str, float, int, int]]) -> list[bool | None]:
    """Good, bad or open (None) for each block."""
    has_article = any(b[3] and b[2] < 2 for b in found)
    densities = [density(b[0]) for b in found]
    usual = usual_density(found, densities)
    low, high = min(STOP_LOW, usual), min(STOP_HIGH, 2 * usual)

    def judged(block: tuple[str, float, int, int], dense: float) -> bool | None:
        text, links, enclosed, article = block
        if enclosed == 2 or (has_article and not article) or links > LINKS or (enclosed and len(text) <= LONG):
            return False
        if len(text) <= SHORT:
            return None
        if enclosed:
            return dense >= STOP_HIGH
        if usual and dense >= (low if len(text) > LONG else high):
            return True
        # articles hold tables and lists without stop words, and where there are hardly any they tell nothing
        return None if article or dense > 0 or usual < STOP_LOW / 2 else False

    labels = [judged(b, d) for b, d in zip(found, densities, strict=True)]
    if True not in labels:  # the longest open text is what the page is about
        most = max((len(b[0]) for b, label in zip(found, labels, strict=True) if label is None), default=0)
        labels = [True if label is None and 2 * len(b[0]) >= most > SHORT else label for b, label in zip(found, labels, strict=True)]
    return labels


def second_pass(labels: list[bool | None], found: list[tuple[str, float, int, int]]) -> list[bool]:
    """Open blocks take the label of the nearest decided neighbour of their own article (or page), good ones first.

    What containers of boilerplate hold is no neighbour. An article's edge is a good one if the decided block next to it is.
    """
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if not b[2] or labels[i]:
            groups.setdefault(b[3], []).append(i)
    out = [bool(label) for label in labels]
    for article, group in groups.items():
        decided = [(at, labels[i]) for at, i in enumerate(group) if labels[i] is not None]
        if article and decided:
            decided = [(-1, True)] * decided[0][1] + decided + [(len(group), True)] * decided[-1][1]
        after = 0
        for at, i in enumerate(group):
            while after < len(decided) and decided[after][0] < at:
                after += 1
            if labels[i] is None:
                near = [(abs(place - at), not good) for place, good in decided[max(0, after - 1) : after + 1]]
                out[i] = not near or not min(near)[1]  # with nothing decided, nothing speaks against it
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, good in zip(found, second_pass(first_pass(found), found), strict=True) if good)


@F.pandas_udf(T.StringType())
def main_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([main_text(p) for p in batch], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    return pages.select("page_id", "url", main_texts(F.col("html")).alias("text"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_main_text": op2_main_text}
#: None: the two passes have no SQL form; tests compare with articles of known text.
ORACLE_SQL: dict[str, str] = {}
