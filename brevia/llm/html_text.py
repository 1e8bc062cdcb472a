"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies a block by its place (menus, headers,
footers, sidebars, notices, adverts, forms, comments by tag, role, class or id), link density, length and
stop-word density: good, bad, or short and undecided. The second pass gives each undecided block the label of
its nearest decided neighbours: both sides where they agree, else the nearer one by blocks; in a tie, or with
no decided neighbour, it is good inside the article's element and bad elsewhere. Blocks inside that element
inherit from blocks inside it only, and are bad only where nearly all of their text is links. Stop words of several
languages are in one list; on a page in another language, where long blocks hold hardly any, length and link
density decide alone.

Words in class or id that name boilerplate always count; weak ones (such as ``legal`` or ``reader``) count neither
inside the article nor beside a word that names a main part. Captions, formulas and embedded text are text.

Character references are decoded; white space inside a block becomes one space; blocks are trimmed and joined
in page order by one space. Nothing is cut off.

One pass over the page, however its tags are nested or left open; very long pages are read whole. Ids must be numbers.

Defined cases: null or empty html gives the empty text; text outside any tag is a block; unclosed tags end
with their parent or the page; an unended comment, script or tag reaches to the end of the page; repeated rows
give a row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Element names by their role, words in class or id, and common function words.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe svg select button canvas audio video".split())
BAD_ELEMENTS = frozenset("nav aside footer form menu dialog fieldset search".split())
CLOSED_BY_BLOCK = frozenset("p".split())
GOOD_ELEMENTS = frozenset("article main".split())
_WORD = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
BAD_WORDS = re.compile(_WORD % (
    "ad|ads|advert|adverts|advertisement|advertising|banner|promo|promotion|sponsor|sponsored|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|footer|masthead|sidebar"
    "|related|recommended|widget|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|comment|comments|reply|replies|respond|disqus"
    "|pagination|pager|toolbar|copyright"
))
WEAK_WORDS = re.compile(_WORD % "header|side|aside|search|reader|tags|legal|toc|form")
MAIN_WORDS = re.compile(_WORD % "article|body|content|entry|main|post|story|text")
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
STOP = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our she so that the their there they this to was we were what when which who will with would you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich ihr im in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wir wird zu zum zur "
    "al ante como con cuando de del desde donde el ella en entre era es esta este fue ha hasta hay la las lo los más me mi muy no nos o para pero por que qué se ser si sin sobre son su sus también un una y ya yo "
    "au aux avec ce ces cette dans de des dont du elle elles en est et eux il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que qui sa sans se ses son sont sur tout un une vous".split()
)
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKS = 0.15, 0.30, 0.33
#: Link density that makes a block of the article a menu; stop-word density below which the language is unknown.
ALL_LINKS, NO_STOP = 0.9, 0.05
ENDS = tuple(".!?…。！？\"»”)")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WHITE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    link: int  # characters inside links
    place: int  # -1 inside a boilerplate element, 1 inside the article, 0 elsewhere
    heading: bool
    label: str = ""
    inherited: str = ""


def _bad(name: str, attributes: str, inside: int) -> bool:
    if name in BAD_ELEMENTS or name == "header" and inside == 0:
        return True
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                if value in BAD_ROLES:
                    return True
            elif name not in ("html", "body", "main", "article"):
                if BAD_WORDS.search(value) or inside == 0 and WEAK_WORDS.search(value) and not MAIN_WORDS.search(value):
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open block elements and their place
    depth: Counter[str] = Counter()  # how many of each name are open
    place, links, in_link, heading = 0, 0, 0, False

    def close() -> None:
        nonlocal links
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, min(links, len(text)), place, heading))
            parts.clear()
        links = 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text = page[at:]
            parts.append(text)
            links += len(text) if in_link else 0
            break
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if in_link:
                links += len(text)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCK:
                close()
                if depth[name]:
                    while True:
                        last = stack.pop()[0]
                        depth[last] -= 1
                        if last == name:
                            break
                    place = stack[-1][1] if stack else 0
                    heading, in_link = False, 0
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            if name in BLOCK:
                close()
            continue
        if name == "a":
            in_link += 1
        elif name in BLOCK:
            close()
            if name in VOID:
                continue
            if stack and stack[-1][0] in CLOSED_BY_BLOCK:
                depth[stack.pop()[0]] -= 1
                place = stack[-1][1] if stack else 0
            if place >= 0:
                if _bad(name, m[3], place):
                    place = -1
                elif name in GOOD_ELEMENTS:
                    place = 1
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
            stack.append((name, place))
            depth[name] += 1
    close()
    return out


def stop_density(b: Block) -> float:
    words = b.text.lower().split()
    return sum(w.strip(".,;:!?%*#$&()\"'") in STOP for w in words) / len(words)


def first_pass(b: Block, known: bool = True) -> str:
    """good, bad or short; ``known``: whether the stop words are those of the page's language."""
    if b.place < 0:
        return "bad"
    n = len(b.text)
    if b.link / n > (ALL_LINKS if b.place > 0 else LINKS):
        return "bad"
    if n < SHORT:
        return "bad" if b.link and b.place <= 0 else "short"
    if b.place > 0:
        return "good"  # a long block of text inside the article's element
    if not known:
        return "good" if n >= LONG or b.text.endswith(ENDS) else "short"
    stop = stop_density(b)
    if stop >= STOP_HIGH or stop >= STOP_LOW and n >= LONG:
        return "good"
    return "short" if stop >= STOP_LOW else "bad"


def knows_language(found: list[Block]) -> bool:
    """Whether any long block without many links and outside boilerplate holds stop words, if there is one."""
    text = [b for b in found if b.place >= 0 and len(b.text) >= SHORT and b.link / len(b.text) <= LINKS]
    return not text or any(stop_density(b) >= NO_STOP for b in text)


def classify(found: list[Block]) -> list[Block]:
    """Both passes; labels good or bad."""
    known = knows_language(found)
    for b in found:
        b.label = first_pass(b, known)
    # nearest decided blocks to the left and right; inside the article's element only those that are inside too
    for inside in (False, True):
        here = [i for i, b in enumerate(found) if b.place > 0] if inside else range(len(found))
        decided = [i for i in here if found[i].label != "short"]
        for i in here:
            b = found[i]
            if b.label != "short" or (b.place > 0) != inside:
                continue
            k = bisect_left(decided, i)
            a, c = (decided[k - 1] if k else None), (decided[k] if k < len(decided) else None)
            if a is None or c is None:
                near = c if a is None else a
                b.inherited = found[near].label if near is not None else "good" if inside else "bad"
            elif found[a].label == found[c].label:
                b.inherited = found[a].label
            else:
                b.inherited = found[a].label if i - a < c - i else found[c].label if c - i < i - a else "good" if inside else "bad"
    for b in found:
        b.label = b.inherited or b.label
    return found


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    common.small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
