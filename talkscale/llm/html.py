"""Main text of web pages by two-pass block rules.

Markup is cut into blocks; scripts, styles and regions that their element, role or class names as navigation, header,
footer, sidebar, notice, advert, form or comments are left out. Pass 1 decides blocks by stop-word density, length and
link density; pass 2 gives undecided ones the label of the nearest decided neighbour. Stop words count only on pages whose
running text has those of a language with a list; other pages, of any language or script, go by length and link density. A
name of WEAK_NAME is only evidence against a region that is also named as content: its blocks must be good by themselves. If an article (or main)
element holds most of the text that pass 1 finds good or near, only its blocks count; otherwise all blocks do, and the
element is no evidence. Blocks of an article that counts go through the same two passes, with thresholds that take the element as evidence:
half the stop words are enough, half of a block may be links, and a short block came near being good.

Null, empty and broken pages give what can be read of them, an empty text if nothing; nothing is capped. Time is linear in a
page's length, broken markup included. Rows are independent: repeated ones give the same text, ties don't arise, and other
columns of pages, whatever their names, aren't read.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can could did do for from had has have he her his i if in into is it its me more my no not of on or our she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous à été être "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch ein eine einem einen einer eines er es für hat ich ihr im in ist ja mit nach nicht noch nur oder sich sie sind so um und uns von vor war was wenn wie wir zu zum zur über "
    "al como con cuando de del desde donde e el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no o para pero por porque que se ser si sin sobre son su sus también tan te un una y ya".split()
)
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title".split())
#: Of these, the text that follows a start tag is never the page's.
RAW_TEXT = frozenset("script style textarea title".split())
#: Any other start tag, and text, closes a head.
HEAD = frozenset("html head base link meta title style script noscript template".split())
SKIPPED = frozenset("head nav footer aside form button select option datalist dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind closes an open element of the second in the same parent.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|ads?|advert\w*|adsense|banner|cookies?|consent|gdpr|popup|modal|overlay|promo\w*|sponsor\w*|share|sharing|social|comments?|commentlist|replies|respond|disqus|related|recommended|newsletter|subscri\w+|breadcrumbs?|pagination|pager|footer|header|masthead|toolbar|widget|notice|alert|disclaimer|login|signup|search|skip-link)(?:$|[\s_-])",
    re.I,
)
GOOD_NAME = re.compile(r"(?:article|post|entry|story|page)[_-]?(?:header|title|content|body|text)|(?:has|with|no)[_-]\w+", re.I)
#: Of these names, those that a content region may carry too.
WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:share|sharing|social|alert|search|promo\w*|notice|banner|widget|toolbar|related|recommended|overlay|pager|pagination|header|footer|login)(?:$|[\s_-])", re.I)
CONTENT_NAME = re.compile(r"^(?:content|main|story|article|post|entry|body|text|prose|page)$", re.I)
#: Letters of scripts that write no spaces between words; one says about as much as DENSE Latin ones.
IDEOGRAPHS, DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]"), 3
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^"'<>])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A slash that ends a tag and no attribute's value.
CLOSED = re.compile(r"""(?:^|[\s"'])/\s*\Z""")
LETTERS = re.compile(r"[^\W\d_]+")

MAX_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.2, 70, 200, 0.30, 0.32
INSIDE_LINKS, INSIDE_LOW, INSIDE_HIGH = 0.5, STOP_LOW / 2, STOP_HIGH / 2
#: Share of stop words in running text from which on a page's language is one with a list.
KNOWN = STOP_LOW
GOOD, BAD, OPEN, NEAR = "good", "bad", "open", "near"


def unwanted(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's name or attributes mark it as no part of the text, and whether they make it doubtful. inside: within an article."""
    if name in SKIPPED or (name == "header" and not inside):
        return True, False
    if not attributes or name in ("html", "body", "main"):
        return False, False
    doubtful = False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            return True, False
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if key in ("class", "id", "aria-label"):
            names = value.split()
            bad = [x for x in names if BAD_NAME.search(x) and not GOOD_NAME.search(x)]
            if bad and not (any(CONTENT_NAME.match(x) for x in names) and all(WEAK_NAME.search(x) for x in bad)):
                return True, False
            doubtful |= bool(bad)
    return False, doubtful


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    inside: bool  # in an article
    doubtful: bool


def blocks(page: str) -> list[Block]:
    """The blocks that no unwanted region holds."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements, and whether each is unwanted or doubtful
    last = page.rfind(">")  # no tag ends beyond it
    open_: dict[str, int] = {}
    unclosed: set[str] = set()  # raw elements without an end tag in the rest of the page
    bad = articles = links = doubts = at = 0
    text: list[str] = []
    linked: list[str] = []
    size = lambda parts: len(" ".join(html.unescape("".join(parts)).split()))

    def end_block() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, size(linked), articles > 0, doubts > 0))
            text.clear()
            linked.clear()

    def pop() -> None:
        nonlocal bad, articles, links, doubts
        name, was_bad, was_doubtful = stack.pop()
        open_[name] -= 1
        bad -= was_bad
        doubts -= was_doubtful
        links -= name == "a"
        articles -= name in ("article", "main")

    def put(part: str) -> None:
        if stack and stack[-1][0] == "head" and part.strip():
            pop()
        if part and not bad:
            text.append(part)
            if links:
                linked.append(part)

    while at < len(page):
        found = TOKEN.search(page, at, last + 1) if at <= last else None
        if not found:
            put(page[at:].partition("<!--")[0])
            break
        if found[0].startswith("<!--") and not found[0].endswith("-->"):
            put(page[at : found.start()])
            break
        put(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        attributes = found[3] if found[2] else found[6]
        if name not in INLINE:
            if name in ("br", "hr", "img", "input"):
                put(" ")
            else:
                end_block()
        if found[1] or found[4]:
            if open_.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        while open_.get("head") and name not in HEAD:
            pop()
        if name in RAW:
            if name in ("svg", "math") and CLOSED.search(attributes):
                continue
            end = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at, last + 1)
            if end:
                at = end.end()
                continue
            unclosed.add(name)  # only the tag goes
            if name in RAW_TEXT:
                following = TOKEN.search(page, at, last + 1) if at <= last else None
                at = following.start() if following else len(page)
            continue
        if name in VOID or name in INLINE and CLOSED.search(attributes):
            continue
        closes = CLOSES.get(name) or ({"p"} if name in BLOCKS_CLOSE_P else ())
        while stack and stack[-1][0] in closes:
            pop()
        if name == "a" and open_.get("a") and stack[-1][0] == "a":
            pop()
        hit, doubtful = unwanted(name, attributes, articles > 0)
        stack.append((name, hit, doubtful))
        open_[name] = open_.get(name, 0) + 1
        bad += hit
        doubts += doubtful
        links += name == "a"
        articles += name in ("article", "main")
    end_block()
    return out


def length(text: str) -> int:
    """Characters, with those of scripts without spaces for several."""
    return len(text) + (DENSE - 1) * len(IDEOGRAPHS.findall(text))


def stop_share(texts: list[str]) -> float:
    words = [w for text in texts for w in LETTERS.findall(text.lower())]
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def known_language(found: list[Block]) -> bool:
    """Whether the page's running text, or all of it where none runs, has the stop words of a listed language."""
    running = [b.text for b in found if length(b.text) >= SHORT and b.linked <= MAX_LINKS * len(b.text)]
    return stop_share(running or [b.text for b in found]) >= KNOWN


def label(block: Block, inside: bool, known: bool) -> str:
    """Pass 1. inside: within an article that counts, which shifts the thresholds. known: stop words tell."""
    text, linked = block.text, block.linked
    links, low, high = (INSIDE_LINKS, INSIDE_LOW, INSIDE_HIGH) if inside else (MAX_LINKS, STOP_LOW, STOP_HIGH)
    if linked / len(text) > links:
        return BAD
    size = length(text)
    if size < SHORT:
        return BAD if block.doubtful or linked and not inside else NEAR if inside else OPEN
    stops = stop_share([text])
    if stops >= high if known else size > LONG:
        return GOOD if size > LONG else BAD if block.doubtful else NEAR
    if block.doubtful:
        return BAD
    return NEAR if stops >= low or not known else BAD


def settle(labels: list[str]) -> list[bool]:
    """Pass 2: undecided blocks take the label of the nearest decided one; at equal distance the good one if they came near it by themselves. On a page without a good block those that came near are good."""
    if GOOD not in labels:
        labels = [GOOD if x == NEAR else x for x in labels]
    decided = [i for i, x in enumerate(labels) if x in (GOOD, BAD)]
    if not decided:
        return [x == GOOD for x in labels]
    before: list[int | None] = []
    last = None
    known = set(decided)
    for i in range(len(labels)):
        last = i if i in known else last
        before.append(last)
    out, following = [False] * len(labels), None
    for i in range(len(labels) - 1, -1, -1):
        following = i if i in known else following
        x = labels[i]
        if x in (GOOD, BAD):
            out[i] = x == GOOD
            continue
        a, b = before[i], following
        near = [(abs(i - j), labels[j] == GOOD) for j in (a, b) if j is not None]
        closest = min(d for d, _ in near)
        good = [g for d, g in near if d == closest]
        out[i] = all(good) or (any(good) and x == NEAR)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    known = known_language(found)
    weight = {True: 0, False: 0}  # characters that the rules find good without the element as evidence
    for b in found:
        weight[b.inside] += len(b.text) * (label(b, False, known) in (GOOD, NEAR))
    inside = weight[True] >= weight[False] and any(b.inside for b in found)
    if inside:
        found = [b for b in found if b.inside]
    kept = settle([label(b, inside, known) for b in found])
    return " ".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    from pyspark.sql import types as T

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], *T.StructType.fromDDL("text string, n_chars bigint").fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, schema)
