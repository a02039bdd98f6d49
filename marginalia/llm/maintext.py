"""Main text of web pages by two passes of rules over their blocks.

The first pass looks at each block alone. What stands in a menu, a form, an advert or the like is no text of the article. Of the rest,
link density, length, and the share of stop words decide: long prose with few links is good, a run of links is bad, and what is short or has few
stop words stays open. The second pass gives open blocks the label of their nearest decided neighbours. Where the page
marks its article, blocks outside are bad, and an open block inside is bad only between two bad ones."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.registry import query, table
from marginalia.llm.textbytes import chunks

SHORT, LONG = 70, 200  # code points
FEW, MANY = 0.06, 0.12  # share of stop words
LINKED, LINKED_INSIDE = 0.2, 0.5  # share of linked code points, elsewhere and within a marked article

# Frequent words of the four languages, elements, and the words in names of page furniture.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
    de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec
    el que y los del las por con no una su para es al lo como más pero sus""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub
    sup time tt u var""".split()
)
FURNITURE = frozenset(
    """aside audio button canvas datalist dialog fieldset footer form head math menu nav noscript object optgroup option picture select svg
    template textarea title video""".split()
)
FURNITURE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split()
)
FURNITURE_WORDS = frozenset(
    """ad ads adslot adv advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs comment comments
    consent cookie cookies copyright dialog discussion disqus footer form gdpr header legal login masthead menu menus modal nav navbar
    navigation newsletter notice notices overlay pager pagination popup promo promos promoted promotion recommended related replies reply responses search
    share sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar
    topbar widget widgets adbanner adbox adsense commentbox commentlist cookiebar mainnav navmenu sitefooter siteheader sitenav subnav
    topnav""".split()
)
CONTENT_WORDS = frozenset("article content entry main page post story".split())
NEGATING = frozenset("has no with without".split())

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>=]++|=)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
_HEADING = re.compile(r"h[1-6]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
# Elements that a new one ends where they are open, innermost first.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}

NEUTRAL, BAD, MAIN, ARTICLE = 0, 1, 2, 3


def _named_furniture(name: str, value: str) -> bool:
    """Whether a class or id speaks of page furniture. Names of the whole article count only if they say nothing else."""
    for word in value.split():
        if name in ("article", "main"):
            if word.lower() in FURNITURE_WORDS:
                return True
            continue
        before = ""
        for part in _NAME_WORDS.findall(word):
            part = part.lower()
            if part in FURNITURE_WORDS and before not in NEGATING and not (part in ("header", "page") and before in CONTENT_WORDS):
                return True
            before = part
    return False


def _kind(name: str, attributes: str, inside: bool) -> int:
    """What an element holds, by its name and attributes; ``inside`` an article a header may hold its title."""
    if name in FURNITURE or (name == "header" and not inside):
        return BAD
    if attributes and name not in ("html", "body"):
        held = {}
        for m in _ATTRIBUTE.finditer(attributes):
            held.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        role = held.get("role", "").lower()
        if role in FURNITURE_ROLES or "hidden" in held or held.get("aria-hidden", "").lower() == "true":
            return BAD
        if _HIDDEN.search(held.get("style", "")):
            return BAD
        names = f"{held.get('class', '')} {held.get('id', '')}"
        if names != " ":
            if inside and name not in ("article", "main"):
                names = re.sub(r"(?i)\bheader\b", "", names)
            if _named_furniture(name, names):
                return BAD
        if role in ("main", "article"):
            return MAIN if role == "main" else ARTICLE
        if name == "div" and held.get("id", "").lower() in ("content", "main", "article"):
            return MAIN
    return {"article": ARTICLE, "main": MAIN}.get(name, NEUTRAL)


class _Block:
    __slots__ = ("text", "linked", "heading", "zone")

    def __init__(self, text: str, linked: int, heading: bool, zone: int):
        self.text, self.linked, self.heading, self.zone = text, linked, heading, zone


def page_blocks(page: str) -> list[_Block]:
    """Blocks of a page in order, without those in furniture. Markup left open ends where what holds it ends, or with the page."""
    out: list[_Block] = []
    stack: list[tuple[str, int]] = []
    counts, named = [0, 0, 0, 0], Counter()
    wraps: list[int] = []  # places in the stack of furniture that an article may stand in
    pieces: list[str] = []
    linked, anchors, heading = 0, 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            zone = ARTICLE if counts[ARTICLE] else MAIN if counts[MAIN] else NEUTRAL
            out.append(_Block(text, linked, heading, zone))
        linked = 0

    def pop_to(at: int) -> None:
        while len(stack) > at:
            name, kind = stack.pop()
            counts[kind] -= 1
            named[name] -= 1
        while wraps and wraps[-1] >= at:
            wraps.pop()

    def push(name: str, kind: int) -> None:
        if kind == BAD and name in ("form", "header", "nav"):
            wraps.append(len(stack))
        stack.append((name, kind))
        counts[kind] += 1
        named[name] += 1

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at and not counts[BAD]:
            text = html.unescape(page[at:mark])
            pieces.append(text)
            if anchors:
                linked += len(text.strip())
        if mark == size:
            break
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        following = page[mark + 1 : mark + 2]
        if following in ("!", "?") or (following == "/" and not page[mark + 2 : mark + 3].isalpha()):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        if not (following == "/" or (following.isascii() and following.isalpha())):
            if not counts[BAD]:
                pieces.append("<")
            at = mark + 1
            continue
        tag = _TAG.match(page, mark)
        if not tag:  # a tag that the page's end cuts off
            break
        at, name = tag.end(), tag[1].lower()
        if following == "/":
            if name == "a":
                anchors = 0
            held = len(stack) - 1 if named[name] else -1
            while held >= 0 and stack[held][0] != name:
                held -= 1
            if name not in INLINE or (held >= 0 and stack[held][1] == BAD):
                flush()
            if held >= 0:
                pop_to(held)
            if _HEADING.fullmatch(name):
                heading = False
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            if not end:
                break
            at = page.find(">", end.end())
            at = size if at < 0 else at + 1
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                pieces.append(" ")
            continue
        kind = _kind(name, tag[2], counts[ARTICLE] > 0)
        if kind >= MAIN:  # what wraps or was left open before an article says nothing of it
            for k in wraps:
                stack[k] = (stack[k][0], NEUTRAL)
                counts[BAD] -= 1
                counts[NEUTRAL] += 1
            wraps.clear()
        if name in INLINE:
            if name == "a":
                anchors = 1
            if kind == BAD:
                flush()
                push(name, kind)
            continue
        if linked or counts[ARTICLE]:  # a link around whole blocks goes on, one left open in a text does not
            anchors = 0
        flush()
        for ended in ("p", *_ENDS.get(name, ())):
            if stack and stack[-1][0] == ended:
                pop_to(len(stack) - 1)
        if _HEADING.fullmatch(name):
            heading = True
        elif name not in ("div", "header", "hgroup"):
            heading = False
        if not tag[2].endswith("/") or kind != BAD:
            push(name, kind)
    flush()
    return out


def _alone(block: _Block, marked: bool) -> bool | None:
    """First pass: good, bad or open."""
    size = len(block.text)
    if not block.heading and block.linked > (LINKED_INSIDE if marked else LINKED) * size:
        return False
    if block.heading or size < SHORT:
        return None
    found = _WORD.findall(block.text.lower())
    share = sum(w in STOP_WORDS for w in found) / max(len(found), 1)
    if share >= MANY and size >= LONG:
        return True
    if share < FEW and size >= LONG and not marked:
        return False
    return None


def good_blocks(blocks: list[_Block]) -> list[bool]:
    """Both passes over the blocks of a page."""
    top = max((b.zone for b in blocks), default=NEUTRAL)
    labels: list[bool | None] = []
    for b in blocks:
        labels.append(False if top != NEUTRAL and b.zone == NEUTRAL else _alone(b, top != NEUTRAL and b.zone == top))
    near = [k for k, b in enumerate(blocks) if top == NEUTRAL or b.zone != NEUTRAL]
    before: list[int | None] = [None] * len(blocks)
    after: list[int | None] = [None] * len(blocks)
    for order, side in ((near, before), (near[::-1], after)):
        last = None
        for k in order:
            side[k] = last
            if labels[k] is not None:
                last = k
    out = []
    for k, (b, label) in enumerate(zip(blocks, labels, strict=True)):
        if label is None:
            left, right = before[k], after[k]
            if top != NEUTRAL and b.zone == top:
                label = not (left is not None and right is not None and not labels[left] and not labels[right])
            elif left is None and right is None:
                label = True
            elif left is None or right is None:
                label = labels[right if left is None else left]
            elif labels[left] == labels[right]:
                label = labels[left]
            elif k - left == right - k:
                label = b.heading and labels[right] or len(b.text) >= SHORT
            else:
                label = labels[left if k - left < right - k else right]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    blocks = page_blocks(page or "")
    return "\n\n".join(b.text for b, good in zip(blocks, good_blocks(blocks), strict=True) if good)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html"):
            texts = [main_text(page) for page in part.column("html").to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"]
            )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks of the article in page order, two line breaks between them) and n_chars of every row of ``pages`` (page_id,
    url, html; other columns are ignored).

    Null html counts as empty; a page without text gives an empty text. Repeated rows and null ids are rows each. An empty table
    gives no rows. References are decoded, white space within a block becomes one blank. Pages are read as they are stored, a slice
    of about a megabyte at a time, and nothing is shuffled; reading a page costs time in proportion to its length, whatever is left open in it."""
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        _texts, f"page_id {types['page_id']}, url string, text string, n_chars bigint"
    )


# What the rules come to on pages made like the given ones: all of the article element, its tags as breaks.
MAIN_TEXT_SQL = r"""
WITH inner_html AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS body FROM pages),
split AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(replace(regexp_replace(
    regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), chr(160), ' '), '\s+', ' ', 'g'))) AS parts FROM inner_html),
told AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM split)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM told"""


@query("op13_extract_main", MAIN_TEXT_SQL)
def op13_extract_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
