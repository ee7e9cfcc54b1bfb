"""Main text of HTML pages by two passes of block rules.

Pass one classifies every text block by its stop-word density, length and link density: long blocks of many function
words and few links are good, blocks of links are bad, the rest is ambiguous (near or short). Markup is a prior: what
stands in menus, footers, sidebars, notices, adverts, forms or comments, or outside the article of a page that has one,
can't be good, however much it reads like an article, and inside an article few function words alone make nothing bad.
Pass two gives ambiguous blocks the label of their nearest decided neighbours of the same prior (what markup marks ends
where the markup ends); the prior speaks only where none is decided.

Defined results: a null or empty page has an empty text; null urls stay null; repeated rows are kept; an empty table
gives no rows; further columns are ignored; broken markup (unclosed or stray tags, cut pages) never fails; pages
are read whole, so memory is bounded by the longest page; of two equally near neighbours that differ, the good one
counts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import small_batches, table

MAX_LINK_DENSITY = 0.33
SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it was for on are as with his they at be this from or had by not but what all were we when "
    "your can there an which their if will each about how up out them then she many some so these would has her him could "
    "der die das und ist von zu mit den im für auf ein eine des dem nicht als auch es an aus wie bei oder wird sich war "
    "le la les et de des du un une est en que qui dans pour par sur au avec ce il pas plus ne se sont ou aux cette "
    "el los las y del que en un una por con para es no su al lo como más pero sus este son entre ha".split()
)
#: Elements whose text never counts, elements that are boilerplate, elements that end a block.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select option textarea button audio video map datalist".split())
BOILER = frozenset("nav footer aside form menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class names, ids and roles that mark boilerplate.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations comment comments disqus replies respond widget widgets toolbar "
    "pagination pager login search complementary contentinfo copyright legal disclaimer skip paywall teaser".split()
)
HEADER_WORDS = frozenset(("header", "topbar"))
NEGATED = frozenset("has with no without".split())
MAIN_WORDS = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
_CAMEL = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")
_CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    boiler: bool
    inside: bool
    label: str = ""
    prior: int = 0


def _names(attrs: str) -> tuple[bool, bool, bool, bool]:
    """(boilerplate, page header, main, hidden) as the attributes say."""
    boiler = header = main = hidden = False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), entities.unescape(a or b or c)
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            for x in value.split():
                words = [w.lower() for w in _CAMEL.findall(x)]
                if not words or words[0] in NEGATED:
                    continue
                if name == "role" and x.lower() in ("main", "article") or name == "itemprop" and x == "articleBody":
                    main = True
                boiler |= not BOILER_WORDS.isdisjoint(words)
                header |= not HEADER_WORDS.isdisjoint(words)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return boiler, header, main, hidden


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with what the elements around them say."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # element, silent, boilerplate, inside the article, with all above
    parts: list[str] = []
    linked = links = 0
    tag = ""
    silent = boiler = inside = False

    def close_block() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, min(linked, len(text)), tag, boiler, inside))
        parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if not silent and raw:
            parts.append(raw)
            if links:
                linked += len(" ".join(entities.unescape(raw).split()))

    def pop(to: int) -> None:
        nonlocal silent, boiler, inside, tag, links
        for name, *_ in stack[to:]:
            links -= name == "a"
        del stack[to:]
        _, silent, boiler, inside = stack[-1] if stack else ("", False, False, False)
        tag = next((x[0] for x in reversed(stack) if x[0] in BLOCK), "")

    at = 0
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        ends_block = name in BLOCK
        if m[1]:
            if ends_block:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if ends_block is False and stack[i][0] in BLOCK:
                    break  # a stray inline end tag doesn't close blocks
            continue
        if ends_block:
            close_block()
        elif name == "br":
            parts.append(" ")
        closes = [i for i, x in enumerate(stack) if x[0] in _CLOSES and name in _CLOSES[x[0]]]
        if closes:
            i = closes[-1]
            limit = max((j for j, x in enumerate(stack) if x[0] in ("ul", "ol", "dl", "table", "article", "section", "div", "body")), default=-1)
            if i > limit:
                pop(i)
        if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in SILENT and name != "a":
            continue
        b, header, main, hidden = _names(m[3]) if m[3] else (False, False, False, False)
        body = name in ("html", "body", "article", "main")
        within = inside or body and name in MAIN_WORDS or main
        b = (b and not body or name in BOILER or (name == "header" or header and not body) and not inside) and not (main or body)
        stack.append((name, silent or name in SILENT or hidden, boiler or b, within))
        silent, boiler, inside = stack[-1][1:]
        links += name == "a"
        if ends_block:
            tag = name
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            if name not in SILENT:
                text(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            pop(len(stack) - 1)
    text(page[at:])
    close_block()
    return out


def by_density(b: Block) -> str:
    """good, bad, near (nearly good) or short, by length, link density and stop-word density alone."""
    links, n = b.linked / len(b.text), len(b.text)
    if links > MAX_LINK_DENSITY:
        return "bad" if links > 2 * MAX_LINK_DENSITY or n < SHORT else "short"
    if n < SHORT:
        return "bad" if b.linked else "short"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops < STOP_LOW:
        return "bad"
    return "good" if stops >= STOP_HIGH and n > LONG else "near"


def classify(found: list[Block]) -> None:
    """Pass one: labels by density under the prior of the markup."""
    article = any(b.inside and not b.boiler for b in found)
    for b in found:
        b.prior = -1 if b.boiler or article and not b.inside else int(b.inside)
        b.label = by_density(b)
        if b.prior < 0 and b.label == "good":
            b.label = "near"
        elif b.prior > 0 and b.label == "bad":
            if len(b.text) < SHORT:
                b.label = "short"
            elif b.linked <= MAX_LINK_DENSITY * len(b.text):
                b.label = "near"


def inherit(found: list[Block]) -> None:
    """Pass two: ambiguous blocks take the label of the nearest decided neighbours of their prior; headings go with what
    follows. Near blocks need one good neighbour, or the markup's word."""
    labels = [b.label for b in found]
    n = len(labels)
    sides: list[list[int]] = [[] for _ in range(n)]  # the nearest decided before and after
    for order in (range(n), range(n - 1, -1, -1)):
        last: dict[int, int] = {}
        for i in order:
            if (at := last.get(found[i].prior)) is not None:
                sides[i].append(at)
            if labels[i] in ("good", "bad"):
                last[found[i].prior] = i
    for i, b in enumerate(found):
        if labels[i] in ("good", "bad"):
            continue
        said = [labels[j] for j in sides[i]]
        if not said or labels[i] == "near" and b.prior > 0:
            b.label = "good" if b.prior >= 0 else "bad"
        elif len(set(said)) == 1:
            b.label = said[0]
        elif labels[i] == "near":
            b.label = "good"
        elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            b.label = said[1]
        else:
            before, after = i - sides[i][0], sides[i][1] - i
            b.label = said[0] if before < after else said[1] if after < before else "good"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    inherit(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``page_id, url, html``."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(pages.select("page_id", "url", "html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
