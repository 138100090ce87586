"""Main text of a web page by block rules in two passes.

The page is cut into blocks at block-level tags. The first pass decides a block as article or not by link
density, length and the density of stop words; its place is a further feature: what stands inside menus, forms,
notices, comments and the like is none, and in the page's article or main less is asked of a block than outside.
On a page where no block has enough stop words (another language) length and link density decide alone.
Blocks that are not decided inherit, in the second pass, the label of the nearest decided neighbours. Decided
blocks are never cut or capped. A form or an element named like boilerplate that wraps the page's article or main,
or all its text, counts as a wrapper and not as boilerplate; html and body are never boilerplate.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairgraph.llm.common import small_batches
from pairgraph.plans.store import materialize

#: Frequent function words of English, French, German and Spanish: a free choice.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their
    they this to was we were which will with you
    au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour
    que qui sa se ses son sur un une vous
    als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat im ist
    mit nach nicht noch oder sich sie sind so um und von war werden wie wird zu zum zur über
    al como con del desde el ella entre era esta este ha hay las lo los me mi muy más no nos o para pero por se
    ser si sin sobre su sus también todo una uno y ya
    """.split()
)
# Elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody
    td tfoot th thead tr ul
    """.split()
)
OUTSIDE = frozenset(
    """
    applet aside audio button canvas datalist dialog footer form frame frameset head iframe input label map math menu
    nav noframes noscript object optgroup option select svg template textarea title video
    """.split()
)
#: Words in class, id, role and itemprop attributes that name boilerplate and content: a free choice.
BOILERPLATE = frozenset(
    """
    ad ads adslot advert advertisement advertising adverts alert banner breadcrumb breadcrumbs
    captcha comment comments commentlist complementary consent contentinfo cookie cookies copyright cta dialog
    discussion disqus footer form gdpr login masthead menu menubar modal nav navbar navigation
    newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion
    promotions recommendation recommendations recommended related replies reply respond responses search share
    sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe subscription toolbar
    topbar widget widgets
    """.split()
)
CONTENT = frozenset("article articlebody body content entry hentry main post posting story text".split())

_RAW = r"script|style|xmp|noembed|noframes|iframe|textarea|title|noscript|template|svg|math"
_TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))
    | <(?P<raw>{_RAW})(?=[\s/>])[^>]*> .*? (?: </(?P=raw)(?=[\s/>])[^>]*> | \Z )
    | <[!?][^>]*(?:>|\Z)
    | <(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>
    | <(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)[^>]*(?:>|\Z)""",
    re.I | re.S | re.X,
)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class BlockRules:
    """links: share of linked characters over which a block is no article. short: characters under which it is
    undecided. low, high: stop-word densities under which a block is no article and from which it is."""

    links: float = 0.33
    short: int = 70
    long: int = 200
    low: float = 0.08
    high: float = 0.2


@dataclass
class Block:
    text: str
    heading: bool
    links: float
    hint: int  # 2: in an article element, 1: in main, -1: in boilerplate, 0: in none of them
    content: bool  # in an element named as content
    label: int = field(default=0)
    box: int = 0  # the outermost form or element named as boilerplate around it, if nothing else keeps it out
    held: int = 0  # the article or main around it in that box
    framed: bool = False  # whether that box holds page structure


def _hints(attrs: str) -> tuple[int, bool]:
    """Whether the attributes name boilerplate (1) or hide the element (2), and whether they name content."""
    if "=" not in attrs and "hidden" not in attrs:
        return 0, False
    words: set[str] = set()
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return 2, False
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 2, False
            continue
        words |= {w.lower() for w in _PART.findall(value)} | {w.lower() for w in re.split(r"[^A-Za-z]+", value)}
    good = bool(words & CONTENT)
    bad = bool(words & BOILERPLATE) or "header" in words and not good
    return int(bad), good and not bad


def blocks_of(page: str, wrappers: frozenset[int] = frozenset()) -> list[Block]:
    """Blocks with text in page order. wrappers: boxes that are no boilerplate here."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int, int]] = []  # open block elements: name, hint, content, box, held
    framed: set[int] = set()
    number = 0
    text: list[str] = []
    linked = in_link = 0
    heading = False
    at = 0

    def state() -> tuple[int, bool, int, int]:
        return stack[-1][1:] if stack else (0, False, 0, 0)

    def flush() -> None:
        nonlocal linked
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                hint, content, box, held = state()
                out.append(Block(body, heading, min(1.0, linked / len(body)), hint, content, box=box, held=held))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if in_link:
            linked += len(piece.strip())

    def open_(name: str, attrs: str) -> None:
        nonlocal number
        number += 1
        hint, content, box, held = state()
        bad, good = _hints(attrs) if name not in ("html", "body") else (0, False)  # the page's name says nothing of a part
        out_ = name in OUTSIDE and name != "form" or bad == 2 or name == "header" and hint < 1
        named = name == "form" or bad == 1
        body = name == "article" or good and bool(re.search(r"\barticleBody\b", attrs))
        if box and (out_ or named or name == "h1"):
            framed.add(box)
        if hint == -1:
            if out_ or held and named:
                box = held = 0
            elif box and not held and (body or name == "main"):
                held = number
        elif out_:
            hint = -1
        elif named and number not in wrappers:
            hint, box, held = -1, number, number if name in ("article", "main") else 0
        elif body:
            hint = 2
        elif name == "main":
            hint = max(hint, 1)
        stack.append((name, hint, content or good, box, held))

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append("\n")
        elif name == "a":
            in_link = 0 if m["close"] or m["close2"] else 1
        elif name in BLOCK or name in OUTSIDE and name not in VOID:
            cell = name in ("td", "th")
            if cell:
                text.append(" ")
            else:
                flush()
            if name[0] == "h" and name[1:].isdigit():
                heading = not (m["close"] or m["close2"])
            elif not cell:
                heading = False
            if m["close"] or m["close2"]:
                in_link = 0 if not cell else in_link
                close(name)
            elif name not in VOID:
                if name == "p" or name in BLOCK:  # a new block ends an open paragraph
                    if stack and stack[-1][0] == "p":
                        stack.pop()
                if name == "li" and any(s[0] == "li" for s in stack):
                    _end_item(stack)
                open_(name, m["attrs"] or "")
        elif not (m["close"] or m["close2"]) and name not in VOID and (m["attrs"] or ""):
            bad, _ = _hints(m["attrs"])
            if bad and name in ("span", "section", "ins"):
                flush()
                open_(name, m["attrs"])
        elif (m["close"] or m["close2"]) and any(s[0] == name for s in stack):
            flush()
            close(name)
    if at < len(page):
        add(page[at:])
    flush()
    for b in out:
        b.framed = b.box in framed
    return out


def _end_item(stack: list[tuple[str, int, bool, int, int]]) -> None:
    """Close an open list item of the same list."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in ("ul", "ol", "menu", "dir"):
            return
        if stack[i][0] == "li":
            del stack[i:]
            return


def _by_text(b: Block, rules: BlockRules) -> int:
    """1, -1 or 0 (undecided) by link density, length and stop-word density alone."""
    if b.links > rules.links or "©" in b.text:
        return -1
    if b.heading or len(b.text) < rules.short:
        return 0
    words = _WORD.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return 1 if density >= rules.high or len(b.text) > rules.long and density >= rules.low else -1 if density < rules.low else 0


def _place(blocks: list[Block], found: list[int], rules: BlockRules) -> int:
    """The hint that speaks for a block on this page: 2 (articles), 1 (main) or 0 (neither). Articles that hold less
    than the text found outside them are teasers or notes."""
    top = max((b.hint for b in blocks), default=0)
    if top == 2:
        inside = sum(len(b.text) for b in blocks if b.hint == 2 and not b.heading and b.links <= rules.links)
        if inside < sum(len(b.text) for b, v in zip(blocks, found, strict=True) if b.hint in (0, 1) and v > 0):
            return 1 if any(b.hint == 1 for b in blocks) else 0
    return max(0, top)


def classify(blocks: list[Block], rules: BlockRules = BlockRules()) -> list[Block]:
    """The same blocks with labels 1 (article) or -1.

    Densities and length decide; a block in the page's article or main is spared the stop words, and one outside
    must be long and full of them. On pages with neither, elements named as content are taken but for links.
    """
    found = [_by_text(b, rules) for b in blocks]
    if not any(v > 0 for b, v in zip(blocks, found, strict=True) if b.hint >= 0):
        found = [_by_text(b, replace(rules, low=0.0, high=0.0)) for b in blocks]  # the stop words of another language
    place = _place(blocks, found, rules)
    content = all(b.hint < 1 for b in blocks) and any(b.content and b.hint == 0 for b in blocks)
    zones = [-1 if b.hint < 0 else 1 if place and b.hint == place else 0 for b in blocks]
    for b, v, zone in zip(blocks, found, zones, strict=True):  # first pass
        if zone < 0:
            b.label = -1
        elif zone:
            b.label = 0 if b.heading else -1 if b.links > rules.links else max(0, v)
        elif place:
            b.label = 0 if b.heading or v > 0 and len(b.text) <= rules.long else v  # a title may stand before the article
        elif content:
            b.label = (0 if b.heading else -1) if not b.content else -1 if v < 0 and (b.links > rules.links or "©" in b.text) else 1
        else:
            b.label = v
    if place:  # second pass, where no label is handed into or out of the article but to a title
        _inherit([b for b, z in zip(blocks, zones, strict=True) if z > 0], 1)
        _inherit([b for b, z in zip(blocks, zones, strict=True) if not z and not b.heading], -1)
    _inherit(blocks, 1)
    return blocks


def _inherit(blocks: list[Block], alone: int) -> None:
    """Give undecided blocks their neighbours' labels, or alone if nothing is decided."""
    before, after = _nearest(blocks), [len(blocks) - 1 - k if k is not None else None for k in _nearest(blocks[::-1])][::-1]
    given = [b.label or _inherited(blocks, i, before[i], after[i]) or alone for i, b in enumerate(blocks)]
    for b, label in zip(blocks, given, strict=True):
        b.label = label


def _nearest(blocks: list[Block]) -> list[int | None]:
    """For each block the nearest decided one before it."""
    out, last = [], None
    for i, b in enumerate(blocks):
        out.append(last)
        last = i if b.label else last
    return out


def _inherited(blocks: list[Block], i: int, before: int | None, after: int | None) -> int:
    """The label of the nearest decided neighbour, of two that are as near that of the one before; a heading takes that of
    what follows; 0 if nothing is decided."""
    if before is None or after is None:
        k = after if before is None else before
        return 0 if k is None else blocks[k].label
    if blocks[i].heading:
        return blocks[after].label
    return blocks[before if i - before <= after - i else after].label


def _wrapper(blocks: list[Block], rules: BlockRules) -> int:
    """The box that isn't boilerplate but wraps the page's text, 0 if there is none.

    It holds an article or main where no other has text, or a single one with more text than all others; or, on a
    page without any text outside boxes, it holds the most text, and page structure or half of the page.
    """
    size = [len(b.text) if not b.heading and b.links <= rules.links else 0 for b in blocks]
    inside = sum(n for b, n in zip(blocks, size, strict=True) if b.hint > 0)
    held: dict[int, int] = {}
    parts: dict[int, set[int]] = {}
    for b, n in zip(blocks, size, strict=True):
        if b.held and n:
            held[b.box] = held.get(b.box, 0) + n
            parts.setdefault(b.box, set()).add(b.held)
    for box in sorted(held, key=held.get, reverse=True):
        if not inside or held[box] > inside and len(parts[box]) == 1:
            return box
    if inside or any(b.hint == 0 and (b.content or _by_text(b, rules) > 0) for b in blocks):
        return 0
    whole = sum(len(b.text) for b in blocks)
    best, most = 0, 0
    for box in {b.box for b in blocks if b.box}:
        own = [b for b in blocks if b.box == box]
        text = [len(b.text) for b in own if _by_text(b, rules) > 0]
        if sum(text) > most and (own[0].framed or len(text) > 1 and 2 * sum(len(b.text) for b in own) >= whole):
            best, most = box, sum(text)
    return best


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    if not page:
        return ""
    wrappers: frozenset[int] = frozenset()
    blocks = blocks_of(page)
    while any(b.box for b in blocks) and (box := _wrapper(blocks, rules)):
        wrappers |= {box}
        blocks = blocks_of(page, wrappers)
    return "\n".join(b.text for b in classify(blocks, rules) if b.label > 0)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: BlockRules = BlockRules()) -> DataFrame:
    """Per row of pages: the id, the URL, text and n_chars (its code points).

    Null and empty pages, and pages without an article, have an empty text. Null ids and URLs are carried,
    equal rows come back one by one, an empty table gives no rows, and extra columns are ignored. Pages are
    read a few at a time, so long ones need the memory of one. The result is written to the shared folder.
    """
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, rules) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    types = [narrow.schema[c].dataType.simpleString() for c in ("id", "url")]
    with small_batches(pages.sparkSession, 256):
        out = materialize(narrow.mapInArrow(run, f"id {types[0]}, url {types[1]}, text string, n_chars bigint"), "main-texts")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
