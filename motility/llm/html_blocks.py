"""Main text of HTML pages by two passes over their blocks.

The first pass classifies each block by its length and the densities of its stop words and links; where it stands, inside an article or main element or
outside, only shifts what is asked of it. Where no list of stop words fits a page, the page's own common words take its place, and no block is furniture for lack of them. Blocks that are too short or too unusual to tell are left open; in the second pass they inherit the label
of the nearest decided neighbours. What is no prose by its element (scripts, menus, footers, buttons) never becomes part of a block, and blocks under a class, id or role
that names furniture are set aside; they are looked at only where a page has nothing else.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motility.llm.common import small_batches
from motility.llm.quality import COMMON_WORDS

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*>)|<[!?][^>]*>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Element names by their part in a page.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
FURNITURE = {"nav", "footer", "aside", "menu", "noscript", "template", "button", "select", "dialog", "svg", "annotation", "annotation-xml", "object", "audio", "video", "canvas", "head"}
FORMS = {"form", "fieldset"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words in class, id and role names that mark furniture, and words of layout that may stand beside them.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "signup popup modal overlay sidebar sidebars complementary menu nav navbar navigation breadcrumb breadcrumbs masthead footer contentinfo comment comments commentlist disqus respond reply replies "
    "discussion share sharing social related recommended recommendations widget toolbar login search pagination pager copyright skip".split()
)
LAYOUT = set(
    "area article bar block bottom box btn button buttons card column container content div first fixed form global group header heading holder icon icons inner item items left link links list lists "
    "mobile outer page panel post posts primary region reader right row secondary section site slot sticky stories story thread title top unit user wrap wrapper".split()
)
#: What closes an open element of the same kind when it begins.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"}, "option": {"option"}}
LIMITS_OF_SIBLINGS = {"ul", "ol", "dl", "table", "tbody", "div", "section", "article", "main", "body", "nav", "aside", "footer", "form", "blockquote"}

STOP_WORDS = frozenset(w for words in COMMON_WORDS.values() for w in words)
MIN_WORDS, LONG_WORDS, LOW_STOPS, HIGH_STOPS, MAX_LINKS = 10, 25, 0.08, 0.15, 0.5
#: The share of a page's words that the list of one language must hold for the page to count as in it; sister languages share up to 0.15.
OWN_STOPS = 0.2
#: The share of link text under which a long block of an unknown language is prose, and from which a row of links in an article is a menu.
FEW_LINKS, ALL_LINKS, MENU_LINKS = 0.3, 0.9, 3
#: Characters of scripts without spaces; two of them count as a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]{1,2})")


@dataclass
class Block:
    text: str
    link_chars: int
    links: int
    marked: bool  # under a name of furniture, or in a form
    main: bool
    heading: bool


@dataclass(slots=True)
class _Open:
    """An open element, and what holds for the text in it."""

    tag: str
    skip: bool = False
    marked: bool = False
    main: bool = False
    link: bool = False
    heading: bool = False
    limit: int = 0  # where the nearest element stands that keeps its own paragraphs and items


def _attributes(attrs: str):
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        yield name.lower(), a or b or c


def _hidden(attrs: str) -> bool:
    return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v) for k, v in _attributes(attrs))


def _marked(attrs: str, alone: bool) -> bool:
    """Whether class, id or role name furniture: a name all of whose words are marks or, unless ``alone``, layout, with a mark among them.

    So "cookie-notice", "comments-list" and "sidebar" do, "market-share" and "search-results-analysis" don't.
    """
    for key, value in _attributes(attrs):
        if key in ("class", "id", "role"):
            for name in value.split():
                parts = {x.lower() for x in _NAME_PARTS.findall(name) if not x.isdigit()}
                if parts & MARKS and (len(parts) == 1 if alone else parts <= MARKS | LAYOUT):
                    return True
    return False


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order. Time follows the length of the page, whatever is left unclosed."""
    found: list[Block] = []
    stack = [_Open("")]
    places: dict[str, list[int]] = {}  # where the open elements of a name stand
    pieces: list[tuple[str, bool]] = []
    links = 0

    def close_block() -> None:
        nonlocal links
        if pieces:
            text = _normal("".join(p for p, _ in pieces))
            if text:
                top = stack[-1]
                found.append(Block(text, len(_normal("".join(p for p, link in pieces if link))), links, top.marked, top.main, top.heading))
            pieces.clear()
        links = 0

    def cut(at: int) -> None:
        for e in stack[at:]:
            places[e.tag].pop()
        del stack[at:]

    def add(text: str) -> None:
        if not stack[-1].skip:
            pieces.append((text, stack[-1].link))

    at, end = 0, page.rfind(">") + 1  # no tag ends behind it
    while at < end:
        token = _TOKEN.search(page, at, end)
        if token is None:
            add(page[at:end])
            break
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        if token["tag"] is None:
            continue
        tag = token["tag"].lower()
        if tag == "br":
            pieces.append((" ", False))
            continue
        block = tag in BLOCKS
        if block:
            close_block()
        if token["end"]:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in SIBLINGS:
            last = max((places[t][-1] for t in SIBLINGS[tag] if places.get(t)), default=0)
            if last > stack[-1].limit:
                cut(last)
        attrs = token["attrs"][:-1]
        if attrs.endswith("/") and not block and tag != "a":
            continue
        top = stack[-1]
        named = bool(attrs.strip(" /\t\n")) and tag not in ("html", "body")
        marked = named and _marked(attrs, tag in MAIN)
        skip = top.skip or tag in FURNITURE or tag == "header" and not top.main or marked and not block or named and _hidden(attrs)
        marked = marked or tag in FORMS or top.marked and not (tag in MAIN and stack[top.limit].tag in FORMS)  # a form may be around the whole page
        links += tag == "a" and not skip
        stack.append(_Open(tag, skip, marked, top.main or tag in MAIN, top.link or tag == "a", top.heading or tag in HEADINGS, len(stack) if tag in LIMITS_OF_SIBLINGS else top.limit))
        places.setdefault(tag, []).append(len(stack) - 1)
    if at < len(page) and at >= end:
        add(re.sub(r"<!--.*", "", page[at:], flags=re.DOTALL))
    elif end < len(page):
        add(re.sub(r"<!--.*", "", page[end:], flags=re.DOTALL))
    close_block()
    return found


def _normal(text: str) -> str:
    return " ".join(html.unescape(text).split())


def words_of(text: str) -> list[str]:
    return _UNSPACED.sub(r" \1 ", text).split()


def _bare(word: str) -> str:
    return word.strip(".,;:!?\"'()").lower()


def stop_density(words: list[str], stops: frozenset[str] = STOP_WORDS) -> float:
    return sum(_bare(w) in stops for w in words) / len(words)


def stops_of(blocks: list[Block]) -> tuple[frozenset[str], bool]:
    """The stop words of a page, and whether its language has a list.

    It has one if that list holds OWN_STOPS of the words in blocks that could be prose. Otherwise the page teaches its own: short words that stand three times or more, in two blocks at least.
    """
    prose = [[_bare(w) for w in words_of(b.text)] for b in blocks if b.link_chars <= FEW_LINKS * len(b.text)]
    prose = [ws for ws in prose if len(ws) >= MIN_WORDS]
    total = sum(map(len, prose))
    if not total or max(sum(w in own for ws in prose for w in ws) for own in map(frozenset, COMMON_WORDS.values())) >= OWN_STOPS * total:
        return STOP_WORDS, True
    counts, spread = Counter(w for ws in prose for w in ws), Counter(w for ws in prose for w in set(ws))
    return STOP_WORDS | {w for w, n in counts.items() if n >= 3 and spread[w] >= 2 and 0 < len(w) <= 4}, False


def first_pass(blocks: list[Block], stops: frozenset[str] = STOP_WORDS, known: bool = True) -> list[bool | None]:
    """Text, furniture or open, of each block. ``known``: the page is in a language with a list, so that a lack of stop words tells something."""
    return [_label(b, stops, known) for b in blocks]


def _label(block: Block, stop_words: frozenset[str], known: bool) -> bool | None:
    words, links = words_of(block.text), block.link_chars / len(block.text)
    if links > MAX_LINKS and (not block.main or links >= ALL_LINKS and block.links > MENU_LINKS):
        return False
    if len(words) < MIN_WORDS or block.heading or links > MAX_LINKS:
        return None
    stops = stop_density(words, stop_words)
    if block.main:  # prose is expected here
        return True if stops >= LOW_STOPS or not known else None
    if stops >= HIGH_STOPS or len(words) >= LONG_WORDS and (stops >= LOW_STOPS or not known and links <= FEW_LINKS):
        return True
    return None if len(words) < LONG_WORDS or not block.links or not known else False


def second_pass(labels: list[bool | None], headings: list[bool], default: bool = True) -> list[bool]:
    """Open blocks take the label of the nearest decided block; at equal distance headings that of the next one, others of the one before. None decided: ``default``."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            last = i if labels[i] is not None else last
            near[i] = last
    out = []
    for i, label in enumerate(labels):
        b, a = before[i], after[i]
        if label is None:
            near = a if b is None or a is not None and a - i < i - b + headings[i] else b
            label = default if near is None else labels[near]
        out.append(bool(label))
    return out


def text_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks that both passes take for text.

    Where an article or main element holds at least as many words as the prose outside, what is outside is no part of it. Otherwise (an article of a few words, a teaser) both sides
    are judged, each by its own neighbours.
    """
    plain = [b for b in blocks if not b.marked] or blocks
    size = lambda side: sum(len(words_of(b.text)) for b in side)
    stops, known = stops_of(plain)
    sides = [b for b in plain if b.main], [b for b in plain if not b.main]
    prose = [b for b, good in zip(sides[1], first_pass(sides[1], stops, known), strict=True) if good]
    judged = sides[:1] if sides[0] and size(sides[0]) >= size(prose) else sides
    kept = set()
    for side in judged:
        good = second_pass(first_pass(side, stops, known), [b.heading for b in side], default=not sides[0] or side is sides[0])
        kept |= {id(b) for b, g in zip(side, good, strict=True) if g}
    return [b for b in plain if id(b) in kept]


def main_text(page: str | None) -> str:
    """The text blocks of a page, one per line."""
    return "\n".join(b.text for b in text_blocks(blocks_of(page or "")))


def extract(pages: DataFrame, html_col: str = "html", name: str = "main_text") -> DataFrame:
    """Adds the column ``name`` with the main text of each page: its blocks in page order, white space as single spaces, joined by newlines.

    A null or empty page, and one without text, gives the empty string. Broken markup does no harm: unclosed elements end with what encloses them. Whole pages of
    any length are taken, in time that follows their length. An open block as near to the one before as to the one behind takes the label of the one before, a heading that of the one
    behind. Repeated rows are extracted each; other columns are kept, one called ``name`` is replaced. An empty table gives no rows.
    """

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    small_batches(pages.sparkSession)
    return pages.withColumn(name, run(html_col))
