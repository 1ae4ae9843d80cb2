"""A small HTML reader: elements in page order with their parents, and blocks of text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from xxhash import xxh64_intdigest

_TOKEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

# Fixed values of the HTML standard: elements without content, of raw text, and of block layout.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open element of the same group.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}}
_CLOSES |= {"th": {"td", "th"}, "option": {"option"}, "body": {"head"}}

# What is no part of an article: elements, roles, and whole names in class and id.
APART = frozenset("head nav header footer aside form button select dialog".split()) | RAW
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay comment comments disqus sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead share sharing social related recommended newsletter subscribe subscription "
    "widget toolbar pagination pager".split()
)


#: Elements that hold a text, which no class or id sets apart.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption li dt dd td th".split())
HEADINGS = frozenset(["h1", "h2"])
#: Apart whatever they hold; other marks end where an element turns out to hold the page's content.
REAL = frozenset("head nav aside footer button select dialog".split()) | RAW
REAL_ROLES = frozenset("navigation contentinfo complementary dialog".split())


@dataclass
class Page:
    """tags, labels (tag and classes), parents, paths (hash of labels from the root) and apart, by element; element 0 is
    the root.  blocks: (element, text, characters of it in links) in page order."""

    tags: list[str] = field(default_factory=lambda: [""])
    labels: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[int] = field(default_factory=lambda: [0])
    apart: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _is_apart(tag: str, attributes: dict[str, str]) -> bool:
    if tag in APART or attributes.get("role", "").lower() in APART_ROLES:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    if tag in TEXT:
        return False
    return not APART_WORDS.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())


def _is_real(tag: str, attributes: dict[str, str]) -> bool:
    return tag in REAL or attributes.get("role", "").lower() in REAL_ROLES


def _free_wrappers(page: Page, marked: list[bool], real: list[bool]) -> None:
    """Set apart, after marks were taken from elements that hold the content.

    Those are elements that hold a main element or, where neither article nor main stands outside all marks, an article or
    more than half of the text; what stands in a real nav, aside or footer does not count.
    """
    size, parents, tags = len(page.tags), page.parents, page.tags
    inside, apart = real[:], marked[:]
    for e in range(1, size):
        inside[e] = inside[e] or inside[parents[e]]
        apart[e] = apart[e] or apart[parents[e]]
    lost = not any(tags[e] in ("article", "main") and not apart[e] for e in range(1, size))
    wanted = ("article", "main") if lost else ("main",)
    holds, text = [False] * size, [0] * size
    for e, words, _ in page.blocks:
        if not inside[e]:
            text[e] += len(words)
    for e in range(size - 1, 0, -1):
        holds[e] = holds[e] or tags[e] in wanted and not inside[e]
        holds[parents[e]] = holds[parents[e]] or holds[e]
        text[parents[e]] += text[e]
    for e in range(1, size):
        own = marked[e] and (real[e] or not holds[e] and not (lost and 2 * text[e] > text[0]))
        page.apart[e] = page.apart[parents[e]] or own


def _tag_end(source: str, at: int) -> int:
    """Where the tag whose name ends at at ends: the first > outside quotes, or the first one if a quote stays open."""
    place = at
    while True:
        stop = _STOP.search(source, place)
        if not stop or stop[0] == ">":
            return stop.start() if stop else -1
        before = stop.start() - 1
        while before > at and source[before].isspace():
            before -= 1
        place = stop.end()
        if source[before] == "=":
            close = source.find(stop[0], place)
            if close < 0:
                return source.find(">", at)
            place = close + 1


def parse(source: str) -> Page:
    page = Page()
    marked, real = [False], [False]
    stack: list[int] = [0]
    words: list[str] = []
    linked: list[str] = []
    owner = anchors = 0

    def flush():
        nonlocal words, linked
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                page.blocks.append((owner, text, min(len(text), len(" ".join(linked).strip()))))
            words, linked = [], []

    def say(text: str):
        words.append(text)
        if anchors:
            linked.append(text)

    def pop_to(depth: int):
        nonlocal owner, anchors
        anchors -= sum(page.tags[e] == "a" for e in stack[depth:])
        if any(page.tags[e] in BLOCK for e in stack[depth:]):
            flush()
        del stack[depth:]
        owner = next((e for e in reversed(stack) if page.tags[e] in BLOCK), 0)

    def find(names, stop=BLOCK):
        """Depth of the innermost open element of names, not beyond another block."""
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.tags[stack[depth]]
            if tag in names:
                return depth
            if tag in stop:
                break
        return 0

    at, size = 0, len(source)
    while at < size:
        token = _TOKEN.search(source, at)
        if not token:
            say(source[at:])
            break
        if token.start() > at:
            say(source[at : token.start()])
        if token[0] == "<!--":
            end = source.find("-->", token.end())
            at = size if end < 0 else end + 3
            continue
        if token[2] is None:
            end = source.find(">", token.end())
            at = size if end < 0 else end + 1
            continue
        end = _tag_end(source, token.end())
        tag = token[2].lower()
        if end < 0:  # a tag that the end of the page cuts
            break
        at = end + 1
        if token[1]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if page.tags[stack[d]] == tag), 0)
            if depth:
                pop_to(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            words.append(" ")
            continue
        if tag in BLOCK:
            depth = find({"p"})
            if depth and tag != "html":
                pop_to(depth)
        if tag in _CLOSES:
            depth = find(_CLOSES[tag])
            if depth:
                pop_to(depth)
        attributes = {m[1].lower(): m[2].strip("\"'") for m in _ATTR.finditer(source, token.end(), end)}
        parent = stack[-1]
        label = tag
        if tag in BLOCK and "class" in attributes:
            label += "." + ".".join(sorted(attributes["class"].split()))
        if tag in BLOCK:
            flush()
        page.tags.append(tag)
        page.labels.append(label)
        page.parents.append(parent)
        page.paths.append(xxh64_intdigest(label.encode("utf-8", "replace"), page.paths[parent]) >> 1)
        page.apart.append(False)
        marked.append(_is_apart(tag, attributes))
        real.append(_is_real(tag, attributes))
        element = len(page.tags) - 1
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            at = close.end() if close else size
            continue
        if tag in VOID or source[end - 1] == "/" and tag not in BLOCK:
            continue
        stack.append(element)
        anchors += tag == "a"
        if tag in BLOCK:
            owner = element
    flush()
    _free_wrappers(page, marked, real)
    return page
