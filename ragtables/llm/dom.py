"""Leaf blocks of a page: a tolerant, linear reader of HTML that keeps what encloses each block."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|
    <(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>|[^>]*+>)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?(?=[\s/>]|$)""", re.I)

# Elements of HTML by their part in the layout.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
    section select summary table tbody td tfoot th thead tr ul""".split())
VOIDS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas noembed noframes xmp".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SEMANTIC = frozenset("""nav header footer aside form article main section ul ol li table figure figcaption button select label
    dialog details menu address h1 h2 h3 h4 h5 h6 p blockquote pre a fieldset div""".split())
#: Parts of class names, ids and roles, and what they tell.
HINTS = (
    ("menu", ("nav", "menu", "breadcrumb", "pager", "pagination", "tabs", "toolbar", "skip")),
    ("header", ("header", "masthead", "banner", "topbar", "logo", "branding")),
    ("footer", ("footer", "copyright", "colophon", "contentinfo", "legal", "bottom")),
    ("side", ("side", "aside", "widget", "rail", "complementary")),
    ("related", ("related", "recommend", "popular", "trending", "teaser", "more-", "readnext", "outbrain")),
    ("advert", ("advert", "sponsor", "promo", "adsense", "adslot", "dfp")),
    ("notice", ("cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall", "gdpr", "notification", "signup")),
    ("form", ("form", "search", "login", "contact")),
    ("comment", ("comment", "reply", "replies", "disqus", "discussion", "respond", "feedback")),
    ("meta", ("share", "social", "byline", "meta", "author", "date", "tags", "crumb")),
    ("content", ("content", "article", "post", "entry", "story", "main", "text", "body")),
)
_AD = re.compile(r"(?:^|[^a-z])ads?(?:[^a-z]|$)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """Text of a leaf block, with the features of the elements around it and the share of it that is links."""

    text: str
    around: frozenset[str]
    linked: float
    parent: int


def _hints(attributes: str) -> set[str]:
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            found.add("in:hidden")
        elif name in ("class", "id", "role"):
            for hint, parts in HINTS:
                if any(p in value for p in parts):
                    found.add(f"in:{hint}")
            if _AD.search(value):
                found.add("in:advert")
    return found


def leaf_blocks(page: str) -> list[Block]:
    """Blocks with text, in page order: text between borders of block elements, character references decoded.

    White space inside a block becomes one space. Comments, declarations, scripts, styles and other raw elements go.
    Elements that HTML lets end silently are closed; end tags without an open element are ignored. One step per tag.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset, int]] = [("", frozenset(), 0)]
    counts: dict[str, int] = {}
    pieces: list[str] = []
    linked = at = elements = 0

    def flush():
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            inner = max((s for s in reversed(stack) if s[0] in BLOCKS or not s[0]), key=lambda s: s[2])
            blocks.append(Block(text, stack[-1][1], min(1.0, linked / len(text)), inner[2]))
        pieces.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if counts.get("a"):
            linked += len(text.strip())

    def pop():
        name = stack.pop()[0]
        counts[name] -= 1

    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                pieces.append(" ")
            elif counts.get(name):
                if name in BLOCKS:
                    flush()
                while stack[-1][0] != name:
                    if stack[-1][0] in BLOCKS:
                        flush()
                    pop()
                pop()
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>|\\Z", re.I).search(page, at)
            at = end.end()
            continue
        if name in BLOCKS:
            flush()
            ending = CLOSES.get(name, set()) | ({"p"} if name not in ("button", "option") else set())
            # A list item or cell ends its like inside its own list or table only.
            for depth in range(len(stack) - 1, max(0, len(stack) - 12), -1):
                if stack[depth][0] in ending and counts.get(stack[depth][0]):
                    while len(stack) > depth:
                        pop()
                elif stack[depth][0] in ("ul", "ol", "dl", "table", "article", "main", "section", "body", "form", "nav"):
                    break
        elif name == "br":
            pieces.append(" ")
        if name in VOIDS or m[0].endswith("/>") and name not in BLOCKS:
            continue
        elements += 1
        attributes = m["attrs"][:-1]
        own = _hints(attributes) if "=" in attributes or "hidden" in attributes else set()
        if name in SEMANTIC:
            own.add(f"tag:{name}")
            if name in ("header", "footer", "section", "aside") and "tag:article" in stack[-1][1]:
                own.add(f"within:{name}")
        around = stack[-1][1] | own if own else stack[-1][1]
        stack.append((name, around, elements))
        counts[name] = counts.get(name, 0) + 1
    if at < len(page):
        add(page[at:])
    flush()
    return blocks
