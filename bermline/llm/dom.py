"""A small tolerant reader of HTML: the element tree of a page with its texts in order."""
from __future__ import annotations

import re
from dataclasses import dataclass, field

# Fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe".split())
UNSEEN = frozenset("select metadata desc annotation annotation-xml".split())  # elements whose texts are controls or never shown
BLOCK = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "button", "title"}
ENDS_SELECT = BLOCK - {"option", "optgroup", "hr", "button", "div", "legend"}
# A start tag ends these open elements, up to the nearest of its own bounds
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*>?|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>\x00]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")


@dataclass
class Page:
    """Elements in page order: tag, attribute text, parent. Texts in page order: owner, block number, raw text."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    attrs: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def read_page(html: str) -> Page:
    """Elements and texts of a page. Unclosed and stray tags are tolerated; contents of RAW and UNSEEN elements are not texts.

    An unclosed element ends with its parent, an unclosed select also at the next block, RAW ones at the end of the page.
    """
    page = Page()
    stack, at, block = [0], 0, 0
    unseen = 0  # place on the stack of the outermost UNSEEN element, 0 if none
    tags, attrs, parents, texts = page.tags, page.attrs, page.parents, page.texts
    while True:
        m = _TAG.search(html, at)
        if m is None:
            if at < len(html) and not unseen:
                texts.append((stack[-1], block, html[at:]))
            return page
        if m.start() > at and not unseen:
            texts.append((stack[-1], block, html[at : m.start()]))
        at = m.end()
        if m["cdata"] and not unseen:
            texts.append((stack[-1], block, m["cdata"]))
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in BLOCK:
            block += 1
        if m["close"]:
            k = len(stack) - 1
            while k > 0 and tags[stack[k]] != name:
                k -= 1
            if k:
                del stack[k:]
            unseen = unseen if unseen < len(stack) else 0
            continue
        if unseen and name in ENDS_SELECT and tags[stack[unseen]] == "select":
            del stack[unseen:]
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == "p":
                    del stack[k:]
                    break
                if tags[stack[k]] in CLOSES_P:
                    break
        if name in ENDS:
            ends, bounds = ENDS[name]
            cut = None
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in bounds:
                    break
                if tags[stack[k]] in ends:
                    cut = k
            if cut is not None:
                del stack[cut:]
        unseen = unseen if unseen < len(stack) else 0
        tags.append(name)
        attrs.append(m["attrs"])
        parents.append(stack[-1])
        if name in VOID or m["attrs"].endswith("/") and (name not in BLOCK and name not in RAW or any(tags[k] in ("svg", "math") for k in stack)):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.append(len(tags) - 1)
        if name in UNSEEN and not unseen:
            unseen = len(stack) - 1
