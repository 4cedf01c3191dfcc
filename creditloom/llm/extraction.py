"""Main text of web pages by composite text density.

A page is parsed into elements. Every element gets its characters per tag, lowered by the share of
characters and tags in links (the composite text density); an element's density sum adds up its
children's densities. The element with the largest sum is the core of the article, and the lowest
density on the path from the body to it is the threshold: subtrees off that path count as content
if they reach it, the others are dropped. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments are known by their element, role, class or id and never count; an
element so called by class or id that holds most of the page's plain text counts all the same. If
the core lies in an ``article`` or ``main`` element, that element bounds the text and is taken
whole.

Null, empty and text-less pages give an empty text. Unclosed and crossed tags are closed as
browsers do for the common cases. Pages are read whole, each by itself; repeated rows are alike.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# --- Fixed values: kinds of elements --------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
NOISE = frozenset(
    "aside button canvas datalist dialog fieldset footer form head header iframe menu nav noembed"
    " noframes noscript object option script select style svg template textarea title xmp".split()
)
NOISE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search"
    " toolbar".split()
)
NOISE_NAMES = frozenset(
    "ad ads adbox advert advertisement adverts banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation"
    " newsletter notice notices notification pagination popup promo related share sharing sidebar"
    " social sponsor sponsored subscribe toolbar widget".split()
)
# Beside a noise name these leave it one, as in "site-footer"; "has-sidebar" and "related-work" are none.
PLACE_NAMES = frozenset(
    "area bar block bottom box container global inner left list main outer page primary right secondary"
    " section site slot top wrap wrapper".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section"
    " summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag ends an open element of these kinds, unless one of the walls lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
PARAGRAPH_ENDS = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")

_NAMES = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("name", "noise", "named", "children", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, noise: bool = False, named: bool = False):
        self.name = name
        self.noise = noise
        self.named = named  # noise by class or id alone, unless it holds most of the page's text
        self.children: list[Element | str] = []


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-case name; of a repeated name the first counts, as in browsers."""
    found: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(text):
        if match[1]:
            found.setdefault(match[1].lower(), (match[2] or match[3] or match[4] or "").lower())
    return found


def _noise(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is noise by its kind, role or hiding, and whether by class or id."""
    if name in NOISE:
        return True, False
    if not attributes or name in ("body", "html"):
        return False, False
    marks = _attributes(attributes)
    if "hidden" in marks or marks.get("aria-hidden") == "true" or marks.get("role", "").strip() in NOISE_ROLES:
        return True, False
    names = f"{marks.get('class', '')} {marks.get('id', '')}".split()
    if not NOISE_NAMES.isdisjoint(names):
        return False, True
    # An article marked, say, "post comments-list" is one all the same.
    return False, name not in ("article", "main") and any(
        not NOISE_NAMES.isdisjoint(parts) and NOISE_NAMES | PLACE_NAMES >= set(parts)
        for parts in map(_NAMES.findall, names)
    )


def _settle(root: Element) -> None:
    """Turn elements that are noise by name into noise, but for those that hold the page's article.

    That is one with most of the plain text (not in links) and no ``article`` or ``main`` outside.
    """
    order, waiting = [], [root]
    while waiting:
        element = waiting.pop()
        order.append(element)
        waiting += [c for c in element.children if not isinstance(c, str) and not c.noise]
    if not any(element.named for element in order):
        return
    for element in reversed(order):
        element.chars, element.tags = 0, element.name in ("article", "main")  # plain text, articles
        for child in element.children:
            if isinstance(child, str):
                element.chars += len("".join(child.split()))
            elif not child.noise:
                element.chars += child.chars
                element.tags += child.tags
        if element.name == "a":
            element.chars = 0
    for element in order:
        if element.named:
            element.noise = 2 * element.chars <= root.chars or element.tags < root.tags


def parse(page: str) -> Element:
    """The page's elements below one root; comments and the inside of raw elements are left out."""
    root = Element("html")
    stack = [root]
    at = 0
    while True:
        found = _TAG.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].children.append(text)
        if not found:
            _settle(root)
            return root
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
                if stack[depth].name in ("table", "article", "body") and name not in BLOCKS:
                    break
            continue
        if name == "html":
            continue
        if name in PARAGRAPH_ENDS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p":
                    del stack[depth:]
                    break
                if stack[depth].name in BLOCKS:
                    break
        if name in ENDS:
            ended, walls = ENDS[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in walls:
                    break
                if stack[depth].name in ended:
                    del stack[depth:]
                    if name not in ("tr", "tbody"):
                        break
        element = Element(name, *_noise(name, found[3]))
        stack[-1].children.append(element)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if name != "noscript" or end:
                at = end.end() if end else len(page)
        elif name not in VOID and not found[3].rstrip().endswith("/"):
            stack.append(element)
        elif name not in VOID and name not in ("svg", "path"):
            stack.append(element)  # HTML has no self-closing form of other elements


def _order(root: Element) -> list[Element]:
    """Elements that may count, parents before children."""
    order, waiting = [], [root]
    while waiting:
        element = waiting.pop()
        order.append(element)
        waiting += [c for c in element.children if not isinstance(c, str) and not c.noise]
    return order


def measure(root: Element) -> list[Element]:
    """Set every element's counts, density and density sum; returns them parents first."""
    order = _order(root)
    for element in reversed(order):
        chars = tags = link_chars = link_tags = 0
        for child in element.children:
            if isinstance(child, str):
                chars += len("".join(child.split()))
            elif not child.noise:
                chars += child.chars
                tags += child.tags + 1
                link_chars += child.link_chars
                link_tags += child.link_tags + (child.name == "a")
        element.chars, element.tags = chars, tags
        element.link_chars = chars if element.name == "a" else link_chars
        element.link_tags = link_tags
    body_share = root.link_chars / root.chars if root.chars else 0.0
    for element in order:
        element.density = _density(element, body_share)
    for element in order:
        element.total = sum(c.density for c in element.children if not isinstance(c, str) and not c.noise)
    return order


def _density(element: Element, body_share: float) -> float:
    """Characters per tag times a logarithm whose base grows with the links around."""
    if not element.chars:
        return 0.0
    tags = max(element.tags, 1)
    plain = max(element.chars - element.link_chars, 1)
    ratio = element.chars / max(element.link_chars, 1) * tags / max(element.link_tags, 1)
    base = math.log(element.chars / plain * element.link_chars + body_share * element.chars + math.e)
    scale = math.log(ratio) / math.log(base) if base > 1 else math.log(ratio)
    return element.chars / tags * max(scale, 0.0)


def _path(root: Element, target: Element) -> list[Element]:
    parents: dict[int, Element] = {}
    for element in _order(root):
        for child in element.children:
            if not isinstance(child, str):
                parents[id(child)] = element
    path = [target]
    while path[-1] is not root:
        path.append(parents[id(path[-1])])
    return path[::-1]


def main_elements(root: Element) -> tuple[Element, set[int]]:
    """The element whose text is the article, and the ids of subtrees below it to leave out."""
    order = measure(root)
    core = max(order, key=lambda element: element.total)  # of equal ones the outermost
    if not core.total:
        return root, set()
    path = _path(root, core)
    for element in path:
        if element.name in ("article", "main"):
            return element, set()
    threshold = min(element.density for element in path)
    dropped = set()
    on_path = set(map(id, path))
    for element in path[:-1]:
        for child in element.children:
            if not isinstance(child, str) and id(child) not in on_path and not child.noise:
                if child.density < threshold:
                    dropped.add(id(child))
    return root, dropped


def blocks(element: Element, dropped: set[int]) -> list[str]:
    """Texts of the blocks in page order, white space runs turned into one space."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    waiting: list = [element]
    while waiting:
        item = waiting.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            parts.append(item)
        elif not item.noise and id(item) not in dropped:
            if item.name in BLOCKS:
                close()
                waiting.append(None)
            elif item.name == "br":
                parts.append(" ")
            waiting += reversed(item.children)
    close()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not page:
        return ""
    return "\n\n".join(blocks(*main_elements(parse(page))))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and its code points ``n_chars`` for each row."""
    kept = pages.select("page_id", "url", "html")
    schema = kept.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [main_text(page.as_py()) for page in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array(np.fromiter(map(len, texts), np.int64, len(texts))),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    return kept.mapInArrow(rows, schema)
