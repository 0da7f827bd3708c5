"""HTML pages as trees of blocks, many pages at once.

A node is a block element or a run of text in one; inline elements only add to
the text around them. Markup is read leniently: paragraphs, list items and cells
end where the next one begins, end tags without a start are passed over, and a
lone "<" is text. Blocks deeper than DEEPEST hang on their ancestor there, with
all their text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np

DEEPEST = 200

#: Fixed values of HTML: elements by what they do to the text around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose text is never text of the page.
SKIPPED = frozenset("applet audio button canvas datalist embed iframe input noembed noframes noscript object option select svg template textarea title video".split())
#: What ends an open element of the same kind: the element, and those beyond which none is looked for.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|xmp|iframe|noembed|noframes|noscript)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>"
    r"|<[!?][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?![\w-])", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

KINDS = ("text", "main", "division", "paragraph", "heading", "list", "item", "nav", "aside", "header", "footer", "form", "table", "quote", "page", "other")
KIND_OF = {
    **dict.fromkeys(("article", "main"), "main"),
    **dict.fromkeys(("div", "section", "center"), "division"),
    "p": "paragraph",
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), "heading"),
    **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"),
    **dict.fromkeys(("li", "dt", "dd"), "item"),
    **{k: k for k in ("nav", "aside", "header", "footer")},
    **dict.fromkeys(("form", "fieldset", "legend", "dialog"), "form"),
    **dict.fromkeys(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "table"),
    **dict.fromkeys(("blockquote", "pre", "figure", "figcaption", "address"), "quote"),
    **dict.fromkeys(("html", "body", "head", ""), "page"),
}
#: Words in class, id and role that say what a block is for.
HINTS = {
    "content": "article blog body content contents entry main page post story text",
    "menu": "bar breadcrumb breadcrumbs crumbs dropdown links menu nav navbar navigation pager pagination skip tabs tags toc toolbar",
    "advert": "ad ads adv advert advertisement adverts advertising affiliate banner outbrain promo promoted promotion sponsor sponsored taboola",
    "side": "aside complementary more popular recommended related rail recent share sharing sidebar social trending widget widgets",
    "foot": "bottom contentinfo copyright credits foot footer legal",
    "head": "brand head header logo masthead site top topbar",
    "notice": "alert announcement consent cookie cookies dialog disclaimer gdpr message modal newsletter notice notification overlay paywall popup privacy signup subscribe subscription toast warning",
    "reader": "comment commentary comments commentlist discussion disqus feedback forum replies reply respond responses reviews",
    "form": "contact field form input login register search signin",
    "hidden": "hidden invisible",
}
HINT_OF = {word: i for i, words in enumerate(HINTS.values()) for word in words.split()}
N_HINTS = len(HINTS)
_HIDDEN = list(HINTS).index("hidden")


@lru_cache(maxsize=1 << 14)
def hints_of(attrs: str) -> int:
    """Bits of the hints in an element's attributes."""
    bits = 0
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "style":
            bits |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)) << _HIDDEN
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            bits |= 1 << _HIDDEN
        else:
            for part in PART.findall(value):
                if (hint := HINT_OF.get(part.lower())) is not None:
                    bits |= 1 << hint
    return bits


class Level:
    """Nodes of one depth in page order, so that children of one parent stand side by side."""

    def __init__(self, nodes: np.ndarray, parents: np.ndarray):
        self.nodes, self.parents = nodes, parents
        self.begin = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))

    def add(self, total: np.ndarray, values: np.ndarray) -> None:
        """Add the values of the nodes to those of their parents."""
        total[self.parents[self.begin]] += np.add.reduceat(values, self.begin, axis=0)


class Forest:
    """Trees of several pages in arrays; a parent always stands before its children.

    `marked` says which text runs lie inside an element with the attribute `mark`,
    the label of a labelled page.
    """

    def __init__(self, mark: str | None = None):
        self.mark = mark
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.kind: list[int] = []
        self.hints: list[int] = []
        self.page: list[int] = []
        #: Of text runs: (node, text, characters inside links, marked).
        self.runs: list[tuple[int, str, int, bool]] = []
        self.pages = 0

    def _node(self, parent: int, kind: str, hints: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(KINDS.index(kind))
        self.hints.append(hints)
        self.page.append(self.pages)
        return len(self.parent) - 1

    def add(self, page: str) -> None:
        """Read one page."""
        # open elements: (tag, its block or -1 for inline ones, skipped, marked)
        root = self._node(-1, "page", 0)
        stack: list[tuple[str, int, bool, bool]] = [("", root, False, False)]
        block, links, skipped, marked = root, 0, False, False
        pending: list[str] = []
        in_links, in_marked = 0, False

        def flush() -> None:
            nonlocal in_links, in_marked
            if pending:
                text = " ".join("".join(pending).split())
                if text:
                    self.runs.append((self._node(block, "text", 0), text, in_links, in_marked))
                pending.clear()
            in_links, in_marked = 0, False

        def close(keep: int) -> None:
            """End all open elements but the first `keep`."""
            nonlocal block, links, skipped, marked
            if any(e[1] >= 0 for e in stack[keep:]):
                flush()
            links -= sum(e[0] == "a" for e in stack[keep:])
            del stack[keep:]
            block = next(e[1] for e in reversed(stack) if e[1] >= 0)
            skipped, marked = stack[-1][2:]

        def innermost(tags: set[str], beyond: set[str], blocks: bool) -> int:
            """Place of the innermost open element of these; 0 if there is none before one of `beyond`."""
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] in tags:
                    return at
                if stack[at][0] in beyond or (blocks and stack[at][1] >= 0):
                    return 0
            return 0

        def say(text: str) -> None:
            nonlocal in_links, in_marked
            if text and not skipped:
                text = html.unescape(text)
                pending.append(text)
                in_marked |= marked and not text.isspace()
                if links:
                    in_links += len(text.strip())

        at = 0
        for token in TOKEN.finditer(page):
            say(page[at : token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["end"]:
                if found := innermost({tag}, set(), tag in INLINE):
                    close(found)
                continue
            if tag in INLINE:
                if tag == "br":
                    pending.append(" ")
                elif tag not in VOID:
                    marked = marked or self._is_marked(token["attrs"])
                    stack.append((tag, -1, skipped, marked))
                    links += tag == "a"
                continue
            if tag in ENDS and (found := innermost(*ENDS[tag], False)):
                close(found)
            if found := innermost({"p"}, set(), True):
                close(found)
            flush()
            if tag in VOID:
                continue
            attrs = token["attrs"]
            parent = block
            if self.depth[parent] < DEEPEST:
                block = self._node(parent, KIND_OF.get(tag, "other"), hints_of(attrs) if attrs else 0)
            skipped, marked = skipped or tag in SKIPPED, marked or self._is_marked(attrs)
            stack.append((tag, block, skipped, marked))
        say(page[at:])
        flush()
        self.pages += 1

    def _is_marked(self, attrs: str | None) -> bool:
        return self.mark is not None and bool(attrs) and self.mark in attrs

    def levels(self) -> list[Level]:
        """The nodes of every depth."""
        depth, parent = np.array(self.depth, np.int64), np.array(self.parent, np.int64)
        order = np.argsort(depth, kind="stable")
        return [Level(nodes, parent[nodes]) for nodes in np.split(order, np.cumsum(np.bincount(depth))[:-1])] if len(order) else []
