"""Pages as trees of block elements with runs of text as leaves."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# fixed values: groups of HTML element names
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr object canvas audio video noscript template svg select "
             "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mspace mpadded "
             "mphantom mfenced menclose mtable mtr mtd semantics annotation".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style iframe noembed noframes textarea title"
#: What stands in these is no text; a block element ends an open one of the first two, which may lack their end tag.
SILENT = {"svg", "select", "template"}
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
             "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul xmp".split())
#: An opening tag ends an open element of these, unless an element of the second list stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
        "body": ({"head"}, set())}
P_SCOPE = {"td", "th", "table", "button", "caption", "body", "html", "li"}
HEAD_ONLY = {"meta", "link", "base"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW.split()) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.S | re.I)
_ATTRS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_LABEL = re.compile(r"data-y=(\d)")


@dataclass
class Page:
    """Nodes in page order; a node's parent comes before it. Runs of text have the tag ``#text``."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, attrs: str, label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append("")
        self.linked.append(0)
        self.label.append(label)
        return len(self.tag) - 1


def parse(html: str) -> Page:
    """The tree of a page. Scripts, styles, comments and the head's title are no text; ``br`` is white space."""
    page = Page()
    stack = [("#root", page.add(-1, "#root", "", 0))]  # open elements; inline ones share their block's node
    pieces: list[str] = []
    linked = 0
    in_link = in_head = in_silent = 0
    last_template = html.lower().rfind("</template") if "<template" in html.lower() else -1

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                block = stack[-1][1]
                node = page.add(block, "#text", "", page.label[block])
                page.text[node] = text
                page.linked[node] = linked
            linked = 0

    def close(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal in_link, in_head, in_silent
        if any(name not in INLINE for name, _ in stack[k:]):
            flush()
        for name, _ in stack[k:]:
            in_link -= name == "a"
            in_head -= name == "head"
            in_silent -= name in SILENT
        del stack[k:]

    def end_open(names: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                close(k)
                return
            if stack[k][0] in scope:
                return

    def words(raw: str) -> None:
        nonlocal linked
        if in_head or in_silent or not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            linked += len(text)

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            words(html[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            if m.group("raw"):
                words(" ") if m.group("raw").lower() == "textarea" else None
            continue
        tag = tag.lower()
        if in_silent and tag in ENDS_P and not m.group("end"):
            end_open({"svg", "select"}, {"template"})
        if in_silent and tag in INLINE - SILENT:
            continue
        if m.group("end"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                if tag == "br":
                    words(" ")
            continue
        if tag == "br":
            words(" ")
            continue
        if in_silent and tag not in SILENT:
            continue
        if tag in HEAD_ONLY:
            continue
        if tag in ENDS_P:
            end_open({"p"}, P_SCOPE - {"li"})
        if tag in ENDS:
            end_open(*ENDS[tag])
        if tag == "a" and in_link:
            end_open({"a"}, {"td", "th", "table"})
        attrs = m.group("attrs")
        if tag in INLINE:
            if tag in VOID:
                if tag == "img":
                    words(" ")
                continue
            if tag == "select":
                words(" ")
            if tag == "template" and m.start() > last_template:
                continue  # without an end tag it hides nothing
            if not attrs.endswith("/>"):
                stack.append((tag, stack[-1][1]))
                in_link += tag == "a"
                in_silent += tag in SILENT
            continue
        flush()
        found = " ".join(x or y or z for x, y, z in _ATTRS.findall(attrs)) if "=" in attrs else ""
        label = _LABEL.search(attrs) if "data-y" in attrs else None
        parent = stack[-1][1]
        node = page.add(parent, tag, found.lower(), int(label[1]) if label else page.label[parent])
        if tag not in VOID:
            stack.append((tag, node))
            in_head += tag == "head"
    if at < len(html):
        words(html[at:])
    flush()
    return page
