"""HTML to Markdown: a tolerant tree of elements, written out with lists, tables, quotes and code.

End tags may be missing: a block ends an open paragraph, an item the item before it, a cell or row its predecessor, and
what is open at the end is closed. Beyond DEPTH levels elements are flattened into the level above.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

DEPTH = 150
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: A start tag ends the open elements named first, unless one of those named second lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}), "option": ({"option"}, {"select"}),
}
SPACE = re.compile(r"[ \t\r\n\f]+")
REFERENCE = re.compile(r"&(?=(#?[0-9A-Za-z]+;?))")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def close_to(self, tags: set[str], fence: set[str]) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                del self.open[at:]
                return
            if self.open[at].tag in fence:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self.close_to(*ENDS[tag])
        if tag in BLOCKS:
            self.close_to({"p"}, {"table", "ul", "ol", "blockquote", "td", "th", "li"} if tag not in ("p", "div") else {"td", "th", "li", "blockquote", "table"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        self.close_to({tag}, {"table"} if tag not in BLOCKS else set())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def inline(node: Node | str, code: bool = False) -> str:
    """Text and marks of what runs on in a line; breaks are line breaks."""
    if isinstance(node, str):
        return node if code else SPACE.sub(" ", node)
    if node.tag in HIDDEN:
        return ""
    if node.tag == "br":
        return "\n"
    if node.tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})" if node.attrs.get("src") else node.attrs.get("alt", "")
    body = "".join(inline(c, code or node.tag in ("code", "kbd", "samp", "pre")) for c in node.children)
    if code:
        return body
    marks = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}.get(node.tag)
    core = body.strip()
    if not core or (not marks and node.tag != "a"):
        return body
    before, after = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
    if node.tag == "a":
        href, title = node.attrs.get("href", ""), node.attrs.get("title", "")
        return f"{before}[{core}]({href}{f' "{title}"' if title else ''}){after}" if href else body
    return f"{before}{marks}{core}{marks}{after}"


def tidy(text: str) -> str:
    return "\n".join(line.strip() for line in text.split("\n")).strip()


def rows_of(node: Node) -> list[Node]:
    """A table's own rows, also those in its head, bodies and foot."""
    out = []
    for c in node.children:
        if not isinstance(c, str):
            out += [c] if c.tag == "tr" else rows_of(c) if c.tag in ("thead", "tbody", "tfoot") else []
    return out


def table(node: Node) -> str:
    lines, wide = [], 0
    for row in rows_of(node):
        cells = []
        for c in row.children:
            if not isinstance(c, str) and c.tag in ("td", "th"):
                span = c.attrs.get("colspan", "1")
                cells += [" ".join(" ".join(blocks(c)).split()).replace("|", "\\|")] + [""] * (min(int(span), 100) - 1 if span.isdigit() else 0)
        if cells:
            lines.append(cells)
            wide = max(wide, len(cells))
    if not lines:
        return ""
    written = ["| " + " | ".join(c + [""] * (wide - len(c))) + " |" for c in lines]
    return "\n".join([written[0], "|" + " --- |" * wide, *written[1:]])


def listed(node: Node) -> str:
    start = node.attrs.get("start", "1")
    number, out = int(start) if start.isdigit() else 1, []
    for c in node.children:
        if isinstance(c, str) and not c.strip():
            continue
        mark = f"{number}. " if node.tag == "ol" else "* "
        own = blocks(c) if not isinstance(c, str) else [tidy(inline(c))]
        body = "\n".join(own)
        if body:
            out.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            number += 1
    return "\n".join(out)


def blocks(node: Node) -> list[str]:
    """The blocks below a node, each written out."""
    if node.tag in HIDDEN:
        return []
    out, line = [], []

    def flush() -> None:
        if text := tidy("".join(line)):
            out.append(text)
        line.clear()

    for c in node.children:
        if isinstance(c, str) or not holds_block(c):
            line.append(inline(c))
            continue
        flush()
        if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            out += ["#" * int(c.tag[1]) + " " + " ".join(b.split()) for b in [" ".join(blocks(c))] if b.strip()]
        elif c.tag == "hr":
            out.append("---")
        elif c.tag == "pre":
            out.append("```\n" + "".join(inline(x, True) for x in c.children).strip("\n") + "\n```")
        elif c.tag == "blockquote":
            out += ["> " + "\n\n".join(own).replace("\n", "\n> ") for own in [blocks(c)] if own]
        elif c.tag in ("ul", "ol"):
            out += [t for t in [listed(c)] if t]
        elif c.tag == "table":
            out += [t for t in [table(c)] if t]
        else:
            out += blocks(c)
    flush()
    return out


def holds_block(node: Node) -> bool:
    return node.tag in BLOCKS or any(not isinstance(c, str) and holds_block(c) for c in node.children)


def whole_references(html: str) -> str:
    """html in which only character references that end with a semicolon are such; others are their own letters."""
    return REFERENCE.sub(lambda m: "&" if m[1] in html5 and m[1][-1] == ";" or re.fullmatch(r"#(\d+|[xX][0-9A-Fa-f]+);", m[1]) else "&amp;", html)


def markdown(html: str, bare: bool = True) -> str:
    """bare: character references count without their semicolon too, as browsers have it."""
    tree = _Tree()
    tree.feed(html if bare else whole_references(html))
    tree.close()
    return "\n\n".join(blocks(tree.open[0]))
