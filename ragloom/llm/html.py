"""Main-text extraction by a tree-structured graphical model over the DOM.

A tolerant tokeniser builds the tree of block elements; inline markup stays inside its block. Every node has one of
three hidden states: content, boilerplate, or frame (a container whose children differ). Node potentials come from its
tag, its class and id words, the length of its own text and, with the tag, the share of it inside links; pair potentials couple
parent and child. Both are estimated from labelled pages by smoothed counts. One upward and one downward sum-product
pass give exact marginals; a node's own text belongs to the article where content is its likeliest state.

The labelled pages are drawn from layouts written for this purpose (labelled_pages); their number is a parameter and
other labelled pages may be passed instead.

Null or empty html, and html without article text, give the empty text. Text outside any tag counts as text of the
page's body. Unclosed, misnested and unknown tags are tolerated: a head ends where something begins that no head holds, an
element whose inside is left out ends with its parent at the latest, scripts and styles end at their own end tag only.
Repeated rows are extracted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import work

CONTENT, BOILERPLATE, FRAME = range(3)
PAGES = 400  # labelled pages that the model is trained on
#: Elements that stay inside their block, that have no content, and that hold no text of the page.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style noscript template svg math head title iframe object canvas audio video".split())
HEAD = set("base link meta noscript script style template title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = set("ul ol dl table tbody thead tfoot tr select div section article main aside nav body".split())
#: Elements whose inside is not markup; the first three take the rest of the page where they do not end.
RAW = set("script style title textarea noscript template svg math iframe select".split())
ENDLESS = {"script", "style", "title"}
OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
MORE = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")  # attributes; a quote counts after an equals sign only
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("chars", "label", "linked", "names", "parent", "tag")

    def __init__(self, tag: str, names: tuple, parent: int, label: int | None = None):
        self.tag, self.names, self.parent, self.label, self.chars, self.linked = tag, names, parent, label, 0, 0


def tokens(html: str):
    """(text before, tag name or None, is an end tag, attributes) of the page in order; every character is read once.

    A tag, comment or script that does not end takes the rest of the page with it.
    """
    at, begin, unended = 0, 0, set()
    while True:
        at = html.find("<", at)
        if at < 0:
            yield html[begin:], None, False, ""
            return
        m = OPEN.match(html, at)
        if not m:
            if html.startswith(("<!", "<?", "</"), at):
                comment = html.startswith("<!--", at)
                stop = html.find("-->" if comment else ">", at + (4 if comment else 2))
                yield html[begin:at], None, False, ""
                if stop < 0:
                    return
                begin = at = stop + (3 if comment else 1)
            else:  # a plain less-than sign
                at += 1
            continue
        more = MORE.match(html, m.end())
        stop = more.end()
        yield html[begin:at], None, False, ""
        if stop >= len(html):
            return
        tag, end = m[1].lower(), html[at + 1] == "/"
        begin = at = stop + 1
        if tag in RAW and not end:
            inside = None if tag in unended else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if inside:
                close = html.find(">", inside.end())
                begin = at = close + 1 if close >= 0 else len(html)
                continue
            unended.add(tag)
            if tag in ENDLESS:
                return
            continue
        yield "", tag, end, more[0]


class Stack:
    """Open elements. Each knows the nearest one at or below it that matters to closing, so no search walks the others."""

    def __init__(self):
        self.items, self.count = [("body", 0, 0)], {}

    def __getitem__(self, k):
        return self.items[k]

    def push(self, tag: str, node: int) -> None:
        k = len(self.items)
        matters = tag == "p" or tag in LIMITS or tag in CLOSES
        self.items.append((tag, node, k if matters else self.items[-1][2]))
        self.count[tag] = self.count.get(tag, 0) + 1

    def cut(self, k: int) -> None:
        while len(self.items) > k:
            tag = self.items.pop()[0]
            self.count[tag] -= 1

    def close(self, tag: str) -> bool:
        """End the innermost element of that tag, and all inside it."""
        if not self.count.get(tag):
            return False
        k = len(self.items) - 1
        while self.items[k][0] != tag:
            k -= 1
        self.cut(k)
        return True

    def make_room(self, tag: str) -> None:
        """A list item, cell or the like ends its open sibling; any other block ends an open paragraph."""
        ends = CLOSES.get(tag, {"p"})
        k = self.items[-1][2]
        while k > 0:
            have = self.items[k][0]
            if have in ends:
                self.cut(k)
                return
            if have in LIMITS or tag not in CLOSES:
                return
            k = self.items[k - 1][2]


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block nodes in page order, runs of text as (node, text))."""
    nodes, runs = [Node("body", (), -1)], []
    stack = Stack()
    piece: list[str] = []
    links, dropped = 0, []  # open elements whose inside is left out, and how deep the stack was

    def flush():
        text = " ".join(unescape("".join(piece)).split())
        piece.clear()
        if text:
            runs.append((stack[-1][1], text))
            nodes[stack[-1][1]].chars += len(text)

    for text, tag, end, more in tokens(html):
        if dropped and dropped[0][0] == "head" and (text.strip() or (tag and not end and tag not in HEAD)):
            dropped.clear()
        if text and not dropped:
            piece.append(text)
            if links:
                nodes[stack[-1][1]].linked += len(text.strip())
        if not tag:
            continue
        if tag in DROPPED:  # head, and elements of this kind that are not raw text
            if not end and tag not in VOID and not more.endswith("/"):
                dropped.append((tag, len(stack.items)))
            elif end and any(tag == t for t, _ in dropped):
                while dropped.pop()[0] != tag:
                    pass
            continue
        if tag in ("html", "body"):
            dropped.clear()
            continue
        if end:
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
            elif stack.count.get(tag):
                flush()
                links = 0
                stack.close(tag)
                while dropped and dropped[-1][1] > len(stack.items):
                    dropped.pop()
            continue
        if tag in INLINE:
            if tag == "br" and not dropped:
                piece.append(" ")
            links += tag == "a"
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        stack.make_room(tag)
        while dropped and dropped[-1][1] > len(stack.items):
            dropped.pop()
        names = tuple(w for g in NAMES.findall(more) for w in re.findall("[a-z]+", (g[0] or g[1] or g[2]).lower()))
        label = next((int(w[-1]) for w in re.findall(r"data-y=.\d", more)), None)
        nodes.append(Node(tag, names, stack[-1][1], label))
        stack.push(tag, len(nodes) - 1)
    flush()
    return nodes, runs


def features(node: Node) -> list[str]:
    size = min(int(math.log2(node.chars + 1)) // 2, 5)
    share = 0 if not node.chars else 1 + min(3, 4 * node.linked // max(node.chars, 1))
    return [f"tag {node.tag}", f"size {size}", f"links {share}", f"{node.tag} links {share}", *{f"name {w}" for w in node.names}]


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    """Pages of many layouts; data-y is each block's state. Words are nonsense, only structure is to be learnt."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{rng.randint(1, 99)}">{words(1, 3)}</a>'

    def block(tag, y, inside, names=()):
        name = f' {rng.choice(["class", "id", "class"])}="{rng.choice(names)}"' if names and rng.random() < 0.85 else ""
        return f'<{tag} data-y="{y}"{name}>{inside}</{tag}>'

    def menu(tag="nav", names=("nav", "menu", "navigation", "main-menu", "navbar", "breadcrumb", "links", "related", "pagination", "tags", "share", "social")):
        items = "".join(block("li", 1, link()) for _ in range(rng.randint(2, 8)))
        return block(tag, 1, block("ul", 1, items) if rng.random() < 0.7 else " ".join(link() for _ in range(rng.randint(2, 8))), names)

    def noise():
        kind = rng.randrange(9)
        say = words(3, 40)
        if kind == 0:
            return menu(rng.choice(["nav", "nav", "div"]))
        if kind == 1:
            return block("div", 1, say if rng.random() < 0.5 else block("p", 1, say), ("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "ad-box"))
        if kind == 2:
            return block(rng.choice(["aside", "aside", "div"]), 1, block("h3", 1, words(1, 4)) + block("p", 1, say) + menu("div"), ("sidebar", "side", "widget", "aside", "related"))
        if kind == 3:
            return block("div", 1, block("p", 1, say) + block("button", 1, words(1, 2)), ("cookie", "notice", "consent", "cookie-banner", "popup", "modal", "newsletter", "subscribe", "gdpr", "alert"))
        if kind == 4:
            return block("form", 1, block("label", 1, words(1, 3)) + '<input type="text">' + block("button", 1, words(1, 2)) + (block("p", 1, say) if rng.random() < 0.4 else ""), ("search", "login", "newsletter", "signup"))
        if kind == 5:
            return block(rng.choice(["section", "div"]), 1, block("h3", 1, words(1, 3)) + "".join(block(rng.choice(["div", "li", "article"]), 1, block("p", 1, words(3, 60)), ("comment", "reply", "comment-body")) for _ in range(rng.randint(1, 5))), ("comments", "comment-list", "replies", "discussion", "respond"))
        if kind == 6:
            return block("footer", 1, say if rng.random() < 0.5 else block("p", 1, say) + menu("div"), ("footer", "site-footer", "page-footer"))
        if kind == 7:
            return block("header", 1, block("div", 1, words(1, 4), ("logo", "brand", "title")) + menu(), ("header", "site-header", "masthead", "top"))
        return block("div", 1, say, ("footer", "header", "copyright", "disclaimer", "legal", "meta", "byline", "share", "social"))

    def body():
        out = [block(rng.choice(["h1", "h1", "h2"]), 0, words(2, 12))] if rng.random() < 0.9 else []
        if out and rng.random() < 0.2:
            out = [block("header", 0, out[0])]
        for _ in range(rng.randint(1, 12)):
            kind = rng.randrange(14)
            if kind == 0:
                out.append(block(rng.choice(["h2", "h3", "h4"]), 0, words(1, 8)))
            elif kind == 1:
                out.append(block(rng.choice(["ul", "ol"]), 0, "".join(block("li", 0, words(2, 25)) for _ in range(rng.randint(2, 6)))))
            elif kind == 2:
                out.append(block("blockquote", 0, block("p", 0, words(5, 40)) if rng.random() < 0.6 else words(5, 40)))
            elif kind == 3:
                out.append(block("pre", 0, words(4, 30)))
            elif kind == 4:
                out.append(block("figure", 0, '<img src="a.png">' + block("figcaption", 0, words(2, 12))))
            elif kind == 5:
                out.append(block("table", 0, "".join(block("tr", 0, block("td", 0, words(1, 4)) * 2) for _ in range(3))))
            elif kind == 6 and rng.random() < 0.7:
                out.append(noise())
            elif kind == 7:
                out.append(block("section", 0, block("p", 0, words(10, 90))))
            else:
                say = words(1, 120)
                out.append(block("p", 0, say if rng.random() < 0.8 else f"{say} {link()} <b>{words(1, 9)}</b>"))
        return "".join(out)

    pages = []
    for _ in range(n):
        main = block(rng.choice(["article", "article", "main", "div", "section"]), 0, body(), ("article", "content", "post", "entry", "main", "story", "entry-content", "post-body", "text"))
        if "<main" not in main and rng.random() < 0.3:
            main = block("main", 2, main + (noise() if rng.random() < 0.4 else ""), ("main", "content"))
        parts = [noise() for _ in range(rng.randint(0, 4))] + [main] + [noise() for _ in range(rng.randint(0, 4))]
        inside = "".join(parts)
        if rng.random() < 0.15:  # laid out by a table: a row of links above and below, a column of links beside the text
            cell = lambda: block("td", 1, rng.choice([" ", " | ", "<br>"]).join(link() for _ in range(rng.randint(1, 8))))
            rows = [block("tr", 2, cell()) for _ in range(rng.randint(0, 2))]
            text = block("td", 0, body())
            rows.insert(rng.randint(0, len(rows)), block("tr", 2, text + cell() if rng.random() < 0.3 else cell() + text if rng.random() < 0.6 else text))
            inside = block("table", 2, "".join(rows))
        if rng.random() < 0.4:
            inside = block("div", 2, inside, ("page", "wrapper", "container", "layout", "row", "site", "wrap"))
        pages.append(f"<html><body>{inside}</body></html>")
    return pages


STATE_OF = {0: CONTENT, 1: BOILERPLATE, 2: FRAME}


class TreeModel:
    """Potentials of nodes and of parent-child pairs from labelled pages."""

    def __init__(self, pages: list[str]):
        seen: dict[str, list[float]] = {}
        states, pairs = [1.0] * 3, [[0.5] * 3 for _ in range(3)]
        for page in pages:
            nodes, _ = parse(page)
            nodes[0].label = 2
            for node in nodes:
                y = STATE_OF[node.label]
                states[y] += 1
                for f in features(node):
                    seen.setdefault(f, [0.0] * 3)[y] += 1
                if node.parent >= 0:
                    pairs[STATE_OF[nodes[node.parent].label]][y] += 1
        # a feature speaks by its rate within each state
        self.weight = {f: tuple(math.log((c + 0.5) / (n + 1.0)) for c, n in zip(counts, states)) for f, counts in seen.items() if sum(counts) >= 3}
        self.pair = [[c / sum(row) for c in row] for row in pairs]
        self.root = (1e-3, 1e-3, 1.0)

    def node_potential(self, node: Node) -> list[float]:
        total = [0.0] * 3
        for f in features(node):
            w = self.weight.get(f)
            if w:
                total = [a + b for a, b in zip(total, w)]
        top = max(total)
        return [math.exp(max(t - top, -60.0)) for t in total]

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Exact marginals: messages go up in reverse page order, then down in page order."""
        own = [self.node_potential(n) for n in nodes]
        own[0] = [a * b for a, b in zip(own[0], self.root)]
        belief = [list(o) for o in own]
        up: list = [None] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            b = belief[k]
            msg = [row[0] * b[0] + row[1] * b[1] + row[2] * b[2] for row in self.pair]
            total = sum(msg)
            up[k] = msg = [max(x / total, 1e-30) for x in msg]
            above = belief[nodes[k].parent]
            above[:] = [a * x for a, x in zip(above, msg)]
            if (total := sum(above)) < 1e-100:
                above[:] = [x / total for x in above]
        out = [None] * len(nodes)
        for k, node in enumerate(nodes):
            b = belief[k]
            if k:
                above = [a / x for a, x in zip(out[node.parent], up[k])]
                b = [b[y] * sum(above[s] * self.pair[s][y] for s in range(3)) for y in range(3)]
            total = sum(b)
            out[k] = [x / total for x in b]
        return out


def model(pages: int = PAGES) -> TreeModel:
    return work.held(("tree", pages), lambda: TreeModel(labelled_pages(pages)))


def main_text(html: str | None, own: TreeModel) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    nodes, runs = parse(html)
    if not runs:
        return ""
    found = own.marginals(nodes)
    return "\n\n".join(text for k, text in runs if found[k][CONTENT] > found[k][BOILERPLATE] and found[k][CONTENT] > found[k][FRAME])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", labelled: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batch_iter):
        own = model(labelled)
        for batch in work.batches(batch_iter):
            texts = [main_text(h, own) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
