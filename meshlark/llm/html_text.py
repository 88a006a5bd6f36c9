"""Operator 8: the main text of web pages by composite text density.

A page is cut into tags and texts in one pass and built into a tree (parent
numbers in lists, no recursion). Every node gets its characters, tags, link
characters and link tags, and from them the composite text density: characters
per tag, adjusted by the logarithm of the share of links, whose base grows with
the node's and the body's share of linked text. The densities of a node's
children are summed; among the nodes whose density reaches the threshold (the
least density on the path from the densest node to the body) the node with the
largest sum is the content. Its texts are given in page order, without subtrees
that are not part of an article (menus, forms, adverts, comments, ...), which
their element, role or class names tell, and without lists of links outside it.
What holds the page's largest article, or most of its text, is never set apart
by element or name, and if nothing else is left, only what is hidden is.

Defined results: null, empty and markup-only pages give an empty text; very long
pages are parsed whole; every row, repeated ones too, gives one row; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import arrow_map

#: Elements whose content is not text of the page.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "canvas", "audio", "video", "noembed"}
#: Elements whose content is text as it stands, tags and all.
PLAIN = {"xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An opening tag ends an open element of these kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that are never part of an article; headers are, if they stand in one.
APART = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "head"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsors?|sponsored|promos?|promoted|promotion|banners?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|newsletters?|subscribe|subscription|"
    r"sidebars?|widgets?|related|recommended|recommendations?|share|sharing|social|comments?|commentlist|disqus|respond|repl(?:y|ies)|breadcrumbs?|menus?|nav|navbar|navigation|pagination|pager|toolbar|footer|login|signup|search|skip|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
#: Names of what can be longer than the article beside it, so that holding most of the text doesn't tell.
BESIDE = re.compile(r"(?:^|[\s_-])(?:cookies?|consent|gdpr|popups?|modals?|comments?|commentlist|disqus|respond|repl(?:y|ies))(?:$|[\s_-])", re.I)
#: Names that are also words of headings: as a part of a longer name inside an article they set apart only what is mostly links.
HEADED = re.compile(r"(?:social|search|related|alerts?|promotions?|notices?|notifications?|share|reply|replies|navigation)", re.I)
#: Why a node stands apart.
NOT, USUAL, LONG, SECTION, HIDDEN = range(5)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
TOKEN = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Tree:
    """Nodes by number: tag, parent, whether they stand apart; and the texts with their nodes, in page order."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.apart = ["#root"], [-1], [NOT]
        self.pieces: list[tuple[int, str]] = []  # node -1: a break between blocks
        stack, opened = [0], {}
        at, size = 0, len(page)
        while at < size:
            m = TOKEN.search(page, at) if page.find(">", at) >= 0 else None
            text = page[at : m.start() if m else size]
            if text:
                self.pieces.append((stack[-1], html.unescape(text)))
            if not m:
                break
            at = m.end()
            if m[0] == "<!--":
                end = page.find("-->", at - 2 if page.startswith("->", at) else at)
                at = size if end < 0 else end + 3
                continue
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, rest = m[1] or m[4], m[3] or m[6] or ""
            if name not in INLINE:
                self.pieces.append((-1, ""))
            if closing:
                if opened.get(name):
                    while True:
                        top = self.tag[stack.pop()]
                        opened[top] -= 1
                        if top == name:
                            break
                continue
            if name in RAW or name in PLAIN:
                if not rest.endswith("/"):
                    end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                    if name in PLAIN:
                        self.pieces += [(stack[-1], page[at : end.start() if end else size]), (-1, "")]
                    at = end.end() if end else size
                continue
            if name not in INLINE:
                ends = ENDS.get(name, set())
                open_ = opened.get("p") or any(opened.get(x) for x in ends)
                for k in range(len(stack) - 1, 0, -1) if open_ else ():
                    top = self.tag[stack[k]]
                    if top == "p" or top in ends:
                        for x in stack[k:]:
                            opened[self.tag[x]] -= 1
                        del stack[k:]
                        break
                    if top not in INLINE:
                        break
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.apart.append(self._apart(name, rest, opened))
            if name not in VOID and not rest.endswith("/"):
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1

    @staticmethod
    def _apart(name: str, rest: str, opened: dict[str, int]) -> int:
        inside = opened.get("article") or opened.get("main")
        out = USUAL if name in APART or name == "header" and not inside else NOT
        if name in ("html", "body", "main") or not rest:
            return out
        for key, *values in ATTRIBUTE.findall(rest):
            value, key = "".join(values), key.lower()
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return HIDDEN
            if key in ("class", "id") and BESIDE.search(value):
                out = LONG
            elif key in ("class", "id") and (m := NAMES.search(value) or not inside and HEADER.search(value)) or key == "role" and value.lower() in ROLES:
                # names in an article can be made of words of a heading
                words = key != "role" and inside and not any(m[0].strip(" \t\n_-") == x for x in value.split())
                kind = SECTION if words and (key == "id" and name == "section" or name in ("div", "section") and HEADED.fullmatch(m[0].strip(" \t\n_-"))) else USUAL
                out = kind if out in (NOT, SECTION) else out
        return out


def settled(tree: Tree) -> list[bool]:
    """Whether each node stands apart, now that the texts are known."""
    n = len(tree.tag)
    hidden, clear, link, beside = [False] * n, [True] * n, [False] * n, [False] * n
    for k in range(1, n):
        p = tree.parent[k]
        hidden[k], clear[k], link[k] = hidden[p] or tree.apart[k] == HIDDEN, clear[p] and not tree.apart[k], link[p] or tree.tag[k] == "a"
        beside[k] = beside[p] or tree.apart[k] == LONG
    chars, linked, rest = [0] * n, [0] * n, 0
    for k, text in tree.pieces:
        if k >= 0 and not hidden[k]:
            size = len("".join(text.split()))
            chars[k] += size
            linked[k] += size * link[k]
            rest += size * clear[k]
    for k in range(n - 1, 0, -1):
        chars[tree.parent[k]] += chars[k]
        linked[tree.parent[k]] += linked[k]
    out = [bool(x) for x in tree.apart]
    for k in range(1, n):
        if tree.apart[k] in (USUAL, SECTION) and 2 * chars[k] > chars[0] or tree.apart[k] == SECTION and linked[k] <= 0.6 * chars[k]:
            out[k] = False
    # one beside what stands apart counts double, as teasers and comments are articles too
    held = max((k for k in range(1, n) if tree.tag[k] in ("article", "main") and chars[k] and not hidden[k] and not beside[k] and not tree.apart[k] and (clear[k] or 2 * chars[k] > rest)), key=lambda k: (chars[k] * (1 + clear[k]), -k), default=0)
    while held > 0:
        held = tree.parent[held]
        if held > 0:
            out[held] = False
    gone = [False] * n
    for k in range(1, n):
        gone[k] = gone[tree.parent[k]] or out[k]
    left = any(k >= 0 and not gone[k] and text.strip() for k, text in tree.pieces)
    return out if left else [x == HIDDEN for x in tree.apart]


def densities(tree: Tree) -> tuple[list[float], list[float], list[int], list[int], list[int]]:
    """Of each node: composite text density, sum of the children's densities, characters, link characters and links. Subtrees that stand apart count as empty."""
    n = len(tree.tag)
    apart, out, link = settled(tree), [False] * n, [False] * n
    for k in range(1, n):
        p = tree.parent[k]
        out[k], link[k] = apart[k] or out[p], tree.tag[k] == "a" or link[p]
    chars, linked, tags, anchors = [0] * n, [0] * n, [0] * n, [0] * n
    for k, text in tree.pieces:
        if k >= 0 and not out[k]:
            size = len("".join(text.split()))
            chars[k] += size
            linked[k] += size * link[k]
    for k in range(n - 1, 0, -1):
        p = tree.parent[k]
        if not out[k]:
            chars[p] += chars[k]
            linked[p] += linked[k]
            tags[p] += tags[k] + 1
            anchors[p] += anchors[k] + (tree.tag[k] == "a")
    share = linked[0] / max(chars[0], 1)
    density = [0.0] * n
    for k in range(n):
        c, lc = chars[k], linked[k]
        if c and not out[k]:
            t, lt = max(tags[k], 1), max(anchors[k], 1)
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[k] = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / max(math.log(base), 1e-3) if base > 1 else c / t
    sums = [0.0] * n
    for k in range(1, n):
        sums[tree.parent[k]] += density[k]
    tree.apart = out
    return density, sums, chars, linked, anchors


def main_text(page: str | None) -> str:
    """The main text of a page."""
    tree = Tree(page or "")
    density, sums, chars, linked, anchors = densities(tree)
    n = len(tree.tag)
    body = tree.tag.index("body") if "body" in tree.tag else 0
    if not chars[body]:
        body = 0
    if not chars[body]:
        return ""
    densest = max((k for k in range(n) if chars[k] and not tree.apart[k]), key=lambda k: (sums[k], -k))
    threshold, k = density[densest], densest
    while k != body and k > 0:
        k = tree.parent[k]
        threshold = min(threshold, density[k]) if chars[k] else threshold
    best = max((k for k in range(n) if chars[k] and not tree.apart[k] and density[k] >= threshold), key=lambda k: (sums[k], -k), default=densest)
    top = _grown(tree, best, chars)
    article = "article" if "article" in tree.tag else "main"
    inside, cited = [False] * n, [False] * n  # cited: in the article, whose lists of links belong to it
    inside[top], cited[top] = True, any(tree.tag[k] == article for k in _up(tree, top))
    for k in range(top + 1, n):
        p = tree.parent[k]
        cited[k] = cited[p] or inside[p] and tree.tag[k] == article
        inside[k] = inside[p] and not tree.apart[k] and not (not cited[k] and tree.tag[k] in ("ul", "ol", "div", "table", "section") and linked[k] > 0.6 * chars[k] and anchors[k] >= 3)
    return " ".join("".join(" " if k < 0 else text for k, text in tree.pieces if k < 0 or inside[k]).split())


def _grown(tree: Tree, node: int, chars: list[int]) -> int:
    """The article or main element that holds the node, if there is one, or that the node holds with most of its text; else the node, or the block it stands in."""
    k = node
    while k > 0:
        if tree.tag[k] in ("article", "main"):
            return k
        k = tree.parent[k]
    held = max((k for k in range(node + 1, len(tree.tag)) if tree.tag[k] in ("article", "main") and not tree.apart[k]), key=lambda k: (chars[k], -k), default=0)
    if held and chars[held] > 0.5 * chars[node] and _within(tree, held, node):
        return held
    while tree.tag[node] in INLINE or tree.tag[node] in ("p", "li", "td", "tr", "h1", "h2", "h3"):
        node = tree.parent[node]
    return node


def _up(tree: Tree, k: int) -> Iterator[int]:
    while k > 0:
        yield k
        k = tree.parent[k]


def _within(tree: Tree, k: int, top: int) -> bool:
    while k > top:
        k = tree.parent[k]
    return k == top


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"])

        return each

    return arrow_map(pages.select(id_col, url_col, html_col), make, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
