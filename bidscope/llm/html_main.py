"""Main text of HTML pages by composite text density.

A page becomes a tree of elements. Elements that by tag, role or class are no
article text (menus, headers and footers of the site, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are cut off first. Each
remaining node gets its characters per tag, adjusted by the share of link
characters and link tags, and the sum of its children's densities. The node
with the largest sum is the core. The smallest density on the path from the
body to the core is the threshold: beside the path, subtrees at or above it
are kept. A core inside an ``article`` or ``main`` element takes that element
whole.

Blocks end at block-level tags; ``br`` is white space. Character references
are decoded, white space inside a block is one space, blocks are joined by a
blank line in page order.

Defined cases: null or empty html and pages without text give an empty text;
a tag that never ends (a cut page) is dropped; repeated rows give a row each.
"""
from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import with_columns

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_CUT = set("aside button canvas datalist dialog fieldset footer form head iframe input label legend menu nav noframes noscript object optgroup option script select style svg template textarea title audio video".split())
_CUT_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words of class and id names that mark other parts of a page than its article.
_CUT_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager "
    "cookie cookies consent gdpr notice notices notification banner alert popup modal overlay disclaimer "
    "newsletter subscribe subscription signup signin login register search "
    "comment comments commentlist disqus reply replies respond discussion "
    "share sharing social related recommended recommendations widget".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


class _Tree:
    """Elements in page order: tag, parent, end of the subtree, cut; texts with their element."""

    def __init__(self, page: str):
        self.tag, self.parent, self.end, self.cut = ["#root"], [-1], [0], [False]
        self.texts: list[tuple[int, str | None]] = []  # None is the end of a block
        self.open = [0]
        at = 0
        while m := _TOKEN.search(page, at):
            self._text(page[at:m.start()])
            at = m.end()
            if not m[2] or not m[4]:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in _RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
                self._text(page[at:close.start()])
                at = close.end()
                self._end(name)
        self._text(page[at:])
        while self.open:
            self._pop()

    def _text(self, s: str) -> None:
        if s:
            self.texts.append((self.open[-1], s))

    def _pop(self) -> str:
        i = self.open.pop()
        self.end[i] = len(self.tag)
        if self.tag[i] in _BLOCK:
            self.texts.append((i, None))
        return self.tag[i]

    def _start(self, name: str, attrs: str) -> None:
        if name in _BLOCK:
            self._end("p", {"table", "td", "th", "button", "li", "div", "article", "section", "body", "blockquote"})
            self.texts.append((self.open[-1], None))
        for closed in _CLOSES.get(name, ()):
            self._end(closed, _SCOPE[name])
        if name in ("html", "body") and name in self.tag:
            return
        if name == "br":
            self._text(" ")
        parent = self.open[-1]
        self.tag.append(name)
        self.parent.append(parent)
        self.end.append(len(self.tag))
        self.cut.append(self.cut[parent] or self._boilerplate(name, attrs))
        if name not in _VOID and not attrs.rstrip().endswith("/") or name in _BLOCK - _VOID:
            self.open.append(len(self.tag) - 1)

    def _boilerplate(self, name: str, attrs: str) -> bool:
        if name in _CUT:
            return True
        in_article = any(self.tag[i] in ("article", "main") for i in self.open)
        if name == "header":
            return not in_article
        if not attrs or name in ("html", "body", "main"):
            return False
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if key == "role" and value in _CUT_ROLES:
                return True
            if key in ("class", "id"):
                words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower())
                if not _CUT_NAMES.isdisjoint(words) or "header" in words and not in_article:
                    return True
        return False

    def _end(self, name: str, scope: set[str] | None = None) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[k]]
            if t == name:
                while self._pop() != name:
                    pass
                return
            if scope is not None and t in scope:
                return


def _densities(tree: _Tree) -> tuple[list[float], list[float]]:
    """Composite density of each node, and the sum of its children's."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.parent[i]] or tree.tag[i] == "a"
    for i, s in tree.texts:
        if s is not None and not tree.cut[i]:
            c = len(" ".join(s.split()))
            chars[i] += c
            link_chars[i] += c * linked[i]
    for i in range(n - 1, 0, -1):
        if not tree.cut[i]:
            p = tree.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    body = next((i for i, t in enumerate(tree.tag) if t == "body"), 0)
    share = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        c = chars[i]
        if c and not tree.cut[i]:
            t, lc, lt = max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + math.e)
            density[i] = c / t * math.log(max(c / lc * t / lt, 1.0000001)) / max(math.log(base), 1e-9) if base > 1.0000001 else c / t
    for i in range(1, n):
        total[tree.parent[i]] += density[i]
    return density, total


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = _Tree(page)
    density, total = _densities(tree)
    body = next((i for i, t in enumerate(tree.tag) if t == "body"), 0)
    alive = [i for i in range(body, len(tree.tag)) if not tree.cut[i] and density[i] > 0]
    if not alive:
        return ""
    core = max(alive, key=lambda i: (total[i], density[i], -i))
    path = [core]
    while path[-1] not in (body, 0):
        path.append(tree.parent[path[-1]])
    whole = next((i for i in reversed(path) if tree.tag[i] in ("article", "main")), None)
    if whole is not None:
        keep = [(whole, tree.end[whole])]
        on_path: set[int] = set()
    else:
        threshold = min(density[i] for i in path if density[i] > 0)
        keep = [(core, tree.end[core])]
        on_path = set(path)
        i = body + 1 if body else 1
        while i < len(tree.tag):
            if i in on_path and i != core:
                i += 1
                continue
            if density[i] >= threshold and i != core:
                keep.append((i, tree.end[i]))
            i = max(tree.end[i], i + 1)
    inside = [False] * len(tree.tag)
    for a, b in keep:
        for i in range(a, b):
            inside[i] = True
    blocks, piece = [], []
    for i, s in [*tree.texts, (0, None)]:
        if s is None:
            block = " ".join(html.unescape("".join(piece)).split())
            if block:
                blocks.append(block)
            piece = []
        elif not tree.cut[i] and (inside[i] or i in on_path):
            piece.append(s)
    return "\n\n".join(blocks)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Per page row: ``page_id, url, text, n_chars``."""
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def start():
        def step(c):
            text = [main_text(x) for x in c["html"]]
            return None, {"text": text, "n_chars": [len(x) for x in text]}
        return step

    return with_columns(source, ["page_id", "url"], "text string, n_chars long", start)
