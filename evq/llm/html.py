"""Main text of web pages by tree scoring.

A page is read once into a small element tree. Every paragraph passes points to its ancestors, one
for being there, one per comma, up to three for its length, the parent in full and farther ancestors
less; a container's points are discounted by its link density. The best container (widened to the
article around it) and siblings that look like it are kept, without the parts that are marked as
navigation, adverts, notices, forms, scripts or comments. All other text of them is returned whole.

Null and empty pages and pages without text give an empty string. Unclosed, misnested and stray tags
are tolerated. Pages are independent rows: no shuffle; repeated rows and ids stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.common import sliced

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd dt".split())
DROPPED_TAGS = frozenset("nav aside footer form button dialog menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words in a class or id, split at punctuation, that mark what isn't the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert banner popup modal overlay "
                  "newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar aside widget comment comments commentlist disqus respond replies reply "
                  "menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar skip".split())
COMMENT = frozenset("comment comments commentlist disqus replies".split())
KEPT_TAGS = frozenset("html body main article".split())
CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Dropped with all they hold, without a block border; those of the second kind don't nest.
HIDDEN = frozenset("svg template noscript iframe select".split())
SINGLE = frozenset("noscript iframe select".split())
SCOPES = frozenset("ul ol dl table div section article main body html blockquote aside nav header footer form".split()) | HIDDEN


def ended(tokens: list[re.Match]) -> set[int]:
    """Positions of the start tags of HIDDEN elements that have an end tag of their own; of any other only the tag goes."""
    out, begun = set(), {name: [] for name in HIDDEN}
    for m in tokens:
        name = (m[3] or "").lower()
        if name not in HIDDEN:
            continue
        if m[2]:
            if begun[name]:
                out.add(begun[name].pop())
        elif not m[4].endswith("/"):
            if name in SINGLE:
                begun[name].clear()
            begun[name].append(m.start())
    return out


class Page:
    """Element arrays and text pieces of one page."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.drop = ["html"], [-1], [False]
        #: (element, text) in page order; None as text is a block border.
        self.pieces: list[tuple[int, str | None]] = []
        #: Within a HIDDEN element; within an article or main element.
        self.hidden, self.inside = [False], [False]
        #: Where in the stack the open elements of each tag, the scopes and what isn't inline are, so that no depth makes a tag slow.
        self.places: dict[str, list[int]] = {}
        self.scopes, self.solid = [0], [0]
        stack, at, tokens = [0], 0, list(TOKEN.finditer(source))
        whole = ended(tokens)
        for m in tokens:
            if m.start() > at:
                self._text(stack[-1], source[at:m.start()])
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if m[2]:
                self._close(stack, name)
            elif name not in HIDDEN or m.start() in whole:
                self._open(stack, name, m[4])
        if at < len(source):
            self._text(stack[-1], source[at:])

    def _text(self, node: int, text: str) -> None:
        self.pieces.append((node, html.unescape(text) if "&" in text else text))

    def _border(self, node: int) -> None:
        if not self.hidden[node]:
            self.pieces.append((node, None))

    def _cut(self, stack: list[int], k: int) -> None:
        """Close what is open from place k on."""
        for node in stack[k:]:
            self.places[self.tag[node]].pop()
        del stack[k:]
        for kept in (self.scopes, self.solid):
            while kept[-1] >= k:
                kept.pop()

    def _close(self, stack: list[int], name: str) -> None:
        # An inline end tag doesn't reach over a block, a paragraph's not over a scope.
        if places := self.places.get(name):
            if places[-1] >= (self.solid[-1] if name in INLINE else self.scopes[-1] if name in PARAGRAPHS else 0):
                self._cut(stack, places[-1])
        if name not in INLINE and name not in HIDDEN:
            self._border(stack[-1])

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if name in INLINE or name in HIDDEN or name == "br":
            if name == "br":
                self._border(stack[-1])
            if name in VOID:
                return
        else:
            # A block ends an open paragraph; items and cells end their like within the same list or table.
            ends = CLOSES.get(name, ()) + (("p",) if name not in ("td", "th", "tr") else ())
            k = max((self.places[e][-1] for e in ends if self.places.get(e)), default=0)
            if k > self.scopes[-1]:
                self._cut(stack, k)
            self._border(stack[-1])
            if name in VOID:
                return
        if name == "html" or name == "body" and self.places.get(name):
            return
        over = stack[-1]
        self.tag.append(name)
        self.parent.append(over)
        self.drop.append(self.drop[over] or name in HIDDEN or self._boilerplate(over, name, attributes))
        self.hidden.append(self.hidden[over] or name in HIDDEN)
        self.inside.append(self.inside[over] or name in ("article", "main"))
        self.places.setdefault(name, []).append(len(stack))
        if name in SCOPES:
            self.scopes.append(len(stack))
        if name not in INLINE:
            self.solid.append(len(stack))
        stack.append(len(self.tag) - 1)

    def _boilerplate(self, over: int, name: str, attributes: str) -> bool:
        if name in DROPPED_TAGS:
            return True
        inside = self.inside[over]
        if name == "header" and not inside:
            return True
        if len(attributes) < 4:
            return False
        a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(attributes)}
        if a.get("role", "").lower() in DROPPED_ROLES and name not in KEPT_TAGS or "hidden" in a and name not in KEPT_TAGS or "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        words = set(re.split(r"[^a-z0-9]+", f"{a.get('class', '')} {a.get('id', '')}".lower()))
        if name in KEPT_TAGS:
            return name == "article" and inside and bool(words & COMMENT)
        return bool(words & MARKS)


def blocks(page: Page, keep) -> list[str]:
    """Texts of the kept elements, block by block, white space collapsed."""
    out, cur = [], []
    for node, text in page.pieces:
        if text is None:
            if cur:
                out.append(" ".join("".join(cur).split()))
                cur = []
        elif keep(node):
            cur.append(text)
    if cur:
        out.append(" ".join("".join(cur).split()))
    return [b for b in out if b]


def main_text(source: str | None) -> str:
    page = Page(source or "")
    n = len(page.tag)
    # Length, commas and linked length by element, own text first.
    size, commas, linked = [0] * n, [0] * n, [0] * n
    link = [False] * n
    for i in range(1, n):
        link[i] = page.tag[i] == "a" or link[page.parent[i]] and page.tag[i] in INLINE
    block = list(range(n))
    for i in range(1, n):
        if page.tag[i] in INLINE:
            block[i] = block[page.parent[i]]
    for node, text in page.pieces:
        if text and not page.drop[node]:
            k = len(text) - text.count(" ") if text.isspace() else len(text)
            b = block[node]
            size[b] += k
            commas[b] += text.count(",") + text.count("，") + text.count("、")
            if link[node]:
                linked[b] += k
    points = [0.0] * n
    for i in range(n):
        if block[i] == i and size[i] >= 25 and not page.drop[i] and linked[i] <= size[i] // 2:
            own = 1 + commas[i] + min(size[i] // 100, 3)
            up, far = (page.parent[i] if page.tag[i] in PARAGRAPHS and i else i), 1
            while up >= 0 and far <= 5:
                points[up] += own / (1 if far == 1 else 2 * (far - 1))
                up, far = page.parent[up], far + 1
    whole, links, anchors = size[:], linked[:], [int(t == "a") for t in page.tag]
    for i in range(n - 1, 0, -1):
        whole[page.parent[i]] += whole[i]
        links[page.parent[i]] += links[i]
        anchors[page.parent[i]] += anchors[i]
    density = [links[i] / whole[i] if whole[i] else 0.0 for i in range(n)]
    score = [points[i] * (1 - density[i]) for i in range(n)]
    # Lists and tables that are nothing but three or more links are menus; within an article they are its own text.
    article = [t == "article" for t in page.tag]
    for i in range(1, n):
        article[i] = article[i] or article[page.parent[i]]
        if page.drop[page.parent[i]] or page.tag[i] in ("ul", "ol", "table", "div") and density[i] > 0.8 and anchors[i] > 2 and not article[i]:
            page.drop[i] = True
    # Where article elements hold a good part of the text, the best container is one of them.
    articles = [i for i in range(n) if page.tag[i] == "article" and not page.drop[i] and whole[i]]
    best = max(articles if 3 * sum(whole[i] for i in articles) >= whole[0] and articles else range(n), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        return " ".join(blocks(page, lambda i: not page.drop[i]))
    for wide in ("article", "main"):
        up = best
        while up >= 0 and page.tag[up] != wide:
            up = page.parent[up]
        if up >= 0:
            best = up
            break
    chosen = {best}
    if best:
        least, over = max(3.0, 0.2 * score[best]), page.parent[best]
        for i in range(1, n):
            # Beside an article element only other articles count.
            alike = page.tag[best] not in ("article", "main") or page.tag[i] == "article"
            if page.parent[i] == over and not page.drop[i] and alike and (score[i] >= least or page.tag[i] == "p" and whole[i] > 80 and density[i] < 0.25):
                chosen.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in chosen or i > 0 and inside[page.parent[i]]
    return " ".join(blocks(page, lambda i: inside[i] and not page.drop[i]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) per row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(parts, 256):
            texts = [main_text(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, type=pa.string())], names=["id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string")
