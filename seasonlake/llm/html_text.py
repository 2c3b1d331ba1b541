"""Main text of web pages by composite text density.

A page becomes a tree. Every node gets its characters per tag, adjusted for the share of
linked characters and linked tags; a node's sum is that of its block children's densities.
The node with the largest sum is the main part. The least density on its path up to body
is the page's threshold: other parts join it only if they reach that density with
text-bearing blocks of their own; so do single blocks beside the main part and the headings
before them. A main part inside an article or main element stands for the outermost such
element. Page furniture is taken out before anything is counted; a class name or id alone
takes nothing out that holds most of the page's unlinked text, unless it names an element
beside an article, or reader comments in or beside one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|</?[a-zA-Z][^>]*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

RAW = frozenset("script style template noscript iframe textarea title xmp noembed noframes".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset(
    "head nav footer aside form script style template noscript iframe object embed applet "
    "canvas svg math audio video map select button dialog menu textarea title".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
    "output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu "
    "menubar toolbar status".split()
)
NOISE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment "
    "comments commentlist disqus reply replies respond share sharing social related "
    "recommended newsletter subscribe subscription signup widget widgets pagination pager "
    "toolbar skip hidden".split()
)
COMMENTS = frozenset("comment comments commentlist comment-list comments-area disqus reply replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that may stand beside the main part of a page without a container of their own.
PARAGRAPHS = frozenset("p blockquote pre".split())
SINGLE = frozenset("ul ol dl table figure".split())
COMPOUNDS = frozenset(
    "ad-banner ad-slot ad-container ad-wrapper cookie-banner cookie-notice cookie-consent "
    "related-posts related-articles share-buttons social-share social-links comment-list "
    "comments-area newsletter-signup widget-area sidebar-widget site-footer page-footer "
    "site-navigation main-navigation site-nav main-nav nav-menu".split()
)
HEADS = frozenset("header site-header page-header main-header top-header".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What an opening tag closes if it is open inside the nearest scope.
CLOSES = {
    "li": ("li", frozenset("ul ol menu".split())),
    "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])),
    "tr": ("tr", frozenset(["table"])), "td": ("td th", frozenset("tr table".split())),
    "th": ("td th", frozenset("tr table".split())), "option": ("option", frozenset(["select"])),
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section "
    "summary table ul".split()
)
SCOPE = frozenset("html body table td th caption button object template article section div".split())


def is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE:
        return True
    if tag == "header":
        return not in_article
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES or name == "style" and HIDDEN.search(value):
            return True
    return False


def sounds_like_noise(tag: str, attributes: str) -> bool:
    """Whether a whole class name or id is one that furniture has."""
    return any(
        word in HEADS or word in NOISE or word.replace("_", "-") in COMPOUNDS for word in names_of(tag, attributes)
    )


def names_of(tag: str, attributes: str) -> list[str]:
    """The class names and the id of an element; those of the outermost ones say nothing."""
    if not attributes or tag in ("html", "body", "main"):
        return []
    out = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            out += (a or b or c).lower().split()
    return out


class Tree:
    """Nodes in page order, with the texts and block borders between them."""

    def __init__(self, page: str):
        self.tag, self.parent, self.gone, self.noise = ["body"], [-1], [False], [False]
        self.remark, self.semantic = [False], [False]
        self.opened: Counter[str] = Counter()
        self.events: list[tuple[int, str]] = []
        self.read(page)
        if any(self.noise):
            self.drop_noise()

    def read(self, page: str) -> None:
        open_, at = [0], 0
        while True:
            m = TOKEN.search(page, at)
            self.text(open_[-1], page[at : m.start() if m else len(page)])
            if not m:
                return
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(open_, tag)
                continue
            if tag in ("html", "body"):
                continue
            inside = m[3] or m[6] or ""
            self.imply(open_, tag)
            if tag not in INLINE:
                self.border(open_[-1])
            if tag in VOID:
                continue
            above = open_[-1]
            noise = sounds_like_noise(tag, inside)
            self.tag.append(tag)
            self.parent.append(above)
            self.gone.append(self.gone[above] or is_furniture(tag, inside, self.semantic[above]))
            self.noise.append(noise)
            self.remark.append(noise and any(w.replace("_", "-") in COMMENTS for w in names_of(tag, inside)))
            self.semantic.append(self.semantic[above] or tag in ("article", "main"))
            open_.append(len(self.tag) - 1)
            self.opened[tag] += 1
            if tag in RAW:
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)

    def drop_noise(self) -> None:
        """Take out what sounds like noise, unless it holds most of the unlinked text."""
        n = len(self.tag)
        linked = [False] * n
        plain = [0] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] in ("a", "button", "select")
        for node, text in self.events:
            if not linked[node]:
                plain[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
        within = [False] * n  # in something that sounds like noise
        articles = 0
        for i in range(1, n):
            within[i] = within[self.parent[i]] or self.noise[i]
        for node, text in self.events:
            if self.semantic[node] and not within[node] and not linked[node]:
                articles += len("".join(text.split()))
        for i in range(1, n):
            beside = articles and (self.remark[i] or not self.semantic[self.parent[i]])
            inner = self.tag[i] in ("article", "main") and not self.remark[i]
            noise = self.noise[i] and not inner and (2 * plain[i] <= plain[0] or beside)
            self.gone[i] = self.gone[i] or self.gone[self.parent[i]] or noise
        self.events = [(node, text) for node, text in self.events if not self.gone[node]]

    def text(self, node: int, raw: str) -> None:
        if raw and not self.gone[node]:
            self.events.append((node, html.unescape(raw) if "&" in raw else raw))

    def border(self, node: int) -> None:
        if not self.gone[node]:
            self.events.append((node, " "))

    def imply(self, open_: list[int], tag: str) -> None:
        if tag in CLOSES:
            names, until = CLOSES[tag]
            self.pop(open_, names.split(), until)
        if tag in ENDS_P:
            self.pop(open_, ["p"], SCOPE)

    def leave(self, open_: list[int], i: int) -> None:
        for node in open_[i:]:
            self.opened[self.tag[node]] -= 1
        del open_[i:]

    def pop(self, open_: list[int], names: list[str], until: frozenset[str]) -> None:
        if not any(self.opened[name] for name in names):
            return
        for i in range(len(open_) - 1, 0, -1):
            if self.tag[open_[i]] in names:
                self.border(open_[i])
                self.leave(open_, i)
                return
            if self.tag[open_[i]] in until:
                return

    def close(self, open_: list[int], tag: str) -> None:
        for i in range(len(open_) - 1, 0, -1) if self.opened[tag] else ():
            name = self.tag[open_[i]]
            if name == tag:
                if tag not in INLINE:
                    self.border(open_[i])
                self.leave(open_, i)
                return
            if tag in INLINE and name not in INLINE:
                return  # a stray end of an inline element does not close blocks
        if tag in ("p", "br"):
            self.border(open_[-1])


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """(density, sum of the block children's densities) of every node."""
    n = len(tree.tag)
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in tree.events:
        chars[node] += len("".join(text.split()))
    for i in range(n - 1, -1, -1):
        if tree.gone[i]:
            continue
        if tree.tag[i] in ("a", "button", "select"):
            linked[i], links[i] = chars[i], links[i] + 1
        if i:
            up = tree.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            linked[up] += linked[i]
            links[up] += links[i]
    share = linked[0] / max(chars[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if tree.gone[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(tags[i], 1), max(linked[i], 1), max(links[i], 1)
        base = math.log(c * lc / max(c - linked[i], 1) + share * c + math.e)
        density[i] = c / t * math.log(max(c * t / (lc * lt), 1.0)) / math.log(base)
        if i and tree.tag[i] not in INLINE:
            total[tree.parent[i]] += density[i]
    return density, total


def beside(tree: Tree, density: list[float], best: int, threshold: float) -> Iterator[int]:
    """Blocks beside the main part: unlinked paragraphs, others that reach the threshold,
    and headings before it."""
    if not best:
        return
    for i in range(1, len(tree.tag)):
        if tree.parent[i] == tree.parent[best] and density[i]:
            tag = tree.tag[i]
            if tag in PARAGRAPHS or tag in SINGLE and density[i] >= threshold or tag in HEADINGS and i < best:
                yield i


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    density, total = densities(tree)
    n = len(tree.tag)
    best = max(range(n), key=lambda i: (total[i], -i))
    if not total[best]:
        best = 0
    path = [best]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    threshold = min(density[i] for i in path)
    semantic = [i for i in path if tree.tag[i] in ("article", "main")]
    chosen = {semantic[-1] if semantic else best}
    if not semantic:
        on_path = set(path)
        chosen.update(i for i in range(1, n) if i not in on_path and total[i] and density[i] >= threshold)
        chosen.update(beside(tree, density, best, threshold))
    inside = [False] * n
    for i in range(n):
        inside[i] = i in chosen or (i > 0 and inside[tree.parent[i]])
    return " ".join("".join(text for node, text in tree.events if inside[node] or text == " ").split())


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of ``pages``.

    The text is that of the main part with character references decoded; white space
    inside a block is one space, blocks are joined by one space. Null, empty or
    text-free pages give an empty text and 0; unclosed, truncated or badly nested markup
    is read as far as it goes; repeated rows stay repeated. A page is read whole and
    alone, with no shuffle.
    """

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [main_text(page) for page in part.pop("page")]
            yield part.assign(text=texts, n_chars=[len(t) for t in texts])

    narrow = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("page"))
    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInPandas(extract, f"page_id {kind}, url string, text string, n_chars long")
