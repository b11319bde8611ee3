"""Main text of web pages by composite text density (operator 8).

The page is read into a light DOM without what never shows or is by its tag no article (scripts, styles, <nav>,
<header>, <footer>, <aside>, controls, hidden elements). Loose text beside blocks is a node of its own (``#run``),
like the anonymous boxes of CSS. Then, for every node, after Sun, Song and Liao (2011):

* composite text density: C/T log_b(C/LC T/LT) with b = ln(C/nLC LC + LC_body/C_body C + e), from its characters C,
  tags T, linked characters LC, links LT and other characters nLC (each 1 at least). A node of links alone has
  density 0.
* density sum: the densities of its block children. The node with the largest sum is the heart of the article (on a tie
  an <article>, else the one that begins first).
* threshold: the least density on the path from it to the body.

Where the heart holds <article> elements, it is sought among these once more. It is taken whole. What stands beside the path and is at least as dense as the threshold belongs to the article
too, with the headings right before it.

Reader comments and adverts can be as dense as the article. Words of class and id that name them (``WORDS``), forms, and
an <article> within another are therefore a prior on the logarithm of density: for such an element and all in it, it
is multiplied by ``PRIOR``. It lowers no element that holds the article (``Page.wraps``). In the taken subtrees only such
lowered elements that fall below the threshold are left out; if the heart itself is one, the page has no article.

Text is cut into blocks at block elements; white space in a block, line breaks included, becomes one blank; blocks
are joined in page order by a line feed. Edge cases: null, empty and textless pages give an empty text; unclosed
and misnested tags are closed where HTML implies it; a tag that is never closed is text; equal sums go to the node
that begins first; any length and nesting is read in linear time: on a page where tags that are never closed would be
scanned over and over (beyond ``RESCANS`` times its length), a quoted value ends at the next "<" too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
#: Elements that end an open element of the same group: an item ends the item before it.
ENDS = {
    "a": {"a"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Elements that an implied end tag doesn't reach beyond.
SCOPE = frozenset("html body table ul ol dl select article section div main aside nav header footer form td th blockquote".split())

#: Elements and roles that are never part of the article, by the meaning HTML gives them.
CUT_TAGS = frozenset(
    "head nav header footer aside script style noscript template iframe svg math button select textarea input dialog menu "
    "object embed canvas audio video map".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar".split())

#: The prior: the logarithm of the density of an element whose class or id has such a word is multiplied by it.
PRIOR = 0.5
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar sidebars aside widget menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead comment comments commentlist disqus respond reply replies share sharing social related recommended "
    "newsletter subscribe subscription signup login pagination pager toolbar skip".split()
)
#: Words that name the article; beside them only the firm words count.
KEEP_WORDS = frozenset("article content main post entry story body text".split())
FIRM_WORDS = frozenset("comments comment sidebar cookie advert ad".split())
#: Words of elements in which each entry may be an <article> of its own.
ENTRY_WORDS = frozenset("comment comments commentlist disqus respond reply replies related recommended".split())
#: Of the page's text, what a wrapper holds more of: any, or one with such words.
WRAPS, WRAPS_ENTRIES = 0.5, 0.9

#: The last group is empty where the tag or declaration isn't closed.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(>?)|<(/?)([A-Za-z][^\s/><\"']*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(>?)", re.S)
_STRICT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+(>?)|<(/?)([A-Za-z][^\s/><\"']*+)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)(>?)", re.S)
RESCANS = 4
_ATTRIBUTE = re.compile(r"\"[^\"]*\"|'[^']*'|([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_LETTERS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"[\x20\x09-\x0d]+")


def attributes_of(source: str) -> dict[str, str]:
    """Names (lower case) and values; of equal names the first holds, as in HTML."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        if m[1]:
            found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def judged(tag: str, source: str) -> tuple[bool, set[str] | None]:
    """Whether an element is cut by tag, role or hidden; and, where the prior may count against it, its words of
    class and id (empty for a form), else null."""
    if tag in CUT_TAGS:
        return True, None
    words = set() if tag == "form" else None
    if not source.strip() or tag in ("html", "body", "main", "article"):
        return False, words
    attributes = attributes_of(source)
    role = attributes.get("role", "").strip().lower()
    unseen = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    if unseen or role in CUT_ROLES:
        return True, None
    words = set() if role == "form" else words
    for name in ("class", "id"):
        own = set(_LETTERS.findall(_CAMEL.sub(" ", attributes.get(name, "")).lower()))
        if own & WORDS and not own & KEEP_WORDS or own & FIRM_WORDS:
            words = (words or set()) | own
    return False, words


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """The published formula; 0 for a node without text."""
    if not chars:
        return 0.0
    c, t, lc, lt, other = chars, max(1, tags), max(1, link_chars), max(1, link_tags), max(1, chars - link_chars)
    base = math.log(c / other * lc + body_ratio * c + math.e)  # over 1, so its logarithm is over 0
    return c / t * math.log(c / lc * t / lt) / math.log(base)


def size_of(text: str) -> int:
    return len(_SPACE.sub(" ", text).strip(" "))


class Page:
    """The DOM without cut elements, as parallel lists in page order; node 0 is the root. ``items`` are the text
    pieces and block edges in page order: (node, text) or (node, None)."""

    def __init__(self, source: str):
        self.tag, self.parent = ["#root"], [-1]
        self.items: list[tuple[int, str | None]] = []
        self.words: dict[int, set[str]] = {}  # nodes that the prior may count against
        self._names, self._stack, self._runs = ["#root"], [0], [0]  # open elements; the open run of each, or 0
        self._at: dict[str, list[int]] = {}  # places of open elements by tag
        self._scopes = [0]
        self._cut = 0  # place where a cut element began
        self._read(source)
        self._measure()

    def _read(self, source: str) -> None:
        pos = text_from = 0
        markup, left = _MARKUP, RESCANS * len(source)
        while (pos := source.find("<", pos)) >= 0:
            m = markup.match(source, pos)
            if m is None or not source.startswith("<!--", pos) and not (m[1] or m[5]):
                if m:
                    left -= m.end() - pos
                    markup = markup if left > 0 else _STRICT
                pos += 1
                continue
            self._text(source[text_from:pos])
            pos = text_from = m.end()
            tag = (m[3] or "").lower()
            if not tag:
                continue
            if m[2]:
                self._end(tag)
            elif self._start(tag, m[4]) and tag in RAW:
                end = _RAW_END[tag].search(source, pos)
                pos = text_from = end.start() if end else len(source)
        self._text(source[text_from:])

    def _text(self, text: str) -> None:
        if text and not self._cut:
            text = html.unescape(text) if "&" in text else text
            self.items.append((self._place(not text.isspace()), text))

    def _place(self, opens: bool) -> int:
        """The node that takes text or an inline element now: the innermost open one, or a run of it if it is a
        block. White space opens no run."""
        if self._names[-1] not in BLOCKS and len(self._stack) > 1:
            return self._stack[-1]
        if not self._runs[-1] and opens:
            self._runs[-1] = self._node("#run", self._stack[-1])
        return self._runs[-1] or self._stack[-1]

    def _node(self, tag: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        return len(self.tag) - 1

    def _edge(self) -> None:
        self.items.append((self._stack[-1], None))
        self._runs[-1] = 0

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 if none."""
        return max((places[-1] for t in tags if (places := self._at.get(t))), default=0)

    def _start(self, tag: str, source: str) -> bool:
        """Opens an element; false if it is empty."""
        if tag in BLOCKS and (p := self._at.get("p")) and p[-1] > self._scopes[-1]:
            self._close(p[-1])
        if tag in ENDS:
            while (k := self._last(ENDS[tag])) and k >= self._scopes[-1]:
                self._close(k)
        empty = tag in VOID or source.endswith("/") and tag in RAW
        node = self._stack[-1]
        if not self._cut:
            if tag == "br":
                self.items.append((self._place(False), " "))
            elif tag in BLOCKS:
                self._edge()
            cut, words = judged(tag, source)
            if cut:
                self._cut = 0 if empty else len(self._stack)
            else:
                if tag == "article" and self._at.get("article"):
                    words = words or set()
                node = self._node(tag, self._stack[-1] if tag in BLOCKS else self._place(tag not in VOID))
                if words is not None:
                    self.words[node] = words
        if not empty:
            self._at.setdefault(tag, []).append(len(self._stack))
            if tag in SCOPE:
                self._scopes.append(len(self._stack))
            self._names.append(tag)
            self._stack.append(node)
            self._runs.append(0)
        return not empty

    def _end(self, tag: str) -> None:
        if k := self._last((tag,)):
            self._close(k)
        elif tag == "p" and not self._cut:
            self._edge()

    def _close(self, k: int) -> None:
        """Ends the k-th open element and all in it."""
        block = False
        while len(self._stack) > k:
            name = self._names.pop()
            self._stack.pop()
            self._runs.pop()
            self._at[name].pop()
            block = block or name in BLOCKS
            if name in SCOPE:
                self._scopes.pop()
        if self._cut >= k:
            block, self._cut = block and self._cut == k, 0
        if block and not self._cut:
            self._edge()

    def _measure(self) -> None:
        """Characters, tags, linked characters and links below every node (a run is no tag)."""
        n = len(self.tag)
        self.chars, self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = in_link[self.parent[k]] or self.tag[k] == "a"
        for node, text in self.items:
            if text is not None:
                size = size_of(text)
                self.chars[node] += size
                if in_link[node]:
                    self.link_chars[node] += size
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            self.chars[up] += self.chars[k]
            self.tags[up] += self.tags[k] + (self.tag[k] != "#run")
            self.link_chars[up] += self.link_chars[k]
            self.link_tags[up] += self.link_tags[k] + (self.tag[k] == "a")
        self.body = next((k for k in range(n) if self.tag[k] == "body"), 0)

    def densities(self) -> list[float]:
        """Composite text density of every node."""
        ratio = self.link_chars[self.body] / max(1, self.chars[self.body])
        return [composite_density(*node, ratio) for node in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True)]

    def lowered(self) -> set[int]:
        """Nodes that the prior counts against."""
        n = len(self.tag)
        mains, articles, around, blocks = [0] * n, [0] * n, [0] * n, [0] * n
        if not self.words:
            return set()
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            mains[up] += mains[k] + (self.tag[k] == "main")
            articles[up] += articles[k] + (self.tag[k] == "article")
            blocks[up] += blocks[k] + (self.tag[k] in BLOCKS)
        for k in range(1, n):
            up = self.parent[k]
            around[k] = around[up] + (self.tag[up] in ("article", "main"))
        found = set()
        for k, words in self.words.items():
            elsewhere = mains[0] + articles[0] - mains[k] - articles[k] - around[k] - (self.tag[k] == "article") > 0
            share = 0.0 if elsewhere or not blocks[k] else self.chars[k] / max(1, self.chars[0])
            if self.tag[k] == "article" or not self.wraps(words, share, mains[k] > 0, articles[k] > 0):
                found.add(k)
        return found

    @staticmethod
    def wraps(words: set[str], share: float, main: bool, article: bool) -> bool:
        """Whether an element holds the article: a <main>, an <article>, or most of the page's text (its ``share``,
        0 for one without blocks and where an <article> or <main> stands elsewhere). Lists of comments and the like
        hold articles of their own, so there an <article> counts only beside a word that names the article, and most
        is more."""
        if words & ENTRY_WORDS:
            return main or article and bool(words & KEEP_WORDS) or share > WRAPS_ENTRIES
        return main or article or share > WRAPS

    def chosen(self, prior: float = PRIOR) -> list[bool]:
        """For every node, whether its own text is in the article."""
        n, tag, parent = len(self.tag), self.tag, self.parent
        keep, weight, sums, below = [False] * n, [1.0] * n, [0.0] * n, [False] * n
        low = self.lowered() if prior != 1 else set()
        density = self.densities()
        below[self.body] = True
        for k in range(1, n):
            up = parent[k]
            weight[k] = prior if k in low else weight[up]
            if density[k] > 1:
                density[k] **= weight[k]
            below[k] = below[k] or below[up]
        mixed = {parent[k] for k in range(1, n) if tag[k] in BLOCKS}  # nodes with block children
        for k in range(1, n):
            if tag[k] in BLOCKS or tag[k] == "#run" and parent[k] in mixed:
                sums[parent[k]] += density[k]
        heart = max((k for k in range(n) if below[k] and tag[k] != "#run"), key=lambda k: (sums[k], tag[k] == "article", -k))
        if weight[heart] != 1:
            return keep
        heart = self._in_articles(heart, density, sums, weight)
        path = [heart]
        while path[-1] != self.body:
            path.append(parent[path[-1]])
        threshold = min(density[k] for k in path)
        beside = self._beside(path, density, threshold)
        for k in range(self.body, n):
            up = parent[k]
            taken = up >= 0 and keep[up] and (weight[k] == weight[up] or density[k] >= threshold)
            keep[k] = k == heart or k in beside or taken
        return keep

    def _in_articles(self, best: int, density: list[float], sums: list[float], weight: list[float]) -> int:
        """``best``, or the node with the largest sum in the <article> elements that it holds."""
        n = len(self.tag)
        under, inside = [False] * n, [False] * n
        for k in range(1, n):
            up = self.parent[k]
            under[k] = up == best or under[up]
            inside[k] = inside[up] or self.tag[k] == "article"
        found = (k for k in range(best + 1, n) if under[k] and inside[k] and weight[k] == 1 and density[k] > 0 and self.tag[k] != "#run")
        return best if inside[best] else max(found, key=lambda k: (sums[k], -k), default=best)

    def _beside(self, path: list[int], density: list[float], threshold: float) -> set[int]:
        """Children of the path's nodes that are dense enough, and the headings right before what is taken."""
        children: dict[int, list[int]] = {k: [] for k in path}
        for k in range(1, len(self.tag)):
            if self.parent[k] in children:
                children[self.parent[k]].append(k)
        found, on_path = set(), set(path)
        for up in path[1:]:
            follows = False
            for k in reversed(children[up]):
                if k in on_path:
                    follows = True
                elif self.tag[k] in HEADINGS:
                    if follows or density[k] >= threshold > 0:
                        found.add(k)
                elif self.chars[k]:
                    follows = density[k] >= threshold > 0
                    if follows:
                        found.add(k)
        return found


def main_text(source: str | None, prior: float = PRIOR) -> str:
    """The article of a page, one line for each block; ``prior`` 1 leaves words of class and id out of account."""
    if not source:
        return ""
    page = Page(source)
    keep = page.chosen(prior)
    blocks: list[list[str]] = [[]]
    for node, text in page.items:
        if text is None:
            if blocks[-1]:
                blocks.append([])
        elif keep[node]:
            blocks[-1].append(text)
    lines = (_SPACE.sub(" ", "".join(b)).strip(" ") for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of ``pages``: page_id, url, text, n_chars. Map-only."""
    rows = pages.select(pages["page_id"], pages["url"], pages["html"].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h.as_py()) for h in batch["html"]]
            columns = [batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
