"""Main text of web pages by a maximum-scoring subsequence of words, tags and class words.

A page is read as a sequence of words, each +1, and of tags and words of class or id attributes,
each at or below 0. How far below is learned from labelled pages, those that mark their main text
by ``article`` or ``main``: a tag or class word costs more the more it stands outside of that. One
linear scan finds the contiguous region of the greatest sum. The region finds the element that is the text:
the innermost marked one that holds nearly all its words, or else the least container around it. All
blocks of a marked element are text, so that its title, captions and short last paragraphs stay; of
another container those beside the region stay unless class words that cost lie over them.

Elements that are never main text have no words: menus, forms, scripts and so on by element or
role, hidden ones, and those with a class or id that consists of nothing but words for such
things (``comment-list``, ``ad``, but not ``has-sidebar`` or ``long-form``, whose words only cost; of inline
elements only adverts). They
end where HTML has them end, with or without an end tag. An ``article`` in such an element is main
text only if the page has no other, and what a class or id alone names so is, if the page has no other words.

Only the weights come from a bounded sample, at most about ``MAX_LABELLED`` pages.

Defined results: null html is empty; a page without words gives the empty text; of regions with
equal sums the first and shortest wins; repeated rows are extracted alike; an empty table gives no
rows; with no labelled pages built-in weights are used; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import slices

MAX_LABELLED = 2000
#: Factors on the learned costs that are tried; of equally good ones the first is taken.
SCALES = (4.0, 2.0, 8.0, 1.0, 16.0)
SCHEMA = "page_id long, url string, text string, n_chars long"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math|textarea|title|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
# Element names of HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("nav aside footer header form button select option menu dialog head datalist fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
# Words of a class or id that name what is no main text, and words that may stand beside them.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations comment comments disqus reply replies respond reactions widget form search login pagination pager toolbar skip alert".split()
)
#: What a class or id must name for an inline element, such as a word of a verse or of code, to be no main text.
ADVERTS = set("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion".split())
BESIDE = set("site page global top bottom left right main primary secondary box bar block list area section container wrapper inner outer item items link links button buttons post posts slot unit group row icons thread message text".split())
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MAIN = ("article", "main")
# Elements that hold text or stand in a text, and are no container of it.
FLOW = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption ul ol dl table thead tbody tfoot tr caption address hr details summary center".split())
#: The share of a region's words that a marked element holds to be the text, and what a class word costs at least to part blocks from it.
MOSTLY, LEAST_COST = 0.9, -1.0
# Elements that need no end tag, with the start tags and parents' end tags that end them.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",), "option": ("option",)}
#: Weights where no page is labelled; a class word among ``HINTS`` that was not seen costs as much as ``HINT``.
DEFAULT = {"article": -8.0, "main": -8.0, "div": -8.0, "body": -8.0, "section": -2.0, "table": -8.0, "ul": -4.0, "li": -1.0}
HINT = -4.0


def described(name: str, attributes: str, by_name: bool = True) -> tuple[bool, list[str]]:
    """Whether an element is no main text, whatever it holds, and the words of its class and id. Without ``by_name`` these never tell."""
    if name in NEVER:
        return True, []
    if not attributes:
        return False, []
    words: list[str] = []
    out = named = False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            out = True
        elif key == "role" and value.lower() in ROLES:
            out = True
        elif key in ("class", "id"):
            for token in value.split():
                parts = [w.lower() for w in WORD.findall(token)]
                words += parts
                told = ADVERTS if name in INLINE else HINTS
                named |= any(w in told for w in parts) and all(w in told or w in BESIDE for w in parts)
    out |= named and by_name
    return out and name not in ("body", "html", *MAIN), words


def ends(name: str, opening: str) -> bool:
    """Whether a start tag ends an element that was left open."""
    return opening in ITEMS.get(name, ()) or name in ("p", "head") and opening not in INLINE and opening not in VOID


class Page:
    """Events of a page: for each its tag or class word (or None), its words, its block and whether it lies in main elements.

    A class word begins with a full stop.
    """

    def __init__(self, source: str):
        self._read(source, False)
        if not self.seen and any(f"<{m}" in source.lower() for m in MAIN):
            self._read(source, True)
        if not any(e[0] is None for e in self.events):
            self._read(source, True, False)

    def _open(self, name: str, words: list[str]) -> None:
        """An element below the innermost open one; elements are numbered in the order of their start tags."""
        mark = len(self.names) if name in MAIN else self.marks[self.at]
        for values, value in ((self.names, name), (self.parents, self.at), (self.marks, mark), (self.classes, words), (self.first, len(self.pieces) - 1), (self.last, None)):
            values.append(value)
        self.at = len(self.names) - 1

    def _close(self) -> None:
        self.last[self.at] = len(self.pieces) - (1 if self.pieces[-1] else 2)
        self.at = self.parents[self.at]

    def _read(self, source: str, inner: bool, by_name: bool = True) -> None:
        """With ``inner`` a main element counts wherever it is; without ``by_name`` no class or id takes an element out."""
        self.names, self.parents, self.marks, self.classes, self.first, self.last, self.at = [""], [0], [0], [[]], [0], [None], 0
        self.holders: dict[int, int] = {}
        self.events: list[tuple[str | None, int, int, bool]] = []
        self.pieces: list[list[str]] = [[]]
        self.seen = False
        inside, stack, gone = 0, [], 0  # open elements; from place ``gone`` on, they are no main text
        held: Counter = Counter()
        for m in TOKEN.finditer(source):
            text = m["text"]
            if text is not None:
                if not gone:
                    self._text(html.unescape(text), inside > 0)
                continue
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                continue
            if m["end"] or m["end2"]:
                if held[name]:
                    while True:
                        held.subtract(stack[-1:])
                        self._close()
                        if stack.pop() == name:
                            break
                    if gone == len(stack) + 1:
                        gone = 0
                        continue
                    gone = 0 if gone > len(stack) else gone  # what holds it has ended
                if gone:
                    continue
                if name in MAIN:
                    inside = max(0, inside - 1)
                    self._tag(name, False)
                elif name == "br":
                    self._text(" ", inside > 0)
                elif name not in INLINE:
                    self._tag(name, inside > 0)
                continue
            while stack and ends(stack[-1], name):
                held.subtract(stack[-1:])
                stack.pop()
                self._close()
            if gone > len(stack) or gone and (name == "main" or inner and name in MAIN):
                gone = 0
            out, words = (False, []) if gone else described(name, m["attrs"] or m["attrs2"] or "", by_name)
            if name not in VOID and (out or name not in INLINE or gone and name == stack[gone - 1]):
                if self.pieces[-1] and name not in INLINE and not gone:
                    self.pieces.append([])
                stack.append(name)
                held[name] += 1
                self._open(name, words)
                if out:
                    gone = len(stack)
            if gone:
                if out and name not in INLINE:
                    self._tag(name, inside > 0)
                continue
            for w in words:
                self.events.append(("." + w, 0, len(self.pieces) - 1, inside > 0))
            if name in MAIN:
                self.seen = True
                inside += 1
                self._tag(name, False)
            elif name == "br":
                self._text(" ", inside > 0)
            elif name not in INLINE:
                self._tag(name, inside > 0)

    def _text(self, text: str, inside: bool) -> None:
        words = len(text.split())
        block = len(self.pieces) - 1
        self.pieces[block].append(text)
        self.holders.setdefault(block, self.at)
        if words:
            self.events.append((None, words, block, inside))

    def _tag(self, name: str, inside: bool) -> None:
        if self.pieces[-1]:
            self.pieces.append([])
        self.events.append((name, 0, len(self.pieces) - 1, inside))

    def region(self, weights: dict[str, float], other: float) -> tuple[int, int]:
        """The first and last block of the best region; (0, -1) if no word scores."""
        best, here, start, found = 0.0, 0.0, None, (0, -1)
        for tag, words, block, _ in self.events:
            if tag is None:
                if here <= 0:
                    here, start = 0.0, block
                here += words
                if here > best:
                    best, found = here, (start, block)
            elif here > 0:
                weight = weights.get(tag)
                if weight is None:
                    weight = other if tag[0] != "." else HINT if tag[1:] in HINTS else 0.0
                here += weight
        return found

    def grown(self, first: int, last: int, weights: dict[str, float]) -> list[int]:
        """The blocks of the element that a region stands for."""
        words: Counter = Counter()
        for tag, n, block, _ in self.events:
            if tag is None and first <= block <= last:
                words[self.marks[self.holders[block]]] += n
        total = sum(words.values())
        below = set(words)
        while below:  # each element's words count for the marked ones around it too; inner ones have the greater numbers
            mark = max(below)
            below.discard(mark)
            if mark and words[mark] < MOSTLY * total:
                around = self.marks[self.parents[mark]]
                words[around] += words[mark]
                below.add(around)
        marked = [m for m, n in words.items() if m and n >= MOSTLY * total]
        if marked:
            return self._blocks(max(marked))
        a, b = self.holders[first], self.holders[last]
        while a != b:
            a, b = (self.parents[a], b) if a > b else (a, self.parents[b])
        while self.names[a] in FLOW:
            a = self.parents[a]
        if self.names[a] in ("", "html", "body"):
            return list(range(first, last + 1))
        cost = lambda w: weights.get("." + w, HINT if w in HINTS else 0.0)
        costly = {a: False}

        def under(node: int) -> bool:
            way = []
            while node not in costly:
                way.append(node)
                node = self.parents[node]
            for n in reversed(way):
                costly[n] = costly[self.parents[n]] or any(cost(w) < LEAST_COST for w in self.classes[n])
            return costly[way[0]] if way else costly[node]

        return [k for k in self._blocks(a) if first <= k <= last or k in self.holders and not under(self.holders[k])]

    def _blocks(self, node: int) -> list[int]:
        last = self.last[node]
        return list(range(self.first[node], len(self.pieces) if last is None else last + 1))

    def text(self, weights: dict[str, float], other: float) -> str:
        first, last = self.region(weights, other)
        blocks = (" ".join("".join(self.pieces[k]).split()) for k in (self.grown(first, last, weights) if first <= last else ()))
        return "\n\n".join(b for b in blocks if b)

    def labelled(self) -> str:
        """The words in ``article`` or ``main``."""
        kept = {e[2] for e in self.events if e[3] and e[0] is None}
        return "\n\n".join(" ".join("".join(p).split()) for k, p in enumerate(self.pieces) if k in kept)


def tag_costs(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """At or below 0 for each tag: the log of its share outside against inside of main elements, 0 where it prefers inside."""
    inside, outside = Counter(), Counter()
    for (tag, within), n in counts.items():
        (inside if within else outside)[tag] += n
    return {t: -max(0.0, math.log((outside[t] + 0.5) / (inside[t] + 0.5))) - 0.01 for t in inside | outside}


def fit(pages: DataFrame, max_pages: int = MAX_LABELLED) -> tuple[dict[str, float], float]:
    """Tag weights from labelled pages, at the scale that best returns their labelled words."""
    import pyarrow as pa

    marked = pages.where(F.lower("html").rlike("<(article|main)[ >]"))
    n = marked.count()
    if not n:
        return DEFAULT, -0.5
    share = int(min(1.0, max_pages / n) * (1 << 20))
    chosen = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < share
    sample = marked.where(chosen).select(F.col("html").cast("string"))

    def seen(batches: Iterator) -> Iterator:
        counts: Counter = Counter()
        for batch in slices(batches):
            for source in batch.column(0).to_pylist():
                counts.update((tag, inside) for tag, _, _, inside in Page(source).events if tag)
        rows = [{"tag": t, "inside": i, "n": n} for (t, i), n in counts.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("tag", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    totals = sample.mapInArrow(seen, "tag string, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n"))
    costs = tag_costs({(r["tag"], r["inside"]): r["n"] for r in totals.collect()})  # as many as the sample has

    def right(batches: Iterator) -> Iterator:
        scaled = [({t: c * s for t, c in costs.items()}, -0.5 * s) for s in SCALES]
        n = [0] * len(SCALES)
        for batch in slices(batches):
            for source in batch.column(0).to_pylist():
                page = Page(source)
                wanted = page.labelled()
                n = [k + (page.text(*given) == wanted) for k, given in zip(n, scaled, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(SCALES), pa.array(n, pa.int64())], ["scale", "n"])

    by_scale = {r["scale"]: r["n"] for r in sample.mapInArrow(right, "scale double, n long").groupBy("scale").agg(F.sum("n").alias("n")).collect()}
    best = max(SCALES, key=lambda s: by_scale.get(s, 0))
    return {t: c * best for t, c in costs.items()}, -0.5 * best


def extract(pages: DataFrame, fitted: tuple[dict[str, float], float]) -> DataFrame:
    """The main text of every page."""
    import pyarrow as pa

    def some(batches: Iterator) -> Iterator:
        for batch in slices(batches):
            texts = [Page(source or "").text(*fitted) for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(some, SCHEMA)
