"""Main text of web pages from flat text blocks (operator 10).

A page becomes a flat list of text blocks.  Each block has its word count and
link density (share of words in links), and those of the blocks before and after
it.  A small decision tree, grown at import from the labelled pages below, tells
main text from the rest by these numbers; two weak marks help it where numbers
are silent: whether the block stands in an article element, and whether its own
paragraph has a class name of page furniture.  Main blocks are joined by one
newline.  Inside a block white space becomes one space and character references
are decoded.

What the markup itself declares to be no article is left out before: elements for
navigation, footers, asides and forms, hidden ones, and containers whose class
says advert, comments, sidebar and the like.  Their blocks still count as
neighbours.  A container is not furniture for a modifier (`has-sidebar`) or for
holding a headline (`entry-header`), and the outermost article or main element
sets marks of wrappers around it aside, unless the wrapper is hidden or of a kind
that holds other articles.

Blocks end at every block-level tag and at <br>.  Script, style and similar raw
elements and comments hold no text and end no block.  Unclosed elements end with
the container they stand in; the text of an option ends at the next tag but its
own inline ones.  Reading is linear in the page, at any depth of nesting.

Defined cases: null or empty html gives an empty text; a page without main
blocks gives an empty text; null url and page_id stay null; repeated rows give
repeated results; an empty table gives an empty table.  A page of any length is
read whole, with memory in proportion to it, in batches of bounded bytes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts, tune

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"'=]|=\s*+(?:"[^"]*"|'[^']*')?+|["'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NOT_SHOWN = re.compile(r"(?i)display\s*:\s*none")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names of the markup language by what they mean here.
RAW = frozenset("annotation annotation-xml script style noscript template textarea iframe svg object select title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meta link q s samp small span strike strong sub sup time tt u var wbr "
    "math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form menu button dialog fieldset header".split())
ARTICLE = frozenset("article main".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
# Wrappers whose articles are not the page's own.
OTHERS = frozenset("nav footer aside menu button dialog comment comments reply replies disqus discussion related recommended promo promotion".split())
# Words in class, id and role that mark page furniture.
MARKED = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu topbar toolbar header masthead "
    "footer comment comments reply replies disqus discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended breadcrumb breadcrumbs pagination pager widget widgets search copyright legal disclaimer complementary contentinfo skip".split()
)
# First words of class names that only modify a layout, and words beside `header` that make it a headline's place.
MODIFIERS = frozenset("has with without no hide is".split())
HEADLINE = frozenset("entry post article story content page title".split())
# Words that mark an inline element as no part of its sentence.
INLINE_MARKED = frozenset("ad ads advert advertisement sponsored share sharing".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    inside: bool
    weak: bool


def marks_of(attributes: dict[str, str]) -> set[str]:
    """The words of class, id and role that mark furniture."""
    out: set[str] = set()
    for name in " ".join(filter(None, map(attributes.get, ("class", "id", "role")))).split():
        parts = [p.lower() for p in _PIECE.findall(name)]
        found = MARKED.intersection(parts)
        if found and not (len(parts) > 1 and parts[0] in MODIFIERS):
            out |= found - {"header"} if HEADLINE.intersection(parts) else found
    return out


class _Reader:
    """The state of one page: open elements, and the block that is open."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.runs: list[tuple[str, bool]] = []  # of the open block, and whether they are in a link
        self.stack: list[tuple[str, str]] = []  # open elements: name and kind
        self.names: Counter[str] = Counter()  # of open elements
        self.kinds: Counter[str] = Counter()
        self.link = self.muted = 0

    def close(self) -> None:
        if not self.runs:
            return
        whole = " ".join("".join(t for t, _ in self.runs).split())
        if whole:
            linked = sum(len(t.split()) for t, a in self.runs if a)
            inside, kinds = self.kinds["article"] > 0, self.kinds
            furniture = kinds["hard"] > 0 or kinds["inner" if inside else "outer"] > 0
            words = whole.count(" ") + 1
            self.blocks.append(Block(whole, words, min(linked, words), furniture, inside, kinds["weak"] > 0))
        self.runs.clear()

    def push(self, name: str, kind: str) -> None:
        self.stack.append((name, kind))
        self.names[name] += 1
        self.kinds[kind] += 1

    def pop(self) -> str:
        name, kind = self.stack.pop()
        self.names[name] -= 1
        self.kinds[kind] -= 1
        return name

    def end(self, name: str) -> None:
        if self.names[name]:
            while self.pop() != name:
                pass
            self.link = 0

    def start(self, name: str, attributes: dict[str, str]) -> None:
        """Open a block-level element; its kind is hard, outer or inner furniture, weak, article, or plain."""
        if self.stack and (self.stack[-1][0] == "p" or name in ("li", "dt", "dd", "tr", "td", "th") and self.stack[-1][0] == name):
            self.pop()  # these end where the next block, or the next of their kind, begins
        inside = self.kinds["article"] > 0
        marks = marks_of(attributes) if attributes else frozenset()
        if attributes and is_hidden(attributes):
            kind = "hard"
        elif name in ARTICLE:
            kind = "hard" if marks & {"comment", "comments"} else "article"
        elif name in ("html", "body"):
            kind = "plain"
        elif name in TEXTUAL:
            kind = "weak" if marks else "plain"
        elif name in OTHERS or marks & OTHERS:
            kind = "hard"
        elif marks or name in BOILER and not (name == "header" and inside):
            kind = "inner" if inside else "outer"
        else:
            kind = "article" if "articlebody" in attributes.get("itemprop", "").lower() else "plain"
        self.push(name, kind)


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_NOT_SHOWN.search(attributes.get("style", "")))


def flat_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    r = _Reader()
    at, mute = 0, ("", 0)  # inline element whose text is no part of its block, and how many of its name are open
    while True:
        m = _TAG.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk and not mute[1]:
            r.runs.append((html.unescape(chunk) if "&" in chunk else chunk, r.link > 0))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        ending = bool(m[1])
        if name in RAW:
            if not ending and not m[3].endswith("/"):
                close_at = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close_at.end() if close_at else len(page)
            continue
        if name == "option" and not ending:
            r.close()
            while (end := _TAG.search(page, at)) and (not (inner := (end[2] or "").lower()) or inner in INLINE):
                at = end.end()
            at = end.start() if end else len(page)  # its text is passed over up to here
            continue
        if name == "a":
            r.link = 0 if ending else 1
            continue
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] and not ending else {}
        if name in INLINE:
            if name in VOID:
                continue
            if name == mute[0] and mute[1]:
                mute = (name, mute[1] + (-1 if ending else 1))
            elif attributes and not mute[1] and (is_hidden(attributes) or marks_of(attributes) & INLINE_MARKED):
                mute = (name, 1)
            continue
        r.close()
        mute = ("", 0)
        if ending:
            r.end(name)
        elif name not in VOID:
            r.start(name, attributes)
    r.close()
    return r.blocks


# Labelled pages, fixed values: one page a line, its blocks in order.  A block is + (main text), - (not) or x
# (furniture by its markup, only a neighbour), its words, .words in links, a (in an article element), w (marked paragraph).
_LABELLED = """
x1.1 x1.1 x6 +8a +60a +75.2a +3a +40a x8
x2.2 x1.1 +5a +5a x9
x1.1 x1.1 +12a +1a +2a +33a -4.4a -6.5a x3
-1.1a -2.2a +7a +55a +90.6a -3.3a -2.2a +44a
+6a +3a +4a +2a +5a -8.8a -9.7a
+10a +40a +25aw -3.3aw -1aw +18aw +35a -2aw
x4 +1a x7
+9a +30.12a +26.9a -12.10a -20.18a +4a
x1.1 +14a +5aw +70a +8aw -1aw -2.2aw
-1.1 -1.1 -1.1 -1.1 +7 +60 +70.2 +45 -5.5 -1.1 -4
-2.2 -3 +9 +80 +4 +52.3 +2 +38 -6.6 -7.5 -12.12
+5 +120 +64 +90.8 -3
+40 +2 +40
-1 -2.2 +11 +33 +6 +28 +3 +41 -2.2 -2.2 -2.2 -9
-1.1 -1.1 -5 -1.1 -1.1 -2 -3.3
-3 -2.2 -4.4 -2.2 -6 -1.1 -1.1
-4 -1.1 -8.6 -3 -12.12 -2.2 -14.11
+6 +22 +5 +30 +4 +26 -7.7 -3.3
-1.1 -25.18 -1.1 -30.24 -2.2 -28.22 -1.1
-2.2 -2.2 +8 +18 +17 +95 +21.4 -5.5 -4 -1.1
+150 -2.2 -3 -1.1
x1.1 x1.1 +3 +48 +20 +16 +66 x5 x2.2
-1w -2w -3.3w +25w +40 -2w
-4w +6 +50 +22w -3w -1.1
-2 -3.3 -11 -1.1 -1.1 -10 -2.2
+13 +34 -1.1 -1.1 -12 -2.2
-1.1 -9 -1.1 -8 -1.1 -6 -3.3
x1.1 +8a +12a x2.2 x1.1
+60a +5a -2.2a
+9a +7a -1.1a x1.1
+30a +3a x4.4
+6a +11a x3.3 +4a x1.1
+2a -1.1a +3a -2.2a
"""
_BLOCK = re.compile(r"([-+x])(\d+)(?:\.(\d+))?(a?)(w?)")


def features(blocks: list[tuple[int, int, bool, bool]]) -> np.ndarray:
    """(words, linked, inside an article, marked paragraph) of a page's blocks -> rows of eight features."""
    a = np.array(blocks, float).reshape(-1, 4)
    density = a[:, 1] / np.maximum(a[:, 0], 1)
    edge = np.zeros(1)
    before = [np.concatenate([edge, x[:-1]]) for x in (a[:, 0], density)]
    after = [np.concatenate([x[1:], edge]) for x in (a[:, 0], density)]
    return np.stack([a[:, 0], density, *before, *after, a[:, 2], a[:, 3]], 1)


def labelled_pages() -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of each labelled page, without its furniture."""
    out = []
    for line in _LABELLED.strip().split("\n"):
        found = [m.groups() for m in map(_BLOCK.fullmatch, line.split())]
        x = features([(int(n), int(k or 0), bool(a), bool(w)) for _, n, k, a, w in found])
        rows = np.array([f[0] != "x" for f in found])
        out.append((x[rows], np.array([f[0] == "+" for f in found])[rows]))
    return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    pages = labelled_pages()
    return np.concatenate([x for x, _ in pages]), np.concatenate([y for _, y in pages])


class DecisionTree:
    """Binary classification by Gini splits; a leaf answers with its majority."""

    def __init__(self, depth: int = 6, leaf: int = 2):
        self.depth, self.leaf, self.root = depth, leaf, True

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.root = self._grow(x, y, self.depth)
        return self

    def _grow(self, x, y, depth):
        if depth == 0 or y.all() or not y.any():
            return bool(y.mean() >= 0.5)
        best = None
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, k] <= cut
                sizes = left.sum(), (~left).sum()
                if min(sizes) < self.leaf:
                    continue
                gini = sum(n * 2 * p * (1 - p) for n, p in zip(sizes, (y[left].mean(), y[~left].mean()), strict=True))
                if best is None or gini < best[0] - 1e-12:
                    best = gini, k, cut
        if best is None:
            return bool(y.mean() >= 0.5)
        _, k, cut = best
        left = x[:, k] <= cut
        return k, cut, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)

        def walk(node, rows):
            if isinstance(node, bool):
                out[rows] = node
            elif len(rows):
                k, cut, low, high = node
                below = x[rows, k] <= cut
                walk(low, rows[below])
                walk(high, rows[~below])

        walk(self.root, np.arange(len(x)))
        return out


TREE = DecisionTree().fit(*labelled_table())


def main_text(page: str, tree: DecisionTree = TREE) -> str:
    blocks = flat_blocks(page)
    if not blocks:
        return ""
    main = tree.predict(features([(b.words, b.linked, b.inside, b.weak) for b in blocks]))
    return "\n".join(b.text for b, keep in zip(blocks, main, strict=True) if keep and not b.furniture)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    tune(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(p) for p in texts(batch.column(2))]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), run, "page_id long, url string, text string, n_chars long")
