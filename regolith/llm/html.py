"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped and each block element becomes a line. What is never article text (menus, page headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) is stripped along with its content. Page headers, footers and menus leave a gap of empty lines, as do the borders of
article and main elements; what is stripped inside those leaves none. A line weighs as much as its text outside links, and weights are summed over
sliding windows of lines. Where they stay at zero for a window's lines or more, or where there is a gap, the text dives; the lines between two dives are
a stretch, and stretches whose sums surge are text. If none surges, the one with the highest sum is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._scratch import kinds, set_apart

WINDOW, SURGE = 3, 86
#: Lines of a gap: so many that some window's reach ends on either side.
_GAP = 2 * WINDOW - 1

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}

_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACE = frozenset("br td th img".split())
#: Elements that are stripped with their content.
_STRIPPED = frozenset("aside button canvas dialog footer form head menu nav noscript object search select svg template".split())
#: Stripped elements that part what stands before them from what stands behind.
_PARTING = frozenset("footer header menu nav".split())
#: Elements are stripped with their content if a name in class, id or role consists of these words, with or without words of _PLAIN; `related-work` doesn't.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split()
)
_PLAIN = frozenset("area article bar block bottom box buttons container entry form global group inner item items left links list main outer page panel post reader right section site slot top user wrap wrapper".split())
_COMMENT = frozenset("comment comments".split())
_CLOSED_BY_BLOCK = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"])}


def _stripped(name: str, attributes: str, in_article: bool) -> bool:
    if name in _STRIPPED or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    listed = _COMMENT if name == "article" else _WORDS if in_article or name == "article" else _WORDS | {"header"}
    for m in _NAMED.finditer(attributes):
        for whole in (m[1] or m[2] or m[3] or "").split():
            parts = {w.lower() for w in _PART.findall(whole)}
            if parts & listed and parts <= listed | _PLAIN:
                return True
    return False


class _Lines:
    """The lines of a page so far: text, and weight outside links. A gap is a line without text that no stretch spans."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.weight: list[int] = []
        self.pieces: list[str] = []
        self.linked = 0

    def end(self) -> None:
        if self.pieces:
            if line := " ".join("".join(self.pieces).split()):
                self.text.append(line)
                self.weight.append(max(0, len(line) - self.linked))
            self.pieces, self.linked = [], 0

    def gap(self) -> None:
        self.end()
        if self.text and self.text[-1]:
            self.text += [""] * _GAP
            self.weight += [0] * _GAP


def _lines(page: str) -> _Lines:
    out = _Lines()
    stack: list[tuple[str, bool]] = []  # open elements, each with whether it is stripped; inline ones only if they are
    open_of: Counter[str] = Counter()
    stripped: list[int] = []  # where in the stack those are
    at, article, links = 0, 0, 0

    def close(upto: int) -> None:
        nonlocal article
        while len(stack) > upto:
            name, strip = stack.pop()
            open_of[name] -= 1
            if strip:
                stripped.pop()
                if not stripped and not article and name in _PARTING:
                    out.gap()
            elif name in ("article", "main"):
                article -= 1
                if not stripped:
                    out.gap()

    def add(text: str) -> None:
        if not stripped:
            text = unescape(text) if "&" in text else text
            out.pieces.append(text)
            if links:
                out.linked += len(text)

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2] or not m[4]:
            continue
        name, ending = m[2].lower(), bool(m[1])
        if ending:
            if name == "a":
                links = max(0, links - 1)
            elif name in _BLOCK or open_of[name]:
                if not stripped:
                    out.end()
                if open_of[name]:
                    # What is above it is closed too, so no element is looked at twice.
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    close(k)
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if stack and stack[-1][0] == "head" and (name in _BLOCK or name in _SPACE or name == "a"):
            close(len(stack) - 1)
        if name in _SPACE:
            add(" ")
        if name == "a":
            links += 1
        if name in _BLOCK:
            links = 0
            if not stripped:
                out.end()
            if stack and name in _CLOSED_BY_BLOCK.get(stack[-1][0], ()):
                close(len(stack) - 1)
        if name in _VOID or name == "svg" and m[3].endswith("/"):
            continue
        if name in ("article", "main") and stripped and stack[stripped[0]][0] in ("form", "nav", "header", "head"):
            # Such an element can't stand in a menu or page header: those were left open; and a form may wrap a whole page.
            close(stripped[0])
        strip = _stripped(name, m[3], article > 0)
        if strip or name in _BLOCK:
            if name in ("article", "main") and not strip:
                article += 1
                if not stripped:
                    out.gap()
            if strip:
                stripped.append(len(stack))
            stack.append((name, strip))
            open_of[name] += 1
    if at < len(page):
        add(page[at:])
    if not stripped:
        out.end()
    return out


def _between(weight: np.ndarray, gap: np.ndarray, surge: int) -> np.ndarray:
    """Whether each line lies in a stretch of text. gap: of each line, whether it is one."""
    n = len(weight)
    # Runs of lines alike: with weight, of links alone, or gaps. A run of links as long as a window is a dive, a shorter one isn't.
    kind = np.where(gap, 2, np.where(weight > 0, 1, 0))
    begins = np.flatnonzero(np.diff(kind, prepend=-1))
    runs = np.diff(np.append(begins, n))
    text = np.repeat((kind[begins] == 1) | (kind[begins] == 0) & (runs < WINDOW), runs)
    if not (text & (weight > 0)).any():
        return np.zeros(n, bool)
    starts = np.diff(text.astype(np.int8), prepend=0) == 1
    stretch = np.cumsum(starts) - 1
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))[:n]  # of the window that ends with each line; none reaches across a dive or gap
    peak = np.zeros(stretch.max() + 1, np.int64)
    np.maximum.at(peak, stretch[text], sums[text])
    kept = text & (peak >= surge if (peak >= surge).any() else peak == peak.max())[np.maximum(stretch, 0)]
    # A dive between two kept stretches is part of the text, unless a gap is.
    ends = np.flatnonzero(np.diff(kept.astype(np.int8), prepend=0, append=0))
    upto = np.concatenate([[0], np.cumsum(gap)])
    for a, b in zip(ends[1::2], ends[2::2]):
        if upto[a] == upto[b]:
            kept[a:b] = True
    return kept


def main_text(page: str | None) -> str:
    """The kept lines, joined by an empty line; empty for null, for pages without text and for pages of links only."""
    if not page:
        return ""
    lines = _lines(page)
    if not lines.text:
        return ""
    kept = _between(np.array(lines.weight, np.int64), np.array([not t for t in lines.text]), SURGE)
    return "\n\n".join(t for t, k in zip(lines.text, kept) if k and t)


def _extract(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(0)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), pa.array(texts, pa.string()), sizes], names=names)

    return run


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (its code points); columns of pages that have one of these names, in any case, are replaced.

    Pages are read whole, each for itself and where it lies: nothing is shuffled, and time and memory follow the page's length. A null or empty page, or one
    that is cut anywhere, gives what there is; repeated rows give equal rows; an empty table gives an empty result; stretches with equal highest sums
    are all text. White space inside a block, `br` and cells' borders become one space; character references are decoded; nothing else is
    dropped or shortened.
    """
    packed, rest = set_apart(pages, (html_col,), ("text", "n_chars"))
    held = [f"c{k}" for k in range(len(rest))]
    out = packed.mapInArrow(_extract([*held, "text", "n_chars"]), ", ".join([*kinds(packed, held), "text string, n_chars bigint"]))
    return out.toDF(*rest, "text", "n_chars")
