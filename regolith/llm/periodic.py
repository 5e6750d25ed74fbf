"""Periodic runs of words: every maximal stretch that repeats one sequence of words at least three times over, found on a harmonic grid.

Two words q apart that are equal are a match at period q. A run of period q and length n is a stretch of n - q consecutive matches, so it covers one
of the grid points 0, d, 2d, ... if d is no longer than the shortest stretch that counts, max(min_words - q, (min_repeats - 1) * q). Over all periods these
points number about n log n / 2. From each the stretch is measured to both sides by binary search over prefix hashes, all (period, point) pairs of many
texts at once in numpy; the words of what is found are compared afterwards, and a stretch that fails is measured word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._arrow import BLANK, Words, mix, powers, text_chunks
from ._scratch import set_apart

#: (period, grid point) pairs that are held at once.
_PAIRS = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def word_codes(w: Words) -> np.ndarray:
    """A number for each word, equal for words of equal bytes and for no others."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(w.end - w.start)])
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(w.data[BLANK[w.data]])])
    return np.asarray(packed.dictionary_encode().indices, np.int64)


def _grid(sizes: np.ndarray, first: np.ndarray, min_words: int, min_repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, point) of texts of so many words each, whose words begin at first; some pairs at a time."""
    rows = np.flatnonzero(sizes >= max(min_words, min_repeats))
    periods = sizes[rows] // min_repeats
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    total = 0
    # A text's periods are taken in slices, so that a very long one is no more at once than many short ones.
    for r, most in zip(rows, periods):
        low = 1
        while low <= most:
            q = np.arange(low, min(most, low + _PAIRS // 8) + 1)
            step = np.maximum(min_words - q, (min_repeats - 1) * q)
            upto = np.cumsum((sizes[r] - q - 1) // step + 1)
            n = max(1, int(np.searchsorted(upto, _PAIRS, side="right")))
            q, step, upto = q[:n], step[:n], upto[:n]
            held.append((np.full(n, r), q, step))
            low, total = low + n, total + int(upto[-1])
            if total >= _PAIRS:
                yield _points(held, sizes, first)
                held, total = [], 0
    if held:
        yield _points(held, sizes, first)


def _points(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, q, step = (np.concatenate(x) for x in zip(*held))
    count = (sizes[row] - q - 1) // step + 1
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    row, q, step = (np.repeat(x, count) for x in (row, q, step))
    return row, q, first[row] + at * step


def _reach(equal, most: np.ndarray) -> np.ndarray:
    """For each pair the largest length up to most of which equal(length) holds, as it holds for all shorter ones."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while len(most) and (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) >> 1, low)
        good = equal(mid)
        low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
    return low


def found_runs(codes: np.ndarray, word_at: np.ndarray, min_words: int = 24, min_repeats: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; start counts within the text. codes: of the words of all texts, word_at: where
    each text's begin, with the total at the end."""
    sizes, first = np.diff(word_at), word_at[:-1]
    n = len(codes)
    power = powers(_BASE, n + 1)
    upto = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * power[:n], out=upto[1:])
    out: list[np.ndarray] = []

    def same(i: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the hashes of `length` words from i and from i + q are equal."""
        return (upto[i + length] - upto[i]) * power[q] == upto[i + q + length] - upto[i + q]

    for row, q, i in _grid(sizes, first, min_words, min_repeats):
        hit = np.flatnonzero(codes[i] == codes[i + q])
        row, q, i = row[hit], q[hit], i[hit]
        least = np.maximum(min_words - q, (min_repeats - 1) * q)
        begin, end = first[row], first[row] + sizes[row]
        # A stretch that is long enough reaches half of its least length to one side of the point at least.
        half = (least + 1) // 2
        ahead, behind = end - q - i, i - begin
        some = np.flatnonzero(same(i, q, np.minimum(half, ahead)) & (half <= ahead) | same(i - np.minimum(half, behind), q, np.minimum(half, behind)) & (half <= behind))
        row, q, i, least, begin, ahead, behind = (x[some] for x in (row, q, i, least, begin, ahead, behind))
        right = _reach(lambda x: same(i, q, x), ahead)  # noqa: B023
        left = _reach(lambda x: same(i - x, q, x), behind)  # noqa: B023
        good = np.flatnonzero(left + right >= least)
        if len(good):
            out.append(np.unique(np.stack([row[good], i[good] - left[good], left[good] + right[good] + q[good], q[good]], 1), axis=0))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    every = np.unique(np.concatenate(out), axis=0)
    runs = _smallest(every)
    if len(bad := np.unique(runs[~np.array([_holds(codes, word_at, x) for x in runs]), 0])):
        again = [_plainly(codes, word_at, *x, min_words, min_repeats) for x in np.unique(every[np.isin(every[:, 0], bad)][:, [0, 3]], axis=0)]
        runs = np.concatenate([runs[~np.isin(runs[:, 0], bad)], _smallest(np.unique(np.concatenate(again), axis=0))])
    row, start, length, period = runs.T
    start = start - first[row]
    order = np.lexsort((period, start, row))
    return row[order], start[order], length[order], period[order]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of sorted rows (text, start, length, period) the first of each extent: those of one extent have the multiples of one period."""
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    return runs[new]


def _holds(codes: np.ndarray, word_at: np.ndarray, run: np.ndarray) -> bool:
    """Whether the words themselves repeat with the run's period and no neighbour does."""
    row, start, length, q = run
    end = start + length
    inside = (codes[start : end - q] == codes[start + q : end]).all()
    return bool(inside and (start == word_at[row] or codes[start - 1] != codes[start - 1 + q]) and (end == word_at[row + 1] or codes[end] != codes[end - q]))


def _plainly(codes: np.ndarray, word_at: np.ndarray, row: int, q: int, min_words: int, min_repeats: int) -> np.ndarray:
    """The stretches of one text and period, word by word: for texts in which hashes have deceived."""
    a, b = word_at[row], word_at[row + 1]
    match = np.concatenate([[False], codes[a : b - q] == codes[a + q : b], [False]])
    edge = np.flatnonzero(match[1:] != match[:-1])
    start, size = edge[::2] + a, edge[1::2] - edge[::2]
    long = size >= max(min_words - q, (min_repeats - 1) * q)
    return np.stack([np.full(long.sum(), row), start[long], size[long] + q, np.full(long.sum(), q)], 1)


OUT = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "strongest": "struct<start:bigint,length:bigint,period:bigint>", "collapsed_text": "string"}
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(min_words: int, min_repeats: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, best, kept = [], [], [], []
            for w in text_chunks(batch.column(0), BLANK):
                row, start, length, period = found_runs(word_codes(w), w.word_at, min_words, min_repeats)
                cut = np.searchsorted(row, np.arange(w.last - w.first + 1))
                for r in range(w.last - w.first):
                    mine = [{"start": int(s), "length": int(n), "period": int(q)} for s, n, q in zip(*(x[cut[r] : cut[r + 1]] for x in (start, length, period)))]
                    a, b = w.word_at[r], w.word_at[r + 1]
                    n_words.append(int(b - a))
                    runs.append(mine)
                    best.append(min(mine, key=lambda x: (-Fraction(x["length"], x["period"]), x["start"], x["period"])) if mine else None)
                    # +1 where a dropped stretch begins, -1 where it ends.
                    edges = np.zeros(b - a + 1, np.int64)
                    for x in mine:
                        edges[x["start"] + x["period"]] += 1
                        edges[x["start"] + x["length"]] -= 1
                    stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0) + a
                    kept.append(joined(w, stay) if batch.column(0)[w.first + r].is_valid else None)
            columns = [pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), *columns], names=names)

    return run


def joined(w: Words, which: np.ndarray) -> str:
    """The words of those numbers, with one space between them."""
    if not len(which):
        return ""
    size = w.end[which] - w.start[which] + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) - np.repeat(ends - size - w.start[which], size)
    out = w.data[np.minimum(at, len(w.data) - 1)]
    out[ends - 1] = 32
    return out[:-1].tobytes().decode()


def collapsed(docs: DataFrame, text_col: str = "text", min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """docs with, as last columns, n_words, runs, strongest and collapsed_text; a column of docs with one of these names, in any case, is replaced.

    Words are `[^\\x20\\x09-\\x0D]+`. runs: every stretch whose smallest period q leaves at least max(min_words, min_repeats * q) words and that no
    neighbouring word extends at that period, by start, then period. strongest: that of the largest length over period, ties to the smallest start, then
    period; null without a run. collapsed_text: the words that no run contains after its first period, joined by one space.

    A null text has no words and no runs, and a null collapsed_text; an empty text, or one of blanks, gives an empty one. Rows are judged each for itself, so
    repeated rows stay repeated, ids may be null, and an empty table gives an empty result. Texts of any length are read whole; (period, point) pairs
    are taken some at a time, so memory follows the longest text. There is no shuffle.
    """
    own = [c for c in docs.columns if c.lower() not in OUT]
    apart, rest = set_apart(docs, (text_col,), OUT)
    back = {c.lower(): f"c{k}" for k, c in enumerate(rest)} | {text_col.lower(): "in0"}
    packed = apart.selectExpr("in0 AS text", *(f"{back[c.lower()]} AS o{k}" for k, c in enumerate(own)))
    fields = [T.StructField(f"o{k}", packed.schema[f"o{k}"].dataType) for k in range(len(own))]
    schema = T.StructType(fields + [T.StructField(c, T._parse_datatype_string(t)) for c, t in OUT.items()])
    return packed.mapInArrow(_found(min_words, min_repeats, schema.names), schema).toDF(*own, *OUT)
