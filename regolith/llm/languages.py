"""Languages by prediction by partial matching: for each language a tree of byte contexts of up to `order` bytes with counts of the bytes that follow.

A text's code length under a language is the sum over its bytes: in the longest context that the tree has, a byte seen there costs its share, any other
costs an escape to the context one byte shorter, in which bytes that the longer one has seen no longer count (escapes by method C, with exclusion). Below
the empty context all bytes left are alike. Statistics are frozen, so lengths of all bytes can be taken at once: contexts are packed into numbers and
looked up in sorted arrays. Lengths are whole multiples of 2**-20 bits, so their sums don't depend on any order. The shortest code names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import kinds, set_apart, written

UNIT = float(1 << 20)
UNKNOWN = "und"
_U = np.uint64
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Settings:
    """order: bytes of the longest context, 6 at most. sample_bytes: of text that all languages' trees together are counted from, in equal parts; a language that has
    less is counted whole. It bounds the model, which every task holds; nothing else depends on it. cache: numbers kept by a task, of bytes with their contexts that it has met."""

    order: int = 4
    sample_bytes: int = 16 << 20
    cache: int = 1 << 22


def letters(text: Column) -> Column:
    """Lower-cased letters and marks, and one space for each stretch of anything else: what tells languages apart."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " "))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, and where each text's begin, with the total at the end; a null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    return (np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body is not None else np.zeros(0, np.uint8)), at - at[0]


def windows(data: np.ndarray, at: np.ndarray, order: int, low: int, high: int) -> np.ndarray:
    """For every byte from low to high the byte with `order` bytes before it, packed with the byte lowest; spaces stand before a text."""
    out = data[low:high].astype(np.uint64)
    begin = at[:-1][at[:-1] < at[1:]]
    begin = begin[np.searchsorted(begin, low - order) : np.searchsorted(begin, high)]
    for k in range(1, order + 1):
        before = data[max(low - k, 0) : max(high - k, 0)]
        back = np.full(high - low, 32, np.uint64)
        back[high - low - len(before) :] = before
        for j in range(k):
            edge = begin + j
            back[edge[(edge >= low) & (edge < high)] - low] = 32
        out |= back << _U(8 * k)
    return out


def _counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(batch.column(1))
            for k, lang in enumerate(batch.column(0).to_pylist()):
                packed = windows(data[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]]), order, 0, at[k + 1] - at[k])
                for n in range(order + 1):
                    own, count = np.unique(packed & _U((1 << 8 * (n + 1)) - 1), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(np.full(len(own), n, np.int32)), pa.array(own.view(np.int64)), pa.array(count)], names=["lang", "n", "packed", "count"])

    return run


class Tree:
    """One language's contexts. For each order: packed contexts with their byte, sorted, and counts; packed contexts, sorted, with total, number of bytes seen, and `shared`,
    what the context one byte shorter counts for these bytes."""

    def __init__(self, by_order: list[tuple[np.ndarray, np.ndarray]]):
        self.bytes, self.contexts = by_order, []
        for n, (packed, count) in enumerate(by_order):
            context, first = np.unique(packed >> _U(8), return_index=True)
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
            shared = np.zeros(len(first), np.int64)
            if n and len(first):
                shorter, amount = by_order[n - 1]
                found = np.searchsorted(shorter, packed & _U((1 << 8 * n) - 1))
                shared = np.add.reduceat(amount[found], first)
            self.contexts.append((context, total, np.diff(np.append(first, len(packed))), shared))

    def lengths(self, packed: np.ndarray) -> np.ndarray:
        """Code lengths, in units, of bytes with their contexts."""
        bits = np.zeros(len(packed))
        todo = np.arange(len(packed))
        less_total, less_seen = np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64)
        for n in reversed(range(len(self.bytes))):
            keys = packed[todo] & _U((1 << 8 * (n + 1)) - 1)
            at, known = _find(self.contexts[n][0], keys >> _U(8))
            count_at, seen = _find(self.bytes[n][0], keys)
            total = np.where(known, self.contexts[n][1][at] - less_total[todo], 0) if len(self.contexts[n][0]) else np.zeros(len(todo), np.int64)
            fresh = np.where(known, self.contexts[n][2][at] - less_seen[todo], 0) if len(self.contexts[n][0]) else total
            share = np.where(seen, self.bytes[n][1][count_at], fresh) if len(self.bytes[n][0]) else fresh
            # Without a byte that the longer context lacks nothing is told here, so nothing is paid.
            pays = fresh > 0
            bits[todo[pays]] += np.log2((total[pays] + fresh[pays]) / share[pays])
            here = todo[known]
            less_total[here], less_seen[here] = self.contexts[n][3][at[known]], self.contexts[n][2][at[known]]
            todo = todo[~seen]
        left = 256 - (int(self.contexts[0][2][0]) if len(self.contexts[0][0]) else 0)
        bits[todo] += np.log2(max(left, 1))
        return np.rint(bits * UNIT).astype(np.int64)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Lengths:
    """Code lengths under all trees, with those of bytes met lately kept in a table; whatever isn't there is looked up, so nothing depends on the table."""

    def __init__(self, trees: list[Tree], cache: int):
        self.trees = trees
        self.slots = 1 << max(4, (cache // max(1, len(trees))).bit_length() - 1)
        self.keys = np.full(self.slots, 2**64 - 1, np.uint64)
        self.kept = np.zeros((self.slots, len(trees)), np.int32)

    def __call__(self, packed: np.ndarray) -> np.ndarray:
        slot = ((packed * _U(0x9E3779B97F4A7C15)) >> _U(40)) & _U(self.slots - 1)
        out = self.kept[slot]
        miss = np.flatnonzero(self.keys[slot] != packed)
        if len(miss):
            own, back = np.unique(packed[miss], return_inverse=True)
            new = np.stack([t.lengths(own) for t in self.trees], 1).astype(np.int32)
            out[miss] = new[back]
            to = ((own * _U(0x9E3779B97F4A7C15)) >> _U(40)) & _U(self.slots - 1)
            self.keys[to], self.kept[to] = own, new
            # Of several that want one slot the last stays, key and numbers alike.
        return out


def trained(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """For each language, by order, packed contexts with their byte and how often they occur. Rows without a language or without a letter teach nothing; copies of a
    text in one language count once.

    Where a language has more than its part of sample_bytes, those of its texts are taken, whole, whose hash lies in a share of all hashes that is as large; the
    expected amount doesn't grow with the table. Counts are combined in tasks before they are shuffled. What reaches the driver is bounded by the sample.
    """
    apart, _ = set_apart(docs, (text_col, lang_col), docs.columns)
    own = apart.where(F.col("in1").isNotNull() & F.col("in0").rlike(r"\p{L}")).select(F.col("in1").cast("string").alias("lang"), F.col("in0").alias("text"))
    own = own.withColumn("mark", F.xxhash64("text"))
    sizes = written(own.groupBy("lang", "mark").agg(F.max(F.octet_length("text")).alias("size")).groupBy("lang").agg(F.sum("size").alias("size")))
    part = settings.sample_bytes / max(1, sizes.count())
    sizes = sizes.withColumn("limit", F.least(F.lit(1.0), part / F.col("size")))
    taken = own.join(sizes.select("lang", "limit"), "lang").where(F.pmod("mark", F.lit(1 << 40)) < F.col("limit") * float(1 << 40))
    once = taken.groupBy("lang", "mark").agg(F.min("text").alias("text")).select("lang", letters(F.col("text")).alias("text"))
    counted = once.mapInArrow(_counts(settings.order), "lang string, n int, packed bigint, count bigint").groupBy("lang", "n", "packed").agg(F.sum("count").alias("count"))
    table = written(counted).orderBy("lang", "n", "packed").toArrow()
    out: dict[str, list] = {}
    if table.num_rows:
        lang = table.column("lang").combine_chunks().dictionary_encode()
        code, n = np.asarray(lang.indices), np.asarray(table.column("n"))
        packed, count = np.asarray(table.column("packed")).view(np.uint64), np.asarray(table.column("count"))
        for k, name in enumerate(lang.dictionary.to_pylist()):
            out[name] = [(packed[m], count[m]) for m in ((code == k) & (n == o) for o in range(settings.order + 1))]
    return out


def _judged(names: list[str], known, settings: Settings, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(known.value, settings.cache)
        for batch in batches:
            data, at = bytes_of(batch.column(0))
            units = np.zeros((batch.num_rows, len(names)), np.int64)
            for low in range(0, len(data) if names else 0, _CHUNK):
                high = min(len(data), low + _CHUNK)
                each = lengths(windows(data, at, settings.order, low, high))
                upto = np.zeros((high - low + 1, len(names)), np.int64)
                np.cumsum(each, 0, out=upto[1:])
                edge = np.clip(at, low, high) - low
                units += upto[edge[1:]] - upto[edge[:-1]]
            some = np.asarray(batch.column(0).is_valid()) & (len(names) > 0)
            pred, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if len(names):
                least = units.min(1)
                score = np.where(some, 1 / np.exp2((least[:, None] - units) / UNIT).sum(1), 0.0)
                pred = [names[k] if s else UNKNOWN for k, s in zip(units.argmin(1), some)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), pa.array(pred, pa.string()), pa.array(score)], names=columns)

    return run


OUT = ("lang_pred", "score")


def identified(docs: DataFrame, model: dict[str, list[tuple[np.ndarray, np.ndarray]]], settings: Settings = Settings(), text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or its columns in keep, with lang_pred and score; columns that have one of these names, in any case, are replaced.

    lang_pred: the language of the shortest code of the whole text, ties to the first by name; `und`, with a score of 0, where the text is null or has no letter, or
    where the model has no language. score: the language's probability, from 0 to 1, if all were alike before the text was seen. Only the text is looked at.
    Rows are judged each for itself; repeated rows stay repeated, an empty table gives an empty result. Texts of any length are read whole, some bytes at a
    time. There is no shuffle.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    apart, _ = set_apart(docs, (text_col, *names), docs.columns)
    held = [f"in{k + 1}" for k in range(len(names))]
    langs = sorted(model)
    known = docs.sparkSession.sparkContext.broadcast([Tree(model[x]) for x in langs])
    packed = apart.select(letters(F.col("in0")).alias("letters"), F.col("in0").rlike(r"\p{L}").alias("some"), *held)
    out = packed.select(F.when(F.col("some"), F.col("letters")).alias("letters"), *held)
    found = out.mapInArrow(_judged(langs, known, settings, [*held, *OUT]), ", ".join([*kinds(packed, held), "lang_pred string, score double"]))
    return found.toDF(*names, *OUT)
