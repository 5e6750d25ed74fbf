"""Repeated word windows across documents: found by Rabin-Karp hashes counted in Spark, merged into maximal intervals and cut out.

A window is `window` consecutive words of one document. A word goes if any window that covers it also starts in a document with a
smaller id; windows are judged on the texts as they came.

Counting every window by shuffling its hash would move more bytes than the texts themselves. Equal windows have equal anchors (the least
hash among their half-length sub-windows), and an anchor serves a dozen neighbouring windows, so anchors are counted first. A window whose
anchor occurs in one document alone is thereby counted too: it occurs once. All others are counted by a 96-bit hash. Both counts are plain
grouped minima with map-side combining, so a passage that a third of all documents share is no hot group; and each document is told what
it *owns* (where it has the smallest id), which makes a list no longer than the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import BLANK, flat_list, rolling, row_of, sliding_min, text_chunks, word_hashes
from ._scratch import set_apart

_CHECK_BASE = 0xA0761D6478BD642F


def _windows(column: pa.Array, window: int):
    """For each chunk of rows: the words, where a window starts (word number), its row in the chunk, its anchor, its hash and a second hash."""
    part = (window + 1) // 2
    for w in text_chunks(column, BLANK):
        h = word_hashes(w)
        row = row_of(w.word_at)
        n = len(h) - window + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            yield w, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
            continue
        start = np.flatnonzero(row[:n] == row[window - 1 :])
        anchors = sliding_min(rolling(h, part), window - part + 1)
        yield w, start, row[start], anchors[start], rolling(h, window)[start], rolling(h, window, _CHECK_BASE)[start]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, _, row, anchor, _, _ in _windows(batch.column(1), window):
                new = np.ones(len(row), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                ids = batch.column(0).take(pa.array(w.first + row[new]))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), ids], names=["anchor", "id"])

    return run


def _slices(at: np.ndarray, start_row: np.ndarray, n_rows: int) -> np.ndarray:
    return np.searchsorted(start_row, np.arange(n_rows + 1))


def _counted(window: int):
    """The windows whose anchors other documents have too, each once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owned_at, owned = flat_list(batch.column(2))
            owned = np.asarray(owned).view(np.uint64)
            for w, _, row, anchor, h, check in _windows(batch.column(1), window):
                cut = _slices(w.word_at, row, w.last - w.first)
                for r in np.flatnonzero(np.diff(cut)):
                    own = slice(cut[r], cut[r + 1])
                    mine = owned[owned_at[w.first + r] : owned_at[w.first + r + 1]]
                    _, pick = np.unique(h[own][~np.isin(anchor[own], mine)], return_index=True)
                    if not len(pick):
                        continue
                    left = np.flatnonzero(~np.isin(anchor[own], mine))[pick] + cut[r]
                    ids = batch.column(0).take(pa.array(np.full(len(left), w.first + r)))
                    yield pa.RecordBatch.from_arrays([pa.array(h[left].view(np.int64)), pa.array((check[left] >> np.uint64(33)).astype(np.int32)), ids], names=["h", "check", "id"])

    return run


def _cut(window: int, names: list[str]):
    """The rows with their words counted, the removed intervals (word numbers, end excluded) and the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unique_at, unique = flat_list(batch.column(2))
            owned_at, owned = flat_list(batch.column(3))
            unique, owned = np.asarray(unique).view(np.uint64), np.asarray(owned).view(np.uint64)
            identified = np.asarray(batch.column(0).is_valid())
            texts = batch.column(1)
            n_words, n_removed, kept = [], [], []
            span_at, span_from, span_to = [0], [], []
            for w, start, row, anchor, h, _ in _windows(texts, window):
                n_rows = w.last - w.first
                cut = _slices(w.word_at, row, n_rows)
                for r in range(n_rows):
                    i, words = w.first + r, int(w.word_at[r + 1] - w.word_at[r])
                    n_words.append(words)
                    own = slice(cut[r], cut[r + 1])
                    gone = np.zeros(0, np.int64)
                    if identified[i] and cut[r + 1] > cut[r]:
                        shared = ~np.isin(anchor[own], unique[unique_at[i] : unique_at[i + 1]])
                        if shared.any():
                            shared &= ~np.isin(h[own], owned[owned_at[i] : owned_at[i + 1]])
                            gone = start[own][shared] - w.word_at[r]
                    if not len(gone):
                        n_removed.append(0)
                        kept.append(texts[i].as_py())
                    else:
                        new = np.flatnonzero(np.diff(gone) > window)
                        begin, end = gone[np.concatenate([[0], new + 1])], gone[np.concatenate([new, [len(gone) - 1]])] + window
                        n_removed.append(int((end - begin).sum()))
                        span_from += begin.tolist()
                        span_to += end.tolist()
                        # From a removed interval's first byte to the next word kept, or the text's end.
                        first, last = w.word_at[r], w.byte_at[r + 1]
                        edges = np.concatenate([w.start[first : first + words], [last]])
                        pieces, at = [], w.byte_at[r]
                        for b, e in zip(begin, end):
                            pieces.append(w.data[at : edges[b]].tobytes())
                            at = edges[e]
                        pieces.append(w.data[at:last].tobytes())
                        kept.append(b"".join(pieces).decode())
                    span_at.append(len(span_from))
            spans = pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pa.StructArray.from_arrays([pa.array(span_from, pa.int64()), pa.array(span_to, pa.int64())], names=["begin", "end"]))
            rest = [batch.column(k) for k in range(4, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), spans, pa.array(kept, pa.string())], names=names)

    return run


OUT = {"n_words": "bigint", "n_removed": "bigint", "removed_spans": "array<struct<begin:bigint,end:bigint>>", "kept_text": "string"}


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """docs with, as last columns, n_words, n_removed, removed_spans (maximal intervals of word numbers) and kept_text; a column of docs with
    one of these names, in any case, is replaced.

    A null text has no words and stays null. Rows without an id neither lose words nor cost others any. Rows with the same id are one document:
    they don't cost each other words. Copies of a text lose all its windows but for the copy with the smallest id; texts of fewer words than a
    window lose nothing. An empty table gives an empty result. What stands between kept words stays as it was; a removed interval takes the blanks
    behind it along. Texts of any length are read whole; memory follows the longest text.
    """
    own = [c for c in docs.columns if c.lower() not in OUT]
    apart, rest = set_apart(docs, (id_col, text_col), OUT)
    kind = apart.schema["in0"].dataType.simpleString()
    slim = apart.where("in0 is not null").select(F.col("in0").alias("id"), F.col("in1").alias("text"))
    unique = (
        slim.mapInArrow(_anchors(window), f"anchor bigint, id {kind}")
        .groupBy("anchor").agg(F.min("id").alias("id"), F.max("id").alias("last"))
        .where(F.col("id") == F.col("last"))
        .groupBy("id").agg(F.collect_list("anchor").alias("unique_anchors"))
    )
    held = [f"c{k}" for k in range(len(rest))]
    packed = apart.withColumnsRenamed({"in0": "id", "in1": "text"}).join(unique, "id", "left").select("id", "text", "unique_anchors", *held)
    owned = (
        packed.mapInArrow(_counted(window), f"h bigint, check int, id {kind}")
        .where(F.col("id").isNotNull())
        .groupBy("h", "check").agg(F.min("id").alias("id"))
        .groupBy("id").agg(F.collect_list("h").alias("owned"))
    )
    both = packed.join(owned, "id", "left")
    back = {c.lower(): f"c{k}" for k, c in enumerate(rest)} | {id_col.lower(): "id", text_col.lower(): "text"}
    both = both.select("id", "text", "unique_anchors", "owned", *(F.col(back[c.lower()]).alias(f"o{k}") for k, c in enumerate(own)))
    fields = [T.StructField(f"o{k}", both.schema[f"o{k}"].dataType) for k in range(len(own))]
    schema = T.StructType(fields + [T.StructField(c, T._parse_datatype_string(t)) for c, t in OUT.items()])
    return both.mapInArrow(_cut(window, schema.names), schema).toDF(*own, *OUT)
