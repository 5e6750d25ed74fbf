"""Benchmark passages in a corpus, by a positional inverted index that is stored with the documents' shards.

The index holds, for each document, the positions of each of its terms. It is distributed by document, so a search intersects lists of the same
document within one task: the corpus is never moved, no term or passage is a hot key, and a stored index serves any later benchmark. A benchmark is searched
block by block, so that what the driver and a task hold of it has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._arrow import PUNCT, flat_list, list_array, row_of, text_chunks, word_hashes
from ._scratch import kinds, set_apart, written

_PAD = 64  # free numbers between the positions of neighbouring lists, so that a tolerance never reaches into the next


def _index(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in text_chunks(batch.column(0), PUNCT, lower=True):
                n_rows = w.last - w.first
                coded = pa.array(word_hashes(w)).dictionary_encode()
                code, n_codes, n = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary), len(coded)
                bits = max(n, 1).bit_length()
                # One number for row, term and place: sorting the numbers sorts the postings.
                order = np.sort((row_of(w.word_at) * n_codes + code) << bits | np.arange(n))
                at, group = order & (1 << bits) - 1, order >> bits
                begins = np.flatnonzero(np.diff(group, prepend=-1))
                row = group[begins] // max(n_codes, 1)
                list_at = np.searchsorted(row, np.arange(n_rows + 1))
                position_at = np.concatenate([begins, [n]])[list_at]
                sizes = np.diff(np.concatenate([begins, [n]]))
                positions = at - np.repeat(w.word_at[:-1], np.diff(w.word_at))
                terms = coded.dictionary.take(pa.array(code[at[begins]]))
                rest = [batch.column(k).slice(w.first, n_rows) for k in range(1, batch.num_columns)]
                lists = [list_array(list_at, terms.cast(pa.uint64()).view(pa.int64())), list_array(list_at, pa.array(sizes.astype(np.int32))), list_array(position_at, pa.array(positions.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(w.word_at).astype(np.int64)), *lists], names=names)

    return run


def indexed(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The index, written: row_id, the columns in keep as k0, k1, ..., n_words, terms (their hashes), counts (of each term's places) and positions (word numbers,
    term after term). Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z have been lower-cased, of whole texts."""
    slim, _ = set_apart(docs, (text_col, *keep), docs.columns)
    slim = slim.toDF("text", *(f"k{k}" for k in range(len(keep))))
    names = [*slim.columns[1:], "n_words", "terms", "counts", "positions"]
    made = slim.mapInArrow(_index(names), ", ".join([*kinds(slim, slim.columns[1:]), "n_words bigint, terms array<bigint>, counts array<int>, positions array<int>"]))
    return written(made.withColumn("row_id", F.monotonically_increasing_id()))


class Queries(NamedTuple):
    """Windows of benchmark items. terms: sorted hashes; of each window: item (a number), length, and its offsets and term numbers from the rarest term to the
    commonest; by_rarest, first: the windows by their rarest term, and where each term's begin. Sent to tasks as a plain tuple."""

    terms: np.ndarray
    item: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    term: np.ndarray
    by_rarest: np.ndarray
    first: np.ndarray


def _item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts, and where each text's begin."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in text_chunks(pa.array(texts, pa.string()), PUNCT, lower=True):
        hashes.append(word_hashes(w))
        sizes.append(np.diff(w.word_at))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _queries(h: np.ndarray, at: np.ndarray, terms: np.ndarray, frequency: np.ndarray, window: int) -> Queries:
    """frequency: of each term in the corpus."""
    n = np.diff(at)
    windows = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), windows)
    start = at[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    length = np.minimum(n[item], window)
    places = np.minimum(start[:, None] + np.arange(window), max(len(h) - 1, 0))
    inside = np.arange(window) < length[:, None]
    term = np.searchsorted(terms, h)[places] if len(h) else np.zeros((0, window), np.int64)
    order = np.argsort(np.where(inside, frequency[term] if len(h) else 0, np.iinfo(np.int64).max), axis=1, kind="stable")
    term = np.where(np.take_along_axis(inside, order, 1), np.take_along_axis(term, order, 1), -1).astype(np.int32)
    by_rarest = np.argsort(term[:, 0], kind="stable").astype(np.int32)
    return Queries(terms, item.astype(np.int32), length.astype(np.int16), order.astype(np.int16), term, by_rarest, np.searchsorted(term[by_rarest, 0], np.arange(len(terms) + 1)))


def _frequencies(terms):
    """From an index's terms and counts: how often each known term occurs, a row for each that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            found, counts = (np.asarray(batch.column(k).flatten()) for k in (0, 1))
            found = found.view(np.uint64)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = known[at] == found
            total += np.bincount(at[hit], weights=counts[hit], minlength=len(known)).astype(np.int64)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], names=["term", "n"])

    return run


def _matches(q: Queries, row: np.ndarray, term: np.ndarray, position: np.ndarray, slack: int):
    """Yields (row, window, start) of matches, a bounded number of whole rows at a time; the postings come sorted."""
    at, rows = 0, max(1, (1 << 28) // len(q.terms))
    while at < len(row):
        to = int(np.searchsorted(row, row[at] + rows))
        to = max(int(np.searchsorted(row, row[at], side="right")), min(to, int(np.searchsorted(row, row[min(at + (1 << 20), len(row) - 1)]))) if at + (1 << 20) < len(row) else to)
        for r, win, start in _intersected(q, row[at:to] - row[at], term[at:to], position[at:to], slack):
            yield r + row[at], win, start
        at = to


def _intersected(q: Queries, row: np.ndarray, term: np.ndarray, position: np.ndarray, slack: int, most: int = 1 << 20):
    """The lists' intersection, each shifted by its term's offset, from the rarest term on, to a tolerance of slack."""
    n_terms = len(q.terms)
    held = ((row * n_terms + term) << 34) + position + _PAD
    fanout = q.first[term + 1] - q.first[term]
    upto = np.concatenate([[0], np.cumsum(fanout)])
    at = 0
    while at < len(held):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        each = fanout[at:to]
        post = np.repeat(np.arange(at, to), each)
        within = np.arange(len(post)) - np.repeat(upto[at:to] - upto[at], each)
        win = q.by_rarest[q.first[term[post]] + within]
        r, start = row[post], position[post] - q.offset[win, 0]
        if not slack:
            keep = start >= 0
            r, win, start = r[keep], win[keep], start[keep]
        for k in range(1, q.term.shape[1]):
            if not len(r):
                break
            more = k < q.length[win]
            want = ((r * n_terms + q.term[win, k]) << 34) + start + q.offset[win, k] + _PAD
            near = np.minimum(np.searchsorted(held, want - slack), len(held) - 1)
            keep = ~more | (held[near] >= want - slack) & (held[near] <= want + slack)
            r, win, start = r[keep], win[keep], start[keep]
        yield r, win, start
        at = to


def _pairs(found: list[np.ndarray], n_rows: int, ids: pa.Array) -> pa.Array:
    """For each row the distinct items, from arrays of (row, item number)."""
    pairs = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
    return list_array(np.searchsorted(pairs[0], np.arange(n_rows + 1)), ids.take(pa.array(pairs[1])))


def _search(block, slack: int):
    """block: a broadcast of (Queries as a tuple, the items' ids). Rows of the index with a match: row_id, items, near_items, and spans, the union of the exact matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids = Queries(*block.value[0]), block.value[1]
        for batch in batches:
            n_rows = batch.num_rows
            n_words = np.asarray(batch.column(1))
            list_at, terms = flat_list(batch.column(2))
            terms, sizes, positions = np.asarray(terms).view(np.uint64), np.asarray(batch.column(3).flatten(), np.int64), np.asarray(batch.column(4).flatten(), np.int64)
            list_row = row_of(list_at)
            t = np.minimum(np.searchsorted(q.terms, terms), len(q.terms) - 1)
            mine = q.terms[t] == terms
            place = np.repeat(mine, sizes)
            row, term, position = np.repeat(list_row[mine], sizes[mine]), np.repeat(t[mine], sizes[mine]), positions[place]
            # The index has a row's terms in any order; a search wants them by number.
            order = np.argsort(row * len(q.terms) + term, kind="stable")
            row, term, position = row[order], term[order], position[order]
            items, near, spans = [], [], [np.zeros((3, 0), np.int64)]
            for r, win, start in _matches(q, row, term, position, 0):
                items.append(np.stack([r, q.item[win]]))
                spans.append(np.stack([r, start, start + q.length[win]]))
            if slack:
                near = [np.unique(np.stack([r, q.item[win]]), axis=1) for r, win, _ in _matches(q, row, term, position, slack)]
            # Begins and ends counted on a line of all rows' words, with one place between rows.
            r, begin, end = np.concatenate(spans, axis=1)
            word_at = np.concatenate([[0], np.cumsum(n_words + 1)])
            change = np.bincount(word_at[r] + begin, minlength=word_at[-1] + 1) - np.bincount(word_at[r] + end, minlength=word_at[-1] + 1)
            hit = (np.cumsum(change) > 0).astype(np.int8)
            begins, ends = np.flatnonzero(np.diff(hit, prepend=0) == 1), np.flatnonzero(np.diff(hit, prepend=0) == -1)
            owner = np.searchsorted(word_at, begins, side="right") - 1
            span_list = list_array(np.searchsorted(owner, np.arange(n_rows + 1)), pa.StructArray.from_arrays([pa.array(begins - word_at[owner]), pa.array(ends - word_at[owner])], names=["begin", "end"]))
            out = pa.RecordBatch.from_arrays([batch.column(0), _pairs(items, n_rows, ids), _pairs(near, n_rows, ids), span_list], names=["row_id", "items", "near_items", "spans"])
            some = np.zeros(n_rows, bool)
            for x in (*items, *near):
                some[x[0]] = True
            yield out.filter(pa.array(some))

    return run


def searched(docs: DataFrame, bench: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slack: int = 0, block_words: int = 500_000, index: DataFrame | None = None) -> DataFrame:
    """The columns in keep, and n_words, n_hit (words inside exact matches), items (ids of items with an exact match), near_items (ids of items of
    which all words of a window occur, each within `slack` (under 64) of its place; empty without slack) and spans (maximal intervals of the words that are hit).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. A null text has no words. Items with a null
    id are searched and listed as null. Repeated rows of docs are searched each for itself; an item that occurs twice, with whatever texts, is listed
    once. Empty tables give empty results or no hits. index: of indexed(), where it has been made before.

    Benchmark items are dealt out, by hash, to blocks of about block_words, or one item; only one block at a time is held by the driver and by tasks, and its
    hits are written before the next. Each block reads the index once, and the corpus only for the index. Of the corpus, only a frequency for each of the
    block's terms reaches the driver.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    index = indexed(docs, text_col, keep) if index is None else index
    items, _ = set_apart(bench, (item_col, item_text_col), bench.columns)
    n_bytes = items.agg(F.sum(F.octet_length("in1")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-n_bytes // (6 * block_words)))
    parts = written(items.withColumn("block", F.pmod(F.xxhash64("in0", "in1"), F.lit(n_blocks))))
    kind = items.schema["in0"].dataType
    listed = f"array<{kind.simpleString()}>"
    hits = spark.createDataFrame([], f"row_id bigint, items {listed}, near_items {listed}, spans array<struct<begin:bigint,end:bigint>>")
    for b in range(n_blocks):
        rows = parts.where(F.col("block") == b).select("in0", "in1").collect()
        h, at = _item_words([x["in1"] for x in rows])
        terms = np.unique(h)
        if not len(terms):
            continue
        known = sc.broadcast(terms)
        counted = index.select("terms", "counts").mapInArrow(_frequencies(known), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
        known.destroy()
        frequency = np.zeros(len(terms), np.int64)
        frequency[[x["term"] for x in counted]] = [x["n"] for x in counted]
        block = sc.broadcast((tuple(_queries(h, at, terms, frequency, window)), pa.array([x["in0"] for x in rows], to_arrow_type(kind))))
        found = index.select("row_id", "n_words", "terms", "counts", "positions").mapInArrow(_search(block, slack), hits.schema)
        hits = hits.union(written(found))
        block.destroy()
    union = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))), F.array().cast("array<struct<begin:bigint,end:bigint>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["begin"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["begin"].alias("begin"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))))
    merged = hits.groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"), union.alias("spans")) if n_blocks > 1 else hits
    held = [f"k{k}" for k in range(len(keep))]
    out = index.select("row_id", *held, "n_words").join(merged, "row_id", "left")
    none = F.array().cast(listed)
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["begin"]), F.lit(0).cast("bigint"))
    out = out.select(*held, "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"), F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("spans"))
    return out.toDF(*keep, "n_words", "n_hit", "items", "near_items", "spans")
