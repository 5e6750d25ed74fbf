"""Pseudo-likelihoods of whole texts: a small network predicts every word from two words on either side.

The network is a window network: the neighbours' embeddings go through a matrix for each place into a hidden layer, and from there down a Huffman tree
of the corpus's words, with a logistic decision at each inner node, so that every word has a probability of its own given its context. All counts are of all
documents, and the network is trained on every position of every document. Documents are dealt to shards by a hash of what they are, and lie there
in the order of that hash: a shard, and so the model, is the same in whatever partitions the table came. Shards train side by side from common weights, and Spark
averages each row of weights over the shards that have used it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import BLANK, list_array, row_of, text_chunks, word_hashes
from ._scratch import kinds, set_apart, written

PLACES = (-2, -1, 1, 2)
_STEP = 1 << 15


@dataclass(frozen=True)
class Settings:
    """hidden: units. least: share of all words from which a word has a leaf of its own, so there are 1 / least of these at most. rare: leaves of the others, by
    hash. fine: buckets by which words are told apart within these. rounds: over all positions. batch: positions of a gradient step, at most; rate: of it."""

    hidden: int = 8
    least: float = 2.0**-18
    rare: int = 1 << 8
    fine: int = 1 << 18
    rounds: int = 1
    batch: int = 8192
    rate: float = 0.1
    seed: int = 5


class Vocabulary(NamedTuple):
    """own: sorted hashes of the words with leaves of their own, which come first. within: by fine bucket, the logarithm of its share of its rare leaf.
    path_at, node, sign: of each leaf, where its decisions begin, and their inner nodes and directions (1 or -1). total: words counted."""

    own: np.ndarray
    within: np.ndarray
    path_at: np.ndarray
    node: np.ndarray
    sign: np.ndarray
    total: int


class Weights(NamedTuple):
    """One column for each leaf or node: embed (hidden x leaves + 1; the last one stands beyond a text's ends), nodes (hidden x inner nodes), lean (of each
    inner node). place: hidden x hidden for each place, bias: of the hidden layer."""

    embed: np.ndarray
    nodes: np.ndarray
    lean: np.ndarray
    place: np.ndarray
    bias: np.ndarray


def _fine(h: np.ndarray, s: Settings) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (s.fine - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in text_chunks(batch.column(0), BLANK, lower=True, size=1 << 22):
            coded = pa.array(word_hashes(w)).dictionary_encode()
            n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.uint64()).view(pa.int64()), pa.array(n.astype(np.int64))], names=["h", "n"])


def _tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree's path_at, node and sign. counts: of the leaves."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    value = np.concatenate([counts[order], np.zeros(max(n - 1, 0))]).tolist()
    parent, sign = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
    leaf, inner = 0, n
    for new in range(n, 2 * n - 1):
        total = 0.0
        for side in (1, -1):
            if inner >= new or leaf < n and value[leaf] <= value[inner]:
                one, leaf = leaf, leaf + 1
            else:
                one, inner = inner, inner + 1
            parent[one], sign[one] = new, side
            total += value[one]
        value[new] = total
    who, at, steps = np.arange(n), np.arange(n), []
    while len(who := who[at != 2 * n - 2]):
        at = at[at != 2 * n - 2]
        steps.append((order[who], parent[at] - n, sign[at]))
        at = parent[at]
    if not steps:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    whose, node, direction = (np.concatenate(x) for x in zip(*steps))
    by = np.argsort(whose, kind="stable")
    return np.searchsorted(whose[by], np.arange(n + 1)), node[by].astype(np.int32), direction[by].astype(np.float32)


def vocabulary(texts: DataFrame, s: Settings) -> Vocabulary:
    """texts: one column. Words are counted over all of it; only those above the least share, and the buckets of the others, reach the driver."""
    counted = written(texts.mapInArrow(_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    frequent = F.col("n") >= s.least * total
    own = counted.where(frequent).toArrow()
    others = counted.where(~frequent).groupBy(F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(s.fine - 1)).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    h, n = np.asarray(own["h"]).view(np.uint64), np.asarray(own["n"])
    order = np.argsort(h)
    buckets = np.full(s.fine, 0.5)
    buckets[np.asarray(others["bucket"])] += np.asarray(others["n"])
    leaf = np.arange(s.fine) % s.rare
    leaves = np.bincount(leaf, weights=buckets, minlength=s.rare)
    # What no word of a rare leaf has been seen for weighs little in the tree: half a word in all.
    seen = np.bincount(leaf, weights=buckets - 0.5, minlength=s.rare) + 0.5
    return Vocabulary(h[order], np.log(buckets / leaves[leaf]).astype(np.float32), *_tree(np.concatenate([n[order].astype(np.float64), seen])), int(total))


def _leaves(h: np.ndarray, own: np.ndarray, s: Settings) -> np.ndarray:
    at = np.minimum(np.searchsorted(own, h), max(len(own) - 1, 0))
    rest = (len(own) + _fine(h, s) % s.rare).astype(np.int32)
    return np.where(own[at] == h, at, rest).astype(np.int32) if len(own) else rest


def _context(leaves: np.ndarray, row: np.ndarray, beyond: int) -> np.ndarray:
    """The leaves at each place around each word, one line for each place."""
    out = np.full((len(PLACES), len(leaves)), beyond, np.int32)
    for k, p in enumerate(PLACES):
        a, b = (slice(-p, None), slice(None, p)) if p < 0 else (slice(None, -p), slice(p, None))
        if len(leaves) > abs(p):
            out[k, a] = np.where(row[a] == row[b], leaves[b], beyond)
    return out


def _encoded(s: Settings, own):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in text_chunks(batch.column(0), BLANK, lower=True):
                some = np.flatnonzero(np.diff(w.word_at))
                if len(some):
                    leaves = _leaves(word_hashes(w), own.value, s)
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(w.first + some)), list_array(np.append(w.word_at[some], len(leaves)), pa.array(leaves))], names=["key", "leaves"])

    return run


def start(words: Vocabulary, s: Settings) -> Weights:
    rng = np.random.default_rng(s.seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    n, leaves = s.hidden, len(words.path_at) - 1
    return Weights(normal(n, leaves + 1, scale=0.3), np.zeros((n, max(leaves - 1, 0)), np.float32), np.zeros(max(leaves - 1, 0), np.float32), normal(len(PLACES), n, n, scale=0.5 / n**0.5), np.zeros(n, np.float32))


def _paths(words: Vocabulary, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the targets' decisions: the inner nodes, directions, whose they are, and where each target's begin."""
    sizes = words.path_at[target + 1] - words.path_at[target]
    begins = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(words.path_at[target] - begins, sizes)
    return words.node[at], words.sign[at], np.repeat(np.arange(len(target)), sizes), begins


def _summed(at: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct columns in at, how often each occurs, and for each of values its sums by column."""
    have, back, n = np.unique(at, return_inverse=True, return_counts=True)
    return have, n, np.stack([np.bincount(back, weights=line, minlength=len(have)) for line in values]).astype(np.float32)


def fit(weights: Weights, words: Vocabulary, parts: Iterator[tuple[np.ndarray, np.ndarray]], s: Settings) -> tuple[Weights, Weights]:
    """Adagrad steps over (context, target) parts: the weights, and for each of their columns how often it was used, in the first line of each array."""
    weights = Weights(*(w.copy() for w in weights))
    squares = Weights(*(np.full(w.shape, 1e-8, np.float32) for w in weights))
    used_leaves, used_nodes, n = np.zeros(weights.embed.shape[1], np.int64), np.zeros(len(weights.lean), np.int64), 0

    def step(w: np.ndarray, q: np.ndarray, g: np.ndarray, columns) -> None:
        q[..., columns] += g * g
        w[..., columns] -= s.rate * g / np.sqrt(q[..., columns])

    for context, target in parts:
        n += len(target)
        seen = np.take(weights.embed, context, axis=1)
        hid = np.tanh(sum(p.T @ seen[:, k] for k, p in enumerate(weights.place)) + weights.bias[:, None])
        node, sign, whose, begins = _paths(words, target)
        if not len(node):
            continue
        own, mine = np.take(weights.nodes, node, axis=1), np.take(hid, whose, axis=1)
        score = sign * (np.einsum("hm,hm->m", own, mine) + weights.lean[node])
        pull = (-sign / (1 + np.exp(score)) / len(target)).astype(np.float32)
        own *= pull
        back = np.add.reduceat(own, begins, axis=1) * (1 - hid * hid)
        mine *= pull
        have, times, g = _summed(node, [*mine, pull])
        step(weights.nodes, squares.nodes, g[:-1], have)
        step(weights.lean, squares.lean, g[-1], have)
        used_nodes[have] += times
        to = np.concatenate([p @ back for p in weights.place], axis=1)
        step(weights.place, squares.place, np.stack([seen[:, k] @ back.T for k in range(len(PLACES))]), slice(None))
        step(weights.bias, squares.bias, back.sum(1), slice(None))
        have, times, g = _summed(context.ravel(), list(to))
        step(weights.embed, squares.embed, g, have)
        used_leaves[have] += times
    return weights, Weights(used_leaves, used_nodes, used_nodes, np.full(len(PLACES), n), np.full(1, n))


def _rows(w: Weights) -> np.ndarray:
    """All weights as rows of hidden + 1 numbers: leaves, inner nodes with their lean, the places' matrices, the bias."""
    n = len(w.bias)
    wide = lambda x: np.concatenate([x, np.zeros((len(x), 1), np.float32)], 1)
    return np.concatenate([wide(w.embed.T), np.concatenate([w.nodes.T, w.lean[:, None]], 1), wide(w.place.reshape(-1, n)), wide(w.bias[None])])


def _from_rows(rows: np.ndarray, like: Weights) -> Weights:
    n, leaves, nodes = len(like.bias), like.embed.shape[1], len(like.lean)
    a, b, c = rows[:leaves], rows[leaves : leaves + nodes], rows[leaves + nodes :]
    parts = a[:, :n].T, b[:, :n].T, b[:, n], c[:-1, :n].reshape(like.place.shape), c[-1, :n]
    return Weights(*(np.ascontiguousarray(x, np.float32) for x in parts))


def _trained(s: Settings, words, weights, batch_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begin = Vocabulary(*words.value), Weights(*weights.value)

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                at = np.concatenate([[0], np.cumsum(np.asarray(batch.column(0).value_lengths(), np.int64))])
                leaves = np.asarray(batch.column(0).flatten())
                context = _context(leaves, row_of(at), begin.embed.shape[1] - 1)
                for k in range(0, len(leaves), batch_words):
                    yield context[:, k : k + batch_words], leaves[k : k + batch_words]

        own, used = fit(begin, known, parts(), s)
        n = np.concatenate([used.embed, used.nodes, np.full(len(PLACES) * s.hidden + 1, used.bias[0])])
        have = np.flatnonzero(n)
        rows = _rows(own)[have].astype(np.float64) * n[have, None]
        names = ["row", "n", *(f"v{k}" for k in range(s.hidden + 1))]
        for k in range(0, len(have), 1 << 16):
            some = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(have[some]), pa.array(n[have[some]]), *(pa.array(x) for x in np.ascontiguousarray(rows[some].T))], names=names)

    return run


def trained(docs: DataFrame, s: Settings = Settings(), text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",)) -> tuple[Vocabulary, Weights]:
    """The model of all texts. The columns in id_cols and the text decide a document's shard, so that copies with different ids are spread. Without any word it is
    that of an even distribution.

    There are as many shards as the words' number in millions to the power 2/3: at any size, both they and their lengths grow.
    """
    sc = docs.sparkSession.sparkContext
    apart, _ = set_apart(docs, (text_col, *id_cols), docs.columns)
    words = vocabulary(apart.select("in0"), s)
    weights = start(words, s)
    shards = max(1, round((words.total / 1e6) ** (2 / 3)))
    batch_words = int(min(s.batch, max(256, words.total // shards // 512)))
    keyed = apart.select("in0", F.xxhash64(*apart.columns).alias("key"))
    encoded = keyed.mapInArrow(_encoded(s, sc.broadcast(words.own)), "key bigint, leaves array<int>")
    encoded = written(encoded) if s.rounds > 1 else encoded
    known = sc.broadcast(tuple(words))
    for _ in range(s.rounds):
        dealt = encoded.repartition(shards, "key").sortWithinPartitions("key").select("leaves")
        names = [f"v{k}" for k in range(s.hidden + 1)]
        sums = dealt.mapInArrow(_trained(s, known, sc.broadcast(tuple(weights)), batch_words), ", ".join(["row bigint, n bigint", *(f"{v} double" for v in names)]))
        mean = sums.groupBy("row").agg(*((F.sum(v) / F.sum("n")).cast("float").alias(v) for v in names)).toArrow()
        rows = _rows(weights)
        rows[np.asarray(mean["row"])] = np.stack([np.asarray(mean[v]) for v in names], 1)
        weights = _from_rows(rows, weights)
    return words, weights


def log_probabilities(words: Vocabulary, weights: Weights, h: np.ndarray, row: np.ndarray, s: Settings) -> np.ndarray:
    """The logarithm of each word's probability given the words on both sides. h: hashes of the words; row: their texts' numbers."""
    out = np.zeros(len(h))
    leaves = _leaves(h, words.own, s)
    context = _context(leaves, row, weights.embed.shape[1] - 1)
    tables = [p.T @ weights.embed for p in weights.place]
    for at in range(0, len(h), _STEP):
        part = slice(at, at + _STEP)
        hid = np.tanh(sum(np.take(t, line, axis=1) for t, line in zip(tables, context[:, part])) + weights.bias[:, None])
        node, sign, whose, begins = _paths(words, leaves[part])
        if len(node):
            score = sign * (np.einsum("hm,hm->m", np.take(weights.nodes, node, axis=1), np.take(hid, whose, axis=1)) + weights.lean[node])
            out[part] = -np.add.reduceat(np.log(1 + np.exp(np.minimum(-score, 60))), begins)
    rare = leaves >= len(words.own)
    out[rare] += words.within[_fine(h[rare], s)]
    return out


def _scores(s: Settings, words, weights, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = Vocabulary(*words.value), Weights(*weights.value)
        for batch in batches:
            n_words, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
            for w in text_chunks(batch.column(0), BLANK, lower=True):
                upto = np.concatenate([[0.0], np.cumsum(log_probabilities(known, own, word_hashes(w), row_of(w.word_at), s))])
                n_words.append(np.diff(w.word_at))
                sums.append(upto[w.word_at[1:]] - upto[w.word_at[:-1]])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), pa.array(np.concatenate(n_words).astype(np.int64)), pa.array(np.concatenate(sums))], names=names)

    return run


def scored(docs: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), settings: Settings = Settings(), model: tuple[Vocabulary, Weights] | None = None) -> DataFrame:
    """docs without the text, with n_words, log_likelihood (the sum over all words of the logarithm of their probabilities) and per_word (their mean; null
    without words); columns of docs that have one of these names, in any case, are replaced.

    The model is trained on docs unless one is given. A null or empty text has no words and the likelihood 0. Repeated rows are counted and trained
    on as often as they occur, and score alike; an empty table gives an empty result. Texts are read whole. Words below the least share are told apart by
    their number within a rare leaf, whatever the context. Partitioning changes scores by rounding only.
    """
    extra = ("n_words", "log_likelihood", "per_word")
    packed, rest = set_apart(docs, (text_col,), extra)
    words, weights = model or trained(docs, settings, text_col, id_cols)
    sc = docs.sparkSession.sparkContext
    held = [f"c{k}" for k in range(len(rest))]
    out = packed.mapInArrow(_scores(settings, sc.broadcast(tuple(words)), sc.broadcast(tuple(weights)), [*held, *extra[:2]]), ", ".join([*kinds(packed, held), "n_words bigint, log_likelihood double"]))
    return out.toDF(*rest, *extra[:2]).withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))
