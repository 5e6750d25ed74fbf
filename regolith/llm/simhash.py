"""SimHash fingerprints, joined on shared blocks of bits, verified by Hamming distance and, for a wanted similarity, by the sets of shingles.

A fingerprint is cut into blocks, and two fingerprints are compared if some block of theirs, or some choice of blocks, agrees. With four blocks of 16 bits
and all choices of two, fingerprints within 2 of 64 bits always share one: at most two of the blocks differ.

Where all shingles vote on every bit, texts at a similarity of 0.8 differ in about 15 of 100 bits, so that a block long enough to tell unrelated texts apart is
hardly ever equal. For a wanted similarity each 64-bit block is therefore voted by three shingles only, those with the least hashes of the block's own: it is
equal if these three are common, with a probability that depends on the similarity alone and neither on the texts' lengths nor on their number. Distance and
blocks find families of candidates there; verified() links those whose sets of shingles are alike.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import BLANK, flat_list, list_array, mix, rolling, text_chunks, word_hashes
from ._scratch import set_apart, written
from .graph import components


@dataclass(frozen=True)
class SimHash:
    """shingle: words of one. bits: of a fingerprint, a multiple of 64. distance: bits in which linked fingerprints differ at most. tables: choices of 16-bit
    blocks of the first 64 bits; none: each 64 bits are a block. similarity: of the sets of shingles of linked texts, at least, or 0 if fingerprints decide."""

    shingle: int
    bits: int
    distance: int
    tables: tuple[tuple[int, ...], ...] = ()
    similarity: float = 0.0

    @property
    def lanes(self) -> int:
        return self.bits // 64


#: Exact to 2 of 64 bits.
CLOSE = SimHash(3, 64, 2, tuple(itertools.combinations(range(4), 2)))
#: Members of a block that are compared with each other in one list; members of larger ones are dealt out, see in_large().
SMALL = 64
#: Fingerprints on either side of a piece of a large block.
PIECE = 1 << 12
#: Shingles of a family that one task holds on either side, about.
FAMILY = 1 << 21


def similar(shingle: int = 5, similarity: float = 0.8, lanes: int = 8) -> SimHash:
    """For texts whose sets of shingles have a Jaccard similarity of at least `similarity`.

    With similarity s a block is equal with probability s**3 (all three least shingles of the union are common). At 0.8 that is 0.51, and of 1000 pairs 3
    share none of 8 blocks. If one of the three differs, a quarter of the block's bits does; if more do, up to half of them. The distance allowed
    lies three deviations above the mean at `similarity`: 151 of 512 bits at 0.8, where unrelated texts differ in 256, give or take 11.
    """
    common = [math.comb(3, k) * similarity**k * (1 - similarity) ** (3 - k) for k in (3, 2, 1, 0)]
    bits = [0.0, 16.0, 24.0, 32.0]
    mean = sum(p * x for p, x in zip(common, bits))
    spread = sum(p * (x * x + x * (1 - x / 64)) for p, x in zip(common, bits)) - mean * mean
    return SimHash(shingle, 64 * lanes, round(lanes * mean + 3 * math.sqrt(lanes * spread)), similarity=similarity)


def _hashes(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each row that has words, and the XXH64 (seed 42) of its shingles, in order."""
    h64 = xxhash.xxh64_intdigest
    for w in text_chunks(column, BLANK, lower=True):
        # The words of each row with one blank between them: a shingle is then one slice.
        data = w.data.tobytes()
        for r in np.flatnonzero(np.diff(w.word_at)):
            a, b = int(w.word_at[r]), int(w.word_at[r + 1])
            body = b" ".join(data[w.byte_at[r] : w.byte_at[r + 1]].split())
            ends = np.cumsum(w.end[a:b] - w.start[a:b] + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            k = min(shingle, b - a)
            yield w.first + int(r), np.array([h64(body[s:e], 42) for s, e in zip(starts[: b - a - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def _sets_of(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each row that has words, and the sorted hashes of its distinct shingles."""
    for w in text_chunks(column, BLANK, lower=True):
        h = word_hashes(w)
        whole = rolling(h, shingle)
        for r in np.flatnonzero(np.diff(w.word_at)):
            a, b = int(w.word_at[r]), int(w.word_at[r + 1])
            yield w.first + int(r), np.unique(whole[a : b - shingle + 1] if b - a >= shingle else rolling(h[a:b], b - a) ^ np.uint64(b - a))


def _digest(shingles: np.ndarray) -> np.uint64:
    """Of a set of shingles."""
    return mix(shingles).sum(dtype=np.uint64)


def _voted(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """For each lane, the bits that over half of its three least shingles have; of fewer than three, that over half of them have."""
    seeds = mix(np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own = mix(shingles[None, :] ^ seeds[:, None])
    if own.shape[1] > 3:
        own = np.partition(own, 2, axis=1)[:, :3]
    own = mix(own + np.uint64(0x632BE59BD9B4E019))
    if own.shape[1] < 3:
        return np.bitwise_and.reduce(own, axis=1)
    a, b, c = own.T
    return a & b | a & c | b & c


def _fingerprints(params: SimHash):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes, digests = np.zeros((batch.num_rows, params.lanes), np.uint64), np.zeros(batch.num_rows, np.uint64)
            if params.similarity:
                for r, h in _sets_of(batch.column(0), params.shingle):
                    lanes[r], digests[r] = _voted(h, params.lanes), _digest(h)
            else:
                for r, h in _hashes(batch.column(0), params.shingle):
                    votes = np.zeros(64, np.int64)
                    for at in range(0, len(h), 1 << 16):
                        part = h[at : at + (1 << 16)]
                        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int64)
                    lanes[r] = np.packbits(2 * votes > len(h)).view(">u8").astype(np.uint64)
            fp = list_array(np.arange(len(lanes) + 1) * params.lanes, pa.array(lanes.view(np.int64).ravel()))
            more = {"digest": pa.array(digests.view(np.int64))} if params.similarity else {}
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1, batch.num_columns)), fp, *more.values()], names=[*batch.schema.names[1:], "fp", *more])

    return run


def fingerprints(docs: DataFrame, params: SimHash, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and fp: array of bits/64 longs, the highest bits first. With a similarity also digest, of the set of shingles.

    Without a similarity, shingles count as often as they occur, their XXH64 (seed 42) is the hash, and a bit is set if it is in over half of the hashes; with
    one, each distinct shingle counts once, and each 64 bits are voted as _voted() says. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of fewer
    words than a shingle is one shingle; an empty or null text has the fingerprint zero.
    """
    slim = docs.select(F.col(text_col).alias("text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    return slim.mapInArrow(_fingerprints(params), f"{kinds}, fp array<bigint>" + ", digest bigint" * (params.similarity > 0))


def hamming(a: Column, b: Column, params: SimHash) -> Column:
    return sum((F.bit_count(a[j].bitwiseXOR(b[j])) for j in range(1, params.lanes)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _keys(params: SimHash) -> Column:
    """The keys under which a fingerprint is filed: the number of the table, and its blocks."""
    if not params.tables:
        return F.array(*(F.xxhash64(F.lit(j), F.col("fp")[j]) for j in range(params.lanes)))
    block = lambda j: F.shiftrightunsigned(F.col("fp")[0], 48 - 16 * j).bitwiseAND(F.lit(0xFFFF))
    out = []
    for t, table in enumerate(params.tables):
        key = F.lit(t).cast("bigint")
        for j in table:
            key = F.shiftleft(key, 16).bitwiseOR(block(j))
        out.append(key)
    return F.array(*out)


def _bits(members: pa.StructArray, lanes: int) -> np.ndarray:
    return np.asarray(members.field("fp").flatten()).view(np.uint64).reshape(-1, lanes)


def _within(params: SimHash):
    """From lists of (node, fp), smallest first: a link from each node to the smallest that it reaches within its list, over links of near fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, members = flat_list(batch.column(0))
            nodes, fp = members.field("node"), _bits(members, params.lanes)
            sizes = np.diff(at)
            firsts, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in np.unique(sizes[sizes > 1]).tolist():
                begin, step = at[:-1][sizes == n], max(1, (1 << 20) // (n * n * params.lanes))
                for k in range(0, len(begin), step):
                    index = begin[k : k + step, None] + np.arange(n)
                    f = fp[index]
                    near = np.bitwise_count(f[:, :, None] ^ f[:, None]).sum(-1, dtype=np.int64) <= params.distance
                    root, before = np.tile(np.arange(n), (len(index), 1)), None
                    while before is None or not np.array_equal(root, before):
                        root, before = np.where(near, root[:, None], n).min(-1), root
                    linked = root != np.arange(n)
                    firsts.append(np.take_along_axis(index, root, 1)[linked])
                    others.append(index[linked])
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(np.concatenate(x))) for x in (firsts, others)], names=["a", "b"])

    return run


def links(nodes: DataFrame, params: SimHash, small: int = SMALL) -> DataFrame:
    """(a, b): verified links that connect what all links between members of a block connect. nodes: (node, fp), a written table.

    Only keys are counted at first; those that several nodes have are few, and only then do fingerprints move. Up to `small` members are compared with
    each other in one list, which leaves a link for each member and not for each pair. Larger blocks go by in_large(). No link is lost in either.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    keyed = nodes.select("node", F.explode(_keys(params)).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = written(keyed.join(shared, "key").join(nodes.select("node", "fp"), "node").select("key", "node", "fp", "n"))
    lists = members.where(F.col("n") <= small).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("members"))
    near = lists.select("members").mapInArrow(_within(params), f"a {kind}, b {kind}")
    return near.union(in_large(members.where(F.col("n") > small), params))


def _in_piece(params: SimHash):
    """From a piece's rows (left, node, fp): links that connect what the links of its left rows with its right rows connect."""

    def run(piece: pa.Table) -> pa.Table:
        piece = piece.combine_chunks()
        left = np.asarray(piece["left"])
        fp = np.asarray(piece["fp"].combine_chunks().flatten()).view(np.uint64).reshape(-1, params.lanes)
        lefts, rights = np.flatnonzero(left), np.flatnonzero(~left)
        # Groups of right rows that a left row has connected: later left rows need but one link to each.
        group = np.arange(len(rights))
        firsts, others = [], []
        for i in lefts:
            near = np.bitwise_count(fp[rights] ^ fp[i]).sum(-1, dtype=np.int64) <= params.distance
            found, first = np.unique(group[near], return_index=True)
            if len(found):
                firsts += [i] * len(found)
                others += rights[np.flatnonzero(near)[first]].tolist()
                group[np.isin(group, found)] = found[0]
        take = lambda x: piece["node"].take(pa.array(np.array(x, np.int64)))
        return pa.table([take(firsts), take(others)], names=["a", "b"])

    return run


def in_large(members: DataFrame, params: SimHash) -> DataFrame:
    """Links among the members of blocks that are too large for one list, exactly.

    To 2 bits: two fingerprints are within 2 bits if and only if some number is within 1 bit of both. Each member is therefore filed under
    itself and under its 64 one-bit neighbours, a file holds 65 fingerprints at most, and its members are linked to the smallest of them.

    For wider distances each member is compared with the block's smallest, in a join that the planner can split. Copies are all near it, and then the block is
    done. Members that aren't near it are compared with all others of the block, dealt out in pieces of PIECE fingerprints on either side: work
    grows with their number times the block's, but no task, and no more links come out than a piece has rows.
    """
    kind = members.schema["node"].dataType.simpleString()
    if params.bits == 64 and params.distance <= 2:
        flips = [0, *(1 << j if j < 63 else -(1 << 63) for j in range(64))]
        filed = members.select("node", F.col("fp")[0].alias("f")).distinct().select("node", F.explode(F.array(*(F.col("f").bitwiseXOR(F.lit(x)) for x in flips))).alias("file"))
        first = filed.groupBy("file").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        return filed.join(first, "file").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    heads = members.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("head"))
    judged = written(members.join(heads, "key").select("key", "node", "fp", F.col("head.node").alias("first"), (hamming(F.col("fp"), F.col("head.fp"), params) <= params.distance).alias("near")))
    found = judged.where("near and node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    mixed = judged.groupBy("key").agg(_pieces(F.count("*"), PIECE).alias("rights"), _pieces(F.count_if(~F.col("near")), PIECE).alias("lefts")).where("lefts > 0")
    rest = _dealt(judged.join(mixed, "key").withColumn("at", F.xxhash64("node")), "key", ["node", "fp"]).groupBy("key", "i", "j").applyInArrow(_in_piece(params), f"a {kind}, b {kind}")
    return found.union(rest.where("a <> b"))


def _pieces(n: Column, most: int) -> Column:
    return F.ceil(n / F.lit(float(most)))


def _dealt(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows (with near, at, lefts, rights): those that aren't near as left rows and all as right rows of pieces (key, i, j), so that each left row meets each right
    row of its key in one piece."""

    def side(df: DataFrame, left: bool) -> DataFrame:
        own, others = F.pmod("at", "lefts" if left else "rights"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rights" if left else "lefts") - 1))
        out = df.select(key, F.lit(left).alias("left"), *columns, own.alias("own"), others.alias("other"))
        return out.select(key, F.col("own" if left else "other").alias("i"), F.col("other" if left else "own").alias("j"), "left", *columns)

    # Pieces are spread by all three numbers, or those of one key would follow the key's own shuffle into one task.
    return side(rows.where("not near"), True).union(side(rows, False)).repartition(key, "i", "j")


def _sets(shingle: int):
    """From (text, node): the node, and its set of shingles with its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            sets = [np.zeros(0, np.uint64)] * batch.num_rows
            for r, h in _sets_of(batch.column(0), shingle):
                sets[r] = h
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            digests = np.array([_digest(x) for x in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(digests.view(np.int64)), list_array(at, pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "digest", "shingles"])

    return run


def _alike(common, a, b, similarity: float):
    """Sets of a and b members, of which so many are common, have the similarity; two empty sets are equal. Of numbers, arrays or columns."""
    return common >= similarity * (a + b - common) - 1e-9


def _in_family(similarity: float):
    """From a unit's rows (left, near, node, shingles): links that connect what the links of its left rows with its right rows connect. Near rows are connected."""

    def run(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        left, near = (np.asarray(unit[c]) for c in ("left", "near"))
        at, flat = flat_list(unit["shingles"].combine_chunks())
        flat, sizes, right = np.asarray(flat), np.diff(at), np.flatnonzero(~left)
        # Numbers for groups of rows that are connected; equal nodes and near rows are from the start.
        group = np.unique(np.asarray(unit["node"].combine_chunks().dictionary_encode().indices), return_inverse=True)[1]
        if near.any():
            group[np.isin(group, group[near])] = group[near][0]
        firsts, others = [], []
        for i in np.flatnonzero(left):
            mine = flat[at[i] : at[i + 1]]
            small, large = np.minimum(sizes[right], sizes[i]), np.maximum(sizes[right], sizes[i])
            todo, step = right[_alike(small, small, large, similarity)], 4
            while len(todo := todo[group[todo] != group[i]]):
                some, todo, step = todo[:step], todo[step:], min(4 * step, 256)
                for j in some:
                    if group[j] != group[i] and _alike(len(np.intersect1d(mine, flat[at[j] : at[j + 1]], assume_unique=True)), sizes[i], sizes[j], similarity):
                        group[group == group[j]] = group[i]
                        firsts.append(i)
                        others.append(j)
        take = lambda x: unit["node"].take(pa.array(np.array(x, np.int64)))
        return pa.table([take(firsts), take(others)], names=["a", "b"])

    return run


def verified(families: DataFrame, docs: DataFrame, params: SimHash) -> DataFrame:
    """(a, b): links that connect what all pairs of a family connect whose sets of shingles are alike. families: (node, digest, component), a written table of
    candidates, each component named by its smallest node; docs: (id, text).

    Each member is compared with its family's smallest first, in a join that the planner can split. Members that aren't near it are compared with all
    others of the family to which nothing connects them yet. Families are dealt out to tasks in pieces of about FAMILY shingles on either side.
    """
    kind = families.schema["node"].dataType.simpleString()
    texts = docs.join(families.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select("text", F.col("id").alias("node"))
    sets = texts.mapInArrow(_sets(params.shingle), f"node {kind}, digest bigint, shingles array<bigint>").dropDuplicates(["node", "digest"])
    members = written(families.join(sets, ["node", "digest"]).select("component", "node", "digest", "shingles"))
    heads = members.where("node = component").groupBy("component").agg(F.min_by("shingles", "digest").alias("head"))
    common = F.size(F.array_intersect("shingles", "head"))
    near = _alike(common, F.size("shingles"), F.size("head"), params.similarity)
    judged = written(members.join(heads, "component").select("component", "node", "digest", "shingles", near.alias("near")))
    found = judged.where("near and node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    size = F.size("shingles").cast("bigint") + 8
    mixed = judged.groupBy("component").agg(F.count("*").alias("n"), _pieces(F.sum(size), FAMILY).alias("rights"), _pieces(F.sum(F.when(~F.col("near"), size)), FAMILY).alias("lefts")).where("n > 2 and lefts is not null").drop("n")
    rows = _dealt(judged.join(mixed, "component").withColumn("at", F.xxhash64("node", "digest")), "component", ["near", "node", "shingles"])
    rest = rows.groupBy("component", "i", "j").applyInArrow(_in_family(params.similarity), f"a {kind}, b {kind}")
    return found.union(rest)


def grouped(docs: DataFrame, params: SimHash, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns in keep, fp and component, the smallest id in reach over links; a column in keep that has one of these
    names, in any case, is replaced.

    Rows without an id have the component of their fingerprint's group; they are never its name. Repeated rows and exact copies share a fingerprint,
    which is one node however many rows have it. An empty table gives an empty result. With a similarity, nodes are sets of shingles. Texts are read
    whole; of a similarity, once more for the sets of the candidates.
    """
    slim, _ = set_apart(docs, (id_col, text_col), docs.columns)
    kept = [c for c in keep if c.lower() not in ("id", "fp", "component")]
    slim = set_apart(docs.select(id_col, text_col, *kept), (id_col, text_col), ())[0] if kept else slim
    slim = slim.withColumnsRenamed({"in0": "id", "in1": "text"})
    held = tuple(f"c{k}" for k in range(len(kept)))
    prints = written(fingerprints(slim, params, "text", ("id", *held)))
    same = ["fp", "digest"] if params.similarity else ["fp"]
    nodes = written(prints.groupBy(*same).agg(F.min("id").alias("node")))
    found = components(links(nodes.where("node is not null").select("node", "fp"), params))
    if params.similarity:
        roots = found.select(F.col("component").alias("node"), "component").distinct()
        families = written(nodes.join(found.union(roots), "node").select("node", "digest", "component"))
        found = components(verified(families, slim.select("id", "text"), params))
    named = nodes.join(found, "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
    return prints.join(named, same).select("id", *held, "fp", "component").toDF("id", *kept, "fp", "component")


def keep_one(docs: DataFrame, params: SimHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest id. Columns stay as they are, whatever their names.

    Rows that repeat an id and its text are one document and leave one row; of different texts under one id in a group, that with the smallest hash
    stays. Rows without an id can't be told apart and stay. Rows with null or empty texts are copies of each other.
    """
    apart, rest = set_apart(docs, (id_col, text_col), ())
    marked = apart.withColumn("mark", F.xxhash64(F.coalesce("in1", F.lit(""))))
    slim = marked.where("in0 is not null").select(F.col("in0").alias("id"), F.col("in1").alias("body"), "mark")
    kept = grouped(slim, params, "id", "body", ("mark",)).groupBy("component").agg(F.min(F.struct("id", "mark")).alias("k")).select(F.col("k.id").alias("kept_id"), F.col("k.mark").alias("kept_mark"))
    named = marked.join(kept, (F.col("in0") == F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))).drop("kept_id", "kept_mark")
    once = named.withColumn("turn", F.row_number().over(Window.partitionBy("in0", "mark").orderBy("in0"))).where("turn = 1").drop("turn", "mark")
    names = dict(zip(["in0", "in1", *(f"c{k}" for k in range(len(rest)))], [id_col, text_col, *rest]))
    out = once.union(apart.where("in0 is null")).select(*[next(k for k, v in names.items() if v.lower() == c.lower()) for c in docs.columns])
    return out.toDF(*docs.columns)
