"""How many craters a similarity brings onto craters: counted for blocks of hypotheses at once, in tasks that hold two images' craters and one block.

Spark joins an image's hypotheses with the image's craters as two arrays, of which there are as many as an image has pattern craters; within a task numpy
compares some hundred at once, in their order, until one is so good that none after it is tried. Each point meets only the targets in the cells
around it. Only counts leave the task; pairs are listed for the few similarities that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELLS = 1 << 16
#: Cells of a lookup along either axis.
_SIDE = 256


@dataclass(frozen=True)
class Bounds:
    """A target is hit by the nearest point if it is nearer than max(least, share of the target's radius) and the ratio of the target's radius to the point's
    lies between low and high (all strict). single: of the points that hit one target only the nearest counts."""

    share: float = 0.3
    low: float = 0.72
    high: float = 1.39
    single: bool = True


FIRST = Bounds()
#: Of refit rounds.
TIGHT = Bounds(0.3, 0.78, 1.28)
#: Of the matcher that works on detections, for hypotheses and for its fits.
LEARNED, LEARNED_TIGHT = Bounds(0.3, 0.7, 1.43, False), Bounds(0.2, 0.75, 1.33, False)


def moved_points(sims: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and r of points (x, y, r) under similarities (re, im, tx, ty): one row for each similarity."""
    re, im, tx, ty = sims.T[:, :, None]
    x, y, r = points.T[:, None]
    return re * x - im * y + tx, im * x + re * y + ty, np.hypot(re, im) * r


def nearest_of(x: np.ndarray, y: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number of the nearest target, ties to the first, and the distance."""
    square = x[..., None] - targets[:, 0]
    square *= square
    other = y[..., None] - targets[:, 1]
    other *= other
    square += other
    at = square.argmin(-1)
    return at, np.sqrt(np.take_along_axis(square, at[..., None], -1)[..., 0])


@dataclass(frozen=True)
class Stop:
    """A hypothesis that isn't a seed ends its image's votes if it finds `pairs` pairs and `share` of the craters that could be found: the targets, or, if those are fewer, the points
    that fall into the target's frame, less a twentieth of its shorter side around, with 0.8 of least_r."""

    pairs: int = 14
    share: float = 0.85
    least_r: float = 8.0


class Lookup:
    """The nearest of some targets within `reach`. Cells are at least as wide, so a point meets the targets of the nine cells around it, by their numbers."""

    def __init__(self, targets: np.ndarray, reach: float):
        self.targets, n = targets, len(targets)
        self.low = targets[:, :2].min(0)
        self.width = max(reach, float((targets[:, :2].max(0) - self.low).max()) / (_SIDE - 3), 1e-9)
        cell = np.floor((targets[:, :2] - self.low) / self.width).astype(np.int64) + 1
        self.shape = cell.max(0) + 2
        near = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        flat = ((cell[:, None, 1] + near[:, 1]) * self.shape[0] + cell[:, None, 0] + near[:, 0]).ravel()
        order = np.argsort(flat, kind="stable")
        flat, who = flat[order], np.repeat(np.arange(n), 9)[order]
        start = np.searchsorted(flat, np.arange(self.shape.prod() + 1))
        size = np.diff(start)
        # One row more, empty, for all that lies outside.
        self.table = np.full((len(size) + 1, max(1, int(size.max()))), n, np.int64)
        self.table[flat, np.arange(len(flat)) - start[flat]] = who
        self.x, self.y = (np.append(targets[:, c], np.inf) for c in (0, 1))

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the number of the nearest target, ties to the first, and the distance, infinite where none is near."""
        cx, cy = (np.floor((v - o) / self.width) + 1 for v, o in ((x, self.low[0]), (y, self.low[1])))
        inside = (cx >= 0) & (cx < self.shape[0]) & (cy >= 0) & (cy < self.shape[1])
        at = np.full(x.shape, len(self.table) - 1)
        at[inside] = (cy[inside] * self.shape[0] + cx[inside]).astype(np.int64)
        there = self.table[at]
        square = (x[..., None] - self.x[there]) ** 2 + (y[..., None] - self.y[there]) ** 2
        best = square.argmin(-1)[..., None]
        who, square = np.take_along_axis(there, best, -1)[..., 0], np.take_along_axis(square, best, -1)[..., 0]
        return np.where(who < len(self.targets), who, 0), np.sqrt(square)


def lookup_of(targets: np.ndarray, least: float, b: Bounds) -> Lookup:
    return Lookup(targets, max(least, b.share * float(targets[:, 2].max(initial=0.0))))


def hits(sims: np.ndarray, points: np.ndarray, targets: np.ndarray, least: float, b: Bounds, lookup: Lookup | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first similarity, hit, target, distance) for some similarities at a time, of every point. The nearest target is chosen first and tested afterwards;
    what is further than any target may be is no hit whichever is nearest."""
    lookup = lookup or lookup_of(targets, least, b)
    step = max(1, _CELLS // max(1, len(points) * lookup.table.shape[1]))
    for k in range(0, len(sims), step):
        x, y, r = moved_points(sims[k : k + step], points)
        at, d = lookup.nearest(x, y)
        size = targets[at, 2] / r
        yield k, (d < np.maximum(least, b.share * targets[at, 2])) & (size > b.low) & (size < b.high), at, d


def firsts(ids: np.ndarray) -> np.ndarray:
    """For each of some ids the place of the first that is equal: circles of one id are one target."""
    _, first, which = np.unique(ids, return_index=True, return_inverse=True)
    return first[which]


def consensus(sims: np.ndarray, points: np.ndarray, targets: np.ndarray, least: float, b: Bounds, same: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """hits() of which, of the points with one target, the nearest counts alone, ties to the first, if the bounds say so. same: firsts() of the targets' ids, else each is a
    target of its own."""
    for k, hit, at, d in hits(sims, points, targets, least, b):
        if b.single:
            # Sorted by similarity, target, distance and point, the first of each target stays.
            row, i = np.nonzero(hit)
            who = at if same is None else same[at]
            order = np.lexsort((i, d[row, i], who[row, i], row))
            row, i = row[order], i[order]
            later = np.zeros(len(row), bool)
            later[1:] = (row[1:] == row[:-1]) & (who[row, i][1:] == who[row, i][:-1])
            hit[row[later], i[later]] = False
        yield k, hit, at, d


def n_pairs(sims: np.ndarray, points: np.ndarray, targets: np.ndarray, least: float, b: Bounds, lookup: Lookup | None = None, same: np.ndarray | None = None) -> np.ndarray:
    """How many pairs consensus() finds for each similarity: of single ones as many as targets are hit."""
    out = np.zeros(len(sims), np.int64)
    for k, hit, at, _ in hits(sims, points, targets, least, b, lookup):
        if b.single:
            taken = np.zeros((len(hit), len(targets)), bool)
            row, i = np.nonzero(hit)
            taken[row, at[row, i] if same is None else same[at[row, i]]] = True
            hit = taken
        out[k : k + len(hit)] = hit.sum(1)
    return out


def matrix_of(column: pa.Array, names: Sequence[str], row: int) -> np.ndarray:
    """The structs of one row's list as a matrix."""
    items = column[row].values
    return np.stack([np.asarray(items.field(c), np.float64) for c in names], 1) if items is not None and len(items) else np.zeros((0, len(names)))


def craters_of(craters: DataFrame, name: str, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """keys and an array of (id, x, y, r) by id."""
    each = F.struct(F.col("crater_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "r")
    return craters.groupBy(*keys).agg(F.sort_array(F.collect_list(each)).alias(name))


def n_visible(sims: np.ndarray, points: np.ndarray, width: float, height: float, least_r: float) -> np.ndarray:
    """How many points each similarity brings into a frame, see Stop."""
    x, y, r = moved_points(sims, points)
    m = 0.05 * min(width, height)
    return ((x > -m) & (x < width + m) & (y > -m) & (y < height + m) & (r >= 0.8 * least_r)).sum(1)


def n_pairs_until(sims: np.ndarray, seeded: np.ndarray, points: np.ndarray, targets: np.ndarray, least: float, b: Bounds, stop: Stop, width: float, height: float, same: np.ndarray | None = None) -> np.ndarray:
    """n_pairs() of the similarities up to the first that isn't seeded and ends the votes; ever more are tried at once, as the good ones mostly come first."""
    lookup, out, k, size = lookup_of(targets, least, b), [], 0, 32
    while k < len(sims):
        part = sims[k : k + size]
        n = n_pairs(part, points, targets, least, b, lookup, same)
        good = np.flatnonzero((n >= stop.pairs) & ~seeded[k : k + size])
        good = good[n[good] >= stop.share * np.minimum(len(targets), n_visible(part[good], points, width, height, stop.least_r))]
        if len(good):
            return np.concatenate([*out, n[: good[0] + 1]])
        out.append(n)
        k, size = k + size, min(2 * size, 1024)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def blocks(sims: DataFrame, ref: DataFrame, tgt: DataFrame, thresholds: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """image_id, sims (hyp, re, im, tx, ty) by hyp, points, targets, thr, width, height: a row for each image. frames: image_id, width, height of the targets; without,
    they have no end."""
    each = F.struct("hyp", "re", "im", "tx", "ty")
    rows = sims.groupBy("image_id").agg(F.sort_array(F.collect_list(each)).alias("sims"))
    # Rows are few bytes and much work: their number of partitions is given, or they would be taken together by size.
    rows = rows.repartition(int(sims.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    rows = rows.join(craters_of(ref, "points").hint("merge"), "image_id").join(craters_of(tgt, "targets").hint("merge"), "image_id").join(thresholds.hint("merge"), "image_id")
    end = F.lit(float("inf"))
    rows = rows.join(frames.select("image_id", "width", "height").hint("merge"), "image_id", "left").withColumns({c: F.coalesce(F.col(c).cast("double"), end) for c in ("width", "height")}) if frames is not None else rows.withColumns({"width": end, "height": end})
    return rows.select("image_id", "sims", "points", "targets", "thr", "width", "height")


def counted(rows: DataFrame, b: Bounds = FIRST, stop: Stop | None = None) -> DataFrame:
    """image_id, hyp, n_pairs of blocks(); hypotheses without any pair are left out. With a stop an image's hypotheses are tried by hyp, those below 0 being seeds, and
    none after the first that ends the votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                points, targets = (matrix_of(batch.column(c), ("id", "x", "y", "r"), k) for c in (2, 3))
                same, points, targets = firsts(targets[:, 0]), points[:, 1:], targets[:, 1:]
                sims, least = matrix_of(batch.column(1), ("re", "im", "tx", "ty"), k), batch.column(4)[k].as_py()
                hyp = np.asarray(batch.column(1)[k].values.field("hyp"))
                if stop:
                    n = n_pairs_until(sims, hyp < 0, points, targets, least, b, stop, batch.column(5)[k].as_py(), batch.column(6)[k].as_py(), same)
                else:
                    n = n_pairs(sims, points, targets, least, b, same=same)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(some), pa.int64()), pa.array(hyp[some], pa.int64()), pa.array(n[some])], names=["image_id", "hyp", "n_pairs"])

    return rows.mapInArrow(run, "image_id bigint, hyp bigint, n_pairs bigint")


def listed(rows: DataFrame, b: Bounds = FIRST) -> DataFrame:
    """image_id, hyp, i, j, d of blocks()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["image_id", "hyp", "i", "j", "d"]
        for batch in batches:
            for k in range(batch.num_rows):
                points, targets = (matrix_of(batch.column(c), ("id", "x", "y", "r"), k) for c in (2, 3))
                sims, hyps = matrix_of(batch.column(1), ("re", "im", "tx", "ty"), k), np.asarray(batch.column(1)[k].values.field("hyp"))
                for at, hit, target, d in consensus(sims, points[:, 1:], targets[:, 1:], batch.column(4)[k].as_py(), b, firsts(targets[:, 0])):
                    row, i = np.nonzero(hit)
                    image = pa.array([batch.column(0)[k].as_py()] * len(row), pa.int64())
                    yield pa.RecordBatch.from_arrays([image, pa.array(hyps[at + row], pa.int64()), pa.array(points[i, 0].astype(np.int64)), pa.array(targets[target[row, i], 0].astype(np.int64)), pa.array(d[row, i])], names=names)

    return rows.mapInArrow(run, "image_id bigint, hyp bigint, i bigint, j bigint, d double")


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """(re, im, tx, ty) of the least-squares similarity from points a to b; None where all of a coincide."""
    p, q = a @ np.array([1, 1j]), b @ np.array([1, 1j])
    p0, q0 = p.mean(), q.mean()
    den = (np.abs(p - p0) ** 2).sum()
    if den <= 1e-9:
        return None
    z = (np.conj(p - p0) * (q - q0)).sum() / den
    t = q0 - z * p0
    return np.array([z.real, z.imag, t.real, t.imag])


def refined(rows: DataFrame, rounds: int = 4) -> DataFrame:
    """image_id, i, j from blocks() of one similarity each: up to `rounds` times the similarity is fitted to its pairs and pairs are collected anew within
    tighter bounds; it ends where fewer than three are left or more than one is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                points, targets = (matrix_of(batch.column(c), ("id", "x", "y", "r"), k) for c in (2, 3))
                sim, thr = matrix_of(batch.column(1), ("re", "im", "tx", "ty"), k), batch.column(4)[k].as_py()

                def pairs(sim: np.ndarray, least: float, b: Bounds) -> tuple[np.ndarray, np.ndarray]:
                    _, hit, at, _ = next(consensus(sim[None], points[:, 1:], targets[:, 1:], least, b))
                    i = np.flatnonzero(hit[0])
                    return i, at[0, i]

                i, j = pairs(sim[0], thr, FIRST)
                for _ in range(rounds):
                    new = similarity(points[i, 1:3], targets[j, 1:3]) if len(i) >= 3 else None
                    if new is None:
                        break
                    fresh = pairs(new, max(0.6 * thr, 3.0), TIGHT)
                    if len(fresh[0]) < 3 or len(fresh[0]) < len(i) - 1:
                        break
                    i, j = fresh
                image = pa.array([batch.column(0)[k].as_py()] * len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([image, pa.array(points[i, 0].astype(np.int64)), pa.array(targets[j, 0].astype(np.int64))], names=["image_id", "i", "j"])

    return rows.mapInArrow(run, "image_id bigint, i bigint, j bigint")


def learned(rows: DataFrame, rounds: int = 3) -> DataFrame:
    """image_id, i, j and the last fit's re, im, tx, ty from blocks() of one similarity each, fitted `rounds` times to the pairs collected last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                points, targets = (matrix_of(batch.column(c), ("id", "x", "y", "r"), k) for c in (2, 3))
                sim = matrix_of(batch.column(1), ("re", "im", "tx", "ty"), k)[0]
                found = next(consensus(sim[None], points[:, 1:], targets[:, 1:], batch.column(4)[k].as_py(), LEARNED))
                for _ in range(rounds):
                    i = np.flatnonzero(found[1][0])
                    new = similarity(points[i, 1:3], targets[found[2][0, i], 1:3]) if len(i) else None
                    if new is None:
                        break
                    sim, found = new, next(consensus(new[None], points[:, 1:], targets[:, 1:], 2.0, LEARNED_TIGHT))
                i = np.flatnonzero(found[1][0])
                j = found[2][0, i]
                image = pa.array([batch.column(0)[k].as_py()] * len(i), pa.int64())
                yield pa.RecordBatch.from_arrays([image, pa.array(points[i, 0].astype(np.int64)), pa.array(targets[j, 0].astype(np.int64)), *(pa.array(np.full(len(i), v)) for v in sim)], names=["image_id", "i", "j", "re", "im", "tx", "ty"])

    return rows.mapInArrow(run, "image_id bigint, i bigint, j bigint, re double, im double, tx double, ty double")
