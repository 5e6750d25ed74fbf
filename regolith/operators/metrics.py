"""Accuracy of a registration: coverage, robust residuals, grades, hulls."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(points: DataFrame, width: float, height: float, keys: Sequence[str] = ("image_id",), cells: int = 3) -> DataFrame:
    """keys, n_hit, coverage: the share of the frame's cells x cells grid (half-open cells) that holds a point (u, v)."""
    cell = F.floor(F.col("v") * cells / height) * cells + F.floor(F.col("u") * cells / width)
    inside = points.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))
    return inside.groupBy(*keys).agg(F.countDistinct(cell).alias("n_hit")).withColumn("coverage", F.col("n_hit") / float(cells * cells))


def trimmed(nodes: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """keys, n, n_kept, rms, rms_all, median, most (of the kept), within_half, within_one (of all) of the residuals' lengths; kept are those up to max(1.5, median + 4
    max(1.4826 MAD, 0.2))."""
    e = nodes.withColumn("e", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    mid = e.groupBy(*keys).agg(F.median("e").alias("med"))
    off = e.join(mid, list(keys))
    bound = off.groupBy(*keys).agg(F.max("med").alias("med"), F.median(F.abs(F.col("e") - F.col("med"))).alias("mad"))
    bound = bound.select(*keys, F.greatest(F.lit(1.5), F.col("med") + 4.0 * F.greatest(1.4826 * F.col("mad"), F.lit(0.2))).alias("bound"), "med")
    kept = e.join(bound, list(keys)).withColumn("kept", F.col("e") <= F.col("bound"))
    square = F.col("e") * F.col("e")
    return kept.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.sqrt(F.avg(F.when(F.col("kept"), square))).alias("rms"), F.sqrt(F.avg(square)).alias("rms_all"),
        F.max("med").alias("median"), F.max(F.when(F.col("kept"), F.col("e"))).alias("most"), F.avg((F.col("e") <= 0.5).cast("double")).alias("within_half"), F.avg((F.col("e") <= 1.0).cast("double")).alias("within_one"))


# The grades and their upper bounds in source pixels.
GRADES = (
    (0.5, "EXCELLENT - sub-pixel (<= 0.5 px)"),
    (1.0, "SUB-PIXEL (<= 1 px)"),
    (2.0, "near sub-pixel (1 - 2 px)"),
    (5.0, "pixel-level (2 - 5 px)"),
)
COARSE = "COARSE (> 5 px)"


def grade(px: Column) -> Column:
    """The grade of an error in source pixels; null and NaN are unknown."""
    out = F.lit(COARSE)
    for bound, name in reversed(GRADES):
        out = F.when(px <= bound, name).otherwise(out)
    return F.when(px.isNull() | F.isnan(px) | (F.abs(px) == float("inf")), "unknown").otherwise(out)


def basis(n_dense: Column, dense: Column, held_out: Column, rmse: Column) -> Column:
    """The figure to be graded: the dense check's with at least 8 nodes, else the held-out error, else the fit's."""
    return F.coalesce(F.when(n_dense >= 8, dense), held_out, rmse)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def area(polygon: np.ndarray) -> float:
    if len(polygon) < 3:
        return 0.0
    x, y = polygon.T
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def clipped(polygon: np.ndarray, width: float, height: float) -> np.ndarray:
    """A convex polygon's part in the frame [0, width] x [0, height]."""
    for axis, bound, sign in ((0, 0.0, 1), (0, width, -1), (1, 0.0, 1), (1, height, -1)):
        if not len(polygon):
            break
        side = sign * (polygon[:, axis] - bound)
        out = []
        for k in range(len(polygon)):
            a, b, sa, sb = polygon[k - 1], polygon[k], side[k - 1], side[k]
            if (sa < 0) != (sb < 0):
                out.append(a + (b - a) * sa / (sa - sb))
            if sb >= 0:
                out.append(b)
        polygon = np.array(out).reshape(-1, 2)
    return polygon


def hull_areas(points: DataFrame, width: float, height: float, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """keys, n, hull_area, frame_share of points (u, v), clipped to the frame. A group is one image's matches."""
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = area(clipped(hull(pdf[["u", "v"]].to_numpy()), width, height))
        return pd.DataFrame([(*key, len(pdf), a, a / (width * height))])

    return points.groupBy(*keys).applyInPandas(run, f"{kinds}, n bigint, hull_area double, frame_share double")


def inside(polygon: np.ndarray, x: float, y: float) -> bool:
    """Whether a place lies in a convex polygon or on its border."""
    turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(polygon, np.roll(polygon, -1, axis=0))]
    return all(t >= -1e-9 for t in turns) or all(t <= 1e-9 for t in turns)


def geometry(placed: DataFrame, matrices: DataFrame, frames: DataFrame) -> DataFrame:
    """image_id, overlap_area, overlap_share (of the reference), hull_share (of the matches' hull in the overlap's area) and coverage (of the cells of the overlap's
    bounding box cut 3 x 3 whose middle lies in the overlap, the share that holds a match; half-open cells).

    placed: image_id, x, y of the matches in the reference; matrices: image_id, t00..t22 from reference to target; frames: image_id, wa, ha, wb, hb. The overlap is
    the target's frame carried to the reference and clipped to it, or the whole frame if nothing is left. A group is one pair's matches.
    """
    t = [f"t{i}{j}" for i in range(3) for j in range(3)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, xy = pdf.iloc[0], pdf[["x", "y"]].to_numpy()
        back = np.linalg.inv(p[t].to_numpy(float).reshape(3, 3))
        corners = np.array([[0, 0, 1], [p.wb, 0, 1], [p.wb, p.hb, 1], [0, p.hb, 1]], float) @ back.T
        over = clipped(corners[:, :2] / corners[:, 2:], p.wa, p.ha)
        over = over if area(over) > 0 else np.array([[0, 0], [p.wa, 0], [p.wa, p.ha], [0, p.ha]], float)
        (x0, y0), (w, h) = over.min(0), (over.max(0) - over.min(0)) / 3
        cells = [(i, j) for i in range(3) for j in range(3) if inside(over, x0 + (i + 0.5) * w, y0 + (j + 0.5) * h)]
        hit = sum(bool(((xy[:, 0] >= x0 + i * w) & (xy[:, 0] < x0 + (i + 1) * w) & (xy[:, 1] >= y0 + j * h) & (xy[:, 1] < y0 + (j + 1) * h)).any()) for i, j in cells)
        whole = area(over)
        return pd.DataFrame([(*key, whole, whole / (p.wa * p.ha), area(hull(xy)) / whole if len(xy) >= 3 else 0.0, hit / max(len(cells), 1))])

    rows = placed.select("image_id", "x", "y").join(matrices.select("image_id", *t), "image_id").join(frames, "image_id")
    return rows.groupBy("image_id").applyInPandas(run, "image_id bigint, overlap_area double, overlap_share double, hull_share double, coverage double")


def quality(summary: DataFrame, nodes: DataFrame, frames: DataFrame) -> DataFrame:
    """summary (matching.match_pairs()) with, in pixels of the target's original, rmse_src, heldout_src, dense_src, accuracy_src and its basis and grade, and the
    residual check's figures, null without it. nodes: raster.residual_nodes(); frames: image_id, scale_tgt."""
    dense = trimmed(nodes.where("not rejected"), ("image_id",)).withColumnRenamed("n", "dense_nodes")
    out = summary.join(frames.select("image_id", "scale_tgt"), "image_id").join(dense, "image_id", "left")
    source = lambda c: F.round(F.col(c) / F.col("scale_tgt"), 3)
    out = out.withColumns({"rmse_src": source("rmse_tgt"), "heldout_src": source("heldout_tgt"), "dense_src": F.round(F.col("rms") * F.col("scale") / F.col("scale_tgt"), 3)})
    dense_counts = F.coalesce(F.col("dense_nodes") >= 8, F.lit(False))
    accuracy = basis(F.col("dense_nodes"), F.col("dense_src"), F.col("heldout_src"), F.col("rmse_src"))
    return out.withColumns({"accuracy_src": accuracy, "accuracy_basis": F.when(dense_counts, "images").otherwise("craters"), "quality": grade(accuracy)})


def uniqueness(votes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """votes: keys, hyp, n_pairs, s. keys, n_best, n_second, uniqueness: the best hypothesis against the best one at another zoom (by over 0.25 in log scale)."""
    order = F.struct("n_pairs", (-F.col("hyp")).alias("turn"), "s")
    best = votes.groupBy(*keys).agg(F.max(order).alias("b")).select(*keys, F.col("b.n_pairs").alias("n_best"), F.col("b.s").alias("s_best"))
    other = votes.join(best.hint("merge"), list(keys)).where(F.abs(F.log(F.col("s") / F.col("s_best"))) > 0.25).groupBy(*keys).agg(F.max("n_pairs").alias("n_second"))
    out = best.join(other.hint("merge"), list(keys), "left").withColumn("n_second", F.coalesce("n_second", F.lit(0)))
    return out.select(*keys, "n_best", "n_second", (F.col("n_best") / F.greatest("n_best", "n_second", F.lit(1))).alias("uniqueness"))
