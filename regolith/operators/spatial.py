"""Neighbour joins of circles in the plane. Frames carry keys (image or pair), so work is spread over many images; within a key, grids bound candidates.

Tables that grow with the craters are joined by a shuffle, whatever size they are taken for (hint "merge"): that is told from compressed files and from before rows are
exploded, so they pass for small, and a broadcast would bring them whole to the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def same_crater(a: str, b: str, k: float = 0.5) -> Column:
    """Circles of frames aliased a and b are one crater: centres nearer than k times the larger radius, and radii of about one size (strict bounds)."""
    c = lambda side, name: F.col(f"{side}.{name}")
    d = distance(c(a, "cx"), c(a, "cy"), c(b, "cx"), c(b, "cy"))
    ratio = c(a, "r") / c(b, "r")
    return (d < k * F.greatest(c(a, "r"), c(b, "r"))) & (ratio > 0.6) & (ratio < 1.67)


def _celled(df: DataFrame, cell: float) -> DataFrame:
    return df.withColumns({"gx": F.floor(F.col("cx") / cell), "gy": F.floor(F.col("cy") / cell)})


def _around(df: DataFrame, cell: float) -> DataFrame:
    """Each row once for each of the nine cells around its own."""
    near = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    out = _celled(df, cell).withColumn("step", F.explode(near))
    return out.withColumns({"gx": F.col("gx") + F.col("step.x"), "gy": F.col("gy") + F.col("step.y")}).drop("step")


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float, how: str = "inner", condition: Column | None = None) -> DataFrame:
    """left (alias a) joined with right (alias b) on keys where condition holds; condition must imply distance below cell in both axes.

    Both sides need cx and cy. An equi-join on grid cells: a theta join would compare all pairs of a key. For semi and anti joins right is spread over the
    cells, so each row of left stays one row; for inner joins left is.
    """
    keep = how in ("left_semi", "left_anti")
    a = (_celled(left, cell) if keep else _around(left, cell)).alias("a")
    b = (_around(right, cell) if keep else _celled(right, cell)).hint("merge").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "gx", "gy")]
    out = a.join(b, [*on, condition] if condition is not None else on, how)
    return out.drop("gx", "gy") if keep else out


def matching(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("image_id",), k: float = 0.5, most_r: float = 200.0, keep: bool = True) -> DataFrame:
    """Rows of left that are (keep) or are not the same crater as some row of right. Radii above most_r are compared without a grid: those are few."""
    cell = k * most_r
    small_l, small_r = left.where(F.col("r") <= most_r), right.where(F.col("r") <= most_r)
    on = [F.col(f"a.{x}") == F.col(f"b.{x}") for x in keys]
    rule = same_crater("a", "b", k)
    large, whole = right.where(F.col("r") > most_r).hint("merge"), right.hint("merge")
    if keep:
        near = near_pairs(small_l, small_r, keys, cell, "left_semi", rule)
        wide = small_l.alias("a").join(large.alias("b"), [*on, rule], "left_semi")
        big = left.where(F.col("r") > most_r).alias("a").join(whole.alias("b"), [*on, rule], "left_semi")
        return near.union(wide).union(big).distinct()
    near = near_pairs(small_l, small_r, keys, cell, "left_anti", rule).alias("a").join(large.alias("b"), [*on, rule], "left_anti")
    return near.union(left.where(F.col("r") > most_r).alias("a").join(whole.alias("b"), [*on, rule], "left_anti"))


def knn(craters: DataFrame, k: int = 8, keys: Sequence[str] = ("image_id",), id_col: str = "crater_id", carry: Sequence[str] = (), levels: int = 12) -> DataFrame:
    """keys, i, j, d, rank: the k nearest other craters of each, exactly; ties go to the smaller id. carry: columns that come along as <name>_i and <name>_j.

    An image is cut into cells that halve from level to level. The finest cell around a crater that holds k others has them within its diagonal, so cells of twice its
    width hold the k nearest in the nine around the crater: it is joined with these. Dense and empty regions get cells of their own size, and no
    image's craters are all compared with each other. Images of fewer than k + 1 craters are one cell.
    """
    base = craters.select(*keys, F.col(id_col).alias("id"), "cx", "cy", *carry)
    box = base.groupBy(*keys).agg(F.min("cx").alias("x0"), F.min("cy").alias("y0"), F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"), F.lit(1e-9)).alias("side"))
    base = base.join(box.hint("merge"), list(keys))
    cell = lambda c, o, level: F.floor((F.col(c) - F.col(o)) / F.col("side") * F.pow(F.lit(2.0), level) * (1 - 1e-12))
    at = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumns({"gx": cell("cx", "x0", F.col("level")), "gy": cell("cy", "y0", F.col("level"))})
    full = at.select(*keys, "id", "level", "gx", "gy").withColumn("n", F.count("*").over(Window.partitionBy(*keys, "level", "gx", "gy"))).where(F.col("n") > k)
    finest = full.groupBy(*keys, "id").agg(F.max("level").alias("finest"))
    own = base.join(finest.hint("merge"), [*keys, "id"], "left").withColumn("level", F.greatest(F.coalesce("finest", F.lit(0)) - 1, F.lit(0)))
    # No further than the diagonal of the finest cell, with room for rounding: the rest needn't be ranked.
    own = own.withColumn("within", F.when(F.col("finest").isNotNull(), 1.4143 * F.col("side") / F.pow(F.lit(2.0), F.col("finest"))).otherwise(float("inf")))
    near = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    a = own.withColumn("step", F.explode(near)).withColumns({"gx": cell("cx", "x0", F.col("level")) + F.col("step.x"), "gy": cell("cy", "y0", F.col("level")) + F.col("step.y")})
    # Beyond the image there is nothing to meet, and below its finest cells nobody asks.
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < F.pow(F.lit(2.0), F.col("level")))
    a = a.where(inside("gx") & inside("gy")).alias("a")
    deepest = finest.groupBy(*keys).agg(F.greatest(F.max("finest") - 1, F.lit(0)).alias("deepest"))
    b = base.join(deepest.hint("merge"), list(keys), "left").withColumn("level", F.explode(F.sequence(F.lit(0), F.coalesce("deepest", F.lit(0)))))
    b = b.withColumns({"gx": cell("cx", "x0", F.col("level")), "gy": cell("cy", "y0", F.col("level"))}).hint("merge").alias("b")
    d = distance(F.col("a.cx"), F.col("a.cy"), F.col("b.cx"), F.col("b.cy"))
    pairs = a.join(b, [*(F.col(f"a.{x}") == F.col(f"b.{x}") for x in (*keys, "level", "gx", "gy")), F.col("a.id") != F.col("b.id"), d <= F.col("a.within")])
    pairs = pairs.select(*(F.col(f"a.{x}") for x in keys), F.col("a.id").alias("i"), F.col("b.id").alias("j"), d.alias("d"), *(F.col(f"{s}.{c}").alias(f"{c}_{t}") for c in carry for s, t in (("a", "i"), ("b", "j"))))
    order = Window.partitionBy(*keys, "i").orderBy("d", "j")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(points: DataFrame, targets: DataFrame, keys: Sequence[str], target_keys: Sequence[str], least: float, share: float, carry: Sequence[str] = ("i", "r")) -> DataFrame:
    """points with the nearest target (j, rb, d) that could be accepted at all; ties go to the smaller j. points: keys, i, cx, cy, r; targets: target_keys (a part of
    keys), j, cx, cy, r. Cells are as wide as the largest distance that later tests accept among a key's targets, max(least, share * r)."""
    reach = targets.groupBy(*target_keys).agg(F.greatest(F.lit(float(least)), share * F.max("r")).alias("reach"))
    near = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    cells = lambda df: df.join(reach.hint("merge"), list(target_keys)).withColumns({"gx": F.floor(F.col("cx") / F.col("reach")), "gy": F.floor(F.col("cy") / F.col("reach"))})
    a = cells(points).withColumn("step", F.explode(near)).withColumns({"gx": F.col("gx") + F.col("step.x"), "gy": F.col("gy") + F.col("step.y")}).alias("a")
    b = cells(targets).hint("merge").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*target_keys, "gx", "gy")]
    d = distance(F.col("a.cx"), F.col("a.cy"), F.col("b.cx"), F.col("b.cy"))
    best = F.min(F.struct(d.alias("d"), F.col("b.j").alias("j"), F.col("b.r").alias("rb")))
    joined = a.join(b, on).where(d <= F.col("a.reach"))
    return joined.groupBy(*(F.col(f"a.{k}") for k in keys), *(F.col(f"a.{c}") for c in carry)).agg(best.alias("best")).select(*keys, *carry, "best.j", "best.rb", "best.d")


def sized(pairs: DataFrame, least: Column, share: float, low: float, high: float, scale: Column) -> DataFrame:
    """Nearest pairs that fit: d below max(least, share * rb), and rb / (r * scale) between low and high (strict). Chosen first, tested afterwards: a nearest target
    of the wrong size hides others."""
    ratio = F.col("rb") / (F.col("r") * scale)
    return pairs.where((F.col("d") < F.greatest(least, share * F.col("rb"))) & (ratio > low) & (ratio < high))


def one_to_one(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each target the nearest of its points; ties go to the smaller i."""
    order = Window.partitionBy(*keys, "j").orderBy("d", "i")
    return pairs.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def _suppress(k: float, of_new: bool = False):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["conf", "det_id"], ascending=[False, True], kind="stable")
        x, y, r = (pdf[c].to_numpy() for c in ("cx", "cy", "r"))
        # Kept circles by cell and size class: those of one crater have radii in ratios up to 1.67 and centres nearer than k of the larger.
        size = np.floor(np.log(r) / np.log(1.67)).astype(int)
        cells: dict[tuple[int, int, int], list[int]] = {}
        kept: list[int] = []
        for n in range(len(pdf)):
            near = []
            for c in (size[n] - 1, size[n], size[n] + 1):
                wide = k * 1.67 ** (max(c, size[n]) + 1)
                side = k * 1.67 ** (c + 2)
                for cx in range(int((x[n] - wide) // side), int((x[n] + wide) // side) + 1):
                    for cy in range(int((y[n] - wide) // side), int((y[n] + wide) // side) + 1):
                        near += cells.get((c, cx, cy), ())
            at = np.array(near, int)
            d, ratio = np.hypot(x[at] - x[n], y[at] - y[n]), r[n] / r[at] if of_new else r[at] / r[n]
            if not ((d < k * np.maximum(r[at], r[n])) & (ratio > 0.6) & (ratio < 1.67)).any():
                kept.append(n)
                side = k * 1.67 ** (size[n] + 2)
                cells.setdefault((size[n], int(x[n] // side), int(y[n] // side)), []).append(n)
        return pdf.iloc[kept]

    return run


def nms(detections: DataFrame, k: float = 0.5, keys: Sequence[str] = ("image_id",), of_new: bool = False) -> DataFrame:
    """Greedy suppression: by falling conf (ties: smaller det_id), a detection stays unless it is the same crater as one that stays, its radius being taken over the other's if of_new,
    else the other's over its own (the bounds, 0.6 and 1.67, aren't quite each other's inverse). A group is one image."""
    return detections.groupBy(*keys).applyInPandas(_suppress(k, of_new), detections.schema)


def _assign(pdf_d: pd.DataFrame, pdf_t: pd.DataFrame, tol: float) -> pd.DataFrame:
    x, y, r, ids = (pdf_d[c].to_numpy() for c in ("cx", "cy", "r", "det_id"))
    free = np.ones(len(ids), bool)
    rows = []
    for t in pdf_t.sort_values("crater_id").itertuples():
        d = np.hypot(x - t.cx, y - t.cy)
        at = np.flatnonzero(free & (np.abs(r / t.r - 1) < 0.3))
        if len(at):
            n = at[np.lexsort((ids[at], d[at]))[0]]
            if d[n] < tol * t.r:
                free[n] = False
                rows.append((t.image_id, t.crater_id, int(ids[n]), float(d[n])))
    return pd.DataFrame(rows, columns=["image_id", "crater_id", "det_id", "d"])


def score_detections(detections: DataFrame, truth: DataFrame, tol: float = 0.25) -> DataFrame:
    """image_id, crater_id, det_id, d: in the truth's order, each crater takes the nearest unused detection of about its size, if nearer than tol radii."""
    return detections.groupBy("image_id").cogroup(truth.groupBy("image_id")).applyInPandas(lambda d, t: _assign(d, t, tol), "image_id bigint, crater_id bigint, det_id bigint, d double")


def detection_report(detections: DataFrame, truth: DataFrame, tol: float = 0.25) -> DataFrame:
    """image_id, n_found, n_truth, n_extra (detections that no crater took), mean_d of those found."""
    hit = score_detections(detections, truth, tol).groupBy("image_id").agg(F.count("*").alias("n_found"), F.avg("d").alias("mean_d"))
    size = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    both = size(truth, "n_truth").join(size(detections, "n_det"), "image_id", "full").join(hit, "image_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return both.select("image_id", zero("n_found").alias("n_found"), zero("n_truth").alias("n_truth"), (zero("n_det") - zero("n_found")).alias("n_extra"), "mean_d")


def select_pattern(craters: DataFrame, width: float | Column, height: float | Column, min_r: float = 8.0, max_frac: float = 0.35, most: int = 80) -> DataFrame:
    """The largest craters of an image that lie well inside its frame, given for all or by columns; ties go to the smaller id."""
    m, wide, high = 0.7 * F.col("r"), *(x if isinstance(x, Column) else F.lit(float(x)) for x in (width, height))
    inside = (F.col("cx") - m >= 0) & (F.col("cy") - m >= 0) & (F.col("cx") + m <= wide) & (F.col("cy") + m <= high)
    fit = craters.where((F.col("r") >= min_r) & (F.col("r") <= max_frac * F.least(wide, high)) & inside)
    order = Window.partitionBy("image_id").orderBy(F.desc("r"), "crater_id")
    return fit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _holding(points: DataFrame, circles: DataFrame, reach: float) -> DataFrame:
    """points (alias p: image_id, point_id, x, y) with the circles (alias c: image_id, crater_id, cx, cy, r) that hold them within `reach` radii, and the distance d. An
    equi-join on cells as wide as the image's widest reach."""
    wide = circles.groupBy("image_id").agg((reach * F.max("r")).alias("reach"))
    near = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    p = points.join(wide.hint("merge"), "image_id").withColumn("step", F.explode(near)).withColumns({"gx": F.floor(F.col("x") / F.col("reach")) + F.col("step.x"), "gy": F.floor(F.col("y") / F.col("reach")) + F.col("step.y")}).alias("p")
    c = circles.join(wide.hint("merge"), "image_id").withColumns({"gx": F.floor(F.col("cx") / F.col("reach")), "gy": F.floor(F.col("cy") / F.col("reach"))}).hint("merge").alias("c")
    d = distance(F.col("p.x"), F.col("p.y"), F.col("c.cx"), F.col("c.cy"))
    hit = p.join(c, [F.col(f"p.{k}") == F.col(f"c.{k}") for k in ("image_id", "gx", "gy")]).where(d < reach * F.col("c.r"))
    return hit.select("p.image_id", "p.point_id", "c.crater_id", "c.r", d.alias("d"))


def smallest_around(points: DataFrame, circles: DataFrame, reach: float = 1.1) -> DataFrame:
    """For each point (image_id, point_id, x, y) the smallest circle (crater_id) that holds it, within `reach` radii; ties go to the smaller id."""
    return _holding(points, circles, reach).groupBy("image_id", "point_id").agg(F.min(F.struct("r", "crater_id")).alias("m")).select("image_id", "point_id", F.col("m.crater_id").alias("crater_id"))


def label_at(points: DataFrame, labels: DataFrame, reach: float = 1.2) -> DataFrame:
    """For each point (image_id, point_id, x, y) the label (crater_id) whose centre is nearest among those within `reach` radii; ties go to the smaller id."""
    return _holding(points, labels, reach).groupBy("image_id", "point_id").agg(F.min(F.struct("d", "crater_id")).alias("m")).select("image_id", "point_id", "m.crater_id", "m.d")
