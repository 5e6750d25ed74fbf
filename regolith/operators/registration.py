"""A whole registration of any number of image pairs: craters of both sides to one row of figures for each pair.

Pairs differ in how sure their craters are. The ladder goes down from the surest craters to less sure ones; each rung is a few jobs over the pairs that are still without a
match, so what a rung costs shrinks with its frontier, and a pair that matches never sees the rungs below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settled
from . import correlation, detection, matching, metrics, patterns, raster
from .matching import KEY, MATRIX
from .spatial import select_pattern


@dataclass(frozen=True)
class Options:
    """sure, further: the least confidence of the rungs, in this order. most_craters: of a side that a rung takes, in catalogue order; most_pattern: of these, the largest
    that lie well inside and have a useful size. neighbours, tolerance, hypotheses, rounds, least, model: of the matching."""

    sure: float = 0.5
    further: tuple[float, ...] = (0.4, 0.3, 0.25)
    least_r: float = 8.0
    largest: float = 0.35
    most_craters: int = 160
    most_pattern: int = 80
    neighbours: int = 8
    tolerance: float = 0.06
    hypotheses: int = 7000
    rounds: int = 4
    least: int = 4
    model: str = "auto"

    @property
    def rungs(self) -> list[float]:
        return list(dict.fromkeys((self.sure, *self.further)))


def usable(craters: DataFrame, frames: DataFrame, least_conf: float, options: Options = Options()) -> DataFrame:
    """The pattern craters of a rung. craters: image_id, crater_id, cx, cy, r, conf, in catalogue order by crater_id; frames: image_id, width, height."""
    order = Window.partitionBy("image_id").orderBy("crater_id")
    first = craters.where(F.col("conf") >= least_conf).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= options.most_craters).drop("turn")
    framed = first.join(frames.select("image_id", "width", "height"), "image_id")
    return select_pattern(framed, F.col("width"), F.col("height"), options.least_r, options.largest, options.most_pattern).drop("width", "height", "rank")


def side(frames: DataFrame, which: str) -> DataFrame:
    """image_id, width, height of one side of frames (image_id, wa, ha, wb, hb); which: a (reference) or b (target)."""
    return frames.select("image_id", F.col(f"w{which}").alias("width"), F.col(f"h{which}").alias("height"))


def matched(ref: DataFrame, tgt: DataFrame, frames: DataFrame, options: Options = Options(), seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs' matches (matching.match_table(), with conf_used), and the pattern craters of both sides that they were found among.

    frames: image_id, wa, ha, wb, hb. Pairs with fewer than four pattern craters on a side, or without a hypothesis that brings four together, try the next
    rung; those that fail on all are left out. seeds: see matching.match_table(), tried on every rung.
    """
    left, found = frames.select(*KEY), []
    for p in options.rungs:
        open_ = frames.join(left, list(KEY), "left_semi")
        a, b = (settled(usable(c.join(left, list(KEY), "left_semi"), side(open_, which), p, options)) for c, which in ((ref, "a"), (tgt, "b")))
        own = seeds.join(left, list(KEY), "left_semi") if seeds is not None else None
        rows = matching.match_table(a, b, options.hypotheses, options.rounds, options.least, own, side(open_, "b"), options.neighbours, options.tolerance, options.least_r)
        done = rows.select(*KEY).distinct()
        found.append((rows.withColumn("conf_used", F.lit(p)), a.join(done, list(KEY), "left_semi"), b.join(done, list(KEY), "left_semi")))
        left = settled(left.join(done, list(KEY), "left_anti"))
        if left.isEmpty():
            break
    out = list(found[0])
    for more in found[1:]:
        out = [x.unionByName(y) for x, y in zip(out, more)]
    return tuple(out)


def summarised(pairs: DataFrame, used: tuple[DataFrame, DataFrame], frames: DataFrame, options: Options = Options(), matrices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One row for each matched pair, and the placed matches (image_id, i, j, x, y, ra, u, v, rb, e, e_ref). pairs, used: of matched(). matrices: image_id and
    t00..t22 in place of the fitted ones, where given.

    Columns: those of matching.summarised(), conf_used, n_pattern_ref, n_pattern_tgt, n_visible_ref, n_visible_tgt, inlier_ratio, overlap_area, overlap_share, hull_share, coverage,
    star_deviation (null with fewer than three matches).
    """
    ref, tgt = used
    placed = settled(matching.coordinates(pairs, ref, tgt))
    out = settled(matching.summarised(pairs, placed, options.model, matrices))
    of = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name))
    seen = matching.visibility(ref, tgt, out, frames, options.least_r)
    shape = metrics.geometry(placed, out.select(*KEY, *MATRIX), frames)
    conf = pairs.groupBy(*KEY).agg(F.max("conf_used").alias("conf_used"))
    star = patterns.star_deviation(placed).select(*KEY, F.col("deviation").alias("star_deviation"))
    every = out.join(conf, list(KEY)).join(of(ref, "n_pattern_ref"), list(KEY)).join(of(tgt, "n_pattern_tgt"), list(KEY)).join(seen, list(KEY)).join(shape, list(KEY)).join(star, list(KEY), "left")
    errors = matching.errors(placed, out).select(*placed.columns, "e", (F.col("e") / F.col("scale")).alias("e_ref"))
    return every, errors


def from_catalogues(ref: DataFrame, tgt: DataFrame, frames: DataFrame, options: Options = Options(), seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """summarised() of all pairs of catalogues, with n_craters_ref, n_craters_tgt, and accuracy_src, accuracy_basis and quality by the craters alone. frames: image_id, wa, ha,
    wb, hb and scale_tgt, by which the target's original has been made smaller. Pairs that don't match have a row with ok false and nulls."""
    pairs, *used = matched(ref, tgt, frames, options, seeds)
    summary, errors = summarised(settled(pairs), tuple(used), frames, options)
    none = frames.sparkSession.createDataFrame([], "image_id bigint, dx double, dy double, rejected boolean")
    return _told(metrics.quality(summary, none, frames), ref, tgt, frames), errors


def _told(summary: DataFrame, ref: DataFrame, tgt: DataFrame, frames: DataFrame) -> DataFrame:
    of = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name))
    out = frames.select(*KEY).join(of(ref, "n_craters_ref"), list(KEY), "left").join(of(tgt, "n_craters_tgt"), list(KEY), "left").join(summary, list(KEY), "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_craters_ref", "n_craters_tgt", "n_inliers")}
    return out.withColumns(zero).withColumn("ok", F.col("model").isNotNull())


def craters_of_sides(base_ref: DataFrame, base_tgt: DataFrame, catalogues: tuple[DataFrame | None, DataFrame | None] = (None, None), model: RandomForestClassificationModel | None = None, options: Options = Options(), trees: int = 400, fit: bool = True, most_r: float = 200.0) -> tuple[DataFrame, DataFrame, RandomForestClassificationModel | None]:
    """Craters (image_id, crater_id, cx, cy, a, b, angle_deg, r, conf) of both sides, and the model they came from.

    base_ref, base_tgt: tiles of level 0 by the pairs' image_id. An image with a catalogue has its craters; the others are searched with the model, or, without
    one, with a model that is trained first on all catalogues and, in images without one, on the circles that slopes vote for. One model serves all pairs of
    the call. Without any image that lacks a catalogue nothing is searched or trained. Detections come surest first.
    """
    # Sides are told apart by the image's number: even for references, odd for targets.
    numbered = [df.withColumn("image_id", F.col("image_id") * 2 + n) for n, df in enumerate((base_ref, base_tgt))]
    base = numbered[0].unionByName(numbered[1])
    columns = ["image_id", "crater_id", "cx", "cy", "a", "b", "angle_deg", "r", "conf"]
    given = None
    for n, c in enumerate(catalogues):
        if c is not None:
            own = c.select((F.col("image_id") * 2 + n).alias("image_id"), *columns[1:])
            given = own if given is None else given.unionByName(own)
    bare = settled(base.join(given.select("image_id").distinct(), "image_id", "left_anti") if given is not None else base)
    found = None
    if not bare.isEmpty():
        if model is None:
            labels = given.select("image_id", "crater_id", "cx", "cy", "r", F.lit(1).alias("label"), F.lit(False).alias("complete")) if given is not None else None
            model = detection.quickly_trained(base, labels, options.least_r * 0.75, most_r, trees)
        ready = detection.prepared(bare)
        extra, _ = detection.classic_candidates(*ready, options.least_r * 0.75, most_r)
        found = detection.detected(bare, model, min(options.rungs), options.least_r * 0.75, most_r, extra, fit, ready)
        order = Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id")
        found = found.withColumn("crater_id", (F.row_number().over(order) - 1).cast("bigint")).select(*columns)
    every = settled(found if given is None else given if found is None else detection.with_catalogues(found, given))
    sides = [every.where(F.pmod("image_id", F.lit(2)) == n).withColumn("image_id", F.expr("floor(image_id / 2)").cast("bigint")) for n in (0, 1)]
    return sides[0], sides[1], model


def from_images(base_ref: DataFrame, base_tgt: DataFrame, scale_tgt: DataFrame | None = None, catalogues: tuple[DataFrame | None, DataFrame | None] = (None, None), model: RandomForestClassificationModel | None = None, library: DataFrame | None = None, options: Options = Options(), trees: int = 400, fit: bool = True, refine: bool = True, most_r: float = 200.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for each pair, its matches with their errors, and its registered target's tiles: detection or catalogues, patterns of the library (tables.patterns() with image_id) as seeds, the
    ladder, the model, refinement by correlation if asked for, figures, the check of what is left of the shift in the images, and the grade.

    base_ref, base_tgt: tiles of level 0 by the pairs' image_id; scale_tgt: image_id, scale_tgt, else 1. Pairs that don't match have a row with ok false.
    """
    ref, tgt, model = craters_of_sides(base_ref, base_tgt, catalogues, model, options, trees, fit, most_r)
    size = lambda df, s: df.groupBy("image_id").agg(F.max("width").alias(f"w{s}"), F.max("height").alias(f"h{s}"))
    frames = size(base_ref, "a").join(size(base_tgt, "b"), "image_id")
    frames = settled(frames.join(scale_tgt, "image_id", "left").withColumn("scale_tgt", F.coalesce("scale_tgt", F.lit(1.0))) if scale_tgt is not None else frames.withColumn("scale_tgt", F.lit(1.0)))
    sure = min(options.rungs)
    seeds = patterns.library_seeds(library, ref.where(F.col("conf") >= sure), tgt.where(F.col("conf") >= sure)) if library is not None else None
    pairs, *used = matched(ref, tgt, frames, options, seeds)
    pairs, used = settled(pairs), tuple(used)
    summary, errors = summarised(pairs, used, frames, options)
    if refine:
        summary = settled(summary)
        better = settled(correlation.refined(base_ref, base_tgt, summary.select(*KEY, "model", *MATRIX), errors))
        again, errors = summarised(pairs, used, frames, options, better.where("used").select(*KEY, *MATRIX))
        summary = again.join(better.select(*KEY, F.col("used").alias("ecc_used"), "cc"), list(KEY), "left")
    summary = settled(summary)
    shape = frames.select("image_id", F.col("ha").alias("height"), F.col("wa").alias("width"))
    registered = settled(raster.warped(base_tgt, summary.select(*KEY, *MATRIX), shape.join(summary.select(*KEY), list(KEY), "left_semi")))
    nodes = raster.residual_nodes(base_ref.join(summary.select(*KEY), list(KEY), "left_semi"), registered)
    return _told(metrics.quality(summary, settled(nodes), frames), ref, tgt, frames), errors, registered
