"""From look-alike triangles to one transform for each pair of images: hypotheses, votes, refits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settled
from . import consensus
from .fits import choose_model, fit_affine, fit_homography, fit_similarity, leave_one_out, moved
from .triangles import all_triangles, corner_pairs, knn_triangles, lookalikes, top_hypotheses, with_corners

KEY = ("image_id",)


def thresholds(tgt: DataFrame) -> DataFrame:
    """image_id, thr: a tenth of the median target radius, at least 5."""
    return tgt.groupBy(*KEY).agg(F.greatest(F.lit(5.0), 0.1 * F.median("r")).alias("thr"))


def collected(sims: DataFrame, ref: DataFrame, tgt: DataFrame, bounds: consensus.Bounds = consensus.FIRST, least: DataFrame | None = None) -> DataFrame:
    """image_id, i, j, d: reference craters under each image's similarity with their nearest targets, tested for size, one to one."""
    one = sims.select(*KEY, F.lit(0).cast("bigint").alias("hyp"), "re", "im", "tx", "ty")
    return consensus.listed(consensus.blocks(one, ref, tgt, thresholds(tgt) if least is None else least), bounds).drop("hyp")


def hypotheses(ref: DataFrame, tgt: DataFrame, most: int = 7000, k: int = 8, tol: float = 0.06, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """image_id, hyp and a similarity for each of the closest look-alike triangles."""
    a, b = settled(knn_triangles(ref, k)), settled(knn_triangles(tgt, k))
    top = with_corners(top_hypotheses(lookalikes(a, b, KEY, tol), most), a, b)
    return fit_similarity(corner_pairs(top), [*KEY, "hyp"]).where((F.col("s") > low) & (F.col("s") < high))


def votes(hyps: DataFrame, ref: DataFrame, tgt: DataFrame, frames: DataFrame | None = None, stop: consensus.Stop | None = consensus.Stop()) -> DataFrame:
    """image_id, hyp, n_pairs: how many craters each hypothesis brings together, up to the first of its image that ends the votes. frames: image_id, width, height of the
    targets. Without a stop all are tried."""
    return consensus.counted(consensus.blocks(hyps, ref, tgt, thresholds(tgt), frames), consensus.FIRST, stop)


def winners(counted: DataFrame) -> DataFrame:
    """image_id, hyp, n_pairs: most pairs, then the closest look-alike."""
    best = counted.groupBy(*KEY).agg(F.max(F.struct("n_pairs", (-F.col("hyp")).alias("turn"))).alias("b"))
    return best.select(*KEY, (-F.col("b.turn")).alias("hyp"), F.col("b.n_pairs").alias("n_pairs"))


def coordinates(pairs: DataFrame, ref: DataFrame, tgt: DataFrame) -> DataFrame:
    """pairs (image_id, i, j) with x, y, ra of the reference and u, v, rb of the target."""
    a = ref.select(*KEY, F.col("crater_id").alias("i"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("r").alias("ra"))
    b = tgt.select(*KEY, F.col("crater_id").alias("j"), F.col("cx").alias("u"), F.col("cy").alias("v"), F.col("r").alias("rb"))
    return pairs.join(a.hint("merge"), [*KEY, "i"]).join(b.hint("merge"), [*KEY, "j"])


def refitted(sims: DataFrame, ref: DataFrame, tgt: DataFrame, rounds: int = 4) -> DataFrame:
    """image_id, i, j: the pairs of each image's similarity after up to `rounds` rounds of fitting and collecting anew within tighter bounds. An image stops where
    fewer than three pairs are left or more than one is lost. An image's craters are one row, so the rounds need no shuffle."""
    one = sims.select(*KEY, F.lit(0).cast("bigint").alias("hyp"), "re", "im", "tx", "ty")
    return consensus.refined(consensus.blocks(one, ref, tgt, thresholds(tgt)), rounds)


def residuals(pairs: DataFrame, sims: DataFrame) -> DataFrame:
    """pairs with coordinates and their image's similarity, with the distance e in the target."""
    return moved(pairs.join(sims.drop("n").hint("merge"), list(KEY))).withColumn("e", F.sqrt((F.col("px") - F.col("u")) * (F.col("px") - F.col("u")) + (F.col("py") - F.col("v")) * (F.col("py") - F.col("v"))))


def residual_stats(errors: DataFrame) -> DataFrame:
    """image_id, n, rmse_tgt, rmse_ref (over the scale), median_tgt, max_tgt."""
    out = errors.groupBy(*KEY).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse_tgt"), F.median("e").alias("median_tgt"), F.max("e").alias("max_tgt"), F.max("s").alias("s"))
    return out.select(*KEY, "n", "rmse_tgt", (F.col("rmse_tgt") / F.col("s")).alias("rmse_ref"), "median_tgt", "max_tgt")


LEAST = {"similarity": 2, "affine": 3, "homography": 4}
MATRIX = [f"t{i}{j}" for i in range(3) for j in range(3)]


def matrices(fitted: DataFrame, model: str, keys: Sequence[str] = KEY) -> DataFrame:
    """keys and t00..t22 of fits of one model."""
    if model == "homography":
        return fitted.select(*keys, *MATRIX)
    rows = ["re", "-im", "tx", "im", "re", "ty"] if model == "similarity" else ["a00", "a01", "a02", "a10", "a11", "a12"]
    return fitted.selectExpr(*keys, *(f"{e} AS {t}" for e, t in zip([*rows, "0e0", "0e0", "1e0"], MATRIX)))


def models(placed: DataFrame, want: str = "auto", keys: Sequence[str] = KEY) -> DataFrame:
    """keys, n, model, loo_rmse and t00..t22. placed: keys, x, y, u, v.

    With `auto` the next model is taken if its leave-one-out error is below 0.85 of the current one's and there are 3 pairs more than it needs; otherwise the
    wanted model is, where there are pairs enough for it, else the similarity.
    """
    loo = {m: leave_one_out(placed, keys, m, LEAST[m]) for m in LEAST}
    if want == "auto":
        chosen = choose_model(loo, keys, LEAST)
    else:
        chosen = loo[want].withColumn("model", F.when(F.col("n") >= LEAST[want], want).otherwise("similarity")).select(*keys, "n", "model", "loo_rmse")
    fitted = {"similarity": fit_similarity(placed, keys), "affine": fit_affine(placed, keys), "homography": fit_homography(placed, keys)}
    every = None
    for m, df in fitted.items():
        own = matrices(df, m, keys).withColumn("model", F.lit(m))
        every = own if every is None else every.unionByName(own)
    return chosen.join(every.hint("merge"), [*keys, "model"]).select(*keys, "n", "model", "loo_rmse", *MATRIX)


def mapped(df: DataFrame, x: str = "x", y: str = "y", to: tuple[str, str] = ("px", "py")) -> DataFrame:
    """df, which has t00..t22, with the transformed point."""
    w = f"(t20 * {x} + t21 * {y} + t22)"
    return df.withColumns({to[0]: F.expr(f"(t00 * {x} + t01 * {y} + t02) / {w}"), to[1]: F.expr(f"(t10 * {x} + t11 * {y} + t12) / {w}")})


def enough(ref: DataFrame, tgt: DataFrame, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Both sides without the pairs of images that have fewer than `least` craters on either."""
    many = lambda df: df.groupBy(*KEY).count().where(F.col("count") >= least)
    both = many(ref).join(many(tgt).hint("merge"), list(KEY), "left_semi").select(*KEY).hint("merge")
    return ref.join(both, list(KEY), "left_semi"), tgt.join(both, list(KEY), "left_semi")


def match_table(ref: DataFrame, tgt: DataFrame, most: int = 7000, rounds: int = 4, least: int = 4, seeds: DataFrame | None = None, frames: DataFrame | None = None, k: int = 8, tol: float = 0.06, least_r: float = 8.0) -> DataFrame:
    """image_id, i, j, n_best, n_second, seeded: the refined pairs of every pair of images in which a hypothesis finds at least `least`, with the best
    hypothesis's number of pairs, that of the best one at another zoom (by over 0.25 in log scale), and whether it came from a seed.

    seeds: image_id, re, im, tx, ty of similarities that are known already; they are tried before the triangles'. The first good hypothesis ends an image's votes,
    see consensus.Stop; frames: image_id, width, height of the targets, without which they have no end. All pairs of images run at once.
    """
    ref, tgt = enough(ref, tgt, least)
    hyps = hypotheses(ref, tgt, most, k, tol).select(*KEY, F.col("hyp").cast("bigint").alias("hyp"), "re", "im", "tx", "ty", "s")
    if seeds is not None:
        turn = Window.partitionBy(*KEY).orderBy("re", "im", "tx", "ty")
        hyps = hyps.unionByName(seeds.select(*KEY, (-F.row_number().over(turn)).cast("bigint").alias("hyp"), "re", "im", "tx", "ty", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("s")))
    hyps = settled(hyps)
    counted = settled(votes(hyps, ref, tgt, frames, consensus.Stop(least_r=least_r)).join(hyps.hint("merge"), [*KEY, "hyp"]))
    # Of equal numbers of pairs a seed goes first, then the closest look-alike.
    order = F.struct("n_pairs", F.when(F.col("hyp") < 0, F.lit(1)).otherwise(0).alias("seeded"), (-F.col("hyp")).alias("turn"), "re", "im", "tx", "ty", "s")
    best = counted.groupBy(*KEY).agg(F.max(order).alias("b")).select(*KEY, "b.*").where(F.col("n_pairs") >= least)
    other = counted.join(best.select(*KEY, F.col("s").alias("s_best")).hint("merge"), list(KEY)).where(F.abs(F.log(F.col("s") / F.col("s_best"))) > 0.25).groupBy(*KEY).agg(F.max("n_pairs").alias("n_second"))
    told = best.join(other.hint("merge"), list(KEY), "left").select(*KEY, F.col("n_pairs").alias("n_best"), F.coalesce("n_second", F.lit(0)).cast("bigint").alias("n_second"), (F.col("seeded") == 1).alias("seeded"))
    return settled(refitted(best, ref, tgt, rounds).join(told.hint("merge"), list(KEY)))


def inverse_matrix() -> list[Column]:
    """The inverse of t00..t22, row by row, with 1 at its end."""
    t = {c: F.col(c) for c in MATRIX}
    minor = lambda a, b, c, d: t[f"t{a}"] * t[f"t{d}"] - t[f"t{b}"] * t[f"t{c}"]
    rows = [minor("11", "12", "21", "22"), -minor("01", "02", "21", "22"), minor("01", "02", "11", "12"), -minor("10", "12", "20", "22"), minor("00", "02", "20", "22"), -minor("00", "02", "10", "12"), minor("10", "11", "20", "21"), -minor("00", "01", "20", "21"), minor("00", "01", "10", "11")]
    return [r / rows[8] for r in rows]


def scale_of_matrix() -> Column:
    return F.sqrt(F.abs(F.col("t00") * F.col("t11") - F.col("t01") * F.col("t10")))


def errors(placed: DataFrame, matrices: DataFrame) -> DataFrame:
    """placed (coordinates()) with their image's t00..t22, its scale and the distance e in the target."""
    at = mapped(placed.join(matrices.select(*KEY, *MATRIX).hint("merge"), list(KEY))).withColumn("scale", scale_of_matrix())
    return at.withColumn("e", F.sqrt((F.col("px") - F.col("u")) * (F.col("px") - F.col("u")) + (F.col("py") - F.col("v")) * (F.col("py") - F.col("v"))))


def summarised(pairs: DataFrame, placed: DataFrame, model: str = "auto", matrices: DataFrame | None = None) -> DataFrame:
    """image_id, model, n_inliers, scale, rotation_deg, tx, ty, rmse_tgt, rmse_ref, median_ref, max_ref, heldout_tgt, heldout_ref, uniqueness, seeded and t00..t22 of matches
    (match_table()) and their coordinates. matrices: image_id, t00..t22 that are taken in place of the fit, where given."""
    chosen = models(placed, model)
    if matrices is not None:
        other = matrices.select(*KEY, F.struct(*MATRIX).alias("own"))
        chosen = chosen.join(other.hint("merge"), list(KEY), "left").select(*KEY, "n", "model", "loo_rmse", *(F.coalesce(F.col(f"own.{c}"), F.col(c)).alias(c) for c in MATRIX))
    stats = residual_stats(errors(placed, chosen).withColumnRenamed("scale", "s"))
    told = pairs.groupBy(*KEY).agg(F.max("n_second").alias("n_second"), F.max("seeded").alias("seeded"))
    out = stats.join(chosen.drop("n").hint("merge"), list(KEY)).join(told.hint("merge"), list(KEY)).withColumn("s", scale_of_matrix())
    return out.select(
        *KEY, "model", F.col("n").alias("n_inliers"), F.col("s").alias("scale"), F.degrees(F.atan2("t10", "t00")).alias("rotation_deg"), F.col("t02").alias("tx"), F.col("t12").alias("ty"),
        "rmse_tgt", "rmse_ref", (F.col("median_tgt") / F.col("s")).alias("median_ref"), (F.col("max_tgt") / F.col("s")).alias("max_ref"), F.col("loo_rmse").alias("heldout_tgt"), (F.col("loo_rmse") / F.col("s")).alias("heldout_ref"),
        (F.col("n") / F.greatest("n", "n_second", F.lit(1))).alias("uniqueness"), "seeded", *MATRIX)


def match_pairs(ref: DataFrame, tgt: DataFrame, most: int = 7000, rounds: int = 4, least: int = 4, model: str = "auto", seeds: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """summarised() of every pair of images with at least `least` craters on both sides and as many pairs. Empty catalogues give an empty result."""
    pairs = match_table(ref, tgt, most, rounds, least, seeds, frames)
    return summarised(pairs, settled(coordinates(pairs, ref, tgt)), model).where(F.col("n_inliers") >= least)


def match_learned(ref: DataFrame, tgt: DataFrame, largest: int = 45, tol: float = 0.06, most: int = 4000, least: int = 4) -> DataFrame:
    """image_id, n_inliers, scale, rotation_deg, tx, ty, rmse, inlier_ratio by the triangles of the `largest` craters of either side.

    Every hypothesis counts the reference craters whose nearest target fits, without one-to-one; the best is fitted three times to those that fit within tighter
    bounds. Images are rows with their craters, so the fits need no shuffle.
    """
    ref, tgt = enough(ref, tgt, least)
    a, b = settled(all_triangles(ref, largest)), settled(all_triangles(tgt, largest))
    top = with_corners(top_hypotheses(lookalikes(a, b, KEY, tol), most), a, b)
    hyps = fit_similarity(corner_pairs(top), [*KEY, "hyp"]).where("s > 0.1 and s < 10").select(*KEY, F.col("hyp").cast("bigint").alias("hyp"), "re", "im", "tx", "ty")
    hyps = settled(hyps)
    floor = tgt.select(*KEY).distinct().withColumn("thr", F.lit(3.0))
    counted = consensus.counted(consensus.blocks(hyps, ref, tgt, floor), consensus.LEARNED)
    best = winners(counted).where(F.col("n_pairs") >= least).drop("n_pairs")
    rows = consensus.blocks(hyps.join(best.hint("merge"), [*KEY, "hyp"]).withColumn("hyp", F.lit(0).cast("bigint")), ref, tgt, floor)
    pairs = settled(consensus.learned(rows))
    placed = coordinates(pairs, ref, tgt)
    sims = pairs.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("re", "im", "tx", "ty")))
    stats = residual_stats(residuals(placed.select(*KEY, "i", "j", "x", "y", "u", "v"), sims.withColumns({"s": F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), "n": F.lit(0)}))).where(F.col("n") >= least)
    size = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name))
    out = stats.join(sims.hint("merge"), list(KEY)).join(size(ref, "a").hint("merge"), list(KEY)).join(size(tgt, "b").hint("merge"), list(KEY))
    return out.select(*KEY, F.col("n").alias("n_inliers"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("scale"), F.degrees(F.atan2("im", "re")).alias("rotation_deg"), "tx", "ty", F.col("rmse_tgt").alias("rmse"), (F.col("n") / F.least("a", "b")).alias("inlier_ratio"))


def visible(craters: DataFrame, matrices: DataFrame, frames: DataFrame, min_r: float = 8.0) -> DataFrame:
    """craters (image_id, cx, cy, r) with in_frame: their image under t00..t22 lies in the other side's frame (image_id, width, height), less a twentieth of its shorter side
    around, and its radius, by the matrix's scale, is at least 0.8 of min_r."""
    at = mapped(craters.join(matrices.select(*KEY, *MATRIX), list(KEY)).join(frames.select(*KEY, "width", "height"), list(KEY)), "cx", "cy")
    m = 0.05 * F.least("width", "height")
    inside = (F.col("px") > -m) & (F.col("px") < F.col("width") + m) & (F.col("py") > -m) & (F.col("py") < F.col("height") + m)
    return at.withColumn("in_frame", inside & (F.col("r") * scale_of_matrix() >= 0.8 * min_r))


def visibility(ref: DataFrame, tgt: DataFrame, summary: DataFrame, frames: DataFrame, min_r: float = 8.0) -> DataFrame:
    """image_id, n_visible_ref, n_visible_tgt and inlier_ratio, the matches over the smaller of the two. summary: image_id, n_inliers, t00..t22; frames: image_id, wa, ha, wb, hb."""
    back = summary.select(*KEY, *(c.alias(n) for c, n in zip(inverse_matrix(), MATRIX)))
    # Lengths shrink by the matrix's own scale, which that of the inverse, ending in 1, need not be the reciprocal of.
    here = summary.select(*KEY, scale_of_matrix().alias("scale"))
    a = visible(ref, summary, frames.select(*KEY, F.col("wb").alias("width"), F.col("hb").alias("height")), min_r)
    b = visible(tgt, back, frames.select(*KEY, F.col("wa").alias("width"), F.col("ha").alias("height")), -1.0).join(here, list(KEY)).withColumn("in_frame", F.col("in_frame") & (F.col("r") / F.col("scale") >= 0.8 * min_r))
    n = lambda df, name: df.groupBy(*KEY).agg(F.count_if("in_frame").alias(name))
    out = summary.select(*KEY, "n_inliers").join(n(a, "n_visible_ref"), list(KEY)).join(n(b, "n_visible_tgt"), list(KEY))
    return out.select(*KEY, "n_visible_ref", "n_visible_tgt", (F.col("n_inliers") / F.greatest(F.lit(1), F.least("n_visible_ref", "n_visible_tgt"))).alias("inlier_ratio"))


def ladder(rungs: DataFrame, p: float = 0.5, least: int = 4) -> DataFrame:
    """rungs: image_id, conf. image_id, rung, conf_min, n: the first of the confidence bounds p, 0.4, 0.3, 0.25 that leaves enough craters."""
    bounds = list(dict.fromkeys([p, 0.4, 0.3, 0.25]))
    spread = rungs.select(*KEY, "conf", F.posexplode(F.array(*map(F.lit, bounds))).alias("rung", "conf_min")).where(F.col("conf") >= F.col("conf_min"))
    enough = spread.groupBy(*KEY, "rung", "conf_min").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return enough.groupBy(*KEY).agg(F.min(F.struct("rung", "conf_min", "n")).alias("b")).select(*KEY, "b.rung", "b.conf_min", "b.n")
