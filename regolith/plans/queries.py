"""The registered queries over relations derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import settled
from ..operators import correlation, detection, fits, geo, keypoints, labels, learning, matching, metrics, patterns, raster, registration, spatial, tiles, triangles
from ..sources import adapters

FRAME = 900.0
#: So many hypotheses of a pair are tried, the engine's default; SQL takes it from here.
HYPOTHESES = 7000
KEY = ["image_id"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def fixed(c: Column | str, scale: float = 1e4) -> Column:
    """A number as a count of 1 / scale, by which engines that sum in another order agree."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * scale + 0.5).cast("bigint")


def _ref(s: SparkSession, d: str) -> DataFrame:
    return adapters.relation(s, d, "craters_ref")


def _tgt(s: SparkSession, d: str) -> DataFrame:
    return adapters.relation(s, d, "craters_tgt")


def _truth(ref: DataFrame) -> DataFrame:
    """The true similarity of every image."""
    return ref.select("image_id").distinct().selectExpr("image_id", "0.9396926207859084D * 0.8D AS re", "0.3420201433256687D * 0.8D AS im", "60D AS tx", "90D AS ty", "0.8D AS s")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    ref, tgt = _ref(s, d), _tgt(s, d)
    return matching.coordinates(matching.collected(_truth(ref), ref, tgt), ref, tgt)


@query
def crater_select_pattern(s: SparkSession, d: str) -> DataFrame:
    return spatial.select_pattern(_ref(s, d), FRAME, FRAME).select("image_id", "crater_id", F.col("rank").cast("bigint").alias("rank"))


@query
def crater_same_pairs(s: SparkSession, d: str) -> DataFrame:
    det = adapters.relation(s, d, "detections")
    pairs = spatial.near_pairs(det, det, KEY, 100.0, condition=spatial.same_crater("a", "b") & (F.col("a.det_id") < F.col("b.det_id")))
    return pairs.select("a.image_id", F.col("a.det_id").alias("i"), F.col("b.det_id").alias("j"))


@query
def crater_unlabelled_anti(s: SparkSession, d: str) -> DataFrame:
    return spatial.matching(adapters.relation(s, d, "detections"), adapters.relation(s, d, "annotations"), k=0.7, keep=False).select("det_id", "image_id")


@query
def crater_labelled_semi(s: SparkSession, d: str) -> DataFrame:
    return spatial.matching(adapters.relation(s, d, "detections"), adapters.relation(s, d, "annotations"), k=0.7).select("det_id", "image_id")


@query
def knn_neighbours(s: SparkSession, d: str) -> DataFrame:
    return spatial.knn(_ref(s, d)).select("image_id", "i", "j", fixed("d").alias("d"), F.col("rank").cast("bigint").alias("rank"))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    ref, tgt = _ref(s, d), _tgt(s, d)
    at = fits.moved(ref.join(_truth(ref).hint("merge"), "image_id"), "cx", "cy").selectExpr("image_id", "crater_id AS i", "px AS cx", "py AS cy", "r", "s")
    near = spatial.nearest(at, tgt.withColumnRenamed("crater_id", "j"), KEY, KEY, 5.0, 0.3, ("i", "r", "s"))
    return spatial.sized(near, F.lit(5.0), 0.3, 0.72, 1.39, F.col("s"))


@query
def nearest_join_sized(s: SparkSession, d: str) -> DataFrame:
    return _nearest(s, d).select("image_id", "i", "j", fixed("d").alias("d"))


@query
def one_to_one_pairs(s: SparkSession, d: str) -> DataFrame:
    return spatial.one_to_one(_nearest(s, d), KEY).select("image_id", "i", "j", fixed("d").alias("d"))


@query
def point_in_circle(s: SparkSession, d: str) -> DataFrame:
    points = _tgt(s, d).selectExpr("image_id", "crater_id AS point_id", "cx AS x", "cy AS y")
    return spatial.smallest_around(points, _ref(s, d))


def _shown(tri: DataFrame) -> DataFrame:
    return tri.select("image_id", "lo", "mid", "hi", "v0", "v1", "v2", *(fixed(x).alias(x) for x in triangles.DIMS))


@query
def triangles_knn(s: SparkSession, d: str) -> DataFrame:
    return _shown(triangles.knn_triangles(_ref(s, d)))


@query
def triangles_all(s: SparkSession, d: str) -> DataFrame:
    return _shown(triangles.all_triangles(_ref(s, d)))


def _frames(craters: DataFrame) -> DataFrame:
    return craters.select("image_id").distinct().select("image_id", F.lit(FRAME).alias("width"), F.lit(FRAME).alias("height"))


def _alike(s: SparkSession, d: str) -> DataFrame:
    return triangles.lookalikes(triangles.knn_triangles(_ref(s, d)), triangles.knn_triangles(_tgt(s, d)))


@query
def lookalike_join(s: SparkSession, d: str) -> DataFrame:
    return _alike(s, d).select("image_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), fixed("diff", 1e6).alias("diff"))


@query
def top_hypotheses(s: SparkSession, d: str) -> DataFrame:
    return triangles.top_hypotheses(_alike(s, d), HYPOTHESES).select("image_id", *(F.col(c).cast("bigint").alias(c) for c in ("hyp", "i", "j")), fixed("diff", 1e6).alias("diff"))


@query
def fit_similarity(s: SparkSession, d: str) -> DataFrame:
    return fits.fit_similarity(_pairs(s, d), KEY).select("image_id", "n", *(fixed(c).alias(c) for c in ("re", "im", "tx", "ty", "s")))


@query
def fit_affine(s: SparkSession, d: str) -> DataFrame:
    names = [f"a{i}{j}" for i in range(2) for j in range(3)]
    return fits.fit_affine(_pairs(s, d), KEY).select("image_id", "n", *(fixed(c, 1e3).alias(c) for c in names))


@query
def hypothesis_votes(s: SparkSession, d: str) -> DataFrame:
    ref, tgt = _ref(s, d), _tgt(s, d)
    return matching.votes(matching.hypotheses(ref, tgt, HYPOTHESES), ref, tgt, stop=None).select("image_id", F.col("hyp").cast("bigint").alias("hyp"), "n_pairs")


@query
def hypothesis_winner(s: SparkSession, d: str) -> DataFrame:
    """Of every hypothesis: none ends its image's votes, as one does in match_pair."""
    ref, tgt = _ref(s, d), _tgt(s, d)
    return matching.winners(matching.votes(matching.hypotheses(ref, tgt, HYPOTHESES), ref, tgt, stop=None)).select("image_id", F.col("hyp").cast("bigint").alias("hyp"), "n_pairs")


@query
def match_pair(s: SparkSession, d: str) -> DataFrame:
    out = matching.match_pairs(_ref(s, d), _tgt(s, d), HYPOTHESES, model="similarity", frames=_frames(_tgt(s, d)))
    return out.select("image_id", "n_inliers", *(fixed(c, 1e3).alias(c) for c in ("scale", "rotation_deg", "tx", "ty", "rmse_tgt", "rmse_ref", "heldout_tgt")), fixed("uniqueness").alias("uniqueness"))


@query
def match_pair_refined(s: SparkSession, d: str) -> DataFrame:
    return matching.match_pairs(_ref(s, d), _tgt(s, d), HYPOTHESES, frames=_frames(_tgt(s, d)))


@query
def match_learner(s: SparkSession, d: str) -> DataFrame:
    return matching.match_learned(_ref(s, d), _tgt(s, d)).select("image_id", "n_inliers", *(fixed(c, 1e3).alias(c) for c in ("scale", "rotation_deg", "tx", "ty", "rmse", "inlier_ratio")))


@query
def residual_stats(s: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(s, d)
    out = matching.residual_stats(matching.residuals(pairs, fits.fit_similarity(pairs, KEY)))
    return out.select("image_id", "n", *(fixed(c).alias(c) for c in ("rmse_tgt", "rmse_ref", "median_tgt", "max_tgt")))


@query
def loo_similarity(s: SparkSession, d: str) -> DataFrame:
    return fits.leave_one_out(_pairs(s, d), KEY).select("image_id", "n", fixed("loo_rmse").alias("loo_rmse"))


@query
def loo_affine(s: SparkSession, d: str) -> DataFrame:
    return fits.leave_one_out(_pairs(s, d), KEY, "affine", 3).select("image_id", "n", fixed("loo_rmse", 1e3).alias("loo_rmse"))


@query
def model_choice(s: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(s, d)
    loo = {"similarity": fits.leave_one_out(pairs, KEY), "affine": fits.leave_one_out(pairs, KEY, "affine", 3)}
    return fits.choose_model(loo, KEY).select("image_id", "n", "model", fixed("loo_rmse", 1e3).alias("loo_rmse"))


@query
def confidence_ladder(s: SparkSession, d: str) -> DataFrame:
    out = matching.ladder(adapters.relation(s, d, "detections"), least=60)
    return out.select("image_id", F.col("rung").cast("bigint").alias("rung"), fixed("conf_min").alias("conf_min"), "n")


@query
def visible_inlier_ratio(s: SparkSession, d: str) -> DataFrame:
    """Of the true transforms: matches over the craters that could be seen from either side."""
    ref, tgt = _ref(s, d), _tgt(s, d)
    n = matching.collected(_truth(ref), ref, tgt).groupBy("image_id").agg(F.count("*").alias("n_inliers"))
    summary = matching.matrices(_truth(ref), "similarity").join(n, "image_id")
    out = matching.visibility(ref, tgt, summary, _sides(ref))
    return out.select("image_id", "n_visible_ref", "n_visible_tgt", fixed("inlier_ratio").alias("inlier_ratio"))


def _sides(ref: DataFrame) -> DataFrame:
    return ref.select("image_id").distinct().select("image_id", *(F.lit(FRAME).alias(c) for c in ("wa", "ha", "wb", "hb")), F.lit(1.0).alias("scale_tgt"))


@query
def register_catalogues(s: SparkSession, d: str) -> DataFrame:
    """The whole registration of catalogues whose craters are so unsure that images match on different rungs, and some on none."""
    conf = lambda df: df.withColumn("conf", F.expr("(crater_id * 7919 % 1000) / 1000D * (0.3D + 0.1D * (image_id % 5))"))
    ref, tgt = conf(_ref(s, d)), conf(_tgt(s, d))
    return registration.from_catalogues(ref, tgt, _sides(ref))[0].drop(*matching.MATRIX)


@query
def coverage_3x3(s: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(_pairs(s, d), FRAME, FRAME).select("image_id", "n_hit", fixed("coverage").alias("coverage"))


@query
def hull_area(s: SparkSession, d: str) -> DataFrame:
    return metrics.hull_areas(_pairs(s, d), FRAME, FRAME).select("image_id", "n", fixed("hull_area", 10.0).alias("hull_area"), fixed("frame_share").alias("frame_share"))


@query
def pair_geometry(s: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(s, d)
    sims = matching.matrices(fits.fit_similarity(pairs, KEY), "similarity")
    frames = sims.select("image_id", *(F.lit(FRAME).alias(c) for c in ("wa", "ha", "wb", "hb")))
    return metrics.geometry(pairs, sims, frames).select("image_id", fixed("overlap_area", 10.0).alias("overlap_area"), *(fixed(c).alias(c) for c in ("overlap_share", "hull_share", "coverage")))


@query
def zoom_uniqueness(s: SparkSession, d: str) -> DataFrame:
    """Of every hypothesis, as hypothesis_winner."""
    ref, tgt = _ref(s, d), _tgt(s, d)
    hyps = settled(matching.hypotheses(ref, tgt, HYPOTHESES))
    votes = settled(matching.votes(hyps, ref, tgt, stop=None).join(hyps.select("image_id", "hyp", "s").hint("merge"), ["image_id", "hyp"]))
    return metrics.uniqueness(votes).select("image_id", "n_best", "n_second", fixed("uniqueness").alias("uniqueness"))


@query
def mad_trim(s: SparkSession, d: str) -> DataFrame:
    out = metrics.trimmed(adapters.relation(s, d, "residual_nodes"))
    return out.select("pair_id", "n", "n_kept", *(fixed(c).alias(c) for c in ("rms", "rms_all", "median", "most", "within_half", "within_one")))


@query
def quality_grade(s: SparkSession, d: str) -> DataFrame:
    t = metrics.trimmed(adapters.relation(s, d, "residual_nodes"))
    px = metrics.basis(F.col("n_kept"), F.col("rms"), F.lit(None).cast("double"), F.col("rms_all"))
    return t.select("pair_id", metrics.grade(px).alias("grade"))


@query
def nms_detections(s: SparkSession, d: str) -> DataFrame:
    return spatial.nms(adapters.relation(s, d, "detections")).select("image_id", "det_id", "conf")


@query
def known_craters(s: SparkSession, d: str) -> DataFrame:
    """Drawn craters and the detections that are none of them, nothing marked as no crater, and none before."""
    labels = adapters.relation(s, d, "annotations").select("image_id", "cx", "cy", "r", "label")
    out = detection.pooled(labels, adapters.relation(s, d, "detections"), 0.25)
    return out.select("image_id", *(fixed(c).alias(c) for c in ("cx", "cy", "r")), "source")


@query
def score_detections(s: SparkSession, d: str) -> DataFrame:
    return spatial.score_detections(adapters.relation(s, d, "detections"), _ref(s, d)).select("image_id", "crater_id", "det_id", fixed("d").alias("d"))


@query
def fit_homography(s: SparkSession, d: str) -> DataFrame:
    return fits.fit_homography(_pairs(s, d), KEY)


@query
def pattern_propose(s: SparkSession, d: str) -> DataFrame:
    return patterns.proposed(_ref(s, d)).select("image_id", "i", F.array_join("members", ",").alias("members"), fixed("quality").alias("quality"), fixed("extent").alias("extent"))


@query
def pattern_candidates(s: SparkSession, d: str) -> DataFrame:
    return patterns.candidates(_ref(s, d)).select("image_id", "i", F.array_join("members", ",").alias("members"), fixed("quality").alias("quality"), fixed("extent").alias("extent"))


@query
def pattern_signature(s: SparkSession, d: str) -> DataFrame:
    """Of the pattern around every crater that has neighbours enough."""
    ref = _ref(s, d)
    out = patterns.signatures(patterns.as_patterns(patterns.candidates(ref), ref))
    return out.select("pattern_id", F.col("m").cast("bigint").alias("m"), *(F.coalesce(fixed(c, 1e3), F.lit(0)).alias(c) for c in ("sx", "sy", "sr")))


@query
def pattern_locate(s: SparkSession, d: str) -> DataFrame:
    ref = _ref(s, d)
    found = patterns.located(patterns.as_patterns(patterns.proposed(ref), ref).drop("image_id"), _tgt(s, d))
    return found.select("pattern_id", "image_id", "found", "n", "n_hit", "n_probed", "score", "scale", "rotation_deg", F.col("members")[0]["cx"].alias("anchor_x"), F.col("members")[0]["cy"].alias("anchor_y"))


@query
def pattern_ambiguity(s: SparkSession, d: str) -> DataFrame:
    ref = _ref(s, d)
    return patterns.ambiguous(patterns.as_patterns(patterns.proposed(ref), ref), ref)


@query
def star_deviation(s: SparkSession, d: str) -> DataFrame:
    return patterns.star_deviation(_pairs(s, d)).select("image_id", "centre", fixed("deviation").alias("deviation"))


@query
def star_select(s: SparkSession, d: str) -> DataFrame:
    return patterns.stars(_ref(s, d)).select("image_id", "centre", "j", F.col("rank").cast("bigint").alias("rank"))


@query
def sobel_gradient(s: SparkSession, d: str) -> DataFrame:
    out = raster.sobel(adapters.pixels(s, d))
    return out.select("image_id", "y", "x", *(fixed(c, 1e6).alias(c) for c in ("gx", "gy", "mag")))


@query
def gradient_p95(s: SparkSession, d: str) -> DataFrame:
    return raster.gradient_bound(adapters.pixels(s, d)).select("image_id", fixed("g95", 1e6).alias("g95"))


@query
def gauss_blur(s: SparkSession, d: str) -> DataFrame:
    return raster.blurred(adapters.pixels(s, d)).select("image_id", "y", "x", fixed("v", 1e6).alias("v"))


@query
def local_contrast(s: SparkSession, d: str) -> DataFrame:
    return raster.local_norm(adapters.pixels(s, d)).select("image_id", "y", "x", fixed("v", 1e6).alias("v"))


@query
def pyramid_level(s: SparkSession, d: str) -> DataFrame:
    return raster.halved(adapters.pixels(s, d)).select("image_id", "y", "x", fixed("v", 1e6).alias("v"))


@query
def shrunk_images(s: SparkSession, d: str) -> DataFrame:
    """Images of at most 45 pixels a side, by area."""
    small = tiles.shrunk_to(tiles.tiled(adapters.pixels(s, d)), 45)
    return tiles.pixels_of(small).select("image_id", "y", "x", fixed("v", 1e6).alias("v"))


def _shown_pixels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tiles of the rasters as greys, and of their part that begins at (2, 1)."""
    grey = adapters.pixels(s, d).withColumn("v", F.least(F.lit(255.0), F.greatest(F.lit(0.0), 128 + 500 * F.col("v"))))
    return settled(tiles.tiled(grey)), settled(tiles.tiled(grey.where("x >= 2 and y >= 1").withColumns({"x": F.col("x") - 2, "y": F.col("y") - 1})))


def _shift(images: DataFrame, dx: float, dy: float) -> DataFrame:
    values = [1.0, 0.0, dx, 0.0, 1.0, dy, 0.0, 0.0, 1.0]
    return images.select("image_id").distinct().select("image_id", F.lit("affine").alias("model"), *(F.lit(v).alias(c) for v, c in zip(values, matching.MATRIX)))


@query
def keypoint_baseline(s: SparkSession, d: str) -> DataFrame:
    """Rasters against their own part: the homography that keypoints find, against the true shift."""
    ref, tgt = _shown_pixels(s, d)
    out = keypoints.baseline(ref, tgt, _shift(ref, -2.0, -1.0), contrast=0.004)
    return out.select("image_id", "matches", "inliers", "inlier_ratio", "median_disagreement", "agrees", "note")


@query
def correlation_refined(s: SparkSession, d: str) -> DataFrame:
    """Rasters against their own part from a shift that is half a pixel off."""
    ref, tgt = _shown_pixels(s, d)
    lattice = ref.select("image_id").distinct().selectExpr("image_id", "explode(sequence(8, 56, 8)) AS x").selectExpr("image_id", "x", "explode(sequence(8, 88, 16)) AS y")
    placed = lattice.selectExpr("image_id", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y", "x - 2D AS u", "y - 1D AS v")
    out = correlation.refined(ref, tgt, _shift(ref, -1.6, -1.3), placed)
    return out.select("image_id", "used", fixed("cc", 1e2).alias("cc"), fixed("before", 1e2).alias("before"), (F.col("after") < 0.2).alias("close"))


@query
def voted_circles(s: SparkSession, d: str) -> DataFrame:
    ready = detection.prepared(_shown_pixels(s, d)[0])
    return detection.classic_candidates(*ready, 6.0, 24.0)[0].select("image_id", "cx", "cy", "r", "votes", "arc", "score")


@query
def erode_min(s: SparkSession, d: str) -> DataFrame:
    return raster.eroded(adapters.pixels(s, d)).select("image_id", "y", "x", fixed("v", 1e6).alias("v"))


@query
def bilinear_sample(s: SparkSession, d: str) -> DataFrame:
    points = _ref(s, d).selectExpr("crater_id % 5 AS image_id", "crater_id AS point_id", "cx * 0.08e0 AS x", "cy * 0.12e0 AS y")
    return raster.sampled(points, adapters.pixels(s, d)).select("image_id", "point_id", fixed("value", 1e6).alias("value"))


@query
def ring_harmonics(s: SparkSession, d: str) -> DataFrame:
    px = adapters.pixels(s, d).selectExpr("image_id * 100 + y AS vec_id", "x AS angle", "v")
    return raster.harmonics(px, ["vec_id"], 64).select("vec_id", *(fixed(c, 1e5).alias(c) for c in ("mean", "std", "h1", "h2", "h3", "h4")))


@query
def ncc_patches(s: SparkSession, d: str) -> DataFrame:
    """Each vector's window of 32 values against the next vector's, shifted by up to 8."""
    px = adapters.pixels(s, d).selectExpr("image_id * 100 + y AS vec_id", "x", "v")
    own = px.where("x >= 16 and x < 48").selectExpr("vec_id", "x AS pos", "v")
    other = px.withColumn("shift", F.explode(F.sequence(F.lit(-8), F.lit(8)))).selectExpr("vec_id - 1 AS vec_id", "CAST(shift AS BIGINT) AS shift", "x - shift AS pos", "v AS w")
    scores = raster.correlated(own, other, ["vec_id"])
    return raster.best_shift(scores, ["vec_id"]).select("vec_id", "shift", fixed("score").alias("score"))


@query
def descriptor_ratio_test(s: SparkSession, d: str) -> DataFrame:
    """Vectors of one raster against its own, two in three of them shaken a little and the rest taken apart: the nearest, if it is nearer than 0.8 of the second."""
    vectors = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("CAST(floor(vec_id / 100e0) AS BIGINT) AS image_id", "vec_id % 100 AS i", "CAST(embedding AS ARRAY<DOUBLE>) AS v")
    other = vectors.selectExpr("image_id", "i", "transform(v, (x, k) -> x + IF(i % 3 = 0, 9e-1, 1e-2) * ((i * 7 + k * 13) % 11 - 5)) AS v")
    return triangles.ratio_matches(vectors, other).select("image_id", "i", "j", fixed("d").alias("d"))


def _grid(s: SparkSession, d: str) -> DataFrame:
    return adapters.relation(s, d, "geo_grid")


@query
def stereo_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Longitudes come back on the turn on which they were given, however many turns that is."""
    x, y = geo.forward(F.col("lon"), F.col("lat"), F.lit(25.0), F.lit(-60.0))
    at = _grid(s, d).select("image_id", "pixel", "scan", F.col("lon").alias("given"), x.alias("x"), y.alias("y"))
    lon, lat = geo.backward(F.col("x"), F.col("y"), F.lit(25.0), F.lit(-60.0))
    lon = lon + 360.0 * F.round((F.col("given") - lon) / 360.0)
    return at.select("image_id", "pixel", "scan", *(fixed(c, 1.0).alias(n) for c, n in ((F.col("x"), "x"), (F.col("y"), "y"), (lon * 1e4 + 0.06, "lon"), (lat * 1e4 + 0.06, "lat"))))


@query
def circular_mean_lon(s: SparkSession, d: str) -> DataFrame:
    """Longitudes from -180 up to 180."""
    lon = F.when(F.col("lon0") > 180, F.col("lon0") - 360).otherwise(F.col("lon0"))
    return geo.centre(_grid(s, d)).select("image_id", fixed(lon, 1e5).alias("lon0"), fixed("lat0", 1e5).alias("lat0"))


@query
def grid_interpolate(s: SparkSession, d: str) -> DataFrame:
    points = _ref(s, d).selectExpr("image_id", "crater_id AS point_id", "cx AS px", "cy AS py")
    return geo.interpolated(points, _grid(s, d)).select("image_id", "point_id", fixed("lon", 1e5).alias("lon"), fixed("lat", 1e5).alias("lat"))


@query
def great_circle_diff(s: SparkSession, d: str) -> DataFrame:
    g = _grid(s, d).withColumn("m", geo.great_circle(F.col("lon"), F.col("lat"), F.col("lon") + 0.01, F.col("lat") + 0.02))
    return g.groupBy("image_id").agg(F.count("*").alias("n"), fixed(F.avg("m"), 10.0).alias("mean"), fixed(F.median("m"), 10.0).alias("median"), fixed(F.max("m"), 10.0).alias("most"))


@query
def official_grid_difference(s: SparkSession, d: str) -> DataFrame:
    """The reference's grid carried to the target by the true transform, against an official grid of another size and spacing."""
    grid = _grid(s, d)
    official = grid.selectExpr("image_id", "pixel DIV 2 AS pixel", "scan DIV 2 AS scan", "lon + 0.01D + pixel * 0.00001D AS lon", "lat - 0.02D AS lat")
    images = grid.select("image_id").distinct()
    frame = lambda w, h, scale: images.select("image_id", F.lit(w).alias("orig_w"), F.lit(h).alias("orig_h"), F.lit(scale).alias("scale"))
    _, apart = geo.compared_with_official(matching.matrices(_truth(images), "similarity"), grid, official, frame(1001, 1001, 0.9), frame(1200, 1100, 0.8), 50)
    return apart.select("image_id", "n", *(fixed(c, 1.0).alias(c) for c in ("mean", "median", "largest")))


@query
def capture_gap_days(s: SparkSession, d: str) -> DataFrame:
    """Each event of a user against the one before, as labels of two captures."""
    e = s.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "event_id", "ts", "value % 90 AS sun_elevation_deg", "CAST(NULL AS DOUBLE) AS sun_azimuth_deg", "CAST(event_id % 60 AS DOUBLE) AS incidence_angle_deg")
    order = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    facts = ["ts", "sun_elevation_deg", "sun_azimuth_deg", "incidence_angle_deg"]
    both = e.selectExpr("event_id AS pair_id", *facts, f"lag(struct({', '.join(facts)})) {order} AS before").where("before IS NOT NULL")
    time = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS start_time"
    b = both.selectExpr("pair_id", time.format("ts"), *facts[1:])
    a = both.selectExpr("pair_id", time.format("before.ts"), *(f"before.{c} AS {c}" for c in facts[1:]))
    out = labels.context(a, b)
    return out.select("pair_id", fixed("days").alias("days"), *(fixed(f"d_{c}").alias(f"d_{c}") for c in facts[1:]))


def _label_files(s: SparkSession, d: str) -> DataFrame:
    """A label in XML for each image."""
    images = _ref(s, d).select("image_id").distinct()
    body = F.format_string(
        '<p:Product xmlns:p="urn:x"><p:Identification_Area><p:logical_identifier>urn:%1$d</p:logical_identifier><p:title>Image %1$d</p:title></p:Identification_Area>'
        "<Time><start_date_time>2020-01-%2$02dT00:00:00Z</start_date_time></Time><g><sun_elevation>%3$s deg</sun_elevation><orbit_number>%1$d</orbit_number></g>"
        "<Axis_Array><axis_name>Line</axis_name><elements>%4$d</elements></Axis_Array></p:Product>",
        "image_id", (F.col("image_id") % 28 + 1).cast("int"), (F.col("image_id") * 0.5).cast("string"), (F.col("image_id") * 10).cast("int"))
    return images.select(F.concat(F.lit("image"), "image_id").alias("file"), body.alias("content"))


@query
def xml_facts(s: SparkSession, d: str) -> DataFrame:
    return labels.facts(labels.leaves(_label_files(s, d))).select("file", "product_id", "title", "start_time", "sun_elevation_deg", "orbit")


@query
def axis_pairs(s: SparkSession, d: str) -> DataFrame:
    return labels.axis_pairs(labels.leaves(_label_files(s, d))).select("file", "axis", "elements")


def _examples(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.selectExpr("vec_id", "embedding AS features", "CAST(label < 5 AS INT) AS label", "CASE WHEN vec_id % 3 = 0 THEN 0.3D ELSE 1D END AS weight")


@query
def train_eval_rf(s: SparkSession, d: str) -> DataFrame:
    examples = _examples(s, d)
    return learning.scored(learning.train(examples), examples).select("vec_id", "label", "p")


@query
def cv_report(s: SparkSession, d: str) -> DataFrame:
    return learning.report(learning.train, _examples(s, d), id_col="vec_id")


@query
def training_assembly(s: SparkSession, d: str) -> DataFrame:
    ann = adapters.relation(s, d, "annotations").selectExpr("ann_id AS crater_id", "image_id", "cx", "cy", "r", "label", "toxic = 0 AS complete")
    return learning.training_set(ann, adapters.relation(s, d, "detections")).groupBy("image_id", "origin").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))
