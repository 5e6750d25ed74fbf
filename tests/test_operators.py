import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regolith.checkpoints import settled
from regolith.operators import detection, fits, geo, labels, matching, metrics, patterns, raster, spatial, triangles
from regolith.sources import outputs, tables

CRATERS = "crater_id bigint, image_id bigint, cx double, cy double, r double"


def random_craters(n, seed=0, image=0):
    g = np.random.default_rng(seed)
    return [(i, image, float(x), float(y), float(r)) for i, (x, y, r) in enumerate(zip(g.uniform(50, 850, n), g.uniform(50, 850, n), g.uniform(12, 60, n)))]


def test_nearest_is_chosen_before_its_size_is_tested(spark):
    pts = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 1.0)], "image_id bigint, i bigint, cx double, cy double, r double, s double")
    tgt = spark.createDataFrame([(0, 7, 1.0, 0.0, 50.0), (0, 8, 2.0, 0.0, 10.0)], "image_id bigint, j bigint, cx double, cy double, r double")
    near = spatial.nearest(pts, tgt, ["image_id"], ["image_id"], 5.0, 0.3, ("i", "r", "s"))
    assert [r.j for r in near.collect()] == [7]
    assert spatial.sized(near, F.lit(5.0), 0.3, 0.72, 1.39, F.col("s")).count() == 0


def test_one_to_one_keeps_the_closest_and_then_the_smaller_id(spark):
    pairs = spark.createDataFrame([(0, 2, 5, 1.0), (0, 1, 5, 1.0), (0, 3, 5, 2.0)], "image_id bigint, i bigint, j bigint, d double")
    assert [r.i for r in spatial.one_to_one(pairs, ["image_id"]).collect()] == [1]


def test_same_crater_bounds_are_strict(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 6.0, 0.0, 0.0, 10.0), (0.0, 0.0, 10.0, 5.0, 0.0, 10.0), (0.0, 0.0, 10.0, 4.9, 0.0, 10.0)], "ax double, ay double, ar double, bx double, by double, br double")
    df = rows.selectExpr("struct(ax AS cx, ay AS cy, ar AS r) AS a", "struct(bx AS cx, by AS cy, br AS r) AS b").select(spatial.same_crater("a", "b").alias("x"))
    assert [r.x for r in df.collect()] == [False, False, True]


def test_knn_and_triangles_survive_few_and_no_craters(spark):
    for n in (0, 1, 2):
        df = spark.createDataFrame(random_craters(n), CRATERS)
        assert triangles.knn_triangles(df).count() == 0
        assert matching.match_pairs(df, df).count() == 0


def test_descriptors_do_not_depend_on_scale_turn_and_shift(spark):
    rows = random_craters(12)
    c, s = 0.7 * math.cos(1.0), 0.7 * math.sin(1.0)
    moved = [(i, m, c * x - s * y + 5, s * x + c * y - 9, 0.7 * r) for i, m, x, y, r in rows]
    a, b = (triangles.knn_triangles(spark.createDataFrame(x, CRATERS), 5).orderBy("lo", "mid", "hi").toPandas() for x in (rows, moved))
    assert (a[["lo", "mid", "hi"]].to_numpy() == b[["lo", "mid", "hi"]].to_numpy()).all()
    assert np.allclose(a[list(triangles.DIMS)], b[list(triangles.DIMS)])


def test_a_hard_pair_is_recovered(spark):
    rows = random_craters(60, 3)
    g = np.random.default_rng(4)
    c, s = 0.8 * math.cos(math.radians(20)), 0.8 * math.sin(math.radians(20))
    tgt = [(i, 0, c * x - s * y + 60 + g.normal(0, 0.4), s * x + c * y + 90 + g.normal(0, 0.4), 0.8 * r) for i, _, x, y, r in rows if i % 3]
    out = matching.match_pairs(spark.createDataFrame(rows, CRATERS), spark.createDataFrame(tgt, CRATERS), 40, rounds=2).collect()[0]
    assert out.n_inliers >= 35 and abs(out.scale - 0.8) < 0.01 and abs(out.rotation_deg - 20) < 0.5 and out.rmse_tgt < 1.5


def test_fits_equal_numpy(spark):
    g = np.random.default_rng(1)
    xy = g.normal(0, 100, (9, 2))
    uv = xy @ np.array([[0.9, 0.2], [-0.3, 1.1]]).T + [5, 7] + g.normal(0, 0.1, (9, 2))
    df = spark.createDataFrame([(0, *map(float, (*p, *q))) for p, q in zip(xy, uv)], "k int, x double, y double, u double, v double")
    a = fits.fit_affine(df, ["k"]).collect()[0]
    want = np.linalg.lstsq(np.column_stack([xy, np.ones(9)]), uv, rcond=None)[0]
    assert np.allclose([a.a00, a.a01, a.a02], want[:, 0]) and np.allclose([a.a10, a.a11, a.a12], want[:, 1])
    z, w = xy @ [1, 1j], uv @ [1, 1j]
    q = (np.conj(z - z.mean()) * (w - w.mean())).sum() / (abs(z - z.mean()) ** 2).sum()
    s = fits.fit_similarity(df, ["k"]).collect()[0]
    assert np.allclose([s.re, s.im], [q.real, q.imag])
    errors = []
    for i in range(9):
        keep = np.arange(9) != i
        m = np.linalg.lstsq(np.column_stack([xy[keep], np.ones(8)]), uv[keep], rcond=None)[0]
        errors.append((([*xy[i], 1] @ m - uv[i]) ** 2).sum())
    assert np.isclose(fits.leave_one_out(df, ["k"], "affine", 3).collect()[0].loo_rmse, math.sqrt(np.mean(errors)))
    h = np.array([[1, 0.1, 3], [0.05, 0.9, 2], [1e-4, 2e-4, 1]])
    p = np.column_stack([xy, np.ones(9)]) @ h.T
    assert np.allclose(fits.homography(xy, p[:, :2] / p[:, 2:]), h)


def test_coincident_points_have_no_fit(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 2.0, 2.0)] * 3, "k int, x double, y double, u double, v double")
    assert fits.fit_similarity(df, ["k"]).collect()[0].re is None
    assert fits.leave_one_out(df.limit(1), ["k"]).collect()[0].loo_rmse is None


def test_suppression_is_independent_and_maximal(spark):
    g = np.random.default_rng(5)
    rows = [(i, 0, float(g.uniform(0, 200)), float(g.uniform(0, 200)), float(g.uniform(10, 30)), float(g.integers(0, 20))) for i in range(120)]
    df = spark.createDataFrame(rows, "det_id bigint, image_id bigint, cx double, cy double, r double, conf double")
    kept = {r.det_id for r in spatial.nms(df).collect()}

    def same(a, b):
        return math.hypot(a[2] - b[2], a[3] - b[3]) < 0.5 * max(a[4], b[4]) and 0.6 < a[4] / b[4] < 1.67

    left = [r for r in rows if r[0] in kept]
    assert not any(same(a, b) for a in left for b in left if a[5] > b[5])
    assert all(any(same(a, r) for a in left) for r in rows if r[0] not in kept)


def test_rasters(spark):
    v = np.random.default_rng(2).normal(0, 5, (9, 11))
    px = spark.createDataFrame([(0, y, x, float(v[y, x])) for y in range(9) for x in range(11)], "image_id bigint, y bigint, x bigint, v double")
    p = np.pad(v, 1, mode="reflect")
    want = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]) / 8
    got = raster.sobel(px).orderBy("y", "x").toPandas()
    assert np.allclose(got["gx"].to_numpy().reshape(9, 11), want)
    assert np.isclose(raster.gradient_bound(px).collect()[0].g95, np.percentile(got["mag"], 95) + 1e-6)
    at = spark.createDataFrame([(0, 0, 1.25, 2.5), (0, 1, 10.5, 2.0)], "image_id bigint, point_id bigint, x double, y double")
    value = {r.point_id: r.value for r in raster.sampled(at, px).collect()}
    assert np.isclose(value[0], 0.75 * (v[2, 1] + v[3, 1]) / 2 + 0.25 * (v[2, 2] + v[3, 2]) / 2) and value[1] is None


def test_grades_and_hulls(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (9.0,), (None,), (float("nan"),)], "e double")
    assert [r.g[:4] for r in df.select(metrics.grade(F.col("e")).alias("g")).collect()] == ["EXCE", "near", "COAR", "unkn", "unkn"]
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1]], float)
    assert metrics.area(metrics.hull(square)) == 4 and metrics.area(metrics.clipped(metrics.hull(square), 1, 5)) == 2


def test_geography_goes_there_and_back(spark):
    df = spark.createDataFrame([(20.0, -60.0), (25.5, -61.2)], "lon double, lat double")
    x, y = geo.forward(F.col("lon"), F.col("lat"), F.lit(22.0), F.lit(-60.5))
    lon, lat = geo.backward(F.col("x"), F.col("y"), F.lit(22.0), F.lit(-60.5))
    for r in df.withColumns({"x": x, "y": y}).withColumns({"a": lon, "b": lat}).collect():
        assert abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9


def test_labels_take_the_first_leaf_and_keep_errors(spark):
    text = "<a xmlns='urn:q'><x_start_time>2020-01-01T00:00:00Z</x_start_time><start_date_time>2021</start_date_time><sun_elevation>12.5 deg</sun_elevation></a>"
    rows = labels.leaves(spark.createDataFrame([("f", text), ("bad", "<a>"), ("none", None)], "file string, content string"))
    assert rows.where("error IS NOT NULL").select("file").distinct().count() == 2
    f = labels.facts(rows.where("key IS NOT NULL")).collect()[0]
    assert f.start_time.startswith("2020") and f.sun_elevation_deg == 12.5 and f.orbit is None


def test_patterns_are_found_again(spark):
    ref = spark.createDataFrame(random_craters(30, 8), CRATERS)
    pats = patterns.as_patterns(patterns.proposed(ref, 2), ref).drop("image_id")
    turned = ref.selectExpr("crater_id", "image_id", "0.5 * cy + 40 AS cx", "-0.5 * cx + 700 AS cy", "0.5 * r AS r")
    out = patterns.located(pats, turned, rounds=1).collect()
    assert out and all(r.found and abs(r.scale - 0.5) < 1e-3 for r in out)
    a, b = (patterns.signatures(p).orderBy("pattern_id", "m").toPandas() for p in (pats, pats.selectExpr("pattern_id", "m", "3 * y AS x", "-3 * x AS y", "3 * r AS r")))
    assert np.allclose(a.fillna(0), b.fillna(0))


def test_crater_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CX,cy,radius\n1,2,5\n3,4,\n")
    rows = tables.craters(spark, str(tmp_path / "a.csv")).orderBy("cx").collect()
    assert [(r.cx, r.r, r.confidence) for r in rows] == [(1.0, 5.0, 1.0), (3.0, 10.0, 1.0)]
    (tmp_path / "g.csv").write_text(" longitude ,LATITUDE,pixel\n1,2,3\n")
    with pytest.raises(ValueError, match="Scan"):
        tables.geo_grid(spark, str(tmp_path / "g.csv"))


def test_registered_queries_try_all_hypotheses_up_to_the_default(spark):
    from regolith.plans.queries import QUERIES

    at = "/root/testdata/sf0.001"
    alike, tried = ({r.image_id: r["count"] for r in QUERIES[q](spark, at).groupBy("image_id").count().collect()} for q in ("lookalike_join", "top_hypotheses"))
    assert tried == {i: min(n, 7000) for i, n in alike.items()} and max(tried.values()) > 50


def test_sizes_are_compared_target_over_reference(spark):
    """1.385 passes and its inverse, 0.722, too, but 1 / 1.385 of the size the other way round lies on the other side of the bounds."""
    pts = spark.createDataFrame([(0, i, 100.0 * i, 0.0, 10.0, 1.0) for i in range(2)], "image_id bigint, i bigint, cx double, cy double, r double, s double")
    tgt = spark.createDataFrame([(0, 0, 0.0, 0.0, 7.195), (0, 1, 100.0, 0.0, 13.89)], "image_id bigint, j bigint, cx double, cy double, r double")
    near = spatial.nearest(pts, tgt, ["image_id"], ["image_id"], 5.0, 0.3, ("i", "r", "s"))
    assert spatial.sized(near, F.lit(5.0), 0.3, 0.72, 1.39, F.col("s")).select("j").collect() == [(1,)]
    far = spark.createDataFrame([(0, 5, 250.0, 0.0, 900.0)], "image_id bigint, j bigint, cx double, cy double, r double")
    wide = spark.createDataFrame([(0, 5, 0.0, 0.0, 900.0, 1.0)], "image_id bigint, i bigint, cx double, cy double, r double, s double")
    assert spatial.nearest(wide, far, ["image_id"], ["image_id"], 5.0, 0.3, ("i", "r", "s")).first().d == 250.0


def test_a_homography_is_chosen_where_it_is_better(spark):
    g = np.random.default_rng(9)
    h = np.array([[1.1, 0.1, 20], [-0.05, 0.95, 30], [4e-4, -3e-4, 1]])
    rows = []
    for k, m in enumerate((h, np.array([[1.2, 0.3, 5], [-0.1, 0.8, 9], [0, 0, 1]]), np.array([[0.8, -0.3, 5], [0.3, 0.8, 9], [0, 0, 1]]))):
        xy = g.uniform(0, 800, (20, 2))
        q = np.column_stack([xy, np.ones(20)]) @ m.T
        rows += [(k, *map(float, (*a, *b))) for a, b in zip(xy, q[:, :2] / q[:, 2:] + g.normal(0, 0.2, (20, 2)))]
    df = spark.createDataFrame(rows, "image_id bigint, x double, y double, u double, v double")
    got = {r.image_id: r for r in matching.models(df).collect()}
    assert [got[k].model for k in range(3)] == ["homography", "affine", "similarity"] and got[0].loo_rmse < 1 and abs(got[0].t20 - 4e-4) < 1e-4
    assert {r.model for r in matching.models(df, "affine").collect()} == {"affine"}
    own = df.where("image_id = 0").toPandas()[["x", "y", "u", "v"]].to_numpy()
    errors = []
    for i in range(20):
        keep = np.arange(20) != i
        m = fits.homography(own[keep, :2], own[keep, 2:])
        q = m @ [*own[i, :2], 1]
        errors.append(((q[:2] / q[2] - own[i, 2:]) ** 2).sum())
    assert np.isclose(fits.leave_one_out(df.where("image_id = 0"), ["image_id"], "homography", 4).first().loo_rmse, math.sqrt(np.mean(errors)))


def brute_match(ref, tgt, most, rounds):
    """Votes over every hypothesis, and refits, one at a time, by the definition; for craters (id, x, y, r)."""
    import itertools

    def triangles_of(c):
        out = {}
        for i in range(len(c)):
            near = sorted((math.dist(c[i][1:3], c[j][1:3]), j) for j in range(len(c)) if j != i)[:8]
            for (_, a), (_, b) in itertools.combinations(near, 2):
                t = tuple(sorted((i, a, b)))
                side = sorted((math.dist(c[p][1:3], c[q][1:3]), o) for o, p, q in ((t[0], t[1], t[2]), (t[1], t[0], t[2]), (t[2], t[0], t[1])))
                u, v = np.subtract(c[t[1]][1:3], c[t[0]][1:3]), np.subtract(c[t[2]][1:3], c[t[0]][1:3])
                long = side[2][0]
                if side[0][0] / long > 0.22 and abs(u[0] * v[1] - u[1] * v[0]) / 2 / long**2 > 0.05:
                    out[t] = ([side[0][0] / long, side[1][0] / long, *(c[o][3] / long for _, o in side)], [o for _, o in side])
        return [out[t] for t in sorted(out)]

    def fit(pairs):
        z, w = (np.array([complex(*c[k][1:3]) for c, k in side]) for side in ([(ref, i) for i, _ in pairs], [(tgt, j) for _, j in pairs]))
        q = (np.conj(z - z.mean()) * (w - w.mean())).sum() / (abs(z - z.mean()) ** 2).sum()
        return q, w.mean() - q * z.mean()

    def collect(q, t, thr, low, high):
        best = {}
        for i, (_, x, y, r) in enumerate(ref):
            p = q * complex(x, y) + t
            d, j = min((abs(p - complex(*c[1:3])), j) for j, c in enumerate(tgt))
            if d < max(thr, 0.3 * tgt[j][3]) and low < tgt[j][3] / (r * abs(q)) < high and (j not in best or d < best[j][0]):
                best[j] = (d, i)
        return sorted((i, j) for j, (_, i) in best.items())

    a, b = triangles_of(ref), triangles_of(tgt)
    close = sorted((d, i, j) for i, (p, _) in enumerate(a) for j, (q, _) in enumerate(b) if (d := max(abs(x - y) for x, y in zip(p, q))) <= 0.06)
    thr = max(5.0, 0.1 * float(np.median([c[3] for c in tgt])))
    tried = [collect(*fit(list(zip(a[i][1], b[j][1]))), thr, 0.72, 1.39) for _, i, j in close[:most]]
    pairs = max(tried, key=len)
    for _ in range(rounds):
        new = collect(*fit(pairs), max(0.6 * thr, 3.0), 0.78, 1.28)
        if len(new) < 3 or len(new) < len(pairs) - 1:
            break
        pairs = new
    return len(close), [(ref[i][0], tgt[j][0]) for i, j in pairs]


def test_matching_equals_brute_force(spark):
    rows = random_craters(26, 13)
    g = np.random.default_rng(14)
    turn = 1.3 * np.exp(0.4j)
    tgt = [(100 + i, 0, float(z.real), float(z.imag), float(r * 1.3 * g.uniform(0.9, 1.1))) for i, _, x, y, r in rows[4:] for z in [turn * complex(x, y) + complex(30, -20) + complex(*g.normal(0, 1.5, 2))]]
    tgt += [(900 + k, 0, *map(float, c)) for k, c in enumerate(zip(g.uniform(-300, 900, 8), g.uniform(0, 1400, 8), g.uniform(12, 60, 8)))]
    n, want = brute_match([r[:1] + r[2:] for r in rows], [r[:1] + r[2:] for r in tgt], 7000, 4)
    a, b = (spark.createDataFrame(x, CRATERS) for x in (rows, tgt))
    got = sorted((r.i, r.j) for r in matching.match_table(a, b).collect())
    assert got == want and len(want) >= 18 and n > 100
    seeds = spark.createDataFrame([(0, float(turn.real), float(turn.imag), 30.0, -20.0)], "image_id bigint, re double, im double, tx double, ty double")
    assert matching.match_table(a, b, seeds=seeds).first().seeded
    learned = matching.match_learned(a, b).first()
    assert learned.n_inliers >= 16 and abs(learned.scale - 1.3) < 0.02 and abs(learned.rotation_deg - math.degrees(0.4)) < 1


def test_patterns_with_a_probe_seeds_and_ambiguity(spark):
    rows = random_craters(30, 21)
    ref = spark.createDataFrame(rows, CRATERS)
    pats = patterns.as_patterns(patterns.proposed(ref, 2), ref)
    turned = ref.selectExpr("crater_id", "image_id", "0.7 * cx + 40 AS cx", "0.7 * cy + 70 AS cy", "0.7 * r AS r")
    gone = {r.crater_id for r in pats.join(ref.withColumnsRenamed({"cx": "x", "cy": "y"}), ["image_id", "x", "y", "r"]).where("m = 2").collect()}
    some = turned.where(~F.col("crater_id").isin(*gone))
    plain = {r.pattern_id: r for r in patterns.located(pats.drop("image_id"), some).collect()}
    probe = lambda c: c.select("image_id", "det_id", F.lit(0.9).alias("p"))
    asked = {r.pattern_id: r for r in patterns.located(pats.drop("image_id"), some, probe=probe).collect()}
    for k, r in plain.items():
        assert r.found and r.n_probed == 0 and asked[k].n_probed == r.n - r.n_hit > 0 and asked[k].score == 1 and abs(r.scale - 0.7) < 1e-6
    seeds = patterns.library_seeds(pats.drop("image_id"), ref, turned).collect()
    assert len(seeds) == 2 and all(abs(s.re - 0.7) < 1e-6 and abs(s.im) < 1e-6 and abs(s.tx - 40) < 1e-3 for s in seeds)
    assert {(s.source, s.score) for s in seeds} == {(f"pattern {k} (found in both)", 1.0) for k in plain}
    # Drawn on the reference, at half its scale, or on the target: looked up by the picture, and searched on the other side alone.
    library = pats.drop("image_id").withColumns({"image": F.lit("a.png"), "scale": F.lit(0.5), "name": F.lit("P"), "x": F.col("x") / 2, "y": F.col("y") / 2, "r": F.col("r") / 2})
    sides = spark.createDataFrame([(0, "a.png", "b.png", 1.0, 1.0)], "image_id bigint, ref_image string, tgt_image string, scale_ref double, scale_tgt double")
    for names, how in ((("a.png", "b.png"), "reference -> target"), (("b.png", "a.png"), "target -> reference")):
        here, there = (ref, turned) if names[0] == "a.png" else (turned, ref)
        found = patterns.library_seeds(library, here, there, sides=sides.withColumns({"ref_image": F.lit(names[0]), "tgt_image": F.lit(names[1])})).collect()
        factor = 0.7 if how.startswith("ref") else 1 / 0.7
        assert {s.source for s in found} == {f"pattern P ({how})"} and len(found) == 2 and all(abs(s.re - factor) < 1e-6 and s.score == 1 for s in found)
    twice = ref.union(ref.selectExpr("crater_id + 1000", "image_id", "cx + 2000", "cy", "r"))
    assert {r.ambiguous for r in patterns.ambiguous(pats, twice).collect()} == {True}
    assert {r.ambiguous for r in patterns.ambiguous(pats, ref).collect()} == {False}
    pairs = ref.selectExpr("image_id", "crater_id AS i", "cx AS x", "cy AS y", "r AS ra", "-0.5 * cy AS u", "0.5 * cx AS v")
    assert patterns.star_deviation(pairs).first().deviation < 1e-9


def test_detections_are_scored_in_the_order_of_truth(spark):
    truth = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0), (2, 0, 3.0, 0.0, 10.0), (3, 0, 50.0, 0.0, 10.0)], CRATERS)
    det = spark.createDataFrame([(7, 0, 1.0, 0.0, 10.0), (8, 0, 5.0, 0.0, 10.0), (9, 0, 50.0, 0.0, 20.0)], "det_id bigint, image_id bigint, cx double, cy double, r double")
    assert {(r.crater_id, r.det_id) for r in spatial.score_detections(det, truth).collect()} == {(1, 7), (2, 8)}
    report = spatial.detection_report(det, truth).first()
    assert (report.n_found, report.n_truth, report.n_extra) == (2, 3, 1)
    points = spark.createDataFrame([(0, 1, 11.0, 0.0), (0, 2, 80.0, 0.0)], "image_id bigint, point_id bigint, x double, y double")
    assert [(r.point_id, r.crater_id) for r in spatial.label_at(points, truth).collect()] == [(1, 2)]


def test_grids_may_have_an_irregular_last_line_and_are_carried_to_the_target(spark):
    lines = [0, 100, 200, 237]
    grid = spark.createDataFrame([(0, p, s, 359.9 + p / 1000, -10 + s / 1000) for p in lines for s in lines], "image_id bigint, pixel int, scan int, lon double, lat double")
    at = spark.createDataFrame([(0, 1, 220.0, 10.0), (0, 2, 237.0, 237.0), (0, 3, 238.0, 5.0), (0, 4, -1.0, 5.0), (0, 5, 150.0, 210.0)], "image_id bigint, point_id bigint, px double, py double")
    got = {r.point_id: r for r in geo.interpolated(at, grid).collect()}
    assert abs(got[1].lon - 0.12) < 1e-4 and abs(got[2].lat + 9.763) < 1e-6 and got[3].lon is None and got[4].lon is None and abs(got[5].lon - 0.05) < 1e-4
    frames = spark.createDataFrame([(0, 238, 238, 0.5, 119, 119)], "image_id bigint, orig_w int, orig_h int, scale double, w int, h int")
    metres = geo.ground_distance(grid, frames).first().metres
    assert abs(metres - 2 * geo.RADIUS * math.radians(0.001) * math.cos(math.radians(-9.88))) < 0.1
    lattice = geo.lattice(spark.createDataFrame([(0, 101, 50)], "image_id bigint, w int, h int"))
    assert sorted((r.px, r.py) for r in lattice.collect()) == [(0, 0), (0, 49), (100, 0), (100, 49)]
    m = spark.createDataFrame([(0, 1.0, 0.0, 10.0, 0.0, 1.0, 20.0, 0.0, 0.0, 1.0)], "image_id bigint, " + ", ".join(f"t{i}{j} double" for i in range(3) for j in range(3)))
    out = {(r.pixel, r.scan): r for r in geo.target_grid(lattice, m, grid, frames.drop("w", "h"), frames.select("image_id", "scale")).collect()}
    # The target's pixel (100, 49) is (49.75 + 0.5) * 2 - 0.5 = 79.5 less 20 in the reference's pixels, and so on.
    assert abs(out[100, 49].lon - (359.9 + (100 - 20) / 1000 - 360 + 360) % 360) < 1e-3 and abs(out[100, 49].lat - (-10 + (49 - 40) / 1000)) < 1e-4


def test_keys_of_labels_are_told_apart_by_case_where_they_are(spark):
    text = "<a><Observing_System_Component><name>The Orbiter</name></Observing_System_Component><Axis><axis_name>Line</axis_name><elements>12 px</elements></Axis><B><Axis_Name>Sample</Axis_Name><elements>9</elements></B></a>"
    rows = labels.leaves(spark.createDataFrame([("f", text)], "file string, content string"))
    assert labels.instruments(rows).first().instrument == "The Orbiter"
    assert labels.image_size(rows).first() == ("f", 12, None)


def test_what_is_written_can_be_read(spark, tmp_path):
    at = str(tmp_path)
    assert tables.annotations(spark, f"{at}/none.csv").count() == 0 and outputs.read_project(spark, f"{at}/none").count() == 0 and outputs.read_model(spark, at) is None
    outputs.write_annotations(spark.createDataFrame([("i.png", 1.23456, 2.0, 3.0, 1, "manual", 0.5)], "image string, cx double, cy double, r double, label int, source string, scale double"), f"{at}/ann")
    assert tables.annotations(spark, f"{at}/ann").first().cx == 1.235
    outputs.write_project(spark.createDataFrame([("a", True), ("b", False)], "image string, complete boolean"), f"{at}/project")
    assert {(r.image, r.complete) for r in outputs.read_project(spark, f"{at}/project").collect()} == {("a", True), ("b", False)}
    det = spark.createDataFrame([(0, 0, 10.0, 20.0, 6.0, 5.0, 30.0, 5.477, 0.9, "ml", 1.5)], "image_id bigint, id bigint, cx double, cy double, a double, b double, angle_deg double, r double, conf double, source string, rim_strength double")
    outputs.write_craters(det, spark.createDataFrame([(0, 100, 90, 0.5)], "image_id bigint, w int, h int, scale double"), f"{at}/craters")
    back = tables.craters(spark, f"{at}/craters/csv/image_id=0", 0.25).first()
    assert abs(back.cx - (10.5 * 0.5 - 0.5)) < 1e-3 and abs(back.a - 3.0) < 1e-3 and back.confidence == 0.9
    assert spark.read.json(f"{at}/craters/json").first().circles == [[10.0, 20.0, 5.48]]
    members = spark.createDataFrame([("p", m, *c) for m, c in enumerate([(0.0, 0.0, 5.0), (10.0, 0.0, 2.0), (0.0, 20.0, 3.0), (-15.0, 0.0, 4.0)])], "pattern_id string, m int, x double, y double, r double")
    facts = spark.createDataFrame([("p", "P1", "i.png", 0.5, 0.8, False, "new")], "pattern_id string, name string, image string, scale double, quality double, ambiguous boolean, status string")
    outputs.write_patterns(members, facts, f"{at}/patterns")
    line = spark.read.json(f"{at}/patterns").first()
    assert "status" not in line.asDict() and line.signature.members_xy[0] == [0.0, -1.0] and line.signature.anchor_r == 0.5
    assert tables.patterns(spark, f"{at}/patterns").count() == 4
    ref = spark.createDataFrame(random_craters(14, 2), CRATERS)
    tgt = ref.selectExpr("crater_id", "image_id", "2 * cx + 3 AS cx", "2 * cy + 4 AS cy", "2 * r AS r")
    summary = matching.match_pairs(ref, tgt).withColumns({"inlier_ratio": F.lit(1.0), "coverage": F.lit(0.5)})
    matches = matching.coordinates(matching.match_table(ref, tgt), ref, tgt).withColumn("e_ref", F.lit(0.0))
    outputs.write_registration(matches, summary, spark.createDataFrame([(0, 0.5, 0.25)], "image_id bigint, scale_ref double, scale_tgt double"), f"{at}/reg", spark.createDataFrame([(0, 0, 0, 1.0, 2.0), (0, 0, 1, None, 2.0)], "image_id bigint, pixel int, scan int, lon double, lat double"))
    t = spark.read.json(f"{at}/reg/transform").first()
    assert np.allclose(np.array(t.T_reference_to_target) @ np.array(t.T_target_to_reference), np.eye(3), atol=1e-9) and abs(t.zoom_tgt_over_ref - 2) < 1e-9
    assert len(spark.read.csv(f"{at}/reg/matches", header=True).columns) == 12 and spark.read.csv(f"{at}/reg/grid", header=True).count() == 1
    outputs.write_batch(spark.createDataFrame([(0, "t0.png"), (1, "t1.png")], "image_id bigint, target string"), summary, f"{at}/batch")
    assert [r.ok for r in spark.read.csv(f"{at}/batch", header=True, inferSchema=True).orderBy("target").collect()] == [True, False]
    # One found, one weak, one without any place.
    member = "array<struct<m:bigint,cx:double,cy:double>>"
    hits = spark.createDataFrame([("p", 0, True, 5, 1, 0.98765, 1.234567, 33.33333, [(0, 7.777, 8.888)]), ("p", 1, False, 3, 0, 0.5, 0.9, -10.0, [(0, 1.0, 2.0)])], f"pattern_id string, image_id bigint, found boolean, n_hit bigint, n_probed bigint, score double, scale double, rotation_deg double, members {member}")
    outputs.write_search(members.join(facts, "pattern_id"), hits, spark.createDataFrame([("p", 0), ("p", 1), ("p", 2)], "pattern_id string, image_id bigint"), f"{at}/search")
    lines = {r.image_id: r for r in spark.read.csv(f"{at}/search", header=True, inferSchema=True).collect()}
    assert [lines[0][c] for c in ("pattern", "found", "n_pattern_craters", "score", "zoom", "rotation_deg", "anchor_x")] == ["P1", True, members.count(), 0.988, 1.2346, 33.33, 7.78]
    assert lines[1].found is False and lines[1].n_detected == 3 and lines[1].zoom == 0.9 and lines[2].found is False and lines[2].zoom is None and lines[2].n_pattern_craters == members.count()
    outputs.write_report(summary, f"{at}/report")
    page = spark.read.text(f"{at}/report", wholetext=True).first().value
    assert "<th>n_inliers</th><td>14</td>" in page and "<h2>Match</h2>" in page and "<h2>Overlap</h2>" in page and "<table class='matrix'>" in page and page.index("<h2>Match") < page.index("<h2>Transform")
    outputs.write_report(summary.withColumns({"ok": F.lit(False), "quality": F.lit("a<b")}), f"{at}/failed", ("overlay",))
    page = spark.read.text(f"{at}/failed", wholetext=True).first().value
    assert "No consistent crater pattern" in page and "a&lt;b" in page and "picture=overlay" in page
    files = spark.createDataFrame([(f"/d/{n}",) for n in ("x_b_brw_1.png", "x_b_brw_1.xml", "x_g_grd_1.csv", "out/x_b_brw_1/craters.csv", "y.tif")], "path string")
    found = {r.path: r for r in outputs.siblings(files).collect()}
    assert found["/d/x_b_brw_1.png"][1:] == ("/d/x_b_brw_1.xml", "/d/x_g_grd_1.csv", "/d/out/x_b_brw_1/craters.csv") and found["/d/y.tif"][1:] == (None, None, None)


def test_overlaps_and_qualities(spark):
    """The target shows the right half of the reference at twice the scale."""
    points = spark.createDataFrame([(0, 60.0, 10.0), (0, 90.0, 10.0), (0, 90.0, 90.0), (0, 60.0, 90.0)], "image_id bigint, x double, y double")
    m = spark.createDataFrame([(0, 2.0, 0.0, -100.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0)], "image_id bigint, " + ", ".join(f"t{i}{j} double" for i in range(3) for j in range(3)))
    frames = spark.createDataFrame([(0, 100.0, 100.0, 100.0, 200.0)], "image_id bigint, wa double, ha double, wb double, hb double")
    r = metrics.geometry(points, m, frames).first()
    assert (r.overlap_area, r.overlap_share) == (5000.0, 0.5) and abs(r.hull_share - 0.48) < 1e-12 and abs(r.coverage - 4 / 9) < 1e-12
    summary = spark.createDataFrame([(0, 1.0, 0.4, 2.0), (1, 3.0, None, 1.0)], "image_id bigint, rmse_tgt double, heldout_tgt double, scale double")
    nodes = spark.createDataFrame([(0, 0.1, 0.0, False)] * 9 + [(0, 9.0, 0.0, True)], "image_id bigint, dx double, dy double, rejected boolean")
    got = {r.image_id: r for r in metrics.quality(summary, nodes, spark.createDataFrame([(0, 0.5), (1, 0.5)], "image_id bigint, scale_tgt double")).collect()}
    assert got[0].accuracy_src == 0.4 and got[0].quality.startswith("EXC") and got[0].dense_nodes == 9 and got[1].accuracy_src == 6.0 and got[1].quality.startswith("COARSE")


def test_members_and_anchors_are_changed_by_clicks(spark):
    rows = [("p", 0, 0.0, 0.0, 10.0), ("p", 1, 50.0, 0.0, 8.0), ("p", 2, 0.0, 60.0, 9.0), ("q", 0, 5.0, 5.0, 4.0), ("q", 1, 30.0, 5.0, 4.0)]
    pats = spark.createDataFrame(rows, "pattern_id string, m bigint, x double, y double, r double")
    clicks = spark.createDataFrame([("p", 51.0, 1.0, 8.0), ("q", 90.0, 9.0, 5.0)], "pattern_id string, x double, y double, r double")
    got = {(r.pattern_id, r.m): r.x for r in patterns.toggled(pats, clicks).collect()}
    assert got == {("p", 0): 0.0, ("p", 1): 0.0, ("q", 0): 5.0, ("q", 1): 30.0, ("q", 2): 90.0}
    got = {(r.pattern_id, r.m): r.x for r in patterns.anchored(pats, clicks.where("pattern_id = 'p'")).collect()}
    assert got == {("p", 0): 51.0, ("p", 1): 0.0, ("q", 0): 5.0, ("q", 1): 30.0}


def test_pictures_become_tiles(spark, tmp_path):
    v = np.random.default_rng(1).integers(0, 256, (300, 270, 3)).astype(np.uint8)
    pictures = spark.createDataFrame([("a.png", 270, 300, 3, v.tobytes())], "file string, width int, height int, n_channels int, data binary")
    tiles = tables.gray_tiles(pictures).collect()
    want = np.floor(v @ [0.114, 0.587, 0.299] + 0.5)
    assert len(tiles) == 4 and all(np.array_equal(np.array(t.v).reshape(t.h, t.w), want[t.ty * 256 : t.ty * 256 + t.h, t.tx * 256 : t.tx * 256 + t.w]) for t in tiles)
    with pytest.raises(Exception, match="can't read b.png"):
        tables.gray_tiles(spark.createDataFrame([("b.png", -1, -1, -1, b"")], pictures.schema)).collect()


def test_votes_end_at_the_first_good_hypothesis(spark):
    """Counts, winner and the best at another zoom against a loop over the hypotheses in their order, with seeds that end nothing."""
    g = np.random.default_rng(8)
    rows, craters, targets, frames, want = [], [], [], [], {}
    for image in range(6):
        pts = np.column_stack([g.random((40, 2)) * 800 + 50, g.random(40) * 30 + 10])
        keep = np.flatnonzero(g.random(40) < (0.6 if image % 2 else 0.97))
        tgt = np.column_stack([pts[keep, :2] * 0.9 + [20, 30], pts[keep, 2] * 0.9])
        if image % 2:
            tgt = np.vstack([tgt, np.column_stack([g.random((20, 2)) * 800, g.random(20) * 30 + 10])])
        good = np.array([0.9, 0.0, 20.0, 30.0])
        sims = [good + g.normal(size=4) * [0.3, 0.3, 200, 200] for _ in range(150)]
        for at in (5, 70, 90):
            sims[at] = good + g.normal(size=4) * [0.001, 0.001, 0.5, 0.5]
        hyps = [-2, -1, *range(1, 149)]
        sims[0] = good  # a seed
        craters += [(image, k, *map(float, p)) for k, p in enumerate(pts)]
        targets += [(image, k, *map(float, p)) for k, p in enumerate(tgt)]
        frames.append((image, 900.0, 700.0))
        rows += [(image, h, *map(float, s), float(np.hypot(s[0], s[1]))) for h, s in zip(hyps, sims)]
        least = max(5.0, 0.1 * np.median(tgt[:, 2]))
        scored = []
        for h, s in zip(hyps, sims):
            x, y, r = s[0] * pts[:, 0] - s[1] * pts[:, 1] + s[2], s[1] * pts[:, 0] + s[0] * pts[:, 1] + s[3], np.hypot(s[0], s[1]) * pts[:, 2]
            taken = set()
            for k in range(40):
                d = np.hypot(tgt[:, 0] - x[k], tgt[:, 1] - y[k])
                j = int(d.argmin())
                if d[j] < max(least, 0.3 * tgt[j, 2]) and 0.72 < tgt[j, 2] / r[k] < 1.39:
                    taken.add(j)
            seen = sum(-35 < x[k] < 935 and -35 < y[k] < 735 and r[k] >= 6.4 for k in range(40))
            scored.append((h, len(taken)))
            if h >= 0 and len(taken) >= 14 and len(taken) >= 0.85 * min(len(tgt), seen):
                break
        want |= {(image, h): n for h, n in scored if n}
    frame = lambda r, c: spark.createDataFrame(r, c)
    circle = "image_id bigint, crater_id bigint, cx double, cy double, r double"
    hyps = frame(rows, "image_id bigint, hyp bigint, re double, im double, tx double, ty double, s double")
    got = matching.votes(hyps, frame(craters, circle), frame(targets, circle), frame(frames, "image_id bigint, width double, height double"))
    assert {(r.image_id, r.hyp): r.n_pairs for r in got.collect()} == want
    last = {i: max(h for k, h in want if k == i) for i in range(6)}
    assert min(last.values()) < 10 and max(last.values()) > 100


def test_neighbours_of_a_hundred_thousand_craters_with_uneven_density(spark):
    """Against a tree of cells in numpy on a sample; repeated places and an image of two craters."""
    g = np.random.default_rng(1)
    n = 100_000
    xy = np.concatenate([g.random((n // 2, 2)) * 1e5, g.normal(size=(n // 2 - 50, 2)) * 300 + 4e4, np.full((50, 2), 7e4)])
    at = spark.createDataFrame(pd.DataFrame({"image_id": 1, "crater_id": np.arange(n), "cx": xy[:, 0], "cy": xy[:, 1]}))
    few = spark.createDataFrame([(2, 0, 1.0, 1.0), (2, 1, 5.0, 4.0), (3, 0, 0.0, 0.0)], "image_id bigint, crater_id bigint, cx double, cy double")
    got = spatial.knn(at.unionByName(few), 8).where("image_id > 1 OR i % 997 = 3 OR i >= 99990").toPandas()
    assert len(got[got.image_id == 2]) == 2 and not len(got[got.image_id == 3])
    for i, rows in got[got.image_id == 1].groupby("i"):
        d = np.hypot(*(xy - xy[i]).T)
        d[i] = np.inf
        first = np.lexsort((np.arange(n), d))[:8]
        assert rows.sort_values("rank")["j"].tolist() == first.tolist()


def plain_located(q, p, tol=0.22, most=2500):
    """Every two craters of a pattern against every two of an image, one by one; the best proposal, refitted."""
    scored = []
    for i, j in itertools.combinations(range(len(q)), 2):
        length, some = math.dist(q[i][:2], q[j][:2]), []
        for a, b in itertools.permutations(range(len(p)), 2):
            d = math.dist(p[a][:2], p[b][:2])
            la, lb, ld = math.log(p[a][2] / q[i][2]), math.log(p[b][2] / q[j][2]), math.log(d / length)
            if abs(la - lb) < 0.45 and abs(ld - la) < 0.45 and abs(ld - lb) < 0.45:
                some.append((abs(ld - la), a, b))
        for _, a, b in sorted(some)[:most]:
            z = complex(*np.subtract(p[b][:2], p[a][:2])) / complex(*np.subtract(q[j][:2], q[i][:2]))
            scored.append((z, complex(*p[a][:2]) - z * complex(*q[i][:2])))

    def look(z, t):
        out = []
        for x, y, r in q:
            at = z * complex(x, y) + t
            d, k = min((abs(at - complex(*c[:2])), k) for k, c in enumerate(p))
            out.append((d, k, d < max(tol * r * abs(z), 2.5) and 0.65 < p[k][2] / (r * abs(z)) < 1.55))
        return out

    counted = [(sum(h for *_, h in o), z, t, o) for z, t in scored for o in [look(z, t)]]
    counted = [c for c in counted if c[0] >= 3]
    if not counted:
        return None
    n, z, t, o = min(counted, key=lambda c: (-c[0], np.mean([d for d, _, h in c[3] if h]), c[1].real, c[1].imag, c[2].real, c[2].imag))
    for _ in range(3):
        on = [(complex(*q[m][:2]), complex(*p[k][:2])) for m, (_, k, h) in enumerate(o) if h]
        a, b = (np.array(v) for v in zip(*on))
        z2 = (np.conj(a - a.mean()) * (b - b.mean())).sum() / (abs(a - a.mean()) ** 2).sum()
        o2 = look(z2, b.mean() - z2 * a.mean())
        if sum(h for *_, h in o2) < sum(h for *_, h in o):
            break
        z, o = z2, o2
    hit = sum(h for *_, h in o)
    return hit, abs(z), hit >= max(3, math.ceil(0.6 * len(q)))


def test_patterns_in_many_images_against_all_pairs(spark):
    """Forty patterns, in two blocks, in three images: places, counts and verdicts as from every pair of craters; and where only some are asked for."""
    g = np.random.default_rng(2)
    ref = spark.createDataFrame([(k, i, *map(float, (g.uniform(0, 600), g.uniform(0, 600), g.uniform(8, 40)))) for i in range(12) for k in range(i * 100, i * 100 + 25)], CRATERS)
    pats = settled(patterns.as_patterns(patterns.proposed(ref, 4), ref).drop("image_id"))
    images = ref.where("image_id < 3 and crater_id % 7 > 0").selectExpr("crater_id", "image_id", "0.8 * cx - 0.3 * cy + 50 AS cx", "0.3 * cx + 0.8 * cy AS cy", "r * sqrt(0.73) AS r")
    shapes, scenes = {}, {}
    for r in pats.orderBy("pattern_id", "m").collect():
        shapes.setdefault(r.pattern_id, []).append((r.x, r.y, r.r))
    for r in images.orderBy("crater_id").collect():
        scenes.setdefault(r.image_id, []).append((r.cx, r.cy, r.r))
    got = {(r.pattern_id, r.image_id): (r.n_hit, r.scale, r.found) for r in patterns.located(pats, images).collect()}
    want = {(k, i): plain_located(q, p) for k, q in shapes.items() for i, p in scenes.items()}
    want = {k: v for k, v in want.items() if v}
    assert set(got) == set(want) and len(shapes) > 32 and {v[2] for v in want.values()} == {True, False}
    for k, (hit, scale, found) in want.items():
        assert got[k][0] == hit and got[k][2] == found and abs(got[k][1] - scale) < 1e-9
    some = [k for n, k in enumerate(sorted(want)) if n % 5 == 0]
    part = patterns.located(pats, images, asked=spark.createDataFrame(some, "pattern_id bigint, image_id bigint"))
    assert {(r.pattern_id, r.image_id): (r.n_hit, r.scale, r.found) for r in part.collect()} == {k: got[k] for k in some}


def test_a_library_comes_back_from_its_file(spark, tmp_path):
    """Many patterns, written in several files, as lines; and as one array; an absent file; a pattern without members."""
    ref = spark.createDataFrame(random_craters(120, 4), CRATERS)
    members = patterns.as_patterns(patterns.proposed(ref, 40), ref).drop("image_id").withColumn("pattern_id", F.col("pattern_id").cast("string"))
    members = members.unionByName(spark.createDataFrame([("alone", 0, 1.0, 2.0, 3.0)], members.schema))
    facts = members.select("pattern_id").distinct().selectExpr("pattern_id", "'P' || pattern_id AS name", "'i.png' AS image", "0.5D AS scale", "0.8D AS quality", "false AS ambiguous")
    outputs.write_patterns(members.repartition(3), facts, str(tmp_path / "lines"))
    back = tables.patterns(spark, str(tmp_path / "lines"))
    key = ["pattern_id", "m", "x", "y", "r"]
    want = {tuple(r) for r in members.select(*key).collect()}
    assert len({r[0] for r in want}) > 6 and {tuple(r) for r in back.select(*key).collect()} == want
    assert {tuple(r) for r in back.select("pattern_id", "name", "image", "scale", "quality", "ambiguous").distinct().collect()} == {tuple(r) for r in facts.collect()}
    lines = [x for f in sorted((tmp_path / "lines").glob("part-*")) for x in f.read_text().splitlines()]
    (tmp_path / "patterns.json").write_text("[\n" + ",\n".join(lines) + "\n]")
    assert {tuple(r) for r in tables.patterns(spark, str(tmp_path / "patterns.json")).select(*key).collect()} == want
    assert tables.patterns(spark, str(tmp_path / "none.json")).count() == 0
    found = patterns.located(back.where("pattern_id <> 'alone'").select(*key), ref.selectExpr("crater_id", "image_id", "cx + 9 AS cx", "cy", "r")).collect()
    assert all(r.found for r in found) and len(found) == len({r[0] for r in want}) - 1


def test_known_craters_in_the_order_they_were_found(spark):
    """Against a loop: marked places, drawn craters and earlier detections keep a detection out, unsure ones never count."""
    g = np.random.default_rng(6)
    frame = lambda rows, c: spark.createDataFrame(rows, c)
    labels = [(i, *map(float, (g.uniform(0, 300), g.uniform(0, 300), g.uniform(8, 60))), int(k % 2)) for i in range(3) for k in range(12)]
    found = [(i, int(k), *map(float, (g.uniform(0, 300), g.uniform(0, 300), g.uniform(8, 60))), None if k % 11 == 0 else float(g.uniform(0, 1))) for i in range(3) for k in g.permutation(150)]
    found += [(0, 900, 50.0, 50.0, 10.0, 0.9), (0, 901, 51.0, 50.0, 10.0, 0.99)]
    same = lambda a, b: math.dist(a[:2], b[:2]) < 0.5 * max(a[2], b[2]) and 0.6 < a[2] / b[2] < 1.67
    want = set()
    for i in range(3):
        out = [r[1:4] for r in labels if r[0] == i and r[4]]
        for r in sorted(found):
            if r[0] == i and (r[5] is None or r[5] >= 0.25) and not any(same(r[2:5], x[1:4]) for x in labels if x[0] == i and not x[4]) and not any(same(r[2:5], o) for o in out):
                out.append(r[2:5])
        want |= {(i, *o) for o in out}
    got = detection.pooled(frame(labels, "image_id bigint, cx double, cy double, r double, label int"), frame(found, "image_id bigint, det_id bigint, cx double, cy double, r double, conf double"))
    assert {tuple(r)[:4] for r in got.collect()} == want


def test_suppression_with_many_circles_against_a_loop(spark):
    g = np.random.default_rng(9)
    rows = [(k, *map(float, (g.uniform(-200, 400), g.uniform(-200, 400), np.exp(g.uniform(0, 5)))), float(g.integers(0, 50))) for k in range(900)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if not any(math.dist(r[1:3], o[1:3]) < 0.5 * max(r[3], o[3]) and 0.6 < o[3] / r[3] < 1.67 for o in kept):
            kept.append(r)
    got = spatial.nms(spark.createDataFrame([(0, *r) for r in rows], "image_id bigint, det_id bigint, cx double, cy double, r double, conf double"))
    assert {r.det_id for r in got.collect()} == {r[0] for r in kept} and len(kept) < 900
