"""Raster and detection operators, tile by tile, against plain numpy on whole images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.checkpoints import settled
from regolith.operators import detection, learning, raster, spatial, tiles
from regolith.sources import outputs

PX = "image_id bigint, y bigint, x bigint, v double"


def rings(height, width, n, seed, light=0.7):
    """A terrain of bowls lit from one side, and the circles."""
    g = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width].astype(float)
    ground, circles = np.zeros((height, width)), []
    while len(circles) < n:
        r = g.uniform(12, 20)
        cx, cy = g.uniform(2 * r, width - 2 * r), g.uniform(2 * r, height - 2 * r)
        if all(math.hypot(cx - a, cy - b) > 1.6 * (r + c) for a, b, c in circles):
            circles.append((cx, cy, r))
            d = np.hypot(x - cx, y - cy) / r
            ground += np.where(d < 1, (d * d - 1) * 0.5 * r, 0) + 0.15 * r * np.exp(-(((d - 1) / 0.15) ** 2))
    slope = np.cos(light) * np.gradient(ground, axis=1) + np.sin(light) * np.gradient(ground, axis=0)
    return np.clip(128 + 90 * slope + g.normal(0, 4, slope.shape), 0, 255), circles


def frame_of(spark, *images):
    rows = [(k, y, x, float(a[y, x])) for k, a in enumerate(images) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, PX)


def whole(df, column="v"):
    p = df.orderBy("y", "x").toPandas()
    return p[column].to_numpy().reshape(p["y"].max() + 1, p["x"].max() + 1)


def mirrored(a, w):
    half = len(w) // 2
    return tiles.smooth(np.pad(a, half, mode="reflect"), w)


@pytest.fixture(scope="module")
def terrain():
    return rings(300, 280, 14, 1)


@pytest.fixture(scope="module")
def base(spark, terrain):
    from regolith.checkpoints import settled

    return settled(tiles.tiled(frame_of(spark, terrain[0])))


def plain_maps(a):
    w = tiles.gauss(20.0)
    m, q = mirrored(a, w), mirrored(a * a, w)
    ln = (a - m) / np.sqrt(np.maximum(q - m * m, 4))
    gx, gy = tiles.slopes(np.pad(mirrored(ln, tiles.gauss(1.2)), 1, mode="reflect"))
    return ln, gx, gy


def test_filters_do_not_see_tiles(terrain, base):
    a = terrain[0]
    assert np.allclose(whole(tiles.pixels_of(tiles.blurred(base))), mirrored(a, tiles.gauss(1.2)))
    assert np.allclose(whole(tiles.pixels_of(tiles.local_norm(base))), plain_maps(a)[0])
    assert np.allclose(whole(tiles.pixels_of(tiles.halved(base))), mirrored(a, tiles.FIVE)[::2, ::2])
    p = np.pad(a, 4, constant_values=np.inf)
    assert np.array_equal(whole(tiles.pixels_of(tiles.eroded(base, 4))), np.lib.stride_tricks.sliding_window_view(p, (9, 9)).min((2, 3)))
    levels = {r.level: (r.height, r.width) for r in tiles.pyramid(base).select("level", "height", "width").distinct().collect()}
    assert levels == {0: (300, 280), 1: (150, 140)}


def test_features_equal_those_of_the_whole_image(spark, terrain, base):
    features, sizes = detection.prepared(base)
    g = np.random.default_rng(2)
    circles = [(0, k, float(g.uniform(0, 279)), float(g.uniform(0, 299)), float(g.uniform(10, 27))) for k in range(30)]
    got = {r.det_id: np.array(r.features) for r in detection.described(spark.createDataFrame(circles, "image_id bigint, det_id bigint, cx double, cy double, r double"), features, sizes).collect()}
    ln, gx, gy = plain_maps(terrain[0])
    g95 = np.percentile(np.hypot(gx, gy), 95) + 1e-6
    turn = np.arange(24) * 2 * np.pi / 24
    for _, k, cx, cy, r in circles:
        x, y = (c + r * np.linspace(0.4, 1.6, 10)[:, None] * f(turn) for c, f in ((cx, np.cos), (cy, np.sin)))
        v, a, b = (tiles.bilinear(m, x, y) for m in (ln, gx, gy))
        out, length = (a * np.cos(turn) + b * np.sin(turn)) / g95, np.hypot(a, b) / g95
        assert np.allclose(got[k], detection.ring_features(v[None], out[None], length[None])[0]) and len(got[k]) == 147
    scan = detection.scanned(features, sizes, 12.0, 20.0, keep=400).toPandas()
    best = scan.sort_values("ring", ascending=False).head(150)
    near = [min(math.hypot(r.cx - x, r.cy - y) / c for x, y, c in terrain[1]) for r in best.itertuples()]
    assert len(scan) == 400 and np.mean(np.array(near) < 0.5) > 0.7


def test_a_trained_model_finds_craters_and_fits_their_rims(spark, terrain, base):
    ready = detection.prepared(base)
    known = [(0, k, *c, 1, False) for k, c in enumerate(terrain[1][:9])]
    labels = spark.createDataFrame(known, "image_id bigint, crater_id bigint, cx double, cy double, r double, label int, complete boolean")
    model = detection.trained(base, labels, least_r=10.0, most_r=24.0, trees=30, ready=ready)
    found = detection.detected(base, model, 0.5, 10.0, 24.0, ready=ready)
    truth = spark.createDataFrame([(0, k, *c) for k, c in enumerate(terrain[1])], "image_id bigint, crater_id bigint, cx double, cy double, r double")
    report = spatial.detection_report(found, truth, 0.35).first()
    assert report.n_found >= 11 and report.n_extra <= 6
    assert all(r.a >= r.b and 0 <= r.angle_deg < 180 for r in found.collect())
    first = detection.auto_labels(*ready, 10.0, 24.0)
    assert first.count() >= 8 and {(r.label, r.complete) for r in first.collect()} == {(1, False)}
    report = spatial.detection_report(first.withColumnRenamed("crater_id", "det_id"), truth, 0.35).first()
    assert report.n_found >= 10
    known_ = truth.selectExpr("image_id + 1 AS image_id", "crater_id", "cx", "cy", "r AS a", "r AS b", "0D AS angle_deg", "r", "1D AS conf")
    assert detection.with_catalogues(found.withColumnRenamed("det_id", "crater_id"), known_).count() == found.count() + 14
    manual = truth.limit(2)
    assert {r.source for r in detection.final_list(found, manual, truth.where("crater_id = 3")).collect()} == {"manual", "ml"}


def test_a_search_ends_at_the_least_value():
    at, value = detection.simplex(lambda p: float(((p - [1, -2, 3]) ** 2).sum()), np.zeros(3), np.full(3, 0.5), 1e-6, 1e-12, 400)
    assert np.allclose(at, [1, -2, 3], atol=1e-3) and value < 1e-6


def test_a_registered_target_shows_the_shift_that_is_left(spark, terrain, tmp_path, monkeypatch):
    """The target is the reference turned, scaled and shifted; its matrix is given with an error of (0.6, -0.4) pixels."""
    a, m = terrain[0], np.array([[0.9, -0.2, 40], [0.2, 0.9, 5], [0, 0, 1]])
    inverse = np.linalg.inv(m)
    y, x = np.mgrid[:330, :330].astype(float)
    u, v = (inverse[k, 0] * x + inverse[k, 1] * y + inverse[k, 2] for k in (0, 1))
    target = tiles.bilinear(a, u, v)
    off = m @ np.array([[1, 0, 0.6], [0, 1, -0.4], [0, 0, 1]])
    given = spark.createDataFrame([(0, *map(float, off.ravel()))], "image_id bigint, " + ", ".join(f"t{i}{j} double" for i in range(3) for j in range(3)))
    frames = spark.createDataFrame([(0, 300, 280)], "image_id bigint, height bigint, width bigint")
    got = raster.warped(tiles.tiled(frame_of(spark, target)), given, frames)
    y, x = np.mgrid[:300, :280].astype(float)
    u, v = (off[k, 0] * x + off[k, 1] * y + off[k, 2] for k in (0, 1))
    inside = (u >= 0) & (u <= 329) & (v >= 0) & (v <= 329)
    assert np.allclose(whole(tiles.pixels_of(got))[inside], tiles.bilinear(target, u, v)[inside])
    ref = tiles.tiled(frame_of(spark, a))
    nodes = raster.residual_nodes(ref, got).where("not rejected").toPandas()
    assert len(nodes) > 40 and abs(nodes.dx.median() - 0.6) < 0.15 and abs(nodes.dy.median() + 0.4) < 0.15
    made = settled(raster.products(ref, got))
    monkeypatch.setattr(outputs, "BAND", 280 * 90)
    outputs.write_products(made, str(tmp_path / "pictures"))
    back = outputs.read_rasters(spark, str(tmp_path / "pictures")).toPandas()
    want = made.orderBy("y", "x").toPandas()
    byte = lambda c: np.clip(np.floor(want[c].to_numpy() + 0.5), 0, 255).astype(int)
    for picture, columns in outputs.PICTURES.items():
        for k, c in enumerate(columns):
            assert np.array_equal(back[(back.picture == picture) & (back.k == k)].sort_values(["y", "x"])["v"].to_numpy(), byte(c))
    assert len(list((tmp_path / "pictures").glob("image_id=0/picture=overlay/band=*"))) == 4
    first = next((tmp_path / "pictures").glob("image_id=0/picture=overlay/band=270/*.txt")).read_text()
    assert first.startswith("P3 280 30 255\n") and len(first.split()) == 4 + 280 * 30 * 3
    p = made.where("y between 100 and 110 and x between 100 and 150").toPandas()
    assert (p.grey.to_numpy() == a[100:111, 100:151].ravel()).sum() > 0 and p.difference.between(0, 255).all()


def test_shrinking_takes_means_by_area(spark):
    a = np.arange(24.0).reshape(4, 6)
    got = whole(raster.tiles.shrunk(frame_of(spark, a), 0.5))
    assert np.allclose(got, a.reshape(2, 2, 3, 2).mean((1, 3)))
    lit = raster.relit(frame_of(spark, a * 10), 3)
    assert lit.count() == 24 and lit.where("v < 0 or v > 255").count() == 0 and lit.exceptAll(raster.relit(frame_of(spark, a * 10).repartition(3), 3)).count() == 0
    assert raster.gray(frame_of(spark, a).select("image_id", "y", "x", F.lit(10).alias("b"), F.lit(20).alias("g"), F.lit(30).alias("r"))).first().v == 22


def test_tiles_send_each_other_strips_alone(spark):
    """An image of many tiles with margins below and above a tile's side, thin rests at its edges, and images smaller than the margin."""
    g = np.random.default_rng(0)
    for shape, margins in (((530, 515), (1, 40, 300)), ((257, 100), (5, 99)), ((7, 300), (9,))):
        a = g.random(shape)
        base = tiles.tiled(frame_of(spark, a))
        for margin in margins:
            if margin < min(shape):
                pad = np.pad(a, margin, mode="reflect")
                got = whole(tiles.pixels_of(tiles.mapped(base, lambda x, _, m=margin: [x[2 * m :, 2 * m :] + x[: -2 * m, : -2 * m]], margin)))
                assert np.allclose(got, pad[2 * margin :, 2 * margin :] + pad[: -2 * margin, : -2 * margin])
            else:
                got = whole(tiles.pixels_of(tiles.mapped(base, lambda x, _, m=margin: [x[m:-m, m:-m]], margin)))
                assert np.array_equal(got, a)
    a = g.random((530, 515))
    base = tiles.tiled(frame_of(spark, a))
    sent = tiles._strips(base, 1, "v", ()).selectExpr("sum(size(v)) AS n").first().n
    assert sent < 1.03 * a.size
    assert np.allclose(whole(tiles.pixels_of(tiles.halved(base))), mirrored(a, tiles.FIVE)[::2, ::2])


def test_relit_pictures_have_their_own_blur(spark):
    g = np.random.default_rng(1)
    plain = g.random((60, 50)) * 255
    lit = raster.relit(frame_of(spark, *[plain] * 12), 5).toPandas()
    rough = [lit[lit.image_id == k].sort_values(["y", "x"])["v"].to_numpy().reshape(60, 50) for k in range(12)]
    edges = sorted(np.abs(np.diff(r, axis=1)).mean() / r.std() for r in rough)
    assert len({round(e, 2) for e in edges}) > 4 and edges[-1] > 1.3 * edges[0]


def plain_votes(a, r):
    """The share of the circumference that votes for each pixel, by a loop over pixels of the whole image."""
    ln, gx, gy = plain_maps(a)
    g95 = np.percentile(np.hypot(gx, gy), 95) + 1e-6
    out = np.zeros(a.shape)
    for y, x in zip(*np.nonzero(np.hypot(gx, gy) / g95 >= 0.5)):
        m = np.hypot(gx[y, x], gy[y, x])
        for s in (-1, 1):
            cx, cy = int(np.rint(x + s * r * gx[y, x] / m)), int(np.rint(y + s * r * gy[y, x] / m))
            if 0 <= cx < a.shape[1] and 0 <= cy < a.shape[0]:
                out[cy, cx] += min(m / g95, 1.0) / (2 * np.pi * r)
    return sum(np.roll(np.roll(out, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1))


def test_voted_circles_are_the_planted_ones(spark, terrain, base):
    """Votes as a loop over the whole image counts them, away from its border, and nine in ten planted craters on the final list."""
    ready = detection.prepared(base)
    every, final = detection.classic_candidates(*ready, 10.0, 24.0)
    inner = [r for r in every.collect() if 60 < r.cx < 220 and 60 < r.cy < 240]
    assert len(inner) > 10
    for radius in {r.r for r in inner if r.r < 24}:
        votes = plain_votes(terrain[0], radius)
        for r in inner:
            if r.r == radius:
                assert r.votes == pytest.approx(votes[int(r.cy), int(r.cx)])
    truth = spark.createDataFrame([(0, k, *c) for k, c in enumerate(terrain[1])], "image_id bigint, crater_id bigint, cx double, cy double, r double")
    report = spatial.detection_report(final, truth, 0.35).first()
    assert report.n_found >= 0.9 * len(terrain[1]) and final.where("arc < 6 or score < 0.06").count() == 0 and final.count() <= 60
    assert detection.classic_candidates(ready[0], ready[1], 30.0, 20.0)[1].count() == 0


def test_images_shrink_each_by_its_own_scale_tile_by_tile(spark):
    """As shrunk() on rows of pixels, for sizes of one and several tiles, with whole and odd scales; what fits stays."""
    g = np.random.default_rng(3)
    images = [g.random(s) for s in ((530, 300), (90, 260), (400, 800), (60, 50))]
    base = tiles.tiled(frame_of(spark, *images))
    got = settled(tiles.shrunk_to(base, 200))
    assert {(r.image_id, round(r.scale, 12)) for r in got.select("image_id", "scale").collect()} == {(k, round(min(1.0, 200 / max(a.shape)), 12)) for k, a in enumerate(images)}
    for k, a in enumerate(images):
        mine = whole(tiles.pixels_of(got.where(f"image_id = {k}")))
        scale = 200 / max(a.shape)
        want = a if scale >= 1 else whole(tiles.shrunk(frame_of(spark, a), scale))
        assert mine.shape == want.shape and np.allclose(mine, want)


def test_a_model_teaches_itself_and_comes_back_from_disk(spark, terrain, base, tmp_path):
    """From eight drawn craters: the rounds keep the number of detections within bounds, and a saved model scores as before."""
    ready = detection.prepared(base)
    known = [(0, k, *c, 1, False) for k, c in enumerate(terrain[1][:8])]
    labels = spark.createDataFrame(known, "image_id bigint, crater_id bigint, cx double, cy double, r double, label int, complete boolean")
    model = detection.trained(base, labels, least_r=10.0, most_r=24.0, trees=15, ready=ready)
    n = detection.detected(base, model, 0.5, 10.0, 24.0, fit=False, ready=ready).count()
    new = detection.self_trained(base, model, rounds=1, least_r=10.0, most_r=24.0, trees=15)
    m = detection.detected(base, new, 0.5, 10.0, 24.0, fit=False, ready=ready).count()
    assert m == n or 0.95 * n <= m <= 1.4 * n
    report = spark.createDataFrame([(40, 8, 32, 0.9)], "n_samples int, n_positive int, n_negative int, cv_auc double")
    assert outputs.read_model(spark, str(tmp_path / "none")) is None
    outputs.write_model(model, report, str(tmp_path / "m"))
    back = outputs.read_model(spark, str(tmp_path / "m"))
    circles = detection.described(spark.createDataFrame([(0, k, *map(float, c)) for k, c in enumerate(terrain[1])], "image_id bigint, det_id bigint, cx double, cy double, r double"), *ready)
    p = [{r.det_id: r.p for r in learning.scored(x, circles).collect()} for x in (model, back)]
    assert p[0] == p[1] and spark.read.json(str(tmp_path / "m/train_report")).first().cv_auc == 0.9
