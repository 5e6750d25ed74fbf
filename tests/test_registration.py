"""The whole flow against a plain version of it, one pair at a time, and on images."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regolith.checkpoints import settled
from regolith.operators import correlation, matching, raster, registration, tiles
from regolith.schema import CRATERS
from regolith.sources import outputs
from regolith.streaming import register
from tests.test_images import frame_of, rings, whole

CIRCLE = "image_id bigint, crater_id bigint, cx double, cy double, r double, conf double"


def plain_pattern(craters, w, h, p):
    rows = sorted(c for c in craters if c[4] >= p)[:160]
    ok = [c for c in rows if 8 <= c[3] <= 0.35 * min(w, h) and c[1] - 0.7 * c[3] >= 0 and c[2] - 0.7 * c[3] >= 0 and c[1] + 0.7 * c[3] <= w and c[2] + 0.7 * c[3] <= h]
    return sorted(ok, key=lambda c: (-c[3], c[0]))[:80]


def plain_triangles(pts):
    ids = sorted(range(len(pts)), key=lambda k: pts[k][0])
    found = set()
    for i in ids:
        near = sorted((k for k in ids if k != i), key=lambda k: (math.dist(pts[i][1:3], pts[k][1:3]), pts[k][0]))[:8]
        found |= {tuple(sorted((pts[i][0], pts[a][0], pts[b][0]))) for a, b in itertools.combinations(near, 2)}
    at = {c[0]: c for c in pts}
    out = []
    for t in sorted(found):
        c = [at[k] for k in t]
        corner = sorted((math.dist(c[(n + 1) % 3][1:3], c[(n + 2) % 3][1:3]), t[n]) for n in range(3))
        long = corner[2][0]
        (ax, ay), (bx, by), (dx, dy) = (x[1:3] for x in c)
        area = abs((bx - ax) * (dy - ay) - (dx - ax) * (by - ay)) / 2
        if corner[0][0] / long > 0.22 and area / long**2 > 0.05:
            out.append(([corner[0][0] / long, corner[1][0] / long, *(at[v][3] / long for _, v in corner)], [at[v] for _, v in corner]))
    return out


def plain_fit(pairs):
    p, q = np.array([complex(a[1], a[2]) for a, _ in pairs]), np.array([complex(b[1], b[2]) for _, b in pairs])
    z = (np.conj(p - p.mean()) * (q - q.mean())).sum() / (abs(p - p.mean()) ** 2).sum()
    return z, q.mean() - z * p.mean()


def plain_consensus(sim, a, b, thr, low, high):
    best = {}
    for c in a:
        at = sim[0] * complex(c[1], c[2]) + sim[1]
        d, t = min((abs(at - complex(t[1], t[2])), t) for t in sorted(b))
        if d < max(thr, 0.3 * t[3]) and low < t[3] / (abs(sim[0]) * c[3]) < high and (t[0] not in best or d < best[t[0]][0]):
            best[t[0]] = (d, c, t)
    return [(c, t) for _, c, t in best.values()]


def plain_seen(sim, pts, w, h):
    m, n = 0.05 * min(w, h), 0
    for c in pts:
        q = sim[0] * complex(c[1], c[2]) + sim[1]
        n += -m < q.real < w + m and -m < q.imag < h + m and abs(sim[0]) * c[3] >= 6.4
    return n


def plain_match(a, b, frame):
    thr = max(5.0, 0.1 * float(np.median([c[3] for c in b])))
    ta, tb = plain_triangles(a), plain_triangles(b)
    alike = sorted((max(abs(x - y) for x, y in zip(d, e)), i, j) for i, (d, _) in enumerate(ta) for j, (e, _) in enumerate(tb) if all(abs(x - y) <= 0.06 for x, y in zip(d, e)))
    scored = []
    for _, i, j in alike[:7000]:
        sim = plain_fit(list(zip(ta[i][1], tb[j][1])))
        if 0.05 < abs(sim[0]) < 20:
            pairs = plain_consensus(sim, a, b, thr, 0.72, 1.39)
            scored.append((len(pairs), sim, pairs))
            if len(pairs) >= 14 and len(pairs) >= 0.85 * min(len(b), plain_seen(sim, a, *frame)):
                break
    if not scored or max(s[0] for s in scored) < 4:
        return None
    n, sim, pairs = max(scored, key=lambda s: s[0])
    second = max((m for m, s, _ in scored if abs(math.log(abs(s[0]) / abs(sim[0]))) > 0.25), default=0)
    for _ in range(4):
        if len(pairs) < 3:
            break
        new = plain_fit(pairs)
        fresh = plain_consensus(new, a, b, max(0.6 * thr, 3.0), 0.78, 1.28)
        if len(fresh) < 3 or len(fresh) < len(pairs) - 1:
            break
        pairs = fresh
    return n, second, pairs


def scene(g, image, n, conf, decoys, jitter=0.2):
    """Craters of both sides of a pair: turned, scaled and shifted, with wrong ones on the target's side."""
    z, t = 0.85 * np.exp(1j * g.uniform(-3, 3)), complex(450, 420)
    a, b = [], []
    for k in range(n):
        x, y, r = g.uniform(60, 840), g.uniform(60, 740), g.uniform(9, 40)
        c = conf * g.uniform(0.7, 1)
        q = z * (complex(x, y) - complex(450, 400)) + t + complex(*g.normal(size=2)) * jitter
        a.append((k, x, y, r, c))
        b.append((k + 1000, q.real, q.imag, r * 0.85, c * g.uniform(0.9, 1)))
    b += [(5000 + k, g.uniform(60, 840), g.uniform(60, 740), g.uniform(9, 40), conf) for k in range(decoys)]
    g.shuffle(b)
    return a, [(k, *c[1:]) for k, c in enumerate(b)]


def test_pairs_match_on_different_rungs_as_one_pair_at_a_time(spark):
    g = np.random.default_rng(4)
    scenes = {i: scene(g, i, n, conf, decoys) for i, (n, conf, decoys) in enumerate([(26, 1.0, 4), (24, 0.5, 12), (22, 0.4, 3), (24, 0.3, 8), (25, 0.2, 2), (3, 0.9, 0), (18, 0.9, 40)])}
    scenes[7] = (scenes[0][0], scenes[1][1])  # no common craters
    frames = {i: (900.0, 800.0, 880.0, 820.0) for i in scenes}
    rows = [[(i, *c) for i, s in scenes.items() for c in s[n]] for n in (0, 1)]
    ref, tgt = (spark.createDataFrame([(i, int(k), *map(float, c)) for i, k, *c in r], CIRCLE) for r in rows)
    sides = spark.createDataFrame([(i, *f, 2.0) for i, f in frames.items()], "image_id bigint, wa double, ha double, wb double, hb double, scale_tgt double")
    want = {}
    for i, (a, b) in scenes.items():
        for p in (0.5, 0.4, 0.3, 0.25):
            pa, pb = plain_pattern(a, *frames[i][:2], p), plain_pattern(b, *frames[i][2:], p)
            m = plain_match(pa, pb, frames[i][2:]) if min(len(pa), len(pb)) >= 4 else None
            if m:
                want[i] = (p, m, pa, pb)
                break
    pairs, a, b = registration.matched(ref, tgt, sides)
    got = {}
    for r in pairs.collect():
        got.setdefault(r.image_id, (r.conf_used, r.n_best, r.n_second, set()))[3].add((r.i, r.j))
    assert got == {i: (p, n, second, {(c[0], t[0]) for c, t in found}) for i, (p, (n, second, found), _, _) in want.items()}
    assert len({p for p, *_ in want.values()}) >= 3 and len(want) < len(scenes)
    out, errors = registration.from_catalogues(ref, tgt, sides, registration.Options(model="similarity"))
    rows = {r.image_id: r for r in out.collect()}
    assert {i for i, r in rows.items() if r.ok} == set(want) and len(rows) == len(scenes)
    assert {i for i, r in rows.items() if r.model is None and r.n_inliers == 0} == set(scenes) - set(want)
    for i, (p, (n, second, found), pa, pb) in want.items():
        sim, r = plain_fit(found), rows[i]
        back = (1 / sim[0], -sim[1] / sim[0])
        seen = plain_seen(sim, pa, *frames[i][2:]), plain_seen(back, pb, *frames[i][:2])
        assert (r.n_inliers, r.n_pattern_ref, r.n_pattern_tgt, r.n_visible_ref, r.n_visible_tgt) == (len(found), len(pa), len(pb), *seen)
        assert r.inlier_ratio == pytest.approx(len(found) / max(1, min(seen))) and r.scale == pytest.approx(abs(sim[0])) and r.uniqueness == pytest.approx(len(found) / max(len(found), second, 1))
        e = [abs(sim[0] * complex(c[1], c[2]) + sim[1] - complex(t[1], t[2])) for c, t in found]
        assert r.rmse_tgt == pytest.approx(np.sqrt(np.mean(np.square(e)))) and r.rmse_src == pytest.approx(r.rmse_tgt / 2, abs=1e-3) and r.accuracy_basis == "craters"
    assert errors.count() == sum(len(m[2]) for _, m, _, _ in want.values())


def test_nothing_to_register(spark):
    none = spark.createDataFrame([], CIRCLE)
    sides = spark.createDataFrame([(1, 9.0, 9.0, 9.0, 9.0, 1.0)], "image_id bigint, wa double, ha double, wb double, hb double, scale_tgt double")
    out, errors = registration.from_catalogues(none, none, sides)
    (r,) = out.collect()
    assert (r.image_id, r.ok, r.n_inliers, r.n_craters_ref) == (1, False, 0, 0) and errors.count() == 0
    assert registration.from_catalogues(none, none, sides.where("false"))[0].collect() == []


def turned(a, m, size):
    """The picture a seen through the matrix m, from a to the new one."""
    inverse = np.linalg.inv(m)
    y, x = np.mgrid[: size[0], : size[1]].astype(float)
    w = inverse[2, 0] * x + inverse[2, 1] * y + inverse[2, 2]
    u, v = ((inverse[k, 0] * x + inverse[k, 1] * y + inverse[k, 2]) / w for k in (0, 1))
    return tiles.bilinear(a, u, v)


def given(spark, m, model="affine", image=0):
    return spark.createDataFrame([(image, model, *map(float, np.asarray(m).ravel()))], "image_id bigint, model string, " + ", ".join(f"t{i}{j} double" for i in range(3) for j in range(3)))


@pytest.mark.parametrize("model", ["affine", "homography"])
def test_correlation_recovers_a_planted_shift(spark, model):
    """The matrix is given with an error of about a pixel; the images bring it back. A worse start's result is refused."""
    a, _ = rings(420, 400, 26, 5)
    m = np.array([[0.92, -0.15, 60], [0.15, 0.92, 10], [0, 0, 1]])
    if model == "homography":
        m[2, :2] = [2e-5, -3e-5]
    b = turned(a, m, (430, 440))
    ref, tgt = (settled(tiles.tiled(frame_of(spark, p))) for p in (a, b))
    off = m @ np.array([[1.001, 0.0005, 0.7], [-0.0005, 1.0, -0.5], [0, 0, 1]])
    g = np.random.default_rng(0)
    xy = g.uniform(60, 340, (20, 2))
    q = np.column_stack([xy, np.ones(20)]) @ m.T
    placed = spark.createDataFrame([(0, *map(float, p), *map(float, r[:2] / r[2])) for p, r in zip(xy, q)], "image_id bigint, x double, y double, u double, v double")
    (r,) = correlation.refined(ref, tgt, given(spark, off, model), placed).collect()
    new = np.array([r[f"t{i}{j}"] for i in range(3) for j in range(3)]).reshape(3, 3)
    p = np.column_stack([xy, np.ones(20)]) @ new.T
    left = np.hypot(*(p[:, :2] / p[:, 2:] - q[:, :2] / q[:, 2:]).T)
    assert r.used and r.cc > 0.9 and r.before > 0.6 and r.after < 0.15 and left.max() < 0.25 and r.n_rounds < 60
    wrong = placed.withColumns({"u": F.col("u") + 4, "v": F.col("v") - 3})
    start = given(spark, np.array([[1, 0, 4], [0, 1, -3], [0, 0, 1]]) @ m, model)
    (w,) = correlation.refined(ref, tgt, start, wrong).collect()
    assert not w.used and w.after > 1.1 * w.before + 0.3 and [w[c] for c in matching.MATRIX] == [start.first()[c] for c in matching.MATRIX]


def test_one_tile_sums_like_the_whole_picture():
    """The step from tiles' sums equals that of one loop over all pixels."""
    g = np.random.default_rng(3)
    own, part = g.random((30, 40)) * 50, g.random((36, 48)) * 50
    m = np.array([[1.01, 0.02, 2.3], [-0.01, 0.99, 1.7], [0, 0, 1]])
    place = {"ty": 0, "tx": 0, "h": 30, "w": 40, "height": 30, "width": 40, "th": 36, "tw": 48, "top": 0, "left": 0, "ph": 36, "pw": 48}
    gy, gx = np.gradient(part)
    rows = []
    for y in range(30):
        for x in range(40):
            square = [m @ [min(max(x + dx, 0), 39), min(max(y + dy, 0), 29), 1] for dx in (-4, 4) for dy in (-4, 4)]
            u, v, _ = m @ [x, y, 1]
            if all(0 <= round(s[0]) < 48 and 0 <= round(s[1]) < 36 for s in square) and 0 <= u <= 47 and 0 <= v <= 35:
                i, sx, sy = (float(tiles.bilinear(p, np.array([u]), np.array([v]))[0]) for p in (part, gx, gy))
                rows.append((own[y, x], i, sx * x / 40, sx * y / 40, sx, sy * x / 40, sy * y / 40, sy))
    t, i, *slopes = np.array(rows).T
    t, i, s = t - t.mean(), i - i.mean(), np.array(slopes)
    h = np.linalg.inv(s @ s.T)
    lam = (i @ i - (s @ i) @ h @ (s @ i)) / (t @ i - (s @ t) @ h @ (s @ i))
    rho, step = correlation.step_of(correlation.sums_of(own, part, place, m, m, False), False)
    assert rho == pytest.approx(t @ i / np.sqrt((t @ t) * (i @ i))) and np.allclose(step, h @ (s @ (lam * t - i)))


def test_two_pairs_of_images_from_detection_to_grade(spark):
    """One pair without anything drawn, one whose reference has a catalogue, in one call."""
    a, known = rings(420, 400, 30, 11)
    m = np.array([[0.95, -0.1, 40], [0.1, 0.95, 5], [0, 0, 1]])
    b = turned(a, m, (440, 450))
    stack = lambda p: settled(tiles.tiled(frame_of(spark, p).unionByName(frame_of(spark, p).withColumn("image_id", F.lit(1).cast("bigint")))))
    ref, tgt = stack(a), stack(b)
    catalogue = spark.createDataFrame([(1, k, x, y, r, r, 0.0, r, 1.0) for k, (x, y, r) in enumerate(known)], "image_id bigint, crater_id bigint, cx double, cy double, a double, b double, angle_deg double, r double, conf double")
    out, errors, registered = registration.from_images(ref, tgt, catalogues=(catalogue, None), trees=30, most_r=40.0, options=registration.Options(model="similarity"))
    rows = {r.image_id: r for r in out.collect()}
    assert set(rows) == {0, 1}
    for r in rows.values():
        assert r.ok and r.n_inliers >= 8 and r.scale == pytest.approx(np.hypot(0.95, 0.1), rel=0.01) and r.accuracy_basis == "images" and r.accuracy_src < 1.0
        assert r.ecc_used is not None and r.dense_nodes >= 8
    assert rows[1].n_craters_ref == len(known) and errors.count() == sum(r.n_inliers for r in rows.values())
    shown = whole(tiles.pixels_of(registered.where("image_id = 1")))
    inner = np.abs(shown - a)[100:300, 100:300]
    assert np.median(inner) < 4


def test_catalogues_that_arrive_as_files(spark, tmp_path):
    """Two files, registered as they come: the results of one call on both, and a second start adds nothing. Matches and transforms of the learner's folder are read back."""
    g = np.random.default_rng(12)
    scenes = {i: scene(g, i, 24, 1.0, 3) for i in range(2)}
    rows = [[(int(k), i, *map(float, c[:3])) for i, s in scenes.items() for k, *c in s[n]] for n in (0, 1)]
    ref, tgt = (spark.createDataFrame(r, CRATERS) for r in rows)
    for i in (0, 1):
        tgt.where(f"image_id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        register.registered(spark, ref, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(300)
    got = {r.image_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.image_id: r for r in matching.match_pairs(ref, tgt).collect()}
    assert set(got) == set(want) == {0, 1} and spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert all(got[i].n_inliers == want[i].n_inliers and got[i].scale == pytest.approx(want[i].scale) for i in want)
    pairs = matching.match_table(ref, tgt)
    placed = matching.errors(matching.coordinates(pairs, ref, tgt), matching.match_pairs(ref, tgt))
    outputs.write_learned(placed, matching.match_learned(ref, tgt), str(tmp_path / "learned"))
    lines = spark.read.csv(str(tmp_path / "learned/matches"), header=True, inferSchema=True)
    assert lines.columns == ["crater_A", "crater_B", "xA", "yA", "rA", "xB", "yB", "rB", "residual_px", "image_id"] and lines.count() == pairs.count()
    assert {r.image_id for r in spark.read.json(str(tmp_path / "learned/transform")).collect()} == {0, 1}
