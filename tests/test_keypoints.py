"""Keypoints, their matches and the homographies of random draws, on turned pictures and against plain numpy."""

import numpy as np
import pytest

from regolith.checkpoints import settled
from regolith.operators import keypoints, tiles, triangles
from tests.test_images import frame_of
from tests.test_registration import given, turned

def ground(seed, height=420, width=400):
    """A picture with something to see at several scales."""
    g = np.random.default_rng(seed)
    out = np.zeros((height, width))
    for sigma in (2.0, 4.0, 8.0):
        w = tiles.gauss(sigma)
        soft = tiles.smooth(g.normal(size=(height + len(w) - 1, width + len(w) - 1)), w)
        out += soft / soft.std()
    return np.clip(128 + 25 * out, 0, 255)


M = np.array([[0.85, -0.3, 110], [0.3, 0.85, -20], [0, 0, 1]])


def test_ratio_matches_against_all_distances(spark, monkeypatch):
    """In small blocks, with ties, an image with one partner, and one without any."""
    monkeypatch.setattr(triangles, "_VECTORS", 7)
    g = np.random.default_rng(0)
    left = [(i, k, g.normal(size=5).round(1).tolist()) for i in range(4) for k in range(30)]
    right = [(i, k + 100, [v + g.normal() * 0.05 for v in left[i * 30 + k][2]] if k % 3 else g.normal(size=5).tolist()) for i in range(2) for k in range(29)] + [(2, 0, [0.0] * 5)]
    right += [(0, 500, right[1][2])]
    want = set()
    for i, k, v in left:
        d = sorted((float(np.sqrt(np.square(np.subtract(v, w)).sum())), j) for m, j, w in right if m == i)
        if len(d) > 1 and d[0][0] < 0.8 * d[1][0]:
            want.add((i, k, d[0][1], round(d[0][0], 9)))
    frame = lambda r: spark.createDataFrame(r, "image_id bigint, i bigint, v array<double>")
    assert {(r.image_id, r.i, r.j, round(r.d, 9)) for r in triangles.ratio_matches(frame(left), frame(right)).collect()} == want and len(want) > 15


def test_draws_find_the_homography_among_wrong_pairs():
    g = np.random.default_rng(1)
    h = np.array([[0.9, 0.1, 20], [-0.2, 1.1, 5], [1e-4, -2e-4, 1]])
    xy = g.uniform(0, 500, (120, 2))
    q = np.column_stack([xy, np.ones(120)]) @ h.T
    uv = q[:, :2] / q[:, 2:] + g.normal(0, 0.3, (120, 2))
    uv[:70] = g.uniform(0, 500, (70, 2))
    found, hit = keypoints.drawn(xy, uv, 7)
    assert hit[70:].all() and hit.sum() < 55 and np.allclose(found / found[2, 2], h, rtol=0.05, atol=1e-2)
    again, _ = keypoints.drawn(xy, uv, 7)
    assert np.array_equal(found, again)


def test_keypoints_go_along_with_the_picture(spark):
    """Most keypoints of the middle have one at their image under the turn, with its scale and direction turned."""
    a = ground(5)
    b = turned(a, M, (460, 470))
    ka, kb = (keypoints.keypoints(tiles.tiled(frame_of(spark, p))).toPandas() for p in (a, b))
    assert len(ka) > 100 and all(abs(np.linalg.norm(v) - 1) < 1e-9 and len(v) == 128 for v in ka["v"])
    inner = ka[(ka.x.between(80, 320)) & (ka.y.between(80, 320)) & (ka.sigma > 2)]
    near = 0
    for r in inner.itertuples():
        u, v = M[:2, :2] @ [r.x, r.y] + M[:2, 2]
        hit = kb[(np.hypot(kb.x - u, kb.y - v) < 1.5) & (np.abs(np.log(kb.sigma / r.sigma / np.hypot(0.85, 0.3))) < 0.3)]
        near += bool((np.abs(np.angle(np.exp(1j * (hit.turn - r.turn - np.arctan2(0.3, 0.85))))) < 0.3).any())
    assert len(inner) > 30 and near > 0.6 * len(inner)


def test_the_baseline_agrees_with_the_truth_and_not_with_a_lie(spark):
    a = ground(5)
    other = ground(99)
    flat = np.full((420, 400), 100.0)
    b = turned(a, M, (460, 470))
    ref = settled(tiles.tiled(frame_of(spark, a, a, a, flat)))
    tgt = settled(tiles.tiled(frame_of(spark, b, b, turned(other, M, (460, 470)), flat)))
    lie = M.copy()
    lie[:2, 2] += 30
    truth = given(spark, M).unionByName(given(spark, lie, image=1)).unionByName(given(spark, M, image=2)).unionByName(given(spark, M, image=3))
    rows = {r.image_id: r for r in keypoints.baseline(ref, tgt, truth).collect()}
    assert rows[0].agrees and rows[0].inliers >= 20 and rows[0].median_disagreement < 1
    assert not rows[1].agrees and rows[1].median_disagreement == pytest.approx(np.hypot(30, 30), abs=2)
    assert not rows[2].agrees and rows[2].inliers < 12
    assert rows[3].note == "too few features" and rows[3].h00 is None and rows[3].matches == 0
