"""Registration by keypoints, to compare with: extrema of scale space, histograms of slopes, nearest neighbours with a ratio test, homographies by random draws.

Keypoints are found tile by tile, each with a margin for the scales above and for its descriptor. Descriptors of a pair meet in blocks, and only the two nearest of each leave a
task. Draws are made by a hash of the pair and the draw, so they are the same in any partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settled
from . import tiles
from .fits import homography
from .matching import MATRIX
from .tiles import SIDE
from .triangles import ratio_matches

# Scales in an octave and the first of them, the blur that a picture has already, cells of a descriptor, its bins, and its width in scales.
STEPS, FIRST, GIVEN = 3, 1.6, 0.5
CELLS, BINS, WIDE = 4, 8, 3.0
SIGMAS = FIRST * 2.0 ** (np.arange(STEPS + 3) / STEPS)
#: Pixels that the largest scale of an octave and its descriptor reach.
MARGIN = len(tiles.gauss(float(SIGMAS[-1]))) // 2 + int(np.ceil(1.5 * WIDE * SIGMAS[STEPS] * (CELLS + 1) / 2)) + 4


def _octave(a: np.ndarray, given: float) -> list[np.ndarray]:
    """a blurred to each of SIGMAS, all cut to the same frame."""
    half = len(tiles.gauss(float(SIGMAS[-1]))) // 2
    out = []
    for s in SIGMAS:
        w = tiles.gauss(float(np.sqrt(max(s * s - given * given, 0.01))))
        cut = half - len(w) // 2
        out.append(tiles.smooth(a[cut : a.shape[0] - cut, cut : a.shape[1] - cut], w))
    return out


def _extrema(blurs: list[np.ndarray], least: float, edge: float = 10.0) -> np.ndarray:
    """x, y, step and height of the extrema of the differences between blurs, to a fraction, without weak ones and those along an edge."""
    d = np.stack([b - a for a, b in zip(blurs, blurs[1:])])
    core = d[1:-1, 1:-1, 1:-1]
    around = [d[1 + k : d.shape[0] - 1 + k, 1 + i : d.shape[1] - 1 + i, 1 + j : d.shape[2] - 1 + j] for k in (-1, 0, 1) for i in (-1, 0, 1) for j in (-1, 0, 1) if k or i or j]
    top = (core > 0.5 * least) & np.logical_and.reduce([core >= o for o in around]) | (core < -0.5 * least) & np.logical_and.reduce([core <= o for o in around])
    k, y, x = (v + 1 for v in np.nonzero(top))
    if not len(k):
        return np.zeros((0, 4))
    at = lambda dk, dy, dx: d[k + dk, y + dy, x + dx]
    g = np.stack([at(0, 0, 1) - at(0, 0, -1), at(0, 1, 0) - at(0, -1, 0), at(1, 0, 0) - at(-1, 0, 0)], 1) / 2
    two = 2 * at(0, 0, 0)
    xx, yy, kk = (at(*s) + at(*(-v for v in s)) - two for s in ((0, 0, 1), (0, 1, 0), (1, 0, 0)))
    cross = lambda p, q: (at(*(a + b for a, b in zip(p, q))) + at(*(-a - b for a, b in zip(p, q))) - at(*(a - b for a, b in zip(p, q))) - at(*(b - a for a, b in zip(p, q)))) / 4
    xy, xk, yk = cross((0, 0, 1), (0, 1, 0)), cross((0, 0, 1), (1, 0, 0)), cross((0, 1, 0), (1, 0, 0))
    h = np.stack([np.stack([xx, xy, xk], 1), np.stack([xy, yy, yk], 1), np.stack([xk, yk, kk], 1)], 1)
    fine = np.abs(np.linalg.det(h)) > 1e-12
    step = np.zeros_like(g)
    step[fine] = -np.linalg.solve(h[fine], g[fine][..., None])[..., 0]
    value = at(0, 0, 0) + 0.5 * (g * step).sum(1)
    det = xx * yy - xy * xy
    good = fine & (np.abs(step) < 1).all(1) & (np.abs(value) >= least) & (det > 0) & ((xx + yy) ** 2 * edge < (edge + 1) ** 2 * det)
    return np.stack([x + step[:, 0], y + step[:, 1], k + step[:, 2], np.abs(value)], 1)[good]


def _samples(gx: np.ndarray, gy: np.ndarray, p: np.ndarray, turn: np.ndarray, unit: np.ndarray, side: int, reach: float) -> tuple[np.ndarray, ...]:
    """Lengths and directions of the slopes at side x side places within `reach` units around each point, turned, and the places in units."""
    axis = (np.arange(side) + 0.5) / side * 2 * reach - reach
    v, u = (m.ravel() for m in np.meshgrid(axis, axis, indexing="ij"))
    co, si = np.cos(turn)[:, None], np.sin(turn)[:, None]
    x = p[:, :1] + unit[:, None] * (u * co - v * si)
    y = p[:, 1:2] + unit[:, None] * (u * si + v * co)
    a, b = tiles.bilinear(gx, x, y), tiles.bilinear(gy, x, y)
    return np.hypot(a, b), np.arctan2(b, a), u, v


def _directions(blurs: list[np.ndarray], p: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which point, and the directions in which its surroundings slope most: the highest of 36, and others of at least 0.8 of it."""
    who, turn = [], []
    for k in np.unique(level):
        mine = np.flatnonzero(level == k)
        gy, gx = np.gradient(blurs[k])
        sigma = SIGMAS[k] * 1.5
        size, angle, u, v = _samples(gx, gy, p[mine], np.zeros(len(mine)), np.full(len(mine), sigma), 24, 3.0)
        weight = size * np.exp(-(u * u + v * v) / 2)
        cell = np.floor(angle / (2 * np.pi) * 36).astype(int) % 36
        hist = np.zeros((len(mine), 36))
        np.add.at(hist, (np.arange(len(mine))[:, None], cell), weight)
        hist = (np.roll(hist, 1, 1) + hist + np.roll(hist, -1, 1)) / 3
        left, right = np.roll(hist, 1, 1), np.roll(hist, -1, 1)
        row, peak = np.nonzero((hist > left) & (hist > right) & (hist >= 0.8 * hist.max(1, keepdims=True)))
        a, b, c = left[row, peak], hist[row, peak], right[row, peak]
        who.append(mine[row])
        turn.append((peak + 0.5 + 0.5 * (a - c) / (a - 2 * b + c + 1e-12)) * (2 * np.pi / 36))
    return (np.concatenate(who), np.concatenate(turn)) if who else (np.zeros(0, int), np.zeros(0))


def _descriptors(blurs: list[np.ndarray], p: np.ndarray, level: np.ndarray, turn: np.ndarray) -> np.ndarray:
    out = np.zeros((len(p), CELLS * CELLS * BINS))
    for k in np.unique(level):
        gy, gx = np.gradient(blurs[k])
        for at in np.array_split(np.flatnonzero(level == k), max(1, (level == k).sum() // 256)):
            size, angle, u, v = _samples(gx, gy, p[at], turn[at], np.full(len(at), WIDE * SIGMAS[k]), 16, (CELLS + 1) / 2)
            weight = size * np.exp(-(u * u + v * v) / (2 * (CELLS / 2) ** 2))
            bins = ((angle - turn[at][:, None]) / (2 * np.pi) * BINS) % BINS
            hist = np.zeros((len(at), CELLS, CELLS, BINS))
            row = np.arange(len(at))[:, None]
            cy, cx = v + CELLS / 2 - 0.5, u + CELLS / 2 - 0.5
            for dy in (0, 1):
                for dx in (0, 1):
                    iy, ix = np.floor(cy).astype(int) + dy, np.floor(cx).astype(int) + dx
                    share = (1 - np.abs(cy - iy)) * (1 - np.abs(cx - ix)) * ((iy >= 0) & (iy < CELLS) & (ix >= 0) & (ix < CELLS))
                    iy, ix = np.clip(iy, 0, CELLS - 1), np.clip(ix, 0, CELLS - 1)
                    low = np.floor(bins).astype(int)
                    for db in (0, 1):
                        np.add.at(hist, (row, iy[None], ix[None], (low + db) % BINS), weight * share * (1 - np.abs(bins - low - db)))
            flat = hist.reshape(len(at), -1)
            flat = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
            flat = np.minimum(flat, 0.2)
            out[at] = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)
    return out


def keypoints(base: DataFrame, most: int = 4000, contrast: float = 0.01) -> DataFrame:
    """image_id, i, x, y, sigma, turn, height and v (128 numbers) of the `most` highest extrema of each image (ties: smaller y, x, turn), numbered from 0. base: tiles of level
    0, values 0 to 255. An image without any has no rows."""
    least = contrast * 255 / STEPS
    half = len(tiles.gauss(float(SIGMAS[-1]))) // 2

    def kernel(a: np.ndarray, place: dict) -> list[np.ndarray]:
        blurs = _octave(a, GIVEN if place["level"] == 0 else FIRST / 2)
        rest = MARGIN - half
        found = _extrema(blurs, least)
        own = (found[:, 0] >= rest) & (found[:, 0] < rest + place["w"]) & (found[:, 1] >= rest) & (found[:, 1] < rest + place["h"])
        found = found[own]
        level = np.clip(np.rint(found[:, 2]).astype(int), 0, len(SIGMAS) - 1)
        who, turn = _directions(blurs, found[:, :2], level)
        found, level = found[who], level[who]
        v = _descriptors(blurs, found[:, :2], level, turn)
        scale = 2.0 ** place["level"]
        x, y = ((found[:, k] - rest + place[t] * SIDE + 0.5) * scale - 0.5 for k, t in ((0, "tx"), (1, "ty")))
        return [x, y, FIRST * 2.0 ** (found[:, 2] / STEPS) * scale, turn, found[:, 3], v]

    names = ("x", "y", "sigma", "turn", "height_", "v")
    levels = tiles.pyramid(base, least_side=2 * MARGIN).withColumn("lv", F.col("level"))
    each = tiles.mapped(levels, lambda a, p: kernel(a, p | {"level": p["lv"]}), MARGIN, names, extra=("lv",))
    n = CELLS * CELLS * BINS
    each = each.select("image_id", "v", F.posexplode(F.arrays_zip(*names[:-1])).alias("k", "p")).select("image_id", "p.*", F.slice("v", F.col("k") * n + 1, n).alias("v"))
    order = Window.partitionBy("image_id").orderBy(F.desc("height_"), "y", "x", "turn")
    top = each.withColumn("i", F.row_number().over(order) - 1).where(F.col("i") < most)
    return top.select("image_id", F.col("i").cast("bigint").alias("i"), "x", "y", "sigma", "turn", F.col("height_").alias("height"), "v")


def drawn(xy: np.ndarray, uv: np.ndarray, seed: int, draws: int = 2000, within: float = 4.0) -> tuple[np.ndarray | None, np.ndarray]:
    """The homography of the most pairs within `within` of those by four drawn pairs each, fitted to its pairs until they stay the same; and which pairs."""
    g = np.random.Generator(np.random.PCG64(seed & (2**63 - 1)))
    pick = g.integers(0, len(xy), (draws, 4))
    pick = pick[(np.sort(pick, 1)[:, 1:] > np.sort(pick, 1)[:, :-1]).all(1)]
    x, y, u, v = xy[pick, 0], xy[pick, 1], uv[pick, 0], uv[pick, 1]
    one, nil = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([x, y, one, nil, nil, nil, -u * x, -u * y], 2), np.stack([nil, nil, nil, x, y, one, -v * x, -v * y], 2)], 1)
    fine = np.abs(np.linalg.det(rows)) > 1e-6
    if not fine.any():
        return None, np.zeros(len(xy), bool)
    h = np.linalg.solve(rows[fine], np.concatenate([u, v], 1)[fine][..., None])[..., 0]
    h = np.concatenate([h, np.ones((len(h), 1))], 1).reshape(-1, 3, 3)
    p = np.column_stack([xy, np.ones(len(xy))])

    def near(h: np.ndarray) -> np.ndarray:
        q = p @ np.swapaxes(h, -1, -2)
        with np.errstate(all="ignore"):
            off = q[..., :2] / q[..., 2:] - uv
            return (off**2).sum(-1) < within * within

    counts = np.concatenate([near(part).sum(1) for part in np.array_split(h, max(1, len(h) * len(xy) // (1 << 20)))])
    best = h[int(counts.argmax())]
    hit = near(best)
    for _ in range(10):
        new = homography(xy[hit], uv[hit])
        if new is None or (fresh := near(new)).sum() < hit.sum():
            break
        best, same = new, bool((fresh == hit).all())
        hit = fresh
        if same:
            break
    return best, hit


def baseline(ref: DataFrame, tgt: DataFrame, matrices: DataFrame | None = None, most: int = 4000, contrast: float = 0.01, ratio: float = 0.8, draws: int = 2000) -> DataFrame:
    """image_id, matches, inliers, inlier_ratio, median_disagreement, agrees, note and h00..h22 for every pair: what keypoints alone make of it.

    ref, tgt: tiles of level 0 by the pairs' image_id; matrices: image_id, t00..t22 to compare with, at 25 places of the reference. It agrees if the median distance is under 6
    pixels and there are 12 inliers at least. Pairs with fewer than eight keypoints on a side or eight matches have a note and no homography.
    """
    a, b = (settled(keypoints(df, most, contrast)) for df in (ref, tgt))
    size = ref.groupBy("image_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    many = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    pairs = size.join(tgt.select("image_id").distinct(), "image_id", "left_semi").join(many(a, "na"), "image_id", "left").join(many(b, "nb"), "image_id", "left")
    pairs = pairs.join(matrices.select("image_id", *MATRIX), "image_id", "left") if matrices is not None else pairs.withColumns({c: F.lit(None).cast("double") for c in MATRIX})
    found = ratio_matches(a.select("image_id", "i", "v"), b.select("image_id", "i", "v"), ratio)
    placed = found.join(a.select("image_id", "i", "x", "y"), ["image_id", "i"]).join(b.select("image_id", F.col("i").alias("j"), F.col("x").alias("u"), F.col("y").alias("v")), ["image_id", "j"])
    rows = pairs.join(placed.select("image_id", "i", "x", "y", "u", "v"), "image_id", "left")
    names = [f"h{i}{j}" for i in range(3) for j in range(3)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.iloc[0]
        m = pdf.dropna(subset=["x"]).sort_values("i")
        none = [None] * 9
        few = "too few features" if not (p.na >= 8 and p.nb >= 8) else "too few matches" if len(m) < 8 else None
        h, hit = (None, np.zeros(0, bool)) if few else drawn(m[["x", "y"]].to_numpy(), m[["u", "v"]].to_numpy(), int(key[0]), draws)
        if h is None:
            return pd.DataFrame([(*key, 0 if few == "too few features" else len(m), 0, 0.0, None, False, few or "no homography", *none)])
        n, apart = int(hit.sum()), None
        t = p[MATRIX].to_numpy(float).reshape(3, 3)
        if np.isfinite(t).all():
            x, y = (g.ravel() for g in np.meshgrid(np.linspace(0.15, 0.85, 5) * p.width, np.linspace(0.15, 0.85, 5) * p.height))
            q, w = (np.column_stack([x, y, np.ones(25)]) @ k.T for k in (h, t))
            apart = float(np.median(np.hypot(*(q[:, :2] / q[:, 2:] - w[:, :2] / w[:, 2:]).T)))
        return pd.DataFrame([(*key, len(m), n, round(n / len(m), 3), apart, bool(apart is not None and apart < 6 and n >= 12), None, *h.ravel())])

    schema = f"image_id bigint, matches bigint, inliers bigint, inlier_ratio double, median_disagreement double, agrees boolean, note string, {', '.join(f'{c} double' for c in names)}"
    return rows.groupBy("image_id").applyInPandas(run, schema)
