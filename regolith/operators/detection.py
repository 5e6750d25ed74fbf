"""Craters in images: ring features over a pyramid, a dense scan, scores of a model, suppression, and rims fitted to the gradient.

All of it runs tile by tile: feature tiles carry a margin, circles meet the tile that holds their centre on the level that suits their radius, and a task holds
one tile with its circles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settled
from . import learning, spatial, tiles
from .tiles import KEYS, PLACE, SIDE

# Samples on circles, rings in units of the radius, and the scales of contrast and smoothing.
ANGLES, RINGS = 24, np.linspace(0.4, 1.6, 10)
CONTRAST, SMOOTHING = 20.0, 1.2
#: Pixels around a tile that samples may reach: 1.6 radii of up to 28, the pyramid's largest but on its last level.
MARGIN = 64
_HALO = (len(tiles.gauss(CONTRAST)) + len(tiles.gauss(SMOOTHING))) // 2  # and one for the slopes, in the halves of two odd numbers


def feature_tiles(levels: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Tiles with ln (local contrast), gx and gy (slopes of the smoothed contrast), each with a margin in which the image's border goes on, and mag, the slope's length
    within the tile."""
    w = tiles.gauss(SMOOTHING)

    def kernel(a: np.ndarray, place: dict) -> list[np.ndarray]:
        ln = tiles.contrast(a, CONTRAST)
        gx, gy = tiles.slopes(tiles.smooth(ln, w))
        cut = len(w) // 2 + 1
        ln = ln[cut:-cut, cut:-cut]
        rows, cols = (np.clip(np.arange(t * SIDE - margin, t * SIDE + n + margin), 0, most - 1) - (t * SIDE - margin) for t, n, most in ((place["ty"], place["h"], place["height"]), (place["tx"], place["w"], place["width"])))
        ln, gx, gy = (x[np.ix_(rows, cols)] for x in (ln, gx, gy))
        core = slice(margin, margin + place["h"]), slice(margin, margin + place["w"])
        return [ln, gx, gy, np.hypot(gx[core], gy[core])]

    return tiles.mapped(levels, kernel, margin + _HALO, ("ln", "gx", "gy", "mag"))


def strong_gradient(features: DataFrame) -> DataFrame:
    """image_id, level, g95: the 95th percentile of the slopes' lengths."""
    return features.select("image_id", "level", F.explode("mag").alias("m")).groupBy("image_id", "level").agg((F.percentile("m", 0.95) + 1e-6).alias("g95"))


def _polar(maps: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, r: np.ndarray, rings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contrast, slope outwards and slope's length on rings around circles: arrays of circle, ring, angle."""
    turn = np.arange(ANGLES) * (2 * np.pi / ANGLES)
    co, si = np.cos(turn), np.sin(turn)
    px = x[:, None, None] + r[:, None, None] * rings[:, None] * co
    py = y[:, None, None] + r[:, None, None] * rings[:, None] * si
    ln, gx, gy = (tiles.bilinear(m, px, py) for m in maps)
    return ln, gx * co + gy * si, np.hypot(gx, gy)


def ring_features(ln: np.ndarray, outwards: np.ndarray, length: np.ndarray) -> np.ndarray:
    """147 numbers for each circle, from samples in units of the image's strong gradient: on each ring mean and deviation of the three, and the first four
    harmonics of the first two; and seven of the rim against its inside and outside. None depends on the circle's size or on where the light is."""
    n = len(ln)
    basic = [f for v in (ln, outwards, length) for f in (v.mean(2), v.std(2))]
    waves = [(np.abs(np.fft.rfft(v, axis=2))[:, :, 1:5] / ANGLES).reshape(n, -1) for v in (ln, outwards)]
    rim, inner, outer = length[:, 4:6].mean((1, 2)), ln[:, :4], ln[:, 7:]
    step = inner.mean((1, 2)) - outer.mean((1, 2))
    covered = (np.abs(outwards[:, 4:6]).max(1) > 0.6).mean(1)
    rest = [covered, rim, rim / (length[:, 8:].mean((1, 2)) + 1e-3), rim / (length[:, :3].mean((1, 2)) + 1e-3), step, np.abs(step), inner.std((1, 2)) / (outer.std((1, 2)) + 1e-3)]
    return np.hstack([*basic, *waves, np.stack(rest, 1)])


def placed(circles: DataFrame, sizes: DataFrame) -> DataFrame:
    """circles (image_id, det_id, cx, cy, r) with level, lx, ly, lr on it, ty and tx. sizes: image_id, height, width of level 0."""
    at = circles.join(sizes, "image_id").withColumn("level", tiles.level_for(F.col("r"), tiles.n_levels(F.col("height"), F.col("width"))).cast("bigint")).drop("height", "width")
    scale = F.pow(F.lit(2.0), F.col("level"))
    at = at.withColumns({"lx": (F.col("cx") + 0.5) / scale - 0.5, "ly": (F.col("cy") + 0.5) / scale - 0.5, "lr": F.col("r") / scale})
    return at.withColumns({"ty": F.greatest(F.lit(0), F.floor(F.col("ly") / SIDE)), "tx": F.greatest(F.lit(0), F.floor(F.col("lx") / SIDE))})


def sizes_of(levels: DataFrame) -> DataFrame:
    return levels.where("level = 0").groupBy("image_id").agg(F.max("height").alias("height"), F.max("width").alias("width"))


def with_circles(circles: DataFrame, features: DataFrame, kernel: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str, columns: tuple[str, ...]) -> DataFrame:
    """kernel of each tile's circles (rows with level, ty, tx) and the tile, where both are. A circle whose centre lies outside has no tile and is left out."""

    def run(key: tuple, c: pa.Table, t: pa.Table) -> pa.Table:
        out = kernel(c.to_pandas(), t.to_pylist()[0]) if c.num_rows and t.num_rows else None
        return pa.Table.from_pandas(out, preserve_index=False) if out is not None and len(out) else empty

    frame = circles.sparkSession.createDataFrame([], schema)
    empty = frame.toArrow()
    own = features.select(*PLACE, *columns, *(c for c in ("g95",) if c in features.columns))
    return circles.groupBy(*KEYS).cogroup(own.groupBy(*KEYS)).applyInArrow(run, schema)


def _maps(tile: dict, margin: int = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape = tile["h"] + 2 * margin, tile["w"] + 2 * margin
    return tuple(np.asarray(tile[c]).reshape(shape) for c in ("ln", "gx", "gy"))


def described(circles: DataFrame, features: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, det_id, cx, cy, r and features (147 numbers). features: feature_tiles() with g95 of their level."""

    def kernel(c: pd.DataFrame, tile: dict) -> pd.DataFrame:
        x, y = c["lx"].to_numpy() - tile["tx"] * SIDE + MARGIN, c["ly"].to_numpy() - tile["ty"] * SIDE + MARGIN
        ln, out, length = _polar(_maps(tile), x, y, c["lr"].to_numpy(), RINGS)
        found = ring_features(ln, out / tile["g95"], length / tile["g95"])
        return c[["image_id", "det_id", "cx", "cy", "r"]].assign(features=list(found))

    return with_circles(placed(circles, sizes), features, kernel, "image_id bigint, det_id bigint, cx double, cy double, r double, features array<double>", ("ln", "gx", "gy"))


def scanned(features: DataFrame, sizes: DataFrame, least_r: float, most_r: float, keep: int = 9000, ratio: float = 1.15, stride: float = 0.25) -> DataFrame:
    """image_id, cx, cy, r, ring: the `keep` places of an image with the strongest rings of slopes, over radii that grow by `ratio` and places `stride` radii apart
    (ties: smaller cy, cx, r). features: feature_tiles() with g95."""
    radii = least_r * ratio ** np.arange(max(0, math.floor(math.log(most_r / least_r) / math.log(ratio) + 1e-9) + 1)) if most_r >= least_r else np.zeros(0)
    tops = sizes.select("image_id", (tiles.n_levels(F.col("height"), F.col("width")) - 1).alias("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                scale = 2.0 ** tile["level"]
                maps, x0, y0 = _maps(tile), tile["tx"] * SIDE, tile["ty"] * SIDE
                found: list[np.ndarray] = []
                for r in radii:
                    if min(max(math.floor(math.log2(r / 14.0)), 0), tile["top"]) != tile["level"]:
                        continue
                    step = max(2.5, stride * r / scale)
                    xs, ys = (np.arange(0, most, step) for most in (tile["width"], tile["height"]))
                    x, y = (v.ravel() for v in np.meshgrid(xs[(xs >= x0) & (xs < x0 + tile["w"])], ys[(ys >= y0) & (ys < y0 + tile["h"])]))
                    for at in range(0, len(x), 4096):
                        part = slice(at, at + 4096)
                        _, out, _ = _polar(maps, x[part] - x0 + MARGIN, y[part] - y0 + MARGIN, np.full(len(x[part]), r / scale), np.array([0.9, 1.0, 1.1]))
                        ring = np.abs(out).max(1).mean(1) / tile["g95"]
                        found.append(np.stack([(x[part] + 0.5) * scale - 0.5, (y[part] + 0.5) * scale - 0.5, np.full(len(ring), r), ring], 1))
                if found:
                    # No more than `keep` of a tile can be among the image's.
                    every = np.concatenate(found)
                    every = every[np.lexsort((every[:, 2], every[:, 0], every[:, 1], -every[:, 3]))[:keep]]
                    yield pa.RecordBatch.from_arrays([pa.array([tile["image_id"]] * len(every), pa.int64()), *(pa.array(v) for v in every.T)], names=["image_id", "cx", "cy", "r", "ring"])

    every = features.join(tops, "image_id").select(*PLACE, "ln", "gx", "gy", "g95", "top").mapInArrow(run, "image_id bigint, cx double, cy double, r double, ring double")
    order = Window.partitionBy("image_id").orderBy(F.desc("ring"), "cy", "cx", "r")
    return every.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= keep).drop("turn")


def simplex(cost: Callable[[np.ndarray], float], start: np.ndarray, steps: np.ndarray, x_tol: float, f_tol: float, rounds: int) -> tuple[np.ndarray, float]:
    """Nelder and Mead's search from a corner and its steps."""
    points = np.vstack([start, start + np.diag(steps)])
    values = np.array([cost(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.abs(points[1:] - points[0]).max() <= x_tol and np.abs(values[1:] - values[0]).max() <= f_tol:
            break
        middle = points[:-1].mean(0)
        away = lambda f: middle + f * (middle - points[-1])
        p = away(1.0)
        v = cost(p)
        if v < values[0]:
            far = away(2.0)
            w = cost(far)
            points[-1], values[-1] = (far, w) if w < v else (p, v)
        elif v < values[-2]:
            points[-1], values[-1] = p, v
        else:
            near = away(0.5 if v < values[-1] else -0.5)
            w = cost(near)
            if w < min(v, values[-1]) or v < values[-1] and w <= v:
                points[-1], values[-1] = near, w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [cost(q) for q in points[1:]]
    k = int(values.argmin())
    return points[k], float(values[k])


def rim(mag: np.ndarray, g95: float, cx: float, cy: float, r: float) -> tuple[float, ...]:
    """cx, cy, a, b, angle, r and strength of the ellipse near a circle under whose rim the slope is greatest in the mean, less penalties for long and for far ones."""
    t = np.arange(72) * (2 * np.pi / 72)
    ct, st, log_r = np.cos(t), np.sin(t), math.log(r)

    def cost(p: np.ndarray) -> float:
        a, b, c, s = math.exp(p[2]), math.exp(p[3]), math.cos(p[4]), math.sin(p[4])
        strength = tiles.bilinear(mag, p[0] + a * ct * c - b * st * s, p[1] + a * ct * s + b * st * c).mean() / g95
        sizes = sum(max(0.0, abs(q - log_r) - 0.3) ** 2 for q in p[2:4])
        return -strength + 0.3 * ((a - b) / (a + b)) ** 2 + 3.0 * sizes + 3.0 * max(0.0, math.hypot(p[0] - cx, p[1] - cy) / r - 0.25) ** 2

    p, value = simplex(cost, np.array([cx, cy, log_r, log_r, 0.0]), np.array([0.06 * r, 0.06 * r, 0.06, 0.06, 0.4]), 0.01, 1e-4, 250)
    a, b, turn = math.exp(p[2]), math.exp(p[3]), p[4]
    if b > a:
        a, b, turn = b, a, turn + math.pi / 2
    return p[0], p[1], a, b, math.degrees(turn) % 180, math.sqrt(a * b), -value


def refined(circles: DataFrame, base: DataFrame, most_r: float) -> DataFrame:
    """circles (image_id, det_id, cx, cy, r, conf) as ellipses: cx, cy, a, b, angle_deg, r, rim_strength, fitted on level 0. base: tiles of level 0; most_r: the
    largest radius, which sets the tiles' margin."""
    margin = math.ceil(1.9 * most_r)
    features = feature_tiles(base, margin)
    features = features.join(strong_gradient(features), ["image_id", "level"])
    at = circles.withColumns({"level": F.lit(0).cast("bigint"), "ty": F.floor(F.greatest(F.col("cy"), F.lit(0.0)) / SIDE), "tx": F.floor(F.greatest(F.col("cx"), F.lit(0.0)) / SIDE)})

    def kernel(c: pd.DataFrame, tile: dict) -> pd.DataFrame:
        _, gx, gy = _maps(tile, margin)
        mag, x0, y0 = np.hypot(gx, gy), tile["tx"] * SIDE - margin, tile["ty"] * SIDE - margin
        rows = [rim(mag, tile["g95"], x - x0, y - y0, r) for x, y, r in zip(c["cx"], c["cy"], c["r"])]
        out = pd.DataFrame(rows, columns=["cx", "cy", "a", "b", "angle_deg", "r", "rim_strength"])
        out[["cx", "cy"]] += [x0, y0]
        return pd.concat([c[["image_id", "det_id", "conf"]].reset_index(drop=True), out], axis=1)

    return with_circles(at, features, kernel, "image_id bigint, det_id bigint, conf double, cx double, cy double, a double, b double, angle_deg double, r double, rim_strength double", ("ln", "gx", "gy"))


def prepared(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feature tiles of all levels with g95, and the images' sizes, both kept. base: tiles of level 0."""
    levels = settled(tiles.pyramid(base))
    features = settled(feature_tiles(levels))
    return settled(features.join(strong_gradient(features), ["image_id", "level"])), settled(sizes_of(levels))


def candidates(base: DataFrame, features: DataFrame, sizes: DataFrame, least_r: float, most_r: float, extra: DataFrame | None = None) -> DataFrame:
    """image_id, det_id, cx, cy, r of the scan's places and of extra ones (image_id, cx, cy, r). det_id is a hash of the circle."""
    found = scanned(features, sizes, least_r, most_r).select("image_id", "cx", "cy", "r")
    found = found.unionByName(extra.select("image_id", "cx", "cy", "r")) if extra is not None else found
    return found.distinct().withColumn("det_id", F.xxhash64("cx", "cy", "r"))


def detected(base: DataFrame, model: RandomForestClassificationModel, least: float = 0.5, least_r: float = 10.0, most_r: float = 200.0, extra: DataFrame | None = None, fit: bool = True, ready: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """image_id, det_id, cx, cy, a, b, angle_deg, r, conf, rim_strength: places that the model takes for craters with at least `least`, suppressed, fitted to their
    rims unless fit is off, and suppressed again, as fits may meet on one rim. ready: of prepared()."""
    features, sizes = ready or prepared(base)
    circles = candidates(base, features, sizes, least_r, most_r, extra)
    p = learning.scored(model, described(circles, features, sizes)).where(F.col("p") >= least).select("image_id", "det_id", "cx", "cy", "r", F.col("p").alias("conf"))
    kept = settled(spatial.nms(p))
    if fit:
        return spatial.nms(refined(kept, base, most_r))
    return kept.select("image_id", "det_id", "conf", "cx", "cy", F.col("r").alias("a"), F.col("r").alias("b"), F.lit(0.0).alias("angle_deg"), "r", F.lit(0.0).alias("rim_strength"))


def trained(base: DataFrame, labels: DataFrame, extra: DataFrame | None = None, least_r: float = 8.0, most_r: float = 200.0, trees: int = 400, seed: int = 0, ready: tuple[DataFrame, DataFrame] | None = None) -> RandomForestClassificationModel:
    """A model from labelled circles (image_id, crater_id, cx, cy, r, label, complete) and the images' own background."""
    features, sizes = ready or prepared(base)
    circles = learning.training_set(labels, candidates(base, features, sizes, least_r, most_r, extra), seed=seed)
    numbered = settled(circles.withColumn("det_id", F.xxhash64("cx", "cy", "r", "label", "origin")))
    examples = described(numbered, features, sizes).join(numbered.select("image_id", "det_id", "label", "weight").dropDuplicates(["image_id", "det_id"]), ["image_id", "det_id"])
    return learning.train(settled(examples), trees, seed)


def _voted(out: np.ndarray, dx: np.ndarray, dy: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, r: float) -> None:
    """Adds to out what each pixel votes for on both sides along its slope, r away."""
    for sign in (-1, 1):
        cx, cy = np.rint(x + sign * r * dx).astype(int), np.rint(y + sign * r * dy).astype(int)
        inside = (cx >= 0) & (cx < out.shape[1]) & (cy >= 0) & (cy < out.shape[0])
        out += np.bincount(cy[inside] * out.shape[1] + cx[inside], weight[inside], out.size).reshape(out.shape)


def _longest(covered: np.ndarray) -> np.ndarray:
    """Of rows of truth values around a circle the longest run of true ones, in values."""
    n = covered.shape[1]
    run, best = np.zeros(len(covered), int), np.zeros(len(covered), int)
    for k in range(2 * n):
        run = np.where(covered[:, k % n], run + 1, 0)
        best = np.maximum(best, run)
    return np.minimum(best, n)


def voted_circles(features: DataFrame, sizes: DataFrame, least_r: float = 8.0, most_r: float = 200.0, strong: float = 0.5, least_votes: float = 0.25, ratio: float = 1.1) -> DataFrame:
    """image_id, det_id, cx, cy, r, votes, arc and score: circles that the pixels' slopes agree on, without any model. features: feature_tiles() with g95.

    Pixels whose slope is at least `strong` of the image's strong gradient vote for the centres along it at each radius, on the level that suits the radius; votes are the share of
    the circumference that has voted, smoothed over neighbouring centres. Peaks among neighbouring centres and radii with at least `least_votes` are circles. arc: the
    longest stretch of the rim, of 24 parts, over which the slope across it reaches 0.6; score: that slope's mean along the rim times the share that reaches it.
    A tile's margin holds all of its centres' voters, so tiles leave no trace. det_id is a hash of the circle.
    """
    radii = least_r * ratio ** np.arange(max(0, math.floor(math.log(most_r / least_r) / math.log(ratio) + 1e-9) + 1)) if most_r >= least_r else np.zeros(0)
    tops = sizes.select("image_id", (tiles.n_levels(F.col("height"), F.col("width")) - 1).alias("top"))
    names = ["image_id", "cx", "cy", "r", "votes", "arc", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                scale = 2.0 ** tile["level"]
                level_of = lambda r: min(max(math.floor(math.log2(r / 14.0)), 0), tile["top"])  # noqa: B023, E731
                own = [k for k, r in enumerate(radii) if level_of(r) == tile["level"] and r / scale < MARGIN - 2]
                if not own:
                    continue
                ln, gx, gy = _maps(tile)
                mag = np.hypot(gx, gy) / tile["g95"]
                y, x = np.nonzero(mag >= strong)
                m = mag[y, x]
                dx, dy, weight = gx[y, x] / (m * tile["g95"]), gy[y, x] / (m * tile["g95"]), np.minimum(m, 1.0)
                # One radius more on either side, for the peaks.
                steps = [radii[own[0]] / ratio, *radii[own], radii[own[-1]] * ratio]
                acc = np.zeros((len(steps), *mag.shape))
                for k, r in enumerate(steps):
                    _voted(acc[k], dx, dy, x, y, weight, r / scale)
                    acc[k] /= 2 * np.pi * r / scale
                soft = np.zeros_like(acc)
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        soft[:, 1:-1, 1:-1] += acc[:, 1 + i : acc.shape[1] - 1 + i, 1 + j : acc.shape[2] - 1 + j]
                core = soft[1:-1, MARGIN : MARGIN + tile["h"], MARGIN : MARGIN + tile["w"]]
                near = [soft[1 + a : soft.shape[0] - 1 + a, MARGIN + b : MARGIN + b + tile["h"], MARGIN + c : MARGIN + c + tile["w"]] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a or b or c]
                k, cy, cx = np.nonzero((core >= least_votes) & np.logical_and.reduce([core >= o for o in near]))
                if not len(k):
                    continue
                r = np.array(steps)[k + 1]
                _, out, _ = _polar((ln, gx, gy), cx + float(MARGIN), cy + float(MARGIN), r / scale, np.array([0.9, 1.0, 1.1]))
                across = np.abs(out).max(1) / tile["g95"]
                covered = across > 0.6
                score = across.mean(1) * covered.mean(1)
                places = ((cx + tile["tx"] * SIDE + 0.5) * scale - 0.5, (cy + tile["ty"] * SIDE + 0.5) * scale - 0.5)
                yield pa.RecordBatch.from_arrays([pa.array([tile["image_id"]] * len(k), pa.int64()), *(pa.array(v) for v in (*places, r, core[k, cy, cx])), pa.array(_longest(covered), pa.int64()), pa.array(score)], names=names)

    found = features.join(tops, "image_id").select(*PLACE, "ln", "gx", "gy", "g95", "top").mapInArrow(run, "image_id bigint, cx double, cy double, r double, votes double, arc bigint, score double")
    return found.withColumn("det_id", F.xxhash64("cx", "cy", "r"))


def classic_candidates(features: DataFrame, sizes: DataFrame, least_r: float = 8.0, most_r: float = 200.0, least_score: float = 0.06, least_arc: int = 6, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """All voted_circles() of the images, and the final list (image_id, det_id, cx, cy, r, votes, arc, score): those with a score and an arc of at least so much, suppressed by score, and of
    these the `most` best of each image (ties: smaller det_id)."""
    every = settled(voted_circles(features, sizes, least_r, most_r))
    good = every.where((F.col("score") >= least_score) & (F.col("arc") >= least_arc))
    kept = spatial.nms(good.withColumn("conf", F.col("score"))).drop("conf")
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    return every, kept.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("turn")


def auto_labels(features: DataFrame, sizes: DataFrame, least_r: float = 8.0, most_r: float = 200.0) -> DataFrame:
    """image_id, crater_id, cx, cy, r, label, complete: the final list of classic_candidates(), as first labels where nobody has drawn any."""
    _, final = classic_candidates(features, sizes, least_r, most_r)
    return final.select("image_id", F.col("det_id").alias("crater_id"), "cx", "cy", "r", F.lit(1).alias("label"), F.lit(False).alias("complete"))


def quickly_trained(base: DataFrame, extra: DataFrame | None = None, least_r: float = 8.0, most_r: float = 200.0, trees: int = 400) -> RandomForestClassificationModel:
    """A model from first labels and the images' background, without anything drawn. extra: labels of whole images, which get no others."""
    ready = prepared(base)
    every, final = classic_candidates(*ready, least_r, most_r)
    labels = final.select("image_id", F.col("det_id").alias("crater_id"), "cx", "cy", "r", F.lit(1).alias("label"), F.lit(False).alias("complete"))
    if extra is not None:
        labels = labels.join(extra.select("image_id").distinct(), "image_id", "left_anti").unionByName(extra.select(*labels.columns))
    return trained(base, labels, every, least_r=least_r, most_r=most_r, trees=trees, ready=ready)


def with_catalogues(detections: DataFrame, catalogues: DataFrame) -> DataFrame:
    """Craters of all images: those of the catalogue where an image has one, the detections elsewhere. Both: image_id, crater_id, cx, cy, a, b, angle_deg, r, conf."""
    columns = ["image_id", "crater_id", "cx", "cy", "a", "b", "angle_deg", "r", "conf"]
    rest = detections.join(catalogues.select("image_id").distinct(), "image_id", "left_anti")
    return catalogues.select(*columns).unionByName(rest.select(*columns))


def self_trained(base: DataFrame, model: RandomForestClassificationModel, rounds: int = 2, conf: float = 0.6, least_r: float = 8.0, most_r: float = 200.0, trees: int = 400) -> RandomForestClassificationModel:
    """The model after up to `rounds` rounds in which its own sure detections are the labels. A round counts only if the number of detections stays between 0.95 and
    1.4 of the last one's; else the model stays as it is. The rounds are a loop on the driver over jobs on all images."""
    ready = prepared(base)
    find = lambda m, p: settled(detected(base, m, p, least_r, most_r, fit=False, ready=ready))
    n = find(model, 0.5).count()
    for _ in range(rounds):
        sure = find(model, conf)
        if sure.count() < 3:
            break
        labels = sure.select("image_id", F.col("det_id").alias("crater_id"), "cx", "cy", "r", F.lit(1).alias("label"), F.lit(False).alias("complete"))
        new = trained(base, labels, least_r=least_r, most_r=most_r, trees=trees, ready=ready)
        m = find(new, 0.5).count()
        if not 0.95 * n <= m <= 1.4 * n:
            break
        model, n = new, m
    return model


def final_list(detections: DataFrame, manual: DataFrame, removed: DataFrame) -> DataFrame:
    """image_id, cx, cy, r, conf, source: a user's own craters, and detections that are the same as none of them nor of those that were removed; numbered by falling
    radius within an image (id from 0; ties: smaller cy, cx)."""
    cols = ["image_id", "cx", "cy", "r"]
    rest = spatial.matching(spatial.matching(detections, manual, keep=False), removed, keep=False)
    both = manual.select(*cols, F.lit(1.0).alias("conf"), F.lit("manual").alias("source")).unionByName(rest.select(*cols, "conf", F.lit("ml").alias("source")))
    return both.withColumn("id", (F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("r"), "cy", "cx")) - 1).cast("bigint"))


def pooled(labels: DataFrame, detections: DataFrame, least: float = 0.25) -> DataFrame:
    """image_id, cx, cy, r, source: every crater known in an image. labels: image_id, cx, cy, r, label (1 a crater, 0 none); detections: image_id, det_id, cx, cy, r, conf.

    All craters that a user has drawn; of the detections of at least `least` (a null conf counts as 1), in the order of det_id, each that is the same as nothing marked as no crater,
    as no drawn crater and as no detection taken before it.
    """
    cols = ["image_id", "cx", "cy", "r"]
    sure = detections.where(F.coalesce("conf", F.lit(1.0)) >= least)
    rest = spatial.matching(sure, labels, keep=False)
    # Suppression goes by falling conf, so the order becomes the conf.
    kept = spatial.nms(rest.select(*cols, "det_id", (-F.col("det_id")).cast("double").alias("conf")), of_new=True)
    return labels.where("label = 1").select(*cols, F.lit("manual").alias("source")).unionByName(kept.select(*cols, F.lit("ml").alias("source")))
