"""Rasters as rows (image_id, y, x, v), filtered by way of tiles; products of a registered pair; patches compared by correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles
from .detection import MARGIN, _maps, feature_tiles, strong_gradient
from .tiles import KEYS, PLACE, SIDE


def _pixels(df: DataFrame, columns: Sequence[str] = ("v",)) -> DataFrame:
    return tiles.pixels_of(df, columns).drop("level")


def blurred(px: DataFrame, sigma: float = 1.2) -> DataFrame:
    return _pixels(tiles.blurred(tiles.tiled(px), sigma))


def sobel(px: DataFrame) -> DataFrame:
    """image_id, y, x, gx, gy (3 x 3 Sobel over 8) and their length mag."""
    return _pixels(tiles.sobel(tiles.tiled(px)), ("gx", "gy", "mag"))


def gradient_bound(px: DataFrame) -> DataFrame:
    """image_id, g95: the 95th percentile of the gradient's length."""
    return sobel(px).groupBy("image_id").agg((F.percentile("mag", 0.95) + 1e-6).alias("g95"))


def local_norm(px: DataFrame, sigma: float = 20.0) -> DataFrame:
    """(v - mean) / sqrt(max(variance, 4)) with Gaussian moments."""
    return _pixels(tiles.local_norm(tiles.tiled(px), sigma))


def halved(px: DataFrame) -> DataFrame:
    return _pixels(tiles.halved(tiles.tiled(px)))


def eroded(px: DataFrame, half: int = 4) -> DataFrame:
    return _pixels(tiles.eroded(tiles.tiled(px), half))


def sampled(points: DataFrame, px: DataFrame) -> DataFrame:
    return tiles.sampled(points, tiles.tiled(px))


def gray(colour: DataFrame) -> DataFrame:
    """image_id, y, x, v of rows with b, g and r (0 to 255): the usual weights, rounded."""
    return colour.select("image_id", "y", "x", F.floor(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r") + 0.5).alias("v"))


def harmonics(samples: DataFrame, keys: Sequence[str], n: int, most: int = 4) -> DataFrame:
    """keys, mean, std (of the population) and h1.. of n equally spaced samples (angle 0..n-1, v): lengths of the first Fourier coefficients over n."""
    turn = lambda k: F.col("angle") * (2 * math.pi * k / n)
    sums = [x for k in range(1, most + 1) for x in (F.sum(F.col("v") * F.cos(turn(k))).alias(f"c{k}"), F.sum(F.col("v") * F.sin(turn(k))).alias(f"s{k}"))]
    out = samples.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), *sums)
    return out.select(*keys, "mean", "std", *((F.sqrt(F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}")) / float(n)).alias(f"h{k}") for k in range(1, most + 1)))


def correlated(patches: DataFrame, shifted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, shift, score: normalised cross-correlation of a patch (keys, pos, v) with shifted ones (keys, shift, pos, w)."""
    joined = patches.join(shifted, [*keys, "pos"])
    return joined.groupBy(*keys, "shift").agg(F.corr("v", "w").alias("score"))


def best_shift(scores: DataFrame, keys: Sequence[str], least: float = 0.3) -> DataFrame:
    """keys, shift, score of the best correlation (ties: smaller shift), if at least `least`."""
    best = scores.where(F.col("score").isNotNull()).groupBy(*keys).agg(F.max(F.struct("score", (-F.col("shift")).alias("turn"))).alias("b"))
    return best.select(*keys, (-F.col("b.turn")).alias("shift"), F.col("b.score").alias("score")).where(F.col("score") >= least)


# ------------------------------------------------------------------ a target in its reference's frame


def tiles_under(new: DataFrame, target: DataFrame, matrices: DataFrame, slack: int = 2) -> DataFrame:
    """Rows of new (PLACE columns and v, which becomes own) for each tile of the target (sy, sx, sh, sw, v; th, tw: the target's size) that lies under its corners' image and
    `slack` pixels around; one row with nulls where none does. matrices: image_id, t00..t22 from new to target; they come along."""
    new = new.select(*PLACE, F.col("v").alias("own")).join(matrices, "image_id")

    def at(x: Column, y: Column) -> tuple[Column, Column]:
        m = [F.col(c) for c in _MATRIX]
        w = m[6] * x + m[7] * y + m[8]
        return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w

    ends = [at(F.col("tx") * SIDE + F.col("w") * i, F.col("ty") * SIDE + F.col("h") * j) for i in (0, 1) for j in (0, 1)]
    size = target.groupBy("image_id").agg(F.max("height").alias("th"), F.max("width").alias("tw"))
    last = lambda n: F.ceil(F.col(n) / SIDE) - 1
    bound = lambda k, n: (F.greatest(F.lit(0), F.floor((F.least(*(e[k] for e in ends)) - slack) / SIDE)).cast("bigint"), F.least(last(n), F.floor((F.greatest(*(e[k] for e in ends)) + slack) / SIDE)).cast("bigint"))
    (x0, x1), (y0, y1) = bound(0, "tw"), bound(1, "th")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array(F.lit(-1).cast("bigint")))
    want = new.join(size, "image_id").withColumns({"xs": span(x0, x1), "ys": span(y0, y1)}).withColumn("sy", F.explode("ys")).withColumn("sx", F.explode("xs")).drop("xs", "ys")
    source = target.select("image_id", F.col("ty").alias("sy"), F.col("tx").alias("sx"), F.col("h").alias("sh"), F.col("w").alias("sw"), "v")
    return want.join(source, ["image_id", "sy", "sx"], "left")


_MATRIX = [f"t{i}{j}" for i in range(3) for j in range(3)]


def warped(target: DataFrame, matrices: DataFrame, frames: DataFrame) -> DataFrame:
    """Tiles of the target's pixels in the reference's frame, with v (bilinear, 0 beyond the target) and valid (1 where the nearest pixel is the target's).

    target: tiles of level 0; matrices: image_id and t00..t22 from the reference to the target; frames: image_id, height, width of the reference. Each new tile
    meets those of the target under its corners' image, which hold all of its places.
    """
    axis = lambda n: F.sequence(F.lit(0).cast("bigint"), (F.ceil(F.col(n) / SIDE) - 1).cast("bigint"))
    new = frames.select("image_id", "height", "width", F.explode(axis("height")).alias("ty")).select("*", F.explode(axis("width")).alias("tx"))
    side = lambda t, n: F.least(F.lit(SIDE), F.col(n) - F.col(t) * SIDE).cast("bigint")
    new = new.select("image_id", F.lit(0).cast("bigint").alias("level"), "ty", "tx", side("ty", "height").alias("h"), side("tx", "width").alias("w"), "height", "width", F.lit(None).cast("array<double>").alias("v"))
    t = _MATRIX
    met = tiles_under(new, target, matrices.select("image_id", *t)).drop("own")

    def run(key: tuple, unit: pa.Table) -> pa.Table:
        rows = unit.to_pylist()
        p, have = rows[0], [r for r in rows if r["v"] is not None]
        y, x = np.mgrid[p["ty"] * SIDE : p["ty"] * SIDE + p["h"], p["tx"] * SIDE : p["tx"] * SIDE + p["w"]].astype(float)
        m = np.array([p[c] for c in t]).reshape(3, 3)
        w = m[2, 0] * x + m[2, 1] * y + m[2, 2]
        u, v = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / w, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / w
        out, valid = np.zeros(x.shape), np.zeros(x.shape)
        if have:
            top, left = min(r["sy"] for r in have) * SIDE, min(r["sx"] for r in have) * SIDE
            part = np.zeros((max(r["sy"] * SIDE + r["sh"] for r in have) - top + 2, max(r["sx"] * SIDE + r["sw"] for r in have) - left + 2))
            for r in have:
                b, a = r["sy"] * SIDE - top + 1, r["sx"] * SIDE - left + 1
                part[b : b + r["sh"], a : a + r["sw"]] = np.asarray(r["v"]).reshape(r["sh"], r["sw"])
            near = (u > -1) & (u < p["tw"]) & (v > -1) & (v < p["th"])
            out = np.where(near, tiles.bilinear(part, u - left + 1, v - top + 1), 0.0)
            ru, rv = np.rint(u), np.rint(v)
            valid = ((ru >= 0) & (ru < p["tw"]) & (rv >= 0) & (rv < p["th"])).astype(float)
        return pa.table([*(pa.array([p[c]], pa.int64()) for c in PLACE), pa.array([out.ravel()], pa.list_(pa.float64())), pa.array([valid.ravel()], pa.list_(pa.float64()))], names=[*PLACE, "v", "valid"])

    return met.groupBy(*KEYS).applyInArrow(run, ", ".join([*(f"{c} bigint" for c in PLACE), "v array<double>, valid array<double>"]))


def products(ref: DataFrame, registered: DataFrame) -> DataFrame:
    """image_id, y, x, registered (the target where it is valid, else 0), grey (reference), red (the registered target where it is valid, else the reference), checker (tiles of 48 pixels of either) and difference (of
    local contrast, 0 to 255; 0 where the target is not valid). ref: tiles of level 0; registered: warped()."""
    both = tiles.pixels_of(ref.join(registered.select(*KEYS, F.col("v").alias("t"), "valid"), KEYS), ("v", "t", "valid"))
    norm = lambda df, name: tiles.pixels_of(tiles.local_norm(df)).withColumnRenamed("v", name)
    at = ["image_id", "level", "y", "x"]
    p = both.join(norm(ref, "a"), at).join(norm(registered.drop("valid"), "b"), at)
    there = F.col("valid") > 0
    odd = (F.expr("y div 48") + F.expr("x div 48")) % 2 == 1
    difference = F.floor(F.least(F.lit(255.0), F.abs(F.col("a") - F.col("b")) / 3 * 255))
    return p.select("image_id", "y", "x", F.col("v").alias("grey"), F.when(there, F.col("t")).otherwise(F.col("v")).alias("red"), F.when(there & odd, F.col("t")).otherwise(F.col("v")).alias("checker"), F.when(there, F.col("t")).otherwise(0.0).alias("registered"), F.when(there, difference).otherwise(0.0).alias("difference"))


def relit(px: DataFrame, seed: int = 0) -> DataFrame:
    """Rasters (0 to 255) as under another Sun, by numbers drawn from a hash of image and seed: gamma, a ramp of brightness, contrast, blur if strong enough, noise."""
    unit = lambda salt, *key: (F.pmod(F.xxhash64("image_id", F.lit(seed), F.lit(salt), *key), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    between = lambda salt, a, b: a + (b - a) * unit(salt)
    size = px.groupBy("image_id").agg(F.greatest(F.max("y"), F.max("x")).alias("most"))
    g = px.join(size, "image_id")
    turn = 2 * math.pi * unit(2)
    ramp = 1 + between(3, 0.15, 0.7) * ((F.col("x") * F.cos(turn) + F.col("y") * F.sin(turn)) / (F.col("most") + 1) - 0.5)
    v = (F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / 255.0)), between(1, 0.6, 1.7)) * ramp - 0.5) * between(4, 0.6, 1.4) + 0.5
    lit = g.select("image_id", "y", "x", v.alias("v"))
    # Each image's own blur, drawn from 0 to 1.2 and left out up to 0.3.
    drawn = tiles.tiled(lit).withColumn("sigma", between(5, 0.0, 1.2))
    margin = len(tiles.gauss(1.2)) // 2

    def soften(a: np.ndarray, place: dict) -> list[np.ndarray]:
        w = tiles.gauss(place["sigma"])
        cut = margin - len(w) // 2
        return [tiles.smooth(a[cut : a.shape[0] - cut, cut : a.shape[1] - cut], w)]

    soft = _pixels(tiles.mapped(drawn.where("sigma > 0.3"), soften, margin, extra=("sigma",))).withColumnRenamed("v", "soft")
    normal = F.sqrt(-2.0 * F.log(unit(6, "y", "x"))) * F.cos(2 * math.pi * unit(7, "y", "x"))
    both = lit.join(soft, ["image_id", "y", "x"], "left").withColumn("w", F.coalesce("soft", "v") + normal * between(8, 0.0, 0.03))
    return both.select("image_id", "y", "x", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w"))) * 255).alias("v"))


def _peak(area: np.ndarray, patch: np.ndarray) -> tuple[float, float, float] | None:
    """Score and place of the best normalised correlation of a patch within an area, to a fraction of a pixel by a parabola in each axis."""
    views = np.lib.stride_tricks.sliding_window_view(area, patch.shape)
    p = patch - patch.mean()
    mean = views.mean((2, 3))
    top = np.einsum("ijkl,kl->ij", views, p)
    below = np.sqrt(np.maximum(np.einsum("ijkl,ijkl->ij", views, views) - mean * mean * patch.size, 0) * (p * p).sum())
    score = np.where(below > 1e-12, top / np.maximum(below, 1e-12), 0.0)
    y, x = np.unravel_index(int(score.argmax()), score.shape)

    def part(a: float, b: float, c: float) -> float:
        return 0.5 * (a - c) / (a - 2 * b + c + 1e-12)

    dx = part(*score[y, x - 1 : x + 2]) if 0 < x < score.shape[1] - 1 else 0.0
    dy = part(*score[y - 1 : y + 2, x]) if 0 < y < score.shape[0] - 1 else 0.0
    return float(score[y, x]), x + dx, y + dy


def residual_nodes(ref: DataFrame, registered: DataFrame, n: int = 10, half: int = 20, search: int = 14, least: float = 0.3) -> DataFrame:
    """image_id, x, y, dx, dy, score, rejected: what is left of the shift at the places of an n x n lattice: patches of the registered target, by local contrast or by
    slope, whichever agrees better, are looked for around their place in the reference. Places near invalid pixels or without an agreeing patch
    are left out; rejected are peaks at the window's edge. ref: tiles of level 0; registered: warped()."""
    reach = half + search
    a, b = (feature_tiles(df.select(*PLACE, "v")) for df in (ref, registered))
    inner = F.expr(f"filter(ln, (v, k) -> k div (w + {2 * MARGIN}) between {MARGIN} and {MARGIN} + h - 1 and k % (w + {2 * MARGIN}) between {MARGIN} and {MARGIN} + w - 1)")
    ga, gb = strong_gradient(a).drop("level"), strong_gradient(b).drop("level")
    clipped = F.transform("mag", lambda m: F.least(F.lit(255.0), m / F.col("g95") * 60))
    each = a.join(ga, "image_id").select("image_id", F.explode(F.arrays_zip(inner.alias("ln"), clipped.alias("mag"))).alias("p"))
    noise = each.groupBy("image_id").agg(F.stddev_pop("p.ln").alias("s_ln"), F.stddev_pop("p.mag").alias("s_mag"))
    able = tiles.eroded(registered.select(*PLACE, F.col("valid").alias("v")), reach).select(*KEYS, F.col("v").alias("able"))
    size = ref.groupBy("image_id").agg(F.max("height").alias("hh"), F.max("width").alias("ww"))
    size = size.where((F.col("hh") - reach - 3 > reach + 2) & (F.col("ww") - reach - 3 > reach + 2))
    step = lambda k, most: F.round(F.lit(reach + 2.0) + (F.col(most) - (2 * reach + 5)) * F.col(k) / (n - 1)).cast("bigint")
    nodes = size.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
    nodes = nodes.select("image_id", step("j", "ww").alias("x"), step("i", "hh").alias("y"), F.lit(0).cast("bigint").alias("level")).withColumns({"ty": F.expr(f"y div {SIDE}"), "tx": F.expr(f"x div {SIDE}")})
    sides = a.select(*PLACE, "ln", "gx", "gy").join(b.select(*KEYS, *(F.col(c).alias(f"r_{c}") for c in ("ln", "gx", "gy"))), KEYS).join(able, KEYS).join(ga.withColumnRenamed("g95", "ga"), "image_id").join(gb.withColumnRenamed("g95", "gb"), "image_id").join(noise, "image_id")
    columns = ["image_id", "x", "y", "dx", "dy", "score", "rejected"]

    def run(key: tuple, c: pa.Table, t: pa.Table) -> pa.Table:
        rows = []
        if c.num_rows and t.num_rows:
            tile = t.to_pylist()[0]
            own, other = _maps(tile), _maps(tile | {k: tile[f"r_{k}"] for k in ("ln", "gx", "gy")})
            pairs = [(own[0], other[0], tile["s_ln"]), tuple(np.minimum(np.hypot(m[1], m[2]) / g * 60, 255) for m, g in ((own, tile["ga"]), (other, tile["gb"]))) + (tile["s_mag"],)]
            fine = np.asarray(tile["able"]).reshape(tile["h"], tile["w"])
            for x, y in zip(c["x"].to_pylist(), c["y"].to_pylist()):
                if not fine[y - tile["ty"] * SIDE, x - tile["tx"] * SIDE]:
                    continue
                px, py, best = x - tile["tx"] * SIDE + MARGIN, y - tile["ty"] * SIDE + MARGIN, None
                for base, moved, spread_ in pairs:
                    patch = moved[py - half : py + half + 1, px - half : px + half + 1]
                    if patch.std() >= 0.1 * (spread_ + 1e-6):
                        found = _peak(base[py - reach : py + reach + 1, px - reach : px + reach + 1], patch)
                        best = found if best is None or found[0] > best[0] else best
                if best is not None and best[0] >= least:
                    dx, dy = best[1] - search, best[2] - search
                    rows.append((tile["image_id"], x, y, dx, dy, best[0], max(abs(dx), abs(dy)) > search - 1.5))
        return pa.Table.from_pandas(pd.DataFrame(rows, columns=columns).astype({"image_id": "int64", "x": "int64", "y": "int64", "dx": float, "dy": float, "score": float, "rejected": bool}), preserve_index=False)

    return nodes.groupBy(*KEYS).cogroup(sides.groupBy(*KEYS)).applyInArrow(run, "image_id bigint, x bigint, y bigint, dx double, dy double, score double, rejected boolean")
