"""Rasters as tiles: rows (image_id, level, ty, tx, h, w, height, width, v) with a tile's pixels in v, row by row.

A filter runs on a tile with a margin of its neighbours' pixels: strips as wide as the margin, which meet in one group of bounded size; beyond the image's border
pixels are mirrored without repeating the border's own. Images of any size are so many groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import settled

#: Pixels of a tile's side.
SIDE = 256
KEYS = ["image_id", "level", "ty", "tx"]
PLACE = ["image_id", "level", "ty", "tx", "h", "w", "height", "width"]
_SCHEMA = "image_id bigint, level bigint, ty bigint, tx bigint, h bigint, w bigint, height bigint, width bigint"


def tiled(px: DataFrame, level: int = 0, value: str = "v") -> DataFrame:
    """Tiles of rasters given as rows (image_id, y, x, value), which must be complete."""
    size = px.groupBy("image_id").agg((F.max("y") + 1).cast("bigint").alias("height"), (F.max("x") + 1).cast("bigint").alias("width"))
    at = px.select("image_id", F.expr(f"y div {SIDE}").cast("bigint").alias("ty"), F.expr(f"x div {SIDE}").cast("bigint").alias("tx"), F.struct("y", "x", F.col(value).cast("double").alias("v")).alias("p"))
    rows = at.groupBy("image_id", "ty", "tx").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["v"]).alias("v")).join(size, "image_id")
    side = lambda t, n: F.least(F.lit(SIDE), F.col(n) - F.col(t) * SIDE).cast("bigint")
    return rows.select("image_id", F.lit(level).cast("bigint").alias("level"), "ty", "tx", side("ty", "height").alias("h"), side("tx", "width").alias("w"), "height", "width", "v")


def pixels_of(tiles: DataFrame, columns: Sequence[str] = ("v",)) -> DataFrame:
    """image_id, level, y, x and the columns' values, a row for each pixel."""
    each = tiles.select(*KEYS, "w", F.posexplode(F.arrays_zip(*columns)).alias("k", "p"))
    return each.select("image_id", "level", (F.col("ty") * SIDE + F.expr("k div w")).alias("y"), (F.col("tx") * SIDE + F.expr("k % w")).alias("x"), *(F.col(f"p.{c}").alias(c) for c in columns))


def _assembled(unit: pa.Table, own: tuple[int, int], margin: int, fill: str, value: str, extra: Sequence[str]) -> tuple[np.ndarray, dict]:
    """The tile `own` with a margin, from its pixels and the strips of its neighbourhood. fill: mirror, edge or a number for what lies beyond the image."""
    cols = {c: unit[c].to_pylist() for c in ("ty", "tx", "h", "w", "height", "width", "cy", "cx", "ch", "cw", *extra)}
    k = next(n for n in range(unit.num_rows) if (cols["ty"][n], cols["tx"][n]) == own)
    place = {c: cols[c][k] for c in ("ty", "tx", "h", "w", "height", "width", *extra)}
    ys, xs = ([t * SIDE + c for t, c in zip(cols[t], cols[c])] for t, c in (("ty", "cy"), ("tx", "cx")))
    top, left = min(ys), min(xs)
    bottom, right = (max(c + n for c, n in zip(at, cols[size])) for at, size in ((ys, "ch"), (xs, "cw")))
    whole = np.zeros((bottom - top, right - left))
    for n, (y, x) in enumerate(zip(ys, xs)):
        whole[y - top :, x - left :][: cols["ch"][n], : cols["cw"][n]] = np.asarray(unit[value][n].values, np.float64).reshape(cols["ch"][n], cols["cw"][n])
    y0, x0 = own[0] * SIDE, own[1] * SIDE
    want = (y0 - margin, y0 + place["h"] + margin, x0 - margin, x0 + place["w"] + margin)
    have = (max(want[0], 0), min(want[1], place["height"]), max(want[2], 0), min(want[3], place["width"]))
    before, after = (have[0] - want[0], have[2] - want[2]), (want[1] - have[1], want[3] - have[3])
    mode = {"mirror": {"mode": "reflect"}, "edge": {"mode": "edge"}}.get(fill) or {"mode": "constant", "constant_values": float(fill)}
    # Mirroring may need more of the image than the margin, where that is short on the other side; then the strips hold all of it.
    if fill == "mirror" and (max(before[0], after[0]) >= have[1] - have[0] or max(before[1], after[1]) >= have[3] - have[2]):
        have = (max(top, 0), min(bottom, place["height"]), max(left, 0), min(right, place["width"]))
        cut = np.pad(whole[have[0] - top : have[1] - top, have[2] - left : have[3] - left], ((max(0, have[0] - want[0]), max(0, want[1] - have[1])), (max(0, have[2] - want[2]), max(0, want[3] - have[3]))), mode="reflect")
        y, x = max(0, want[0] - have[0]), max(0, want[2] - have[2])
        return cut[y : y + place["h"] + 2 * margin, x : x + place["w"] + 2 * margin], place
    cut = whole[have[0] - top : have[1] - top, have[2] - left : have[3] - left]
    return np.pad(cut, ((before[0], after[0]), (before[1], after[1])), **mode), place


def _strips(tiles: DataFrame, margin: int, value: str, extra: Sequence[str]) -> DataFrame:
    """Each tile for itself, whole, and for every tile around it that its pixels are a margin of (oy, ox) the part that is: value from row cy, ch rows, and column cx, cw columns."""
    reach = max(1, math.ceil(margin / SIDE))
    steps = range(-reach, reach + 1)
    around = F.array(*(F.struct(F.lit(y).cast("bigint").alias("y"), F.lit(x).cast("bigint").alias("x")) for y in steps for x in steps if margin or not (y or x)))
    last = lambda n: F.ceil(F.col(n) / SIDE) - 1
    spread = tiles.select(*PLACE, value, *extra, F.explode(around).alias("s")).withColumns({"oy": F.col("ty") + F.col("s.y"), "ox": F.col("tx") + F.col("s.x")})
    spread = spread.where((F.col("oy") >= 0) & (F.col("oy") <= last("height")) & (F.col("ox") >= 0) & (F.col("ox") <= last("width")))

    def part(step: str, size: str) -> tuple[Column, Column]:
        """First and number of the pixels along an axis. The other tile begins `step` tiles on: what is nearer than the margin to it counts."""
        gap = F.abs(F.col(step)) - 1
        most = F.least(F.col(size), F.greatest(F.lit(0), margin - gap * SIDE))
        after = F.greatest(F.lit(0), F.col(size) - F.greatest(F.lit(0), margin - gap * SIDE - (SIDE - F.col(size))))
        first = F.when(F.col(step) > 0, after).otherwise(F.lit(0))
        return first, F.when(F.col(step) == 0, F.col(size)).when(F.col(step) > 0, F.col(size) - after).otherwise(most)

    (cy, ch), (cx, cw) = part("s.y", "h"), part("s.x", "w")
    cut = spread.withColumns({"cy": cy.cast("bigint"), "ch": ch.cast("bigint"), "cx": cx.cast("bigint"), "cw": cw.cast("bigint")}).where("ch > 0 and cw > 0")
    rows = F.sequence(F.col("cy"), F.col("cy") + F.col("ch") - 1)
    some = F.flatten(F.transform(rows, lambda y: F.slice(value, (y * F.col("w") + F.col("cx") + 1).cast("int"), F.col("cw").cast("int"))))
    return cut.withColumn(value, F.when((F.col("ch") == F.col("h")) & (F.col("cw") == F.col("w")), F.col(value)).otherwise(some)).drop("s")


def mapped(tiles: DataFrame, kernel: Callable[[np.ndarray, dict], Iterable[np.ndarray]], margin: int, columns: Sequence[str] = ("v",), fill: str = "mirror", value: str = "v", extra: Sequence[str] = ()) -> DataFrame:
    """tiles with new columns for v: kernel takes a tile with its margin and the tile's numbers, with those of the columns in extra, and returns one array for
    each column. A tile sends its neighbours no more than the margin needs."""

    def run(key: tuple, unit: pa.Table) -> pa.Table:
        image, level, oy, ox = (k.as_py() for k in key)
        a, place = _assembled(unit, (oy, ox), margin, fill, value, extra)
        out = [image, level, oy, ox, *(place[c] for c in PLACE[4:])]
        return pa.table([*(pa.array([x], pa.int64()) for x in out), *(pa.array([np.ascontiguousarray(x, np.float64).ravel()], pa.list_(pa.float64())) for x in kernel(a, place))], names=[*PLACE, *columns])

    return _strips(tiles, margin, value, extra).groupBy("image_id", "level", "oy", "ox").applyInArrow(run, ", ".join([_SCHEMA, *(f"{c} array<double>" for c in columns)]))


# ------------------------------------------------------------------ kernels


def gauss(sigma: float) -> np.ndarray:
    """Weights over four deviations on either side."""
    half = (round(sigma * 8 + 1) | 1) // 2
    w = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def along(a: np.ndarray, weights: Sequence[float], axis: int) -> np.ndarray:
    """Weighted sums of neighbours along an axis; shorter by the weights' number less one."""
    n = a.shape[axis] - len(weights) + 1
    out = 0.0
    for k, w in enumerate(weights):
        if w:
            out = out + w * (a[k : k + n] if axis == 0 else a[:, k : k + n])
    return out


def smooth(a: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    return along(along(a, weights, 1), weights, 0)


def contrast(a: np.ndarray, sigma: float) -> np.ndarray:
    """(v - mean) / sqrt(max(variance, 4)) with Gaussian moments."""
    w = gauss(sigma)
    half = len(w) // 2
    mean, square = smooth(a, w), smooth(a * a, w)
    return (a[half:-half, half:-half] - mean) / np.sqrt(np.maximum(square - mean * mean, 4.0))


def slopes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3 x 3 Sobel derivatives in x and y, over 8."""
    smoothed, difference = (1.0, 2.0, 1.0), (-1.0, 0.0, 1.0)
    return along(along(a, difference, 1), smoothed, 0) / 8, along(along(a, smoothed, 1), difference, 0) / 8


def blurred(tiles: DataFrame, sigma: float = 1.2) -> DataFrame:
    w = gauss(sigma)
    return mapped(tiles, lambda a, _: [smooth(a, w)], len(w) // 2)


def sobel(tiles: DataFrame) -> DataFrame:
    """tiles with gx, gy and their length mag."""

    def kernel(a: np.ndarray, _: dict) -> list[np.ndarray]:
        gx, gy = slopes(a)
        return [gx, gy, np.hypot(gx, gy)]

    return mapped(tiles, kernel, 1, ("gx", "gy", "mag"))


def local_norm(tiles: DataFrame, sigma: float = 20.0) -> DataFrame:
    return mapped(tiles, lambda a, _: [contrast(a, sigma)], len(gauss(sigma)) // 2)


def eroded(tiles: DataFrame, half: int = 4) -> DataFrame:
    """The least value in the square of 2 half + 1 pixels; what lies beyond the image doesn't count."""

    def kernel(a: np.ndarray, _: dict) -> list[np.ndarray]:
        for axis in (0, 1):
            n = a.shape[axis] - 2 * half
            a = np.minimum.reduce([a[k : k + n] if axis == 0 else a[:, k : k + n] for k in range(2 * half + 1)])
        return [a]

    return mapped(tiles, kernel, half, fill="inf")


FIVE = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)


def halved(tiles: DataFrame) -> DataFrame:
    """The next pyramid level: 5-tap blur, then every second pixel; four tiles become one."""
    half = SIDE // 2
    soft = mapped(tiles, lambda a, _: [smooth(a, FIVE)[::2, ::2]], 2)

    def run(key: tuple, unit: pa.Table) -> pa.Table:
        image, level, qy, qx = (k.as_py() for k in key)
        rows = unit.to_pylist()
        height, width = (-(-rows[0][c] // 2) for c in ("height", "width"))
        out = np.zeros((min(SIDE, height - qy * SIDE), min(SIDE, width - qx * SIDE)))
        for r in rows:
            part = np.asarray(r["v"]).reshape(-(-r["h"] // 2), -(-r["w"] // 2))
            out[r["ty"] % 2 * half :, r["tx"] % 2 * half :][: part.shape[0], : part.shape[1]] = part
        numbers = (image, level + 1, qy, qx, *out.shape, height, width)
        return pa.table([*(pa.array([n], pa.int64()) for n in numbers), pa.array([out.ravel()], pa.list_(pa.float64()))], names=[*PLACE, "v"])

    return soft.groupBy("image_id", "level", F.expr("ty div 2").alias("qy"), F.expr("tx div 2").alias("qx")).applyInArrow(run, f"{_SCHEMA}, v array<double>")


def pyramid(tiles: DataFrame, most: int = 6, least_side: int = 200) -> DataFrame:
    """Level 0 and, while the last one's shorter side is over least_side, the next, up to `most` levels. Images stop each at its own level; each level is
    kept, so none is computed again for those above."""
    out = now = tiles
    for _ in range(most - 1):
        now = settled(halved(now.where((F.col("height") > least_side) & (F.col("width") > least_side))))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out


def n_levels(height: Column, width: Column, most: int = 6, least_side: int = 200) -> Column:
    """How many levels pyramid() makes of an image."""
    out, side = F.lit(1), F.least(height, width)
    for k in range(1, most):
        out = out + F.when(side > least_side, 1).otherwise(0)
        side = F.when(side > least_side, F.floor((side + 1) / 2)).otherwise(side)
    return out


def level_for(r: Column, levels: Column | int, base: float = 14.0) -> Column:
    """The level on which a radius is about `base` to twice as long."""
    top = (F.lit(levels) if isinstance(levels, int) else levels) - 1
    return F.greatest(F.least(F.floor(F.log2(F.greatest(r, F.lit(1e-3)) / base)), top), F.lit(0))


# ------------------------------------------------------------------ samples


def bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between the four pixels around; beyond the array its edge goes on."""
    x, y = np.clip(x, 0, a.shape[1] - 1), np.clip(y, 0, a.shape[0] - 1)
    x0, y0 = np.minimum(x.astype(int), max(a.shape[1] - 2, 0)), np.minimum(y.astype(int), max(a.shape[0] - 2, 0))
    x1, y1 = np.minimum(x0 + 1, a.shape[1] - 1), np.minimum(y0 + 1, a.shape[0] - 1)
    fx, fy = x - x0, y - y0
    return (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy


def sampled(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """points (image_id, point_id, x, y) with value: bilinear on level 0 between the four pixels around; null where one is missing."""
    p = points.withColumns({"x0": F.floor("x"), "y0": F.floor("y")})
    fx, fy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    corner = lambda dx, dy: F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w"))
    spread = p.select("image_id", "point_id", F.explode(F.array(*(corner(dx, dy) for dx in (0, 1) for dy in (0, 1)))).alias("c")).where("c.w > 0")
    at = spread.withColumns({"ty": F.floor(F.col("c.y") / SIDE), "tx": F.floor(F.col("c.x") / SIDE)})
    hit = at.join(tiles.where("level = 0").drop("level"), ["image_id", "ty", "tx"], "left")
    inside = (F.col("c.y") < F.col("height")) & (F.col("c.x") < F.col("width"))
    v = F.when(inside, F.element_at("v", ((F.col("c.y") - F.col("ty") * SIDE) * F.col("w") + F.col("c.x") - F.col("tx") * SIDE + 1).cast("int")))
    out = hit.select("image_id", "point_id", F.col("c.w").alias("weight"), v.alias("value"))
    return out.groupBy("image_id", "point_id").agg(F.when(F.count("value") == F.count("*"), F.sum(F.col("weight") * F.col("value"))).alias("value"))


def shrunk(px: DataFrame, scale: float) -> DataFrame:
    """Rasters (image_id, y, x, v) made smaller by area: each new pixel is the mean of what it covers, by shares of the old pixels. scale: below 1."""
    size = px.groupBy("image_id").agg(*(F.greatest(F.lit(1), F.round((F.max(c) + 1) * scale)).cast("bigint").alias(n) for c, n in (("y", "nh"), ("x", "nw"))), (F.max("y") + 1).alias("oh"), (F.max("x") + 1).alias("ow"))
    at = px.join(size, "image_id")

    def shares(c: str, new: str, old: str) -> Column:
        f = F.col(new) / F.col(old)
        low, high = F.col(c) * f, (F.col(c) + 1) * f
        first = F.floor(low + 1e-9)
        split = F.least(high, first + 1)
        return F.array(F.struct(first.alias("at"), (split - low).alias("w")), F.struct(F.least(first + 1, F.col(new) - 1).alias("at"), (high - split).alias("w")))

    rows = at.select("image_id", "v", F.explode(shares("y", "nh", "oh")).alias("r"), shares("x", "nw", "ow").alias("cs")).select("image_id", "v", "r", F.explode("cs").alias("c"))
    rows = rows.where((F.col("r.w") > 1e-9) & (F.col("c.w") > 1e-9))
    w = F.col("r.w") * F.col("c.w")
    return rows.groupBy("image_id", F.col("r.at").alias("y"), F.col("c.at").alias("x")).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("v"))


def _shares(first: int, n: int, old: int, new: int) -> tuple[int, np.ndarray]:
    """The first new pixel that the old ones from first on reach, and a matrix (new, old) of the shares of each old one, along an axis of `old` pixels made `new`."""
    f = new / old
    low, high = np.arange(first, first + n) * f, np.arange(first + 1, first + n + 1) * f
    at = np.floor(low + 1e-9).astype(int)
    split = np.minimum(high, at + 1)
    start = int(at[0])
    out = np.zeros((min(int(at[-1]) + 2, new) - start, n))
    np.add.at(out, (at - start, np.arange(n)), split - low)
    rest = high - split
    more = rest > 1e-9
    np.add.at(out, (np.minimum(at[more] + 1, new - 1) - start, np.flatnonzero(more)), rest[more])
    return start, out


def shrunk_to(tiles: DataFrame, max_side: int) -> DataFrame:
    """Tiles of level 0 of the images made smaller by area, each by its own scale, so that no side is over max_side; images that fit stay as they are. With scale, work pixels over
    original ones, as a last column.

    Each old tile gives its share to the new tiles under it, weighted sums of at most as many pixels as it has; those that meet in a new tile are added up. Nothing
    is ever a row for each pixel.
    """
    longest = F.greatest("height", "width")
    fit = tiles.where(longest <= max_side).select(*PLACE, "v", F.lit(1.0).alias("scale"))
    names = ["image_id", "ty", "tx", "height", "width", "old", "y", "x", "ph", "pw", "v", "n"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                scale = max_side / max(t["height"], t["width"])
                nh, nw = (max(1, math.floor(t[c] * scale + 0.5)) for c in ("height", "width"))
                (y0, wy), (x0, wx) = _shares(t["ty"] * SIDE, t["h"], t["height"], nh), _shares(t["tx"] * SIDE, t["w"], t["width"], nw)
                value = wy @ np.asarray(t["v"]).reshape(t["h"], t["w"]) @ wx.T
                weight = wy.sum(1)[:, None] * wx.sum(1)
                for ty in range(y0 // SIDE, (y0 + len(wy) - 1) // SIDE + 1):
                    for tx in range(x0 // SIDE, (x0 + len(wx) - 1) // SIDE + 1):
                        a, b = max(y0, ty * SIDE), min(y0 + len(wy), (ty + 1) * SIDE)
                        c, d = max(x0, tx * SIDE), min(x0 + len(wx), (tx + 1) * SIDE)
                        own = slice(a - y0, b - y0), slice(c - x0, d - x0)
                        numbers = (t["image_id"], ty, tx, nh, nw, max(t["height"], t["width"]), a - ty * SIDE, c - tx * SIDE, b - a, d - c)
                        yield pa.RecordBatch.from_arrays([*(pa.array([n], pa.int64()) for n in numbers), *(pa.array([m[own].ravel()], pa.list_(pa.float64())) for m in (value, weight))], names=names)

    def add(key: tuple, unit: pa.Table) -> pa.Table:
        rows = unit.to_pylist()
        p = rows[0]
        shape = min(SIDE, p["height"] - p["ty"] * SIDE), min(SIDE, p["width"] - p["tx"] * SIDE)
        sums, weights = np.zeros(shape), np.zeros(shape)
        # In one order, so that sums don't depend on how rows have come.
        for r in sorted(rows, key=lambda r: (r["y"], r["x"], r["ph"], r["pw"], r["v"][0])):
            at = slice(r["y"], r["y"] + r["ph"]), slice(r["x"], r["x"] + r["pw"])
            sums[at] += np.asarray(r["v"]).reshape(r["ph"], r["pw"])
            weights[at] += np.asarray(r["n"]).reshape(r["ph"], r["pw"])
        numbers = (p["image_id"], 0, p["ty"], p["tx"], *shape, p["height"], p["width"])
        return pa.table([*(pa.array([n], pa.int64()) for n in numbers), pa.array([(sums / weights).ravel()], pa.list_(pa.float64())), pa.array([max_side / p["old"]])], names=[*PLACE, "v", "scale"])

    parts = tiles.where(longest > max_side).select(*PLACE, "v").mapInArrow(part, ", ".join([*(f"{c} bigint" for c in names[:-2]), "v array<double>, n array<double>"]))
    return fit.unionByName(parts.groupBy("image_id", "ty", "tx").applyInArrow(add, f"{_SCHEMA}, v array<double>, scale double"))
