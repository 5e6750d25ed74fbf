"""Transforms refined on the images themselves: the correlation of both sides' slopes is raised by Gauss-Newton steps until it grows no more.

A step's normal equations are sums over pixels, so each reference tile, kept with the part of the target under it, gives one row of sums under its pair's present
transform; they are added up for each pair, and a small task solves them. All pairs take a step in one job, pairs that have converged take no further part, and no
pixel moves after the tiles have met once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import settled
from . import tiles
from .detection import feature_tiles, strong_gradient
from .matching import KEY, MATRIX
from .raster import tiles_under
from .tiles import KEYS, PLACE, SIDE

#: A Gaussian of five taps with a deviation of 1.1.
_SOFT = np.exp(-0.5 * (np.arange(-2, 3) / 1.1) ** 2)
_SOFT = _SOFT / _SOFT.sum()
#: Target pixels kept beyond those under a tile, by how far a transform may move.
SLACK = 24


def slopes_shown(base: DataFrame) -> DataFrame:
    """Tiles with v, the slopes' length in 80ths of the image's strong gradient, up to 255, smoothed."""
    f = feature_tiles(base)
    shown = F.transform("mag", lambda m: F.least(F.lit(255.0), m / F.col("g95") * 80))
    return tiles.mapped(f.join(strong_gradient(f), ["image_id", "level"]).select(*PLACE, shown.alias("v")), lambda a, _: [tiles.smooth(a, _SOFT)], 2)


def _units(ref: DataFrame, tgt: DataFrame, matrices: DataFrame) -> DataFrame:
    """A row for each reference tile that lies over the target: its pixels, and those of the target under it."""
    met = tiles_under(ref, tgt, matrices, SLACK)

    def run(key: tuple, unit: pa.Table) -> pa.Table:
        rows = unit.to_pylist()
        p, have = rows[0], [r for r in rows if r["v"] is not None]
        if not have:
            return empty
        top, left = min(r["sy"] for r in have) * SIDE, min(r["sx"] for r in have) * SIDE
        part = np.zeros((max(r["sy"] * SIDE + r["sh"] for r in have) - top, max(r["sx"] * SIDE + r["sw"] for r in have) - left), np.float32)
        for r in have:
            part[r["sy"] * SIDE - top :, r["sx"] * SIDE - left :][: r["sh"], : r["sw"]] = np.asarray(r["v"], np.float32).reshape(r["sh"], r["sw"])
        numbers = [*(p[c] for c in PLACE), p["th"], p["tw"], top, left, *part.shape]
        return pa.table([*(pa.array([n], pa.int64()) for n in numbers), pa.array([np.asarray(p["own"], np.float32)], pa.list_(pa.float32())), pa.array([part.ravel()], pa.list_(pa.float32()))], names=columns)

    columns = [*PLACE, "th", "tw", "top", "left", "ph", "pw", "own", "part"]
    schema = ", ".join([*(f"{c} bigint" for c in columns[:-2]), "own array<float>, part array<float>"])
    empty = ref.sparkSession.createDataFrame([], schema).toArrow()
    return met.groupBy(*KEYS).applyInArrow(run, schema)


def sums_of(own: np.ndarray, part: np.ndarray, place: dict, start: np.ndarray, now: np.ndarray, projective: bool) -> np.ndarray:
    """n, the sums of both sides' values, squares and product, and of the slopes along the parameters with 1, own and other values and each other, over a tile's pixels.
    start: the matrix by which a pixel counts: with the square of nine around it it lies within the target."""
    y, x = np.mgrid[place["ty"] * SIDE : place["ty"] * SIDE + place["h"], place["tx"] * SIDE : place["tx"] * SIDE + place["w"]].astype(float)

    def moved(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = m[2, 0] * x + m[2, 1] * y + m[2, 2]
        return (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / w, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / w, w

    counts = np.ones(x.shape, bool)
    for dy in (-4, 4):
        for dx in (-4, 4):
            u, v, _ = moved(start, np.clip(x + dx, 0, place["width"] - 1), np.clip(y + dy, 0, place["height"] - 1))
            counts &= (np.rint(u) >= 0) & (np.rint(u) < place["tw"]) & (np.rint(v) >= 0) & (np.rint(v) < place["th"])
    u, v, w = moved(now, x, y)
    pu, pv = u - place["left"], v - place["top"]
    counts &= (u >= 0) & (u <= place["tw"] - 1) & (v >= 0) & (v <= place["th"] - 1) & (pu >= 0) & (pu <= place["pw"] - 1) & (pv >= 0) & (pv <= place["ph"] - 1)
    t, x, y, pu, pv, u, v, w = (a[counts] for a in (own.astype(float), x, y, pu, pv, u, v, w))
    gy, gx = np.gradient(part.astype(float)) if min(part.shape) > 1 else (np.zeros(part.shape), np.zeros(part.shape))
    i, gx, gy = (tiles.bilinear(a, pu, pv) for a in (part.astype(float), gx, gy))
    unit = max(place["width"], place["height"])
    x, y = x / unit, y / unit
    if projective:
        gx, gy = gx / w, gy / w
        back = -(u * gx + v * gy)
        g = np.stack([gx * x, gx * y, gx, gy * x, gy * y, gy, back * x, back * y])
    else:
        g = np.stack([gx * x, gx * y, gx, gy * x, gy * y, gy])
    k = len(g)
    cross = g @ g.T
    full = [np.zeros(8), np.zeros(8), np.zeros(8), np.zeros((8, 8))]
    full[0][:k], full[1][:k], full[2][:k], full[3][:k, :k] = g.sum(1), g @ t, g @ i, cross
    return np.concatenate([[len(t), t.sum(), i.sum(), t @ t, i @ i, t @ i], *full[:3], full[3].ravel()])


N_SUMS = 6 + 24 + 64


def step_of(s: np.ndarray, projective: bool) -> tuple[float, np.ndarray | None]:
    """The correlation, and the step of the parameters (six, or eight of a homography); None where there is none."""
    n, st, si, tt, ii, ti = s[:6]
    k = 8 if projective else 6
    if n < 50:
        return 0.0, None
    g, gt, gi, cross = s[6 : 6 + k], s[14 : 14 + k], s[22 : 22 + k], s[30:].reshape(8, 8)[:k, :k]
    tt, ii, ti = tt - st * st / n, ii - si * si / n, ti - st * si / n
    gt, gi = gt - g * st / n, gi - g * si / n
    if tt <= 1e-9 or ii <= 1e-9:
        return 0.0, None
    rho = ti / np.sqrt(tt * ii)
    try:
        hi, ht = np.linalg.solve(cross, gi), np.linalg.solve(cross, gt)
    except np.linalg.LinAlgError:
        return rho, None
    below = ti - gt @ hi
    if below <= 0:
        return rho, None
    return rho, (ii - gi @ hi) / below * ht - hi


def refined(ref: DataFrame, tgt: DataFrame, summary: DataFrame, placed: DataFrame, rounds: int = 120, least_gain: float = 1e-6) -> DataFrame:
    """image_id, used, cc, before, after, n_rounds and t00..t22: each pair's transform raised to the best correlation. ref, tgt: tiles of level 0; summary: image_id, model,
    t00..t22; placed: image_id, x, y, u, v of the matches.

    Similarities become affine maps, homographies stay homographies. used: the new transform is taken if it is finite, the correlation is over 0.15, and the matches'
    error (before, after: root mean square in the target) is at most 1.1 times the old one's and 0.3; else t00..t22 are the old ones. A pair ends where the
    correlation changes by less than least_gain, where no step can be found, or after `rounds`. Pairs without tiles stay as they are.
    """
    a, b = (slopes_shown(df.where("level = 0")) for df in (ref.join(summary.select(*KEY), list(KEY), "left_semi"), tgt.join(summary.select(*KEY), list(KEY), "left_semi")))
    units = settled(_units(a, b, summary.select(*KEY, *MATRIX)))
    start = F.array(*MATRIX)
    state = settled(summary.select(*KEY, start.alias("start"), start.alias("now"), (F.col("model") == "homography").alias("projective"), F.lit(-1.0).alias("rho"), F.lit(0).alias("n_rounds"), F.lit(False).alias("done"), F.lit(False).alias("failed")))
    sums_schema = f"image_id bigint, unit double, {', '.join(f's{k} double' for k in range(N_SUMS))}"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in batch.schema.names}
                p = {c: r[c].as_py() for c in (*PLACE, "th", "tw", "top", "left", "ph", "pw")}
                own, part = (np.asarray(r[c].values).reshape(shape) for c, shape in (("own", (p["h"], p["w"])), ("part", (p["ph"], p["pw"]))))
                first, now = (np.asarray(r[c].values, float).reshape(3, 3) for c in ("start", "now"))
                s = sums_of(own, part, p, first, now, r["projective"].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([p["image_id"]]), pa.array([float(max(p["width"], p["height"]))]), *(pa.array([v]) for v in s)], names=["image_id", "unit", *(f"s{k}" for k in range(N_SUMS))])

    def steps(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples(index=False):
                now = np.array(r.now).reshape(3, 3)
                missing = r.unit is None or np.isnan(r.unit)
                rho, move = (0.0, None) if missing else step_of(np.array([getattr(r, f"s{k}") for k in range(N_SUMS)]), r.projective)
                failed = move is None or not np.isfinite(move).all()
                done = failed or abs(rho - r.rho) < least_gain
                if not failed:
                    flat = np.zeros(9)
                    flat[: len(move)] = move
                    now = now + flat.reshape(3, 3) / np.array([r.unit, r.unit, 1.0])
                rows.append((r.image_id, r.start, now.ravel().tolist(), r.projective, rho, r.n_rounds + 1, done, failed))
            yield pd.DataFrame(rows, columns=["image_id", "start", "now", "projective", "rho", "n_rounds", "done", "failed"])

    finished = []
    for _ in range(rounds):
        rows = units.join(state.select(*KEY, "start", "now", "projective"), list(KEY)).mapInArrow(sums, sums_schema)
        total = rows.groupBy(*KEY).agg(F.max("unit").alias("unit"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(N_SUMS)))
        state = settled(state.join(total, list(KEY), "left").mapInPandas(steps, state.schema))
        finished.append(state.where("done"))
        state = state.where("not done")
        if state.isEmpty():
            break
    out = state
    for part in finished:
        out = out.unionByName(part)
    new = [F.col("now")[k].alias(c) for k, c in enumerate(MATRIX)]
    fresh = out.select(*KEY, *new, F.col("start"), F.col("rho").alias("cc"), "n_rounds", "failed")
    rms = lambda df, name: _errors(placed, df).groupBy(*KEY).agg(F.sqrt(F.avg("square")).alias(name))
    both = fresh.join(rms(summary, "before"), list(KEY), "left").join(rms(fresh, "after"), list(KEY), "left")
    finite = F.forall("now", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    both = both.withColumn("now", F.array(*MATRIX))
    used = F.coalesce(~F.col("failed") & finite & (F.col("after") <= 1.1 * F.col("before") + 0.3) & (F.col("cc") > 0.15), F.lit(False))
    return both.withColumn("used", used).select(*KEY, "used", "cc", "before", "after", "n_rounds", *(F.when(F.col("used"), F.col(c)).otherwise(F.col("start")[k]).alias(c) for k, c in enumerate(MATRIX)))


def _errors(placed: DataFrame, matrices: DataFrame) -> DataFrame:
    at = placed.select(*KEY, "x", "y", "u", "v").join(matrices.select(*KEY, *MATRIX), list(KEY))
    w = "(t20 * x + t21 * y + t22)"
    return at.withColumn("square", F.expr(f"pow((t00 * x + t01 * y + t02) / {w} - u, 2) + pow((t10 * x + t11 * y + t12) / {w} - v, 2)"))
