"""Polar stereographic projection of the Moon, control grids and great circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of the Moon in metres.
RADIUS = 1737400.0


def forward(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Stereographic x, y in metres about (lon0, lat0), all in degrees."""
    p, q, d = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    k = 2.0 * RADIUS / (1.0 + F.sin(q) * F.sin(p) + F.cos(q) * F.cos(p) * F.cos(d))
    return k * F.cos(p) * F.sin(d), k * (F.cos(q) * F.sin(p) - F.sin(q) * F.cos(p) * F.cos(d))


def backward(x: Column, y: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """lon (0 up to 360), lat in degrees."""
    rho, q = F.sqrt(x * x + y * y), F.radians(lat0)
    c = 2.0 * F.atan(rho / (2.0 * RADIUS))
    safe = F.greatest(rho, F.lit(1e-12))
    lat = F.asin(F.cos(c) * F.sin(q) + y * F.sin(c) * F.cos(q) / safe)
    lon = lon0 + F.degrees(F.atan2(x * F.sin(c), safe * F.cos(q) * F.cos(c) - y * F.sin(q) * F.sin(c)))
    return F.pmod(lon, F.lit(360.0)), F.degrees(lat)


def centre(grid: DataFrame) -> DataFrame:
    """image_id, lon0 (circular mean, 0 up to 360), lat0 (mean)."""
    turn = F.radians("lon")
    return grid.groupBy("image_id").agg(F.pmod(F.degrees(F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn)))), F.lit(360.0)).alias("lon0"), F.avg("lat").alias("lat0"))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two places; null where one is unknown."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon1 - lon2)
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(d)
    return F.when(cosine.isNotNull(), RADIUS * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def interpolated(points: DataFrame, grid: DataFrame) -> DataFrame:
    """points (image_id, point_id, px, py) with lon and lat, bilinear in the control grid (image_id, pixel, scan, lon, lat) between whatever lines it has; outside
    of them, and in a cell without all four corners, null. Interpolated are stereographic coordinates about the grid's centre.

    The cells are made from each line and the next one of the grid's axes, of which there are few, and a point meets its cell in a join on image and interval.
    """
    mid = centre(grid)
    g = grid.join(mid, "image_id")
    gx, gy = forward(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    g = g.select(F.col("image_id").alias("of"), F.col("pixel").alias("gp"), F.col("scan").alias("gs"), gx.alias("gx"), gy.alias("gy"))
    axis = lambda c: F.sort_array(F.collect_set(c))
    axes = grid.groupBy("image_id").agg(axis("pixel").alias("ps"), axis("scan").alias("ss"))
    p = points.join(axes, "image_id")
    # The last line at or before the coordinate; at the last line of all, the one before.
    low = lambda a, c: F.least(F.size(F.filter(a, lambda v: v <= F.col(c))), F.size(a) - 1)
    p = p.withColumns({"a": low("ps", "px"), "b": low("ss", "py")}).where("a >= 1 and b >= 1")
    at = lambda a, k: F.element_at(a, k)
    p = p.withColumns({"p0": at("ps", F.col("a")), "p1": at("ps", F.col("a") + 1), "s0": at("ss", F.col("b")), "s1": at("ss", F.col("b") + 1)}).where("px <= p1 and py <= s1")
    fx, fy = (F.col("px") - F.col("p0")) / (F.col("p1") - F.col("p0")), (F.col("py") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    corner = lambda i, j: F.struct(F.col(f"p{i}").alias("p"), F.col(f"s{j}").alias("s"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    spread = p.select("image_id", "point_id", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("c"))
    hit = spread.join(g, (F.col("image_id") == F.col("of")) & (F.col("c.p") == F.col("gp")) & (F.col("c.s") == F.col("gs")))
    sums = hit.groupBy("image_id", "point_id").agg(F.count("*").alias("n"), *(F.sum(F.col("c.w") * F.col(c)).alias(n) for c, n in (("gx", "x"), ("gy", "y")))).where("n = 4")
    lon, lat = backward(F.col("x"), F.col("y"), F.col("lon0"), F.col("lat0"))
    found = sums.join(mid, "image_id").select("image_id", "point_id", lon.alias("lon"), lat.alias("lat"))
    return points.select("image_id", "point_id").join(found, ["image_id", "point_id"], "left")


def work_places(points: DataFrame, grid: DataFrame, frames: DataFrame) -> DataFrame:
    """points (image_id, point_id, x, y) in work pixels with lon and lat. frames: image_id, orig_w, orig_h, scale (work pixels over original ones).

    Work pixels become original ones by pixel centres, and these the grid's, which may be of another size: its last lines are the last pixels.
    """
    full = grid.groupBy("image_id").agg((F.max("pixel") + 1).alias("full_w"), (F.max("scan") + 1).alias("full_h"))
    at = points.join(frames, "image_id").join(full, "image_id")
    own = lambda c, full, size: ((F.col(c) + 0.5) / F.col("scale")) * F.col(full) / F.col(size) - 0.5
    placed = at.select("image_id", "point_id", own("x", "full_w", "orig_w").alias("px"), own("y", "full_h", "orig_h").alias("py"))
    return interpolated(placed, grid)


def ground_distance(grid: DataFrame, frames: DataFrame) -> DataFrame:
    """image_id, metres: of a work pixel at the middle of the image, from a step of ten pixels to the right. frames also with w and h of the work image."""
    ends = frames.select("image_id", F.explode(F.array(*(F.struct(F.lit(k).alias("point_id"), (F.col("w") / 2 + 10.0 * k).alias("x"), (F.col("h") / 2).alias("y")) for k in (0, 1)))).alias("e")).select("image_id", "e.*")
    mid = centre(grid)
    placed = work_places(ends, grid, frames.drop("w", "h")).join(mid, "image_id")
    x, y = forward(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    both = placed.select("image_id", "point_id", x.alias("gx"), y.alias("gy")).groupBy("image_id").agg(*((F.max(F.when(F.col("point_id") == 1, F.col(c))) - F.max(F.when(F.col("point_id") == 0, F.col(c)))).alias(c) for c in ("gx", "gy")))
    return both.select("image_id", (F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) / 10.0).alias("metres"))


def lattice(frames: DataFrame, step: int = 100) -> DataFrame:
    """frames (image_id, w, h): image_id, px, py of a lattice, with the last row and column."""
    axis = lambda n: F.array_distinct(F.concat(F.sequence(F.lit(0), F.col(n) - 1, F.lit(step)), F.array(F.col(n) - 1)))
    return frames.select("image_id", F.explode(axis("w")).alias("px"), "h").select("image_id", "px", F.explode(axis("h")).alias("py"))


def _target_nodes(lines: DataFrame, tgt_frames: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """lines (image_id, px, py) with u, v, the target's work pixels. full: image_id, full_w, full_h of the frame that the lines count in, where it isn't the original's."""
    at = lines.join(tgt_frames, "image_id")
    at = at.join(full, "image_id").withColumns({"rw": F.col("orig_w") / F.col("full_w"), "rh": F.col("orig_h") / F.col("full_h")}) if full is not None else at.withColumns({"rw": F.lit(1.0), "rh": F.lit(1.0)})
    return at.select("image_id", "px", "py", ((F.col("px") + 0.5) * F.col("rw") * F.col("scale") - 0.5).alias("u"), ((F.col("py") + 0.5) * F.col("rh") * F.col("scale") - 0.5).alias("v"))


def target_grid(lines: DataFrame, matrices: DataFrame, grid: DataFrame, ref_frames: DataFrame, tgt_frames: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """image_id, pixel, scan, lon, lat: the reference's grid carried to the target. lines: a lattice() of the target's original frame (image_id, px, py), or of full, the frame of a grid of
    its own (image_id, full_w, full_h), for which tgt_frames has orig_w and orig_h; matrices: image_id and t00..t22 from the reference's work pixels to the target's,
    which are inverted here; tgt_frames: image_id, scale."""
    at = _target_nodes(lines, tgt_frames, full).join(matrices, "image_id")
    u, v = F.col("u"), F.col("v")
    t = {f"{i}{j}": F.col(f"t{i}{j}") for i in range(3) for j in range(3)}
    minor = lambda a, b, c, d: t[a] * t[d] - t[b] * t[c]
    rows = [(minor("11", "12", "21", "22"), -minor("01", "02", "21", "22"), minor("01", "02", "11", "12")), (-minor("10", "12", "20", "22"), minor("00", "02", "20", "22"), -minor("00", "02", "10", "12")),
            (minor("10", "11", "20", "21"), -minor("00", "01", "20", "21"), minor("00", "01", "10", "11"))]
    x, y, w = (a * u + b * v + c for a, b, c in rows)
    points = at.select("image_id", F.struct("px", "py").alias("point_id"), (x / w).alias("x"), (y / w).alias("y"))
    return work_places(points, grid, ref_frames).select("image_id", F.col("point_id.px").alias("pixel"), F.col("point_id.py").alias("scan"), "lon", "lat")


def compared_with_official(matrices: DataFrame, ref_grid: DataFrame, tgt_grid: DataFrame, ref_frames: DataFrame, tgt_frames: DataFrame, step: int = 100) -> tuple[DataFrame, DataFrame]:
    """The estimated grid of each target, and image_id, n, mean, median, largest: metres between it and the target's official one.

    The lattice is that of the official grid's own frame, which may be of another size than the image. Nodes outside either grid don't count; a target without any
    common node has n 0 and nulls. frames: image_id, orig_w, orig_h, scale.
    """
    full = tgt_grid.groupBy("image_id").agg((F.max("pixel") + 1).alias("full_w"), (F.max("scan") + 1).alias("full_h"))
    lines = lattice(full.join(matrices.select("image_id"), "image_id", "left_semi").select("image_id", F.col("full_w").alias("w"), F.col("full_h").alias("h")), step)
    mine = target_grid(lines, matrices, ref_grid, ref_frames, tgt_frames, full)
    nodes = _target_nodes(lines, tgt_frames, full).select("image_id", F.struct("px", "py").alias("point_id"), F.col("u").alias("x"), F.col("v").alias("y"))
    official = work_places(nodes, tgt_grid, tgt_frames).select("image_id", F.col("point_id.px").alias("pixel"), F.col("point_id.py").alias("scan"), F.col("lon").alias("official_lon"), F.col("lat").alias("official_lat"))
    both = mine.join(official, ["image_id", "pixel", "scan"]).withColumn("m", great_circle(F.col("official_lon"), F.col("official_lat"), F.col("lon"), F.col("lat")))
    return mine, both.groupBy("image_id").agg(F.count("m").alias("n"), F.avg("m").alias("mean"), F.median("m").alias("median"), F.max("m").alias("largest"))
