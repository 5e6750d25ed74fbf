"""Writers of everything a run leaves behind, each one Spark job over all images or pairs, in folders named by them; and the readers that take it up again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import MATRIX, inverse_matrix
from ..operators.patterns import signatures
from .tables import to_original


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _csv(df: DataFrame, path: str, by: str | None = None, **options: str) -> None:
    writer = (df.repartition(by) if by else df).write.mode("overwrite").options(header="true", **options)
    (writer.partitionBy(by) if by else writer).csv(path)


def _rounded(df: DataFrame, digits: int | Mapping[str, int]) -> DataFrame:
    of = lambda c: digits if isinstance(digits, int) else digits.get(c)
    return df.select(*(F.round(c, of(c)).alias(c) if t in ("double", "float") and of(c) is not None else F.col(c) for c, t in df.dtypes))


def write_annotations(rows: DataFrame, path: str) -> None:
    """image, cx, cy, r, label, source, scale with three decimals."""
    _csv(_rounded(rows.select("image", "cx", "cy", "r", "label", "source", "scale"), 3), path)


def write_craters(detections: DataFrame, frames: DataFrame, path: str) -> None:
    """Under path/csv the 13 columns of a catalogue, one folder for each image; under path/json a line for each image with its size and all circles.

    detections: image_id, id, cx, cy, a, b, angle_deg, r, conf, source, rim_strength; frames: image_id, w, h, scale.
    """
    d = detections.join(frames, "image_id")
    s = F.col("scale")
    table = d.select("image_id", "id", "cx", "cy", "a", "b", "angle_deg", "r", to_original(F.col("cx"), s).alias("cx_orig"), to_original(F.col("cy"), s).alias("cy_orig"), (F.col("r") / s).alias("r_orig"), F.coalesce("conf", F.lit(1.0)).alias("confidence"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("rim_strength", F.lit(0.0)).alias("rim_strength"))
    three = {c: 3 for c, t in table.dtypes if t == "double"} | {"angle_deg": 2}
    _csv(_rounded(table, three).sortWithinPartitions("image_id", "id"), f"{path}/csv", "image_id")
    circle = F.array(*(F.round(c, 2) for c in ("cx", "cy", "r")))
    ellipse = F.struct("id", "cx", "cy", "a", "b", F.col("angle_deg").alias("angle"), "r", "conf", "source", "rim_strength")
    lists = d.groupBy("image_id", "w", "h", "scale").agg(F.sort_array(F.collect_list(F.struct("id", circle.alias("c"), ellipse.alias("e")))).alias("s"))
    lists.select(F.col("image_id").alias("image"), "w", "h", F.col("scale").alias("scale_to_original"), F.transform("s", lambda x: x["c"]).alias("circles"), F.transform("s", lambda x: x["e"]).alias("ellipses")).write.mode("overwrite").json(f"{path}/json")


def write_patterns(members: DataFrame, facts: DataFrame, path: str) -> None:
    """Lines of id, name, image, scale, anchor, members, quality, ambiguous and, where there are members, signature. members: pattern_id, m, x, y, r; facts: pattern_id,
    name, image, scale, quality, ambiguous, and whatever a session has noted besides, which isn't written."""
    signed = members.join(signatures(members), ["pattern_id", "m"], "left")
    rows = signed.groupBy("pattern_id").agg(F.sort_array(F.collect_list(F.struct("m", F.array("x", "y", "r").alias("c"), F.array(F.round("sx", 4), F.round("sy", 4)).alias("p"), F.round("sr", 4).alias("sr")))).alias("s"))
    rest = F.filter("s", lambda x: x["m"] > 0)
    signature = F.when(F.size(rest) > 0, F.struct(F.col("s")[0]["sr"].alias("anchor_r"), F.transform(rest, lambda x: x["p"]).alias("members_xy"), F.transform(rest, lambda x: x["sr"]).alias("members_r")))
    out = rows.join(facts, "pattern_id")
    out.select(F.col("pattern_id").cast("string").alias("id"), "name", "image", "scale", F.col("s")[0]["c"].alias("anchor"), F.transform(rest, lambda x: x["c"]).alias("members"), "quality", "ambiguous", signature.alias("signature")).write.mode("overwrite").json(path)


def write_model(model: RandomForestClassificationModel, report: DataFrame, path: str) -> None:
    """The model, and the training report's one row as JSON."""
    model.write().overwrite().save(f"{path}/model")
    report.write.mode("overwrite").json(f"{path}/train_report")


def read_model(spark: SparkSession, path: str) -> RandomForestClassificationModel | None:
    """None where none has been saved."""
    return RandomForestClassificationModel.load(f"{path}/model") if exists(spark, f"{path}/model") else None


def write_project(complete: DataFrame, path: str) -> None:
    """complete: image, complete. Lines of a map with one image each, so that a project of any size is never one row."""
    complete.select(F.create_map("image", "complete").alias("complete")).write.mode("overwrite").json(path)


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """image, complete; empty where no project has been saved."""
    if not exists(spark, path):
        return spark.createDataFrame([], "image string, complete boolean")
    return spark.read.schema("complete map<string,boolean>").json(path).select(F.explode("complete").alias("image", "complete"))


def _square(cells: list[Column]) -> Column:
    return F.array(*(F.array(*cells[k : k + 3]) for k in (0, 3, 6)))


def write_learned(matches: DataFrame, summary: DataFrame, path: str) -> None:
    """Matches of two catalogues, three decimals, and the transforms. matches: image_id, i, j, x, y, ra, u, v, rb, e; summary: matching.match_learned()."""
    names = {"i": "crater_A", "j": "crater_B", "x": "xA", "y": "yA", "ra": "rA", "u": "xB", "v": "yB", "rb": "rB", "e": "residual_px"}
    _csv(_rounded(matches.select("image_id", *(F.col(a).alias(b) for a, b in names.items())), 3), f"{path}/matches", "image_id")
    summary.write.mode("overwrite").json(f"{path}/transform")


def write_search(patterns: DataFrame, hits: DataFrame, images: DataFrame, path: str) -> None:
    """A line for each pattern and searched image: zoom with four decimals, rotation and places with two, score with three. A weak find has its figures and found false; where no place was found
    they are empty. patterns: tables.patterns(); hits: patterns.located(); images: pattern_id, image_id that were searched."""
    size = patterns.groupBy("pattern_id").agg(F.max("name").alias("pattern"), F.max("image").alias("source_image"), F.count("*").alias("n_pattern_craters"))
    figures = hits.select("pattern_id", "image_id", "found", F.col("n_hit").alias("n_detected"), F.col("n_probed").alias("n_pattern_guided"), F.round("score", 3).alias("score"), F.round("scale", 4).alias("zoom"), F.round("rotation_deg", 2).alias("rotation_deg"), F.round(F.col("members")[0]["cx"], 2).alias("anchor_x"), F.round(F.col("members")[0]["cy"], 2).alias("anchor_y"))
    all_ = images.join(size, "pattern_id").join(figures, ["pattern_id", "image_id"], "left")
    out = all_.select("pattern", "source_image", "image_id", F.coalesce("found", F.lit(False)).alias("found"), "n_pattern_craters", *figures.columns[3:])
    _csv(out, path, "image_id")


def write_registration(matches: DataFrame, summary: DataFrame, frames: DataFrame, path: str, grid: DataFrame | None = None) -> None:
    """Of every registered pair: matches (four decimals, with original pixels, and lon and lat if they have them), the transform in both directions, the metrics,
    and the target's grid (seven decimals, only where both are numbers).

    matches: image_id, x, y, ra, u, v, rb, e_ref, optionally lon, lat; summary: matching.match_pairs(), with whatever metrics are joined to it; frames: image_id,
    scale_ref, scale_tgt; grid: geo.target_grid().
    """
    m = matches.join(frames, "image_id")
    original = [to_original(F.col(c), F.col(f"scale_{side}")).alias(f"{side}_{axis}_orig") for c, side, axis in (("x", "ref", "x"), ("y", "ref", "y"), ("u", "tgt", "x"), ("v", "tgt", "y"))]
    names = {"x": "ref_x", "y": "ref_y", "ra": "ref_r", "u": "tgt_x", "v": "tgt_y", "rb": "tgt_r", "e_ref": "residual_ref_px"}
    _csv(_rounded(m.select("image_id", *(F.col(a).alias(b) for a, b in names.items()), *original, *(c for c in ("lon", "lat") if c in matches.columns)), 4), f"{path}/matches", "image_id")
    there = _square([F.col(c) for c in MATRIX])
    t = summary.join(frames, "image_id").select("image_id", "model", there.alias("T_reference_to_target"), _square(inverse_matrix()).alias("T_target_to_reference"), F.col("scale").alias("zoom_tgt_over_ref"), "rotation_deg", "scale_ref", "scale_tgt")
    t.write.mode("overwrite").json(f"{path}/transform")
    summary.drop(*MATRIX).write.mode("overwrite").json(f"{path}/metrics")
    if grid is not None:
        known = grid.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
        _csv(known.select("image_id", F.round("lon", 7).alias("Longitude"), F.round("lat", 7).alias("Latitude"), F.col("pixel").alias("Pixel"), F.col("scan").alias("Scan")), f"{path}/grid", "image_id", lineSep="\r\n")


def write_batch(pairs: DataFrame, summary: DataFrame, path: str) -> None:
    """A line for each pair (image_id, target) that was tried, in the order of targets: ok, and the figures of those that were registered. summary needs model,
    n_inliers, inlier_ratio, scale, rotation_deg, rmse_ref, heldout_ref and coverage."""
    out = pairs.join(summary, "image_id", "left").select(
        "target", F.col("model").isNotNull().alias("ok"), "model", "n_inliers", "inlier_ratio", F.round("scale", 5).alias("zoom_tgt_over_ref"), F.round("rotation_deg", 3).alias("rotation_deg"), F.round("rmse_ref", 3).alias("rmse_ref_px"), F.round("heldout_ref", 3).alias("heldout_rmse_ref_px"), F.round("coverage", 3).alias("coverage_3x3"))
    _csv(out.repartitionByRange("target").sortWithinPartitions("target"), path)


#: Pixels of a band of an image file.
BAND = 1 << 20


def write_rasters(pixels: DataFrame, path: str, columns: Mapping[str, Sequence[str]]) -> None:
    """Pictures of all pairs as portable grey or colour maps in plain text, in bands: path/image_id=.../picture=.../band=..., band being a file's first row. A band has as many rows as
    BAND pixels allow, one at least, so no image is ever in one task.

    pixels: image_id, y, x and values from 0 to 255, which are rounded; columns: for each picture's name its value columns, one, or three in the order red, green, blue.
    """
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    for name, values in columns.items():
        each = F.concat_ws(" ", *(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col(c) + 0.5))).cast("string") for c in values))
        lines = pixels.select("image_id", "y", F.struct("x", each.alias("v")).alias("p")).groupBy("image_id", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["v"]), " ").alias("line"))
        at = lines.join(size, "image_id").withColumn("rows", F.greatest(F.lit(1), F.floor(F.lit(BAND) / F.col("w"))))
        bands = at.withColumn("band", F.floor(F.col("y") / F.col("rows")) * F.col("rows")).groupBy("image_id", "band", "w").agg(F.sort_array(F.collect_list(F.struct("y", "line"))).alias("s"))
        head = F.concat(F.lit("P3 " if len(values) == 3 else "P2 "), F.concat_ws(" ", "w", F.size("s")), F.lit(" 255\n"))
        text = bands.select("image_id", F.lit(name).alias("picture"), "band", F.concat(head, F.array_join(F.transform("s", lambda p: p["line"]), "\n")).alias("value"))
        text.repartition("image_id", "band").write.mode("overwrite" if name == next(iter(columns)) else "append").partitionBy("image_id", "picture", "band").text(path)


#: What the registered pair is shown as: pictures and the columns of raster.products().
PICTURES = {"registered": ("registered",), "overlay": ("red", "grey", "grey"), "checker": ("checker",), "difference": ("difference",)}


def write_products(products: DataFrame, path: str) -> None:
    """raster.products() as PICTURES."""
    write_rasters(products, path, PICTURES)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """image_id, picture, y, x, k (0, or the number of the colour) and v of what write_rasters() has written."""
    files = spark.read.text(path, wholetext=True)
    parts = files.select("image_id", "picture", "band", F.split(F.regexp_replace("value", "\\s+", " "), " ").alias("t"))
    parts = parts.select("image_id", "picture", "band", F.when(F.col("t")[0] == "P3", 3).otherwise(1).alias("n"), F.col("t")[1].cast("bigint").alias("w"), F.posexplode(F.slice("t", 5, F.size("t"))).alias("at", "v")).where("v <> ''")
    return parts.selectExpr("image_id", "picture", "CAST(band AS BIGINT) + at DIV (w * n) AS y", "at DIV n % w AS x", "at % n AS k", "CAST(v AS BIGINT) AS v")


#: The report's sections and their figures; whatever else a summary has comes last.
SECTIONS = {
    "Match": ("model", "n_inliers", "n_craters_ref", "n_craters_tgt", "n_pattern_ref", "n_pattern_tgt", "n_visible_ref", "n_visible_tgt", "inlier_ratio", "uniqueness", "conf_used", "seeded", "source", "star_deviation"),
    "Transform": ("scale", "rotation_deg", "tx", "ty", "ecc_used", "cc"),
    "Accuracy": ("quality", "accuracy_src", "accuracy_basis", "rmse_src", "heldout_src", "dense_src", "rmse_tgt", "rmse_ref", "median_ref", "max_ref", "heldout_tgt", "heldout_ref", "dense_nodes", "n_kept", "rms", "rms_all", "median", "most", "within_half", "within_one"),
    "Overlap": ("overlap_area", "overlap_share", "hull_share", "coverage"),
    "Baseline": ("matches", "inliers", "median_disagreement", "agrees", "note"),
}


def write_report(summary: DataFrame, path: str, pictures: Sequence[str] = ()) -> None:
    """An HTML page for each pair, made from expressions, one text file for each: a heading that says whether it was registered and how well, a section of figures for each of SECTIONS that the
    summary has columns of, the matrix, and links to the pictures of write_rasters() beside it."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("-")), "&", "&amp;"), "<", "&lt;")
    have = [c for c in summary.columns if c not in ("image_id", "ok", *MATRIX)]
    known = {c for cs in SECTIONS.values() for c in cs}
    parts = [F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>Pair "), F.col("image_id").cast("string"), F.lit("</title></head><body><h1>Registration of pair "), F.col("image_id").cast("string"), F.lit("</h1>")]
    if "ok" in summary.columns:
        told = F.concat(F.lit("Registered"), F.concat(F.lit(": "), escaped(F.col("quality"))) if "quality" in have else F.lit(""))
        parts += [F.lit("<p class='verdict'>"), F.when(F.col("ok"), told).otherwise("No consistent crater pattern: fewer than four craters line up under any zoom and turn."), F.lit("</p>")]
    for title, names in {**SECTIONS, "Further figures": [c for c in have if c not in known]}.items():
        if rows := [c for c in names if c in have]:
            parts += [F.lit(f"<h2>{title}</h2><table>"), *(F.concat(F.lit(f"<tr><th>{c}</th><td>"), escaped(F.col(c)), F.lit("</td></tr>")) for c in rows), F.lit("</table>")]
    if set(MATRIX) <= set(summary.columns):
        cell = lambda c: F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>"))
        parts += [F.lit("<h2>From reference to target</h2><table class='matrix'>"), *(F.concat(F.lit("<tr>"), *map(cell, MATRIX[k : k + 3]), F.lit("</tr>")) for k in (0, 3, 6)), F.lit("</table>")]
    if pictures:
        link = lambda n: F.concat(F.lit(f"<li>{n}: <a href='../image_id="), F.col("image_id").cast("string"), F.lit(f"/picture={n}'>bands</a></li>"))
        parts += [F.lit("<h2>Pictures</h2><ul>"), *map(link, pictures), F.lit("</ul>")]
    page = F.concat(*parts, F.lit("</body></html>"))
    summary.select("image_id", page.alias("value")).repartition("image_id").write.mode("overwrite").partitionBy("image_id").text(path)


def siblings(files: DataFrame) -> DataFrame:
    """files: path of images and of what else lies beside and under them. path, label, grid, craters: an image's .xml, its grid (the stem with _b_brw_ as _g_grd_, .csv)
    and the craters.csv of a folder named by its stem; null where there is none."""
    named = files.withColumns({"stem": F.regexp_extract("path", r"^(.*)\.[^./]*$", 1), "kind": F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))})
    images = named.where(F.col("kind").isin("png", "jpg", "jpeg", "tif", "tiff", "bmp")).select("path", "stem", F.regexp_replace("stem", "_b_brw_", "_g_grd_").alias("grid_stem"), F.regexp_extract("stem", r"([^/]*)$", 1).alias("name"))
    label = named.where("kind = 'xml'").select(F.col("stem"), F.col("path").alias("label"))
    grid = named.where("kind = 'csv'").select(F.col("stem").alias("grid_stem"), F.col("path").alias("grid"))
    craters = named.where(F.col("path").endswith("/craters.csv")).select(F.regexp_extract("path", r"([^/]*)/craters\.csv$", 1).alias("name"), F.col("path").alias("craters"))
    craters = craters.groupBy("name").agg(F.min("craters").alias("craters"))
    return images.join(label, "stem", "left").join(grid, "grid_stem", "left").join(craters, "name", "left").select("path", "label", "grid", "craters")
