"""Readers and writers of crater catalogues, annotations, control grids, patterns and matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiles import PLACE, SIDE
from ..schema import ANNOTATIONS, GRID_COLUMNS, PATTERNS


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Labelled circles; empty where there is no file yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ANNOTATIONS)
    return spark.read.schema(ANNOTATIONS).csv(path, header=True)


def to_work(c: Column, scale: Column) -> Column:
    """Work pixels from original ones, by pixel centres."""
    return (c + 0.5) * scale - 0.5


def to_original(c: Column, scale: Column) -> Column:
    return (c + 0.5) / scale - 0.5


def craters(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """file, crater_id, cx, cy, a, b, angle_deg, r, confidence in work pixels.

    With cx_orig, cy_orig and r_orig, the originals are scaled, and the axes by r_orig * scale / r; otherwise coordinates are taken as they are. Missing are:
    r: radius, else 10; a and b: r; angle: 0; confidence: 1. Column names in any case.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns)).withColumn("file", F.col("_metadata.file_path") if "_metadata" in raw.columns else F.input_file_name())
    has = set(raw.columns)
    num = lambda name: F.col(name).try_cast("double") if name in has else F.lit(None).cast("double")
    r = F.coalesce(num("r"), num("radius"), F.lit(10.0))
    df = raw.withColumns({"r_": r, "a_": F.coalesce(num("a"), r), "b_": F.coalesce(num("b"), num("a"), r), "angle_": F.coalesce(num("angle_deg"), F.lit(0.0)), "conf_": F.coalesce(num("confidence"), F.lit(1.0))})
    s, original = F.lit(scale), num("cx_orig").isNotNull() & num("r_orig").isNotNull() & (F.col("r_") > 0)
    f = F.when(original, num("r_orig") * s / F.col("r_")).otherwise(F.lit(1.0))
    place = lambda c: F.when(original, to_work(num(f"{c}_orig"), s)).otherwise(num(c))
    number = F.coalesce(num("id").cast("bigint"), F.monotonically_increasing_id())
    out = df.select("file", number.alias("crater_id"), place("cx").alias("cx"), place("cy").alias("cy"), (F.col("a_") * f).alias("a"), (F.col("b_") * f).alias("b"), F.col("angle_").alias("angle_deg"), F.col("conf_").alias("confidence"))
    return out.withColumn("r", F.sqrt(F.col("a") * F.col("b")))


def geo_grid(spark: SparkSession, path: str) -> DataFrame:
    """pixel, scan, lon, lat of a control grid. Headers may have blanks and any case; a missing column is an error that names it."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.strip().capitalize() for c in raw.columns))
    if missing := [c for c in GRID_COLUMNS if c not in raw.columns]:
        raise ValueError(f"the grid has no column {', '.join(missing)}")
    return raw.select(F.col("Pixel").cast("int").alias("pixel"), F.col("Scan").cast("int").alias("scan"), F.col("Longitude").cast("double").alias("lon"), F.col("Latitude").cast("double").alias("lat"))


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pattern_id, name, image, scale, quality, ambiguous, m, x, y, r); m = 0 is the anchor. Files are lines of one pattern each, or one array of patterns each; a file of either kind is
    one row for a moment. Empty where there is no file yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raw = spark.createDataFrame([], PATTERNS)
    else:
        files = spark.read.text(path, wholetext=True)
        whole = F.from_json("value", f"array<struct<{PATTERNS.replace(' ', ':').replace(',:', ',')}>>")
        lines = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, PATTERNS))
        raw = files.select(F.explode(F.when(F.ltrim("value").startswith("["), whole).otherwise(lines)).alias("p")).where("p.id is not null").select("p.*")
    facts = ["name", "image", "scale", "quality", "ambiguous"]
    each = raw.select(F.col("id").alias("pattern_id"), *facts, F.posexplode(F.concat(F.array("anchor"), F.coalesce("members", F.array().cast("array<array<double>>")))).alias("m", "c"))
    return each.select("pattern_id", *facts, "m", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"), F.col("c")[2].alias("r"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """file, width, height, n_channels, data of images that Spark can decode; others have a width of -1."""
    return spark.read.format("image").option("dropInvalid", "false").load(path).select(F.col("image.origin").alias("file"), "image.width", "image.height", F.col("image.nChannels").alias("n_channels"), "image.data")


def gray_tiles(pictures: DataFrame) -> DataFrame:
    """images() as grey tiles of level 0 (operators.tiles); image_id is the file's hash. A picture that can't be read is an error that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, image, width, height, channels, data in zip(*(c.to_pylist() for c in batch.columns)):
                if width < 1:
                    raise ValueError(f"can't read {file}")
                p = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
                grey = np.floor(p[..., :3] @ [0.114, 0.587, 0.299] + 0.5) if channels >= 3 else p[..., 0]
                for ty in range(-(-height // SIDE)):
                    for tx in range(-(-width // SIDE)):
                        part = grey[ty * SIDE : (ty + 1) * SIDE, tx * SIDE : (tx + 1) * SIDE]
                        numbers = (image, 0, ty, tx, *part.shape, height, width)
                        yield pa.RecordBatch.from_arrays([*(pa.array([n], pa.int64()) for n in numbers), pa.array([part.ravel()], pa.list_(pa.float64()))], names=[*PLACE, "v"])

    return pictures.select("file", F.xxhash64("file"), "width", "height", "n_channels", "data").mapInArrow(run, ", ".join([*(f"{c} bigint" for c in PLACE), "v array<double>"]))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """file, content of XML labels, for operators.labels.leaves()."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
