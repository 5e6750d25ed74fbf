"""Crater relations derived from general-purpose tables, in SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_P = 1000003


def _hashed(key: str, columns: str, table: str) -> str:
    """Pseudo-random integers h, h3, h5, h7 below a prime from an integer key; powers keep neighbours of a key apart."""
    h = f"(({key}) * 48271 + 12345) % {_P}"
    return f"""SELECT *, (h * h % {_P}) * h5 % {_P} AS h7 FROM (SELECT *, (h * h % {_P}) * h3 % {_P} AS h5 FROM (
    SELECT *, (h * h % {_P}) * h % {_P} AS h3 FROM (SELECT {columns}, {h} AS h FROM {table}) a) b) c"""


_POINT = "(h3 % 900000) / 1000e0 AS cx, (h5 % 900000) / 1000e0 AS cy, 12e0 + (h7 % 58000) / 1000e0 AS r"
_PLACE = "CAST(floor({0} / {1}) AS BIGINT) AS image_id"

_REF = f"""SELECT k AS crater_id, image_id, h, h5, h7, {_POINT} FROM ({_hashed("p_partkey", f"p_partkey AS k, {_PLACE.format('p_partkey', '100e0')}", "{part}")}) d"""
_DECOY = f"""SELECT k AS crater_id, image_id, {_POINT} FROM ({_hashed("s_suppkey + 500000", f"s_suppkey + 500000 AS k, {_PLACE.format('s_suppkey', '5e0')}", "{supplier}")}) d"""

#: By relation: SQL over named tables. The target of a pair is its reference turned by 20 degrees, scaled by 0.8, shifted by (60, 90) and jittered, less a
#: seventh of the craters, with five decoys for each image.
RELATIONS: dict[str, str] = {
    "craters_ref": f"SELECT crater_id, image_id, cx, cy, r FROM ({_REF}) e",
    "craters_tgt": f"""SELECT crater_id, image_id,
    (0.9396926207859084e0 * cx - 0.3420201433256687e0 * cy) * 0.8e0 + 60e0 + ((h5 % 201) - 100) / 1000e0 AS cx,
    (0.3420201433256687e0 * cx + 0.9396926207859084e0 * cy) * 0.8e0 + 90e0 + ((h7 % 201) - 100) / 1000e0 AS cy, r * 0.8e0 AS r
    FROM ({_REF}) e WHERE h % 7 <> 0 UNION ALL SELECT * FROM ({_DECOY}) f""",
    "detections": f"""SELECT crater_id * 3 + t AS det_id, crater_id, image_id, cx + t * ((h5 % 5) - 2) AS cx, cy + t * ((h7 % 5) - 2) AS cy, r * (1e0 + t * 0.03e0) AS r,
    ((h7 + t * 331) % 1000) / 1000e0 AS conf FROM ({_REF}) e CROSS JOIN (SELECT CAST(0 AS BIGINT) AS t UNION ALL SELECT CAST(1 AS BIGINT) UNION ALL SELECT CAST(2 AS BIGINT)) f""",
    "annotations": f"""SELECT doc_id AS ann_id, image_id, cx, cy, r, quality AS label, toxic FROM ({_REF}) e JOIN {{labels}} l ON e.crater_id = l.doc_id""",
    "residual_nodes": """SELECT event_id AS node_id, user_id AS pair_id, value / 100e0 AS dx, ((event_id * 7919) % 1000) / 500e0 - 1e0 AS dy FROM {events} WHERE value IS NOT NULL""",
    "geo_grid": """SELECT image_id, pixel, scan, 20e0 + image_id + pixel / 4000e0 + scan / 90000e0 AS lon, -60e0 + scan / 5000e0 + pixel / 80000e0 AS lat
    FROM (SELECT DISTINCT image_id FROM {craters_ref}) a CROSS JOIN (SELECT DISTINCT p_size * 100 - 100 AS pixel FROM {part} WHERE p_size <= 11) b
    CROSS JOIN (SELECT DISTINCT p_size * 100 - 100 AS scan FROM {part} WHERE p_size <= 11) c""",
}
_TABLES = ("part", "supplier", "labels", "events")
_NESTED = {"craters_ref"}


def sql_of(relation: str) -> str:
    """A relation's SQL over tables of these names."""
    return RELATIONS[relation].format(**{t: t for t in _TABLES}, craters_ref=f"({RELATIONS['craters_ref'].format(part='part')})")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation as a DataFrame over the Parquet tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in RELATIONS[name]}
    if "{craters_ref}" in RELATIONS[name]:
        used["craters_ref"] = relation(spark, sf_dir, "craters_ref")
    return spark.sql(RELATIONS[name], **used)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters as rows: image_id, y, x, v."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.selectExpr("CAST(floor(vec_id / 100e0) AS BIGINT) AS image_id", "vec_id % 100 AS y", "posexplode(embedding) AS (x, v)").selectExpr("image_id", "y", "CAST(x AS BIGINT) AS x", "CAST(v AS DOUBLE) AS v")


PIXELS_SQL = """SELECT CAST(floor(vec_id / 100e0) AS BIGINT) AS image_id, vec_id % 100 AS y, CAST(x AS BIGINT) AS x, CAST(v AS DOUBLE) AS v
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings) p"""
