"""Facts from product labels: XML leaves as rows, looked up in document order."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The keys' patterns of each fact. A fact is the value of the first leaf, in document order, whose key matches.
FACTS = {
    "product_id": r"logical_identifier",
    "title": r"(^|/)title$",
    "start_time": r"start_date_time|start_time|image_start",
    "stop_time": r"stop_date_time|stop_time|image_stop",
    "mission": r"Investigation_Area/name|mission",
    "target": r"Target_Identification/name",
    "sun_elevation_deg": r"sun.*elev|solar.*elev",
    "sun_azimuth_deg": r"sun.*azim|solar.*azim",
    "incidence_angle_deg": r"incidence",
    "emission_angle_deg": r"emission",
    "phase_angle_deg": r"phase_angle|phase",
    "altitude_km": r"altitude|spacecraft.*dist",
    "resolution_m": r"resolution|gsd|pixel_size|pixel_scale",
    "orbit": r"orbit_number|orbit_no|(^|/)orbit$",
}
NUMERIC = ("sun_elevation_deg", "sun_azimuth_deg", "incidence_angle_deg", "emission_angle_deg", "phase_angle_deg", "altitude_km", "resolution_m", "orbit")


def _walk(text: str) -> list[tuple[int, str, str]]:
    out: list[tuple[int, str, str]] = []
    stack = [(ET.fromstring(text), ())]
    while stack:
        node, path = stack.pop()
        path = (*path, node.tag.rpartition("}")[2])
        if len(node):
            stack += [(c, path) for c in reversed(node)]
        elif node.text and node.text.strip():
            out.append((len(out), "/".join(path[-3:]), node.text.strip()))
    return out


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[tuple] = []
        for file, text in zip(pdf["file"], pdf["content"]):
            try:
                rows += [(file, *leaf, None) for leaf in _walk(text or "")]
            except ET.ParseError as e:
                rows.append((file, None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["file", "ord", "key", "value", "error"]).astype({"ord": "Int64"})


def leaves(files: DataFrame) -> DataFrame:
    """files (file, content): file, ord, key (the last three tags, without name spaces), value of every leaf; a file that can't be parsed gives one row with its
    error and no key."""
    return files.select("file", "content").mapInPandas(_leaves, "file string, ord bigint, key string, value string, error string")


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0).try_cast("double")


def facts(rows: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """file and one column for each fact; facts that are missing are null. One pass: each fact is an aggregate over the leaves that match it."""
    patterns = patterns or FACTS
    found = [F.min_by("value", F.when(F.col("key").rlike(f"(?i){p}"), F.col("ord"))).alias(name) for name, p in patterns.items()]
    out = rows.groupBy("file").agg(*(F.when(F.count_if(F.col("key").rlike(f"(?i){p}")) > 0, c).alias(n) for (n, p), c in zip(patterns.items(), found)))
    return out.withColumns({n: first_number(F.col(n)) for n in NUMERIC if n in patterns})


def axis_pairs(rows: DataFrame) -> DataFrame:
    """file, ord, axis, elements: a leaf whose key ends in axis_name with the next leaf, if that one's ends in elements."""
    w = Window.partitionBy("file").orderBy("ord")
    both = rows.withColumns({"next_key": F.lead("key").over(w), "next_value": F.lead("value").over(w)})
    pairs = both.where(F.col("key").endswith("axis_name") & F.col("next_key").endswith("elements"))
    return pairs.select("file", "ord", F.col("value").alias("axis"), first_number(F.col("next_value")).cast("int").alias("elements"))


def image_size(rows: DataFrame) -> DataFrame:
    """file, lines, samples: of the axes whose names begin with line and sample, the last ones in document order."""
    axis = axis_pairs(rows).withColumn("name", F.lower("axis"))
    last = lambda word: F.max(F.when(F.col("name").startswith(word), F.struct("ord", "elements"))).getField("elements")
    return axis.groupBy("file").agg(last("line").alias("lines"), last("sample").alias("samples"))


def instruments(rows: DataFrame) -> DataFrame:
    """file, instrument: the first leaf that names an orbiter as a part of the observing system (Chandrayaan's own name aside), or an instrument."""
    key, value = F.col("key"), F.lower("value")
    orbiter = key.rlike("Observing_System_Component/name$") & ~value.contains("chandrayaan") & value.contains("orbiter")
    found = rows.where(orbiter | key.rlike("(?i)instrument.*name"))
    return found.groupBy("file").agg(F.min_by("value", "ord").alias("instrument"))


def context(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences between two labels' facts joined on pair_id: days between the captures, and of sun angles (absolute, not wrapped)."""
    time = lambda c: F.try_to_timestamp(F.regexp_replace(c, "[Zz]", ""))
    j = a.alias("a").join(b.alias("b"), "pair_id")
    days = (F.unix_micros(time(F.col("b.start_time"))) - F.unix_micros(time(F.col("a.start_time")))) / 86400e6
    return j.select("pair_id", F.abs(days).alias("days"), *(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"d_{c}") for c in ("sun_elevation_deg", "sun_azimuth_deg", "incidence_angle_deg")))
