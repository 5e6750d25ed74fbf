"""A Merkle tree over a table's rows, one subtree for each group, with a proof for every row.

Leaves are numbered within their groups by a range sort, whose partitions' sizes give the offsets, so no group is in one task. The tree grows some levels a
round: `levels` levels above `fanout ** levels` consecutive nodes are one row of a written table, which stores each parent's preimage, the hashes of its children
one after the other. Going down again, each such row joins the row above it for the preimages of its ancestors; a leaf joins its row once and has its whole
path. From each preimage it cuts out its own 64 characters, and what stays are its siblings; put back changed, the preimage gives the changed parent.

Everything but the texts' hashes is a few hundred bytes a row, and texts are read once and never shuffled. All of it runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import set_apart, written

HASH = 64


@dataclass(frozen=True)
class Shape:
    """fanout: children of a node. levels: of the tree in one row of a round's table, which holds fanout ** levels hashes."""

    fanout: int = 2
    levels: int = 8

    @property
    def span(self) -> int:
        return self.fanout**self.levels


def field(value: Column) -> Column:
    """A value as `bytes:value` in UTF-8, and null as `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """SHA-256, in lower-case hex, of a row's values."""
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(leaves: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """leaves (group, leaf, ...) with pos, their number from 0 within their group by order, and (group, n), the groups' sizes; both are written tables.

    A group is spread over partitions by its order; the partitions' sizes, as many rows as there are partitions and groups, are summed up in a window.
    """
    turns = [F.col("group").asc_nulls_first(), *order]
    n = max(1, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = written(leaves.repartitionByRange(n, *turns).sortWithinPartitions(*turns).withColumn("part", F.spark_partition_id()).withColumn("turn", F.monotonically_increasing_id()))
    sizes = parted.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    before = Window.partitionBy("group").orderBy("part")
    offsets = written(sizes.select("group", "part", "n", "first", (F.sum("n").over(before) - F.col("n")).alias("before")))
    # monotonically_increasing_id counts on within a partition, and a group's rows are next to each other there.
    at = offsets.select(F.col("group").alias("g"), F.col("part").alias("p"), "first", "before")
    placed = parted.join(at, parted["group"].eqNullSafe(at["g"]) & (parted["part"] == at["p"])).withColumn("pos", F.col("turn") - F.col("first") + F.col("before"))
    return placed.drop("g", "p", "part", "turn", "first", "before"), offsets.groupBy("group").agg(F.sum("n").alias("n"))


def _height(n: Column, fanout: int) -> Column:
    """Levels above n nodes until one is left."""
    powers = F.array(*(F.lit(fanout**k) for k in range(64) if fanout**k < 2**62))
    return F.size(F.filter(powers, lambda p: p < n))


def _blocks(nodes: DataFrame, shape: Shape) -> DataFrame:
    """nodes: group, pos, hash, height (levels still to come). group, block, height, top (the hash that is left), preimages (for each level, those of its
    parents), a row for each `span` consecutive nodes."""
    each = F.sort_array(F.collect_list(F.struct("pos", "hash")))
    rows = nodes.groupBy("group", F.floor(F.col("pos") / shape.span).alias("block")).agg(F.max("height").alias("height"), each.alias("h"))
    rows = rows.withColumn("h", F.transform("h", lambda x: x["hash"])).withColumn("preimages", F.array().cast("array<array<string>>"))
    for level in range(shape.levels):
        f = shape.fanout
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("h") / f) - 1, F.lit(0)).cast("int"))
        parents = F.transform(at, lambda i: F.array_join(F.slice(F.col("h"), i * f + 1, f), ""))  # noqa: B023
        grows = F.col("height") > level
        rows = rows.withColumn("now", F.when(grows, parents))
        rows = rows.withColumns({"h": F.when(grows, F.transform("now", lambda p: F.sha2(p, 256))).otherwise(F.col("h")), "preimages": F.when(grows, F.concat("preimages", F.array("now"))).otherwise(F.col("preimages"))})
    return rows.select("group", "block", "height", F.col("h")[0].alias("top"), "preimages")


def _path(pos: Column, preimages: Column, fanout: int) -> Column:
    """From bottom to top, the preimages above a node, each with the node's own slot in it."""

    def step(p: Column, k: Column) -> Column:
        at = F.floor(pos / F.pow(F.lit(float(fanout)), k)).cast("bigint")
        return F.struct(F.get(p, F.floor(at / fanout).cast("int")).alias("preimage"), F.pmod(at, F.lit(fanout)).cast("int").alias("slot"))

    return F.transform(preimages, step)


def grown(leaves: DataFrame, sizes: DataFrame, shape: Shape = Shape()) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' tables above leaves (group, pos, leaf), bottom to top, and (group, subroot).

    As many rounds as the height of the largest group's tree over `levels`: three for 16 million leaves, four for 4 billion. Groups that are done wait.
    """
    known = sizes.select(F.col("group").alias("g"), _height(F.col("n"), shape.fanout).alias("height"))
    nodes = leaves.select("group", "pos", F.col("leaf").alias("hash"))
    nodes = nodes.join(known, nodes["group"].eqNullSafe(known["g"])).drop("g")
    rounds, tops = [], None
    while True:
        rounds.append(now := written(_blocks(nodes, shape)))
        done = now.where(F.col("height") <= shape.levels).select("group", F.col("top").alias("subroot"))
        tops = done if tops is None else tops.unionByName(done)
        nodes = now.where(F.col("height") > shape.levels).select("group", F.col("block").alias("pos"), F.col("top").alias("hash"), (F.col("height") - shape.levels).alias("height"))
        if nodes.isEmpty():
            return rounds, tops


def with_paths(leaves: DataFrame, rounds: list[DataFrame], ends: DataFrame | None = None, shape: Shape = Shape()) -> DataFrame:
    """leaves (group, pos, ...) with path, an array of (preimage, slot) from their parents to their group's subroot, and on along the `last` of ends (group, last, ...),
    whose other columns come too. A leaf joins the row above it once; what is above that has been joined to that row before."""
    given = ends.columns[1:] if ends is not None else []
    extra = [c for c in given if c != "last"]
    above = None
    for rows in reversed(rounds):
        own = rows.select("group", "block", "height", "preimages")
        if ends is None:
            own = own.withColumn("end", F.struct(_path(F.lit(0), F.array().cast("array<array<string>>"), shape.fanout).alias("last")))
        else:
            to = ends.select(F.col("group").alias("g"), F.struct(*given).alias("end"))
            own = own.join(to, own["group"].eqNullSafe(to["g"]) & (own["height"] <= shape.levels), "left").drop("g")
        if above is not None:
            up = above.select(F.col("group").alias("g"), F.col("block").alias("b"), F.col("preimages").alias("p"), F.col("end").alias("e"))
            joined = own.join(up, own["group"].eqNullSafe(up["g"]) & (F.floor(own["block"] / shape.span) == up["b"]) & (own["height"] > shape.levels), "left")
            further = F.col("e").withField("last", F.concat(_path(F.pmod("block", F.lit(shape.span)), F.col("p"), shape.fanout), F.col("e.last")))
            own = joined.select("group", "block", "height", "preimages", F.when(F.col("height") > shape.levels, further).otherwise(F.col("end")).alias("end"))
        above = own
    up = above.select(F.col("group").alias("g"), F.col("block").alias("b"), F.col("preimages").alias("p"), F.col("end").alias("e"))
    out = leaves.join(up, leaves["group"].eqNullSafe(up["g"]) & (F.floor(leaves["pos"] / shape.span) == up["b"]))
    path = F.concat(_path(F.pmod("pos", F.lit(shape.span)), F.col("p"), shape.fanout), F.col("e.last"))
    return out.select(*leaves.columns, *(F.col(f"e.{c}").alias(c) for c in extra), path.alias("path"))


def siblings(path: Column) -> Column:
    """A path's hashes without the node's own and its ancestors', bottom to top, left to right."""
    cut = lambda p: F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * HASH), F.substr(p["preimage"], p["slot"] * HASH + HASH + 1))
    return F.array_join(F.transform(path, cut), "")


def folded(leaf: Column, path: Column) -> Column:
    """The hash at a path's end if its leaf is this one."""
    put = lambda h, p: F.sha2(F.concat(F.substr(p["preimage"], F.lit(1), p["slot"] * HASH), h, F.substr(p["preimage"], p["slot"] * HASH + HASH + 1)), 256)
    return F.aggregate(path, leaf, put)


OUT = ("leaf", "subroot", "root", "path")


def manifest(rows: DataFrame, group_col: str = "lang", order_col: str = "doc_id", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), keep: Sequence[str] = (), shape: Shape = Shape()) -> DataFrame:
    """keep's columns of rows with leaf, subroot, root and path, an array of (preimage, slot) from the leaf's parent to the root; columns of rows that have one of these
    names, in any case, can't be kept.

    A leaf is digest() of the row's fields. In each group leaves ascend by order_col, null first, rows with the same by their leaves; while several nodes are left, every
    `fanout` consecutive ones become the hash of their hashes, the last being fewer, even one. A lone leaf is its group's subroot. Subroots by
    group, null first, then bytewise, give the root in the same way.

    A null field is `-` in the leaf, so null and empty differ; empty and very long texts are leaves like any other, hashed whole where they are read. Rows that
    repeat are leaves of their own, next to each other, with paths of their own. An empty table gives an empty result.
    """
    kept = [c for c in keep if c.lower() not in OUT]
    apart, _ = set_apart(rows, (group_col, order_col, *fields, *kept), rows.columns)
    f, k = [F.col(f"in{2 + i}") for i in range(len(fields))], len(fields) + 2
    held = [f"in{k + i}" for i in range(len(kept))]
    # Written, as a range sort reads its input twice and texts should be hashed once; row tells rows apart that repeat.
    leaves = written(apart.select(F.col("in0").cast("string").alias("group"), F.col("in1").alias("turn_by"), digest(*f).alias("leaf"), F.monotonically_increasing_id().alias("row"), *held))
    placed, sizes = numbered(leaves, [F.col("turn_by").asc_nulls_first(), F.col("leaf"), F.col("row")])
    rounds, subroots = grown(placed, sizes, shape)
    # Groups are leaves of one more tree.
    tops, one = numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("subroot").alias("leaf")), [F.col("name").asc_nulls_first()])
    upper, root = grown(tops, one, shape)
    ends = with_paths(tops.join(root.select("group", F.col("subroot").alias("root")), "group"), upper, shape=shape)
    ends = ends.select(F.col("name").alias("group"), F.col("path").alias("last"), F.col("leaf").alias("subroot"), "root")
    out = with_paths(placed, rounds, ends, shape)
    return out.select(*held, "leaf", "subroot", "root", "path").toDF(*kept, *OUT)
