"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import set_apart, written

#: Poisson draws are made in parts with means up to this, so that exp(-mean) stays exact; a part's distribution reaches 1 within _STEPS.
_PART, _STEPS = 16.0, 100


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in key))), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def counted(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, n): the sources' numbers of documents, written. Null is a source."""
    apart, _ = set_apart(docs, (source_col,), docs.columns)
    return written(apart.groupBy(F.col("in0").alias("source")).agg(F.count("*").alias("n")))


def tempered(counts: DataFrame, exponent: float = 0.5) -> DataFrame:
    """(source, weight): target weights in proportion to the counts to the power `exponent`."""
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(exponent)).alias("weight"))


def rates(counts: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """(source, rate): how often a document of the source is repeated in the mean, so that sources have their weights' shares of `total` documents (as
    many as there are, unless given). A source without a weight gets none; one of weight zero or less, or null, none either. Null is a source."""
    w = weights.groupBy(F.col("source").alias("of")).agg(F.sum("weight").alias("weight")).where("weight > 0")
    joined = counts.join(w, counts["source"].eqNullSafe(w["of"]), "left").select("source", "n", "weight")
    sums = joined.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    total = float(sums["n"] or 0) if total is None else total
    return joined.where("weight is not null").select("source", (F.lit(total) * F.col("weight") / F.lit(sums["w"] or 1.0) / F.col("n")).alias("rate"))


def _distribution(rate: Column) -> Column:
    """The cumulated Poisson distribution with mean rate at 0, 1, ... _STEPS - 1."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS - 1)), start, step, lambda a: a["all"])


def mixed(docs: DataFrame, weights: DataFrame | float, id_col: str = "doc_id", source_col: str = "source", seed: int = 7, total: float | None = None) -> DataFrame:
    """docs with each row repeated a Poisson number of times, whose mean is its source's rate, in a random global order; new columns: rate, copy
    (1, 2, ...) and shuffle_key, by which the partitions' rows are sorted; columns of docs that have one of these names, in any case, are replaced.
    weights: (source, weight), or an exponent for tempered().

    The number is the inverse of the source's distribution at a hash of seed, id and part, so a rerun, in any partitioning, draws the same; rows with the
    same id, or a null id, draw the same number. An empty table gives an empty result. Distributions are made once for each source and written, so that
    Spark knows their size: below its broadcast threshold they go to the documents, which then move once only; where a third of all rows has one source and
    the table of sources is large, the adaptive join splits them. Rows then go to partitions by the hash of their key: each
    partition is a random part of the whole, in random order, and large sources or repeated rows spread evenly.
    """
    added = ("rate", "copy", "shuffle_key")
    apart, rest = set_apart(docs, (id_col, source_col), added)
    counts = counted(apart, "in1")
    table = rates(counts, tempered(counts, weights) if isinstance(weights, float) else weights, total).withColumn("parts", F.ceil(F.col("rate") / F.lit(_PART)).cast("int"))
    table = written(table.withColumn("steps", _distribution(F.col("rate") / F.greatest("parts", F.lit(1)))))
    joined = apart.join(table, apart["in1"].eqNullSafe(table["source"]))
    draw = lambda j: F.size(F.filter("steps", lambda c: c <= uniform(F.lit(seed), F.col("in0"), j)))
    copies = F.aggregate(F.sequence(F.lit(1), F.greatest("parts", F.lit(1))), F.lit(0), lambda n, j: n + draw(j))
    drawn = joined.withColumn("copies", copies).where("copies > 0")
    out = drawn.select(*apart.columns, "rate", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    out = out.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col("in0"), F.col("copy")))
    out = out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    names = dict(zip([id_col.lower(), source_col.lower(), *map(str.lower, rest)], apart.columns))
    own = [c for c in docs.columns if c.lower() not in added]
    return out.select(*(names[c.lower()] for c in own), *added).toDF(*own, *added)
