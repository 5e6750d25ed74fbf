"""Tables written between the jobs of one operator, in the folder that the cluster shares, and columns set apart from those of the caller."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, below a folder of this application that goes when its driver ends. Only where that setting is absent, as in
    tests on one machine, a local folder is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        sc.setCheckpointDir(base)
    own = f"{base.rstrip('/')}/written-{sc.applicationId}"
    if own not in _MADE:
        _MADE.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the driver's JVM may have ended first
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost only tasks that re-read it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Removes a table made by written() that no later job reads."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of so many rows for the session, unless it has set another number than Spark's own 10,000: texts are long rows, and a batch is held several
    times over, in the JVM outside of its heap and in Python. No result depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, rows)


def set_apart(df: DataFrame, inputs: Sequence[str | None], outputs: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """df with the columns named in inputs as in0, in1, ... and its other columns as c0, c1, ..., and the names of these others. Others that have, in any
    case, one of the names in outputs are left out, as Spark takes names without regard to case. So nothing an operator adds can clash. The operators that
    begin with this read texts in tasks, so their batches are made small."""
    small_batches(df.sparkSession)
    folded = [c.lower() for c in df.columns]
    at = {k: df.columns.index(c) if c in df.columns else folded.index(c.lower()) for k, c in enumerate(inputs) if c is not None}
    gone = {c.lower() for c in outputs}
    rest = [k for k, c in enumerate(folded) if k not in at.values() and c not in gone]
    numbered = df.toDF(*(f"n{k}" for k in range(len(folded))))
    columns = [numbered[f"n{i}"].alias(f"in{k}") for k, i in at.items()] + [numbered[f"n{i}"].alias(f"c{k}") for k, i in enumerate(rest)]
    return numbered.select(*columns), [df.columns[k] for k in rest]


def kinds(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """For the schema of a function over Arrow batches."""
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]
