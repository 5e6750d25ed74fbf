"""Catalogues that arrive as files are registered batch by batch (an extension: the batch loop over targets, without an end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import match_pairs
from ..schema import CRATERS


def registered(spark: SparkSession, reference: DataFrame, folder: str, out: str, checkpoint: str, most: int = 7000) -> StreamingQuery:
    """Matches each new Parquet file of target craters against the reference of its images; appends to `out`. A batch that is run again replaces its own folder,
    so results are written once."""

    def batch(craters: DataFrame, number: int) -> None:
        found = match_pairs(reference.join(craters.select("image_id").distinct(), "image_id", "left_semi"), craters, most)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(CRATERS).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
