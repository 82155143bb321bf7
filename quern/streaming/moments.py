"""Cell moments kept up to date over a stream of assigned nodes: they are sums, so each batch adds its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_moments(assigned: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """assigned: stream of (cell, x).  Appends each batch's (cell, dim, n, s, batch) to the Parquet table at ``path``.

    A batch that is run again after a failure replaces its own part, so its sums count once; current_moments() adds the
    parts, which are as small as the cells.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.select("cell", F.posexplode("x").alias("dim", "v"))
        rows.groupBy("cell", "dim").agg(F.count("*").alias("n"), F.sum("v").alias("s")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return assigned.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_moments(spark: SparkSession, path: str) -> DataFrame:
    """(cell, dim, n, s) of all that came so far."""
    return spark.read.parquet(path).groupBy("cell", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
