"""Tables that cut lineage, in the folder all executors share, and joins against sides of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long column that may be broadcast (16 bytes a row, so 16 MB); larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; only where unset, and only in local mode, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, column: str, ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose column is in ids (one column of that name, a stored table).

    ids is broadcast only if it has at most ``limit`` rows; a larger one is shuffled with df.
    """
    small = ids.count() <= limit
    return df.join(F.broadcast(ids) if small else ids, column, "left_semi")


def joined(docs: DataFrame, column: str, side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """docs with the columns of side (a stored table, one row a value of column).

    If side has at most ``limit`` rows its ids are broadcast, so only rows of docs that have a partner are shuffled; beyond
    that docs and side are shuffled once.
    """
    if side.count() <= limit:
        docs = docs.join(F.broadcast(side.select(column)), column, "left_semi")
    return docs.join(side, column)


def without(docs: DataFrame, column: str, side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of docs whose column is not in side."""
    ids = side.select(column)
    return docs.join(F.broadcast(ids) if side.count() <= limit else ids, column, "left_anti")


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            delete(df.sparkSession, files[0].rsplit("/", 1)[0])
