"""Sharding by a two-pass external shuffle, in DataFrame functions only.

First pass: every record goes to one of the buckets, chosen uniformly by a seeded hash of its place in the input, so rows
that repeat one id or one text spread like all others.  There are as many buckets as it takes to hold ``BUCKET_BYTES`` of
text each, so a bucket fits in a task's memory whatever the size of the table, and one bucket is one partition.

Second pass: each bucket is put into a uniformly random order by Fisher-Yates (the built-in ``shuffle``, seeded by seed and
bucket) and written.  The buckets one after the other are the shuffled table; it is cut into shards of consecutive records
whose counts differ by one at most (law ``rows``), the longer ones first.  A record is shuffled once and written once.

Buckets, their order and so the whole result follow from the seed and the input's files.  ``docs`` has to give the same rows
in the same order when a lost task runs again, as tables do; store other plans first.

Nulls and edge cases: null text has size 1 and the checksum of an empty text; rows without doc_id and rows repeating one are
records of their own; texts of any length count whole, and a bucket grows by what its longest text exceeds the mean.  An empty
table gives an empty result.  Columns of docs named shard or slot are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import BROADCAST_ROWS, stored

SHARDS = 8
SEED = 20_240
#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 32 << 20
#: At least so many buckets, so that small tables occupy more than one core.
LEAST_BUCKETS = 24
#: Buckets whose counts are summed together before the sums of such runs are.
RUN = 1024


def text_size(text: str = "text") -> F.Column:
    """UTF-8 bytes and one for the end; null has none."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def text_crc32(text: str = "text") -> F.Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def scattered(docs: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """First pass: (bucket, place, record), bucket number i in partition number i."""
    rows = docs.select(F.struct("*").alias("record"), F.monotonically_increasing_id().alias("place"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).repartitionById(buckets, "bucket")


def shuffled(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS, text_col: str = "text") -> DataFrame:
    """Both passes, stored: bucket int, pos int (from 0 in each bucket), record."""
    total = docs.agg(F.coalesce(F.sum(text_size(text_col)), F.lit(0)).alias("b")).first().b
    buckets = max(least, -(-total // bucket_bytes))
    rows = scattered(docs, buckets, seed).sortWithinPartitions("bucket", "place")
    lists = rows.groupBy("bucket").agg(F.collect_list("record").alias("records"))
    order = lists.select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("pos", "record"))
    return stored(order, "buckets")


def offsets(rows: DataFrame) -> DataFrame:
    """bucket, before: the records in smaller buckets; summed in runs of buckets, then over the runs."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN))
    counts = stored(counts, "bucket-counts")
    ahead = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("run").agg(F.sum("n").alias("all")).select("run", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return within.join(F.broadcast(runs), "run").select("bucket", (F.col("earlier") + F.col("inside")).alias("before"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS, text_col: str = "text") -> DataFrame:
    """All columns of docs with shard int (0 to shards - 1) and slot long (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("shard", "slot")))
    rows = shuffled(docs, seed, bucket_bytes, least, text_col)
    before = stored(offsets(rows), "bucket-offsets")
    total = rows.count()
    short, longer = divmod(total, shards)
    edge = longer * (short + 1)
    place = F.col("before") + F.col("pos")
    # the first ``longer`` shards have one record more
    early = place < edge
    shard = F.when(early, F.floor(place / (short + 1))).otherwise(longer + F.floor((place - edge) / max(short, 1)))
    slot = F.when(early, F.pmod(place, F.lit(short + 1))).otherwise(F.pmod(place - edge, F.lit(max(short, 1))))
    side = F.broadcast(before) if before.count() <= BROADCAST_ROWS else before
    placed = rows.join(side, "bucket").select("record.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    return placed


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The shards as folders shard=0, shard=1, ... of Parquet files, each file in the order of the slots."""
    sharded(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of a sharded table."""
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_size().alias("size"),
        text_crc32().alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
