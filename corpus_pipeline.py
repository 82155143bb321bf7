"""A training-corpus pipeline over the documents table.

STAGES in order: reject documents of poor quality, cut repeated lines, keep one document of each near-duplicate
group, mix the sources to target weights, encode with a SentencePiece model.  All but the last return the columns
of documents.  run() applies them one after the other, each result written to the shared folder and read back.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables, and leaves out columns
other than those of documents, whatever their names; an empty table gives an empty result.  Null text counts as empty
everywhere and stays null until it is encoded.  Rows without doc_id pass the first three stages as their quality lets
them: they neither lose lines nor count as copies.  Rows repeating a doc_id share their near-duplicate group; the other
stages treat each row alone.  A null source is a source of its own in the mixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, mixing, near_dedup, pieces, quality
from quern.llm.scratch import stored

#: Documents are rejected if the probability of good quality is below this.
LEAST_QUALITY = 0.4

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs, labels).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text that is left."""
    cleaned = line_dedup.clean_documents(docs.select(*COLUMNS))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays, as do documents without words or without doc_id."""
    found = near_dedup.near_duplicates(docs)
    gone = stored(found.where("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document used several times comes that many times, one not used not at all."""
    mixed = mixing.mixed(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether decoding them gives the text back."""
    both = pieces.decoded(pieces.encoded(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))))
    return both.select("doc_id", "source", "n_pieces", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_cotraining", reject_poor),
    ("fuzzy_line_dedup", cut_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("temperature_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained classifier and a tokenizer are not SQL; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
