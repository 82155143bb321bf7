"""Toxicity by compression distance: windows of words are compressed with two zstandard dictionaries.

The ordinary dictionary is trained on windows of ordinary documents.  The toxic dictionary holds the same bytes and, after
them, a dictionary trained on the runs of bytes of toxic windows that ordinary windows lack: most of a toxic document is
ordinary text, and a dictionary trained on all of it differs from the ordinary one mostly by chance.  A run is where every
``GRAM`` bytes are in more windows of toxic documents than chance explains (``SURPRISE`` deviations beyond the share of such
windows); windows that are equal count once.  Short windows need short matches to count, so literals stay uncompressed (the fast strategy
of zstandard, minimum match 4).

Each window of ``WINDOW`` words gives the bytes that the toxic dictionary saves.  How many windows of a document
save at least 1, 2, ... bytes are its features; a logistic curve fitted on labelled documents, which the
dictionaries have not seen, calibrates them to a probability.

Sample: dictionaries and curve are fitted on at most ``SAMPLE`` labelled documents of each class (by hash of
doc_id) outside the held-out fold; half makes the dictionaries, half the curve.  A row of the sample weighs as many
labelled documents as it stands for (its class's labels / those sampled), in the curve and in the share of toxic
labels, so scores don't depend on how many of a class were sampled.  Every document is scored whole.

Nulls and edge cases: null text is empty; a text without words gets the curve's value at no windows.  Labels that are null or
of rows without doc_id are not used; of repeated labels of one doc_id the largest counts.  If a class has no
labels, every score is the share of toxic labels (one half without any).  Too few samples to train a dictionary on (zstandard
refuses them) are the dictionary themselves.  Repeated rows are each scored; of repeated texts in the sample one trains.
Very long texts are scored whole, window by window; columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .fit import Logistic
from .scratch import stored

WINDOW = 8
STEPS = (2, 3, 4, 5, 6, 8)
SAMPLE = 8000
#: Bytes of ordinary text and size of its dictionary; size of the toxic part; bytes of a gram and how far beyond chance.
BASE_TEXT, BASE_SIZE = 6 << 20, 64 << 10
TOXIC_SIZE, GRAM, SURPRISE = 8 << 10, 6, 8.0
_SETTINGS = {"window_log": 17, "chain_log": 17, "hash_log": 17, "search_log": 4, "min_match": 4, "target_length": 1, "strategy": zstd.STRATEGY_FAST, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}


def _trained(samples: list[bytes], size: int, segment: int = 32) -> bytes:
    """Content of a dictionary trained on the samples; if they are too few to train on, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each text, lower case, words with single spaces around them, with the text's label."""
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = text.encode().translate(tx.LOWER.tobytes()).split()
            out = [b" " + b" ".join(words[w : w + WINDOW]) + b" " for w in range(0, len(words), WINDOW)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array([label] * len(out), pa.int32())], ["window", "label"])


def _grams(window: bytes) -> np.ndarray:
    a = np.frombuffer(window, np.uint8).astype(np.uint64)
    g = np.zeros(max(0, len(a) - GRAM + 1), np.uint64)
    for j in range(GRAM):
        g = g << np.uint64(8) | a[j : j + len(g)]
    return g.view(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different grams of each window with its label."""
    for batch in batches:
        found = [np.unique(_grams(w)) for w in batch.column("window").to_pylist()]
        if found:
            label = np.repeat(batch.column("label").to_numpy(), [len(g) for g in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(label)], ["gram", "label"])


def _runs(marked: np.ndarray):
    """The runs of bytes of each window that marked grams cover."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for window in batch.column("window").to_pylist():
                at = np.flatnonzero(np.isin(_grams(window), marked))
                if len(at):
                    edge = np.zeros(len(window) + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + GRAM, -1)
                    cover = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8))))
                    out += [window[a:b] for a, b in zip(np.flatnonzero(cover > 0).tolist(), np.flatnonzero(cover < 0).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["run"])

    return runs


class Meter:
    """Bytes saved by the toxic dictionary, window by window."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.pair = []
        for content in (ordinary, ordinary + toxic):
            content = content if len(content) >= 8 else b" " * 8 + content
            dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            settings = zstd.ZstdCompressionParameters(**_SETTINGS)
            dictionary.precompute_compress(compression_params=settings)
            self.pair.append(zstd.ZstdCompressor(dict_data=dictionary, compression_params=settings))

    def features(self, batch: pa.RecordBatch) -> np.ndarray:
        plain, toxic = (c.compress for c in self.pair)
        rows = []
        for _, _, data, offsets in tx.slices(batch, "text"):
            data = tx.LOWER[data]
            start, end, first = tx.words(data, offsets)
            raw = data.tobytes()
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                saved = []
                for w in range(a, b, WINDOW):
                    piece = b" " + raw[start[w] : end[min(w + WINDOW, b) - 1]] + b" "
                    saved.append(len(plain(piece)) - len(toxic(piece)))
                hits = [sum(s >= step for s in saved) for step in STEPS]
                rows.append([np.log1p(h) for h in hits] + [h / max(1, len(saved)) for h in hits] + [np.log1p(len(saved))])
        return np.array(rows, float).reshape(-1, 2 * len(STEPS) + 1)


def _fit(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int) -> tuple[bytes, bytes, Logistic | None, float]:
    labels = labels.where(f"doc_id is not null and {label_col} in (0, 1)").groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % modulus != 0)
    order = F.xxhash64("doc_id", F.lit(5))
    picked = [stored(labels.where(f"label = {k}").orderBy(order, "doc_id").limit(SAMPLE), "sample") for k in (0, 1)]
    every = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    weight = np.array([every.get(k, 0) / max(1, picked[k].count()) for k in (0, 1)])
    sample = stored(docs.join(F.broadcast(picked[0].union(picked[1])), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2))), "labelled")
    half = sample.where("half = 0").groupBy("text").agg(F.max("label").alias("label"))
    counts = {r.label: r["count"] for r in half.groupBy("label").count().collect()}
    zeros, ones = (sample.where(f"label = {k}").count() * weight[k] for k in (0, 1))
    prior = float((ones + 0.5) / (zeros + ones + 1.0))
    if len(counts) < 2:
        return b"", b"", None, prior
    windows = half.select("text", "label").mapInArrow(_windows, "window binary, label int").groupBy("window").agg(F.max("label").alias("label"))
    windows = stored(windows, "windows")
    share = windows.agg(F.avg("label").alias("share")).first().share or 0.0
    grams = windows.mapInArrow(_held, "gram long, label int").groupBy("gram").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    spread = F.sqrt(F.col("n") * share * (1 - share) + 0.25)
    marked = grams.where((F.col("t") - F.col("n") * share - 0.5) / spread > SURPRISE).select("gram").toArrow().column("gram").to_numpy()
    runs = windows.where("label = 1").select("window").mapInArrow(_runs(np.sort(marked)), "run binary").orderBy("run").toArrow().column("run").to_pylist()
    base: list[bytes] = []
    size = 0
    for r in windows.where("label = 0").orderBy(F.xxhash64("window"), "window").select("window").toLocalIterator():
        base.append(bytes(r.window))
        size += len(base[-1])
        if size >= BASE_TEXT:
            break
    specific = _trained(runs, TOXIC_SIZE, 24)
    ordinary = _trained(base, BASE_SIZE)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = meter_of().features(batch)
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "features"])

    meter_of = _lazy(ordinary, specific)
    rows = sample.where("half = 1").select("text", "label").mapInArrow(measured, "label int, features binary").toPandas()
    if not len(rows):
        return ordinary, specific, None, prior
    x = np.stack([np.frombuffer(f, float) for f in rows["features"]])
    label = rows["label"].to_numpy(int)
    return ordinary, specific, Logistic(x, label.astype(float), weight[label]), prior


def _lazy(ordinary: bytes, specific: bytes):
    made: list[Meter] = []

    def meter() -> Meter:
        if not made:
            made.append(Meter(ordinary, specific))
        return made[0]

    return meter


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label_value")).withColumnRenamed("label_value", label_col)
    ordinary, specific, curve, prior = _fit(docs, labels, label_col, modulus)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((ordinary, specific, curve, prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, specific, curve, prior = model.value
        meter = Meter(ordinary, specific) if curve is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = curve(meter.features(part)) if meter is not None else np.full(part.num_rows, prior)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == 0, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
