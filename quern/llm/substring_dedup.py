"""Substring deduplication with a log-structured index of window fingerprints.

A window is 13 consecutive words of one document.  Each window is represented by its anchor, the smallest hash
among its eight 6-word grams; equal windows have equal anchors, and neighbouring windows mostly share one, so
about a fifth as many fingerprints as windows enter the index and no repeat can be missed.

* The index is a list of immutable runs (anchor, doc_id of its first document), each bucketed and sorted by anchor, so a
  new batch is merge-joined with every run, and runs are merged bucket by bucket, without moving what is indexed.  A run
  holds only anchors that no run before it has.  The index also keeps which later documents met which anchor.  Its
  folder has a manifest, so a later session opens it, adds new documents and gets what one run over all gives.
* Batches arrive in doc_id order.  A batch's anchors that are in a run, or in several of its own documents,
  are suspects; its new anchors become the next run; runs of similar size are merged into one.
* Suspects are verified on 96-bit hashes of all 13 words: a window goes if its word sequence starts in a
  document with a smaller doc_id.  A bit set of the suspects, at most ``FILTER_BITS`` large, goes to every task, which hashes the
  windows whose anchor it may hold, so no text is shuffled to find them; a fuller set lets more windows through and
  loses none.  Everything is judged on the input texts.

Nulls and edge cases: null text has no words.  Rows without doc_id lose nothing and remove nothing.  Rows
repeating a doc_id never count against each other.  Texts of fewer than 13 words are left alone.  An empty table
gives an empty result.  Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .scratch import delete, discard, joined, keep_ids, shared_dir, stored, without

WINDOW, GRAM = 13, 6
BATCHES = 3
#: Bits a suspect gets, and most bits of the set (32 MB).
SUSPECT_BITS, FILTER_BITS = 16, 1 << 28


def _words(batch: pa.RecordBatch):
    for at, to, data, offsets in tx.slices(batch, "text"):
        start, end, first = tx.words(data, offsets)
        yield at, to, data, offsets, start, end, first, tx.span_hashes(data, start, end)


def _window_anchors(word: np.ndarray) -> np.ndarray:
    grams, n = tx.gram_hashes(word, GRAM), len(word) - WINDOW + 1
    best = grams[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(best, grams[j : j + n], out=best)
    return best


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each document."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for at, to, _, _, _, _, first, word in _words(batch):
            where = tx.own_grams(first, WINDOW)
            if not len(where):
                continue
            best = _window_anchors(word)[where]
            row = np.repeat(np.arange(to - at), np.maximum(np.diff(first) - WINDOW + 1, 0))
            new = np.concatenate(([True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])))
            best, row = best[new], row[new]
            order = np.lexsort((best, row))
            best, row = best[order], row[order]
            new = np.concatenate(([True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(best[new].view(np.int64)), pa.array(ids[at:to][row[new]])], ["anchor", "doc_id"])


class FingerprintIndex:
    """Immutable sorted runs of (anchor, first_doc) and the matches (doc_id, anchor) found so far, in one folder.

    The manifest is a table of (version, place, path, entries, buckets); of the rows of the largest version those with a place
    from 0 are the runs, those below the matches of each session.  A session that fails before it commits leaves neither.
    """

    MANIFEST = "version long, place int, path string, entries long, buckets int"

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.lasting = spark, root is not None
        self.root = root or f"{shared_dir(spark)}/quern/index-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs, self.dropped = 0, [], []
        self.sessions: list[str] = []
        self.own = f"{self.root}/matches/{uuid.uuid4().hex}"
        if self.lasting:
            self._open()

    def _open(self) -> None:
        try:
            rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.root}/manifest").collect()
        except AnalysisException:  # a new index
            return
        self.version = max((r.version for r in rows), default=0)
        for r in sorted((r for r in rows if r.version == self.version), key=lambda r: r.place):
            self.buckets = r.buckets
            if r.place < 0:
                self.sessions.append(r.path)
                continue
            self.runs.append((self._register(r.path, "first_doc"), r.path, r.entries))

    def _register(self, path: str, column: str) -> str:
        name = f"quern_run_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (anchor BIGINT, {column} BIGINT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        """A bucketed table of rows, which are already dealt by anchor; external, so that dropping it keeps the files."""
        name, path = f"quern_run_{uuid.uuid4().hex}", f"{self.root}/runs/{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", path).saveAsTable(name)
        return name, path

    def _remove(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, path)

    def matches(self) -> DataFrame:
        """(doc_id, anchor) of the documents indexed before that shared an anchor with another."""
        shape = "doc_id long, anchor long"
        return self.spark.read.schema(shape).parquet(*self.sessions) if self.sessions else self.spark.createDataFrame([], shape)

    def add(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """Suspects (anchor, first_doc) of a batch (anchor, doc_id) whose ids are all larger than those before: anchors that a
        later document of the batch has too.  keep=False leaves the batch itself out of the index."""
        entries = self._write(batch.repartition(self.buckets, "anchor"))
        table = self.spark.table(entries[0])
        seen = table.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).withColumn("before", F.lit(None).cast("long"))
        for name, _, _ in self.runs:
            run = self.spark.table(name).select(F.col("anchor"), F.col("first_doc").alias("found"))
            seen = seen.join(run.hint("merge"), "anchor", "left").select("anchor", "lo", "hi", F.least("before", "found").alias("before"))
        suspects = stored(seen.where(F.col("hi") > F.coalesce("before", "lo")).select("anchor", F.coalesce("before", "lo").alias("first_doc")), "suspects")
        if self.lasting:
            later = table.join(suspects, "anchor").where("doc_id > first_doc").select("doc_id", "anchor")
            later.union(suspects.select("first_doc", "anchor")).write.mode("append").parquet(self.own)
        if keep:
            fresh = seen.where("before is null").select("anchor", F.col("lo").alias("first_doc"))
            self.runs.append((*(made := self._write(fresh)), self.spark.table(made[0]).count()))
            self._compact()
        self._remove(*entries)
        return suspects

    def _compact(self) -> None:
        """Merges runs of similar size: equal buckets of both are joined where they lie."""
        while len(self.runs) > 1 and self.runs[-2][2] < 2 * self.runs[-1][2]:
            a, b = (self.spark.table(name) for name, _, _ in self.runs[-2:])
            both = a.hint("merge").join(b.withColumnRenamed("first_doc", "other"), "anchor", "full").select("anchor", F.coalesce("first_doc", "other").alias("first_doc"))
            self.dropped += self.runs[-2:]
            self.runs[-2:] = [(*self._write(both), self.runs[-2][2] + self.runs[-1][2])]

    def close(self) -> None:
        """Commits the manifest of a lasting index and deletes what was compacted away; an index of one call goes."""
        if self.lasting:
            self.version += 1
            rows = [(self.version, k, path, entries, self.buckets) for k, (_, path, entries) in enumerate(self.runs)]
            rows += [(self.version, -1 - k, path, 0, self.buckets) for k, path in enumerate([*self.sessions, self.own])]
            self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        for name, path, _ in self.dropped:
            self._remove(name, path)
        for name, path, _ in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
            if not self.lasting:
                delete(self.spark, path)
        self.runs, self.dropped = [], []


def suspect_bits(suspects: DataFrame) -> np.ndarray:
    """The suspects' anchors as a set of bits by their last bits; anchors are hashes themselves (the smallest of some, so their
    first bits are not evenly spread)."""
    bits = 1 << max(6, min(FILTER_BITS.bit_length() - 1, (SUSPECT_BITS * suspects.count()).bit_length()))
    words = suspects.select(F.col("anchor").bitwiseAND(F.lit(bits - 1)).alias("p")).groupBy(F.expr("p >> 6").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("held")).toArrow()
    found = np.zeros(bits // 64, np.uint64)
    found[words.column("word").to_numpy()] = words.column("held").to_numpy().view(np.uint64)
    return found


def _windows_of(bits):
    """Hashes and places of the windows whose anchor may be a suspect."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        last = np.uint64(64 * len(held) - 1)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for at, to, data, _, start, end, first, word in _words(batch):
                own = tx.own_grams(first, WINDOW)
                if not len(own):
                    continue
                place = _window_anchors(word)[own] & last
                own = own[held[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1]
                whole, check = tx.gram_hashes(word, WINDOW)[own], tx.gram_hashes(tx.span_hashes2(data, start, end)[1], WINDOW)[own]
                row = np.searchsorted(first, own, "right") - 1
                values = (whole.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[at:to][row], (own - first[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], ["window", "check", "doc_id", "place"])

    return windows


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _cleaned(with_text: bool):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("places") if "places" in batch.schema.names else None
            for at, to, data, offsets in tx.slices(batch, "text"):
                start, end, first = tx.words(data, offsets)
                keep = np.ones(len(start), bool)
                if lists is not None:
                    edge = np.zeros(len(start) + 1, np.int64)
                    for d in range(to - at):
                        if lists[at + d].is_valid:
                            hit = first[d] + lists[at + d].values.to_numpy()
                            np.add.at(edge, hit, 1)
                            np.add.at(edge, hit + WINDOW, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                kept = np.concatenate(([0], np.cumsum(keep)))
                per_doc = np.diff(kept[first])
                mark = np.zeros(len(data) + 1, np.int32)
                mark[start[keep]] += 1
                mark[end[keep]] -= 1
                show = np.cumsum(mark[:-1]) > 0
                last = kept[first[1:]][per_doc > 0] - 1
                gap = np.ones(int(kept[-1]), bool)
                gap[last] = False
                spaces = end[keep][gap]
                out = data.copy()
                out[spaces] = 32
                show[spaces] = True
                size = np.concatenate(([0], np.cumsum(show)))[offsets]
                flat = out[show].tobytes()
                texts = [flat[size[d] : size[d + 1]] for d in range(to - at)]
                total = np.diff(first)
                sums = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), pa.array(total.astype(np.int64)), pa.array((total - per_doc).astype(np.int64)), pa.array(sums), pa.array([t.decode(errors="replace") for t in texts] if with_text else [None] * len(texts), pa.string())],
                    _RESULT.replace(" long", "").replace(" string", "").split(", "),
                )

    return clean


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, batches: int = BATCHES, index: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text; one row per document.

    index: folder of a lasting index, made if there is none.  It stands for ``history``, the documents added to it before,
    whose ids must all be smaller; of those only the ones that share an anchor with docs are read again.  An index that holds
    documents needs them as history (ValueError else): anchors alone don't prove that windows are equal.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = docs.where("doc_id is not null")
    cuts = named.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("q")).first().q or []
    edges = [None, *sorted(set(cuts)), None]
    runs, found = FingerprintIndex(spark, index), []
    if runs.runs and history is None:
        raise ValueError("the index holds documents of earlier sessions: give them as history")
    before = stored(runs.matches(), "matches-before") if index and history is not None else None
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        part = named.where(f"doc_id > {lo}") if lo is not None else named
        part = part.where(f"doc_id <= {hi}") if hi is not None else part
        found.append(runs.add(part.mapInArrow(_anchors, "anchor long, doc_id long"), keep=index is not None or k + 2 < len(edges)))
    runs.close()
    suspects = reduce(DataFrame.union, found)
    bits = spark.sparkContext.broadcast(suspect_bits(suspects))
    texts = named
    if before is not None:
        earlier = before.join(suspects.select("anchor").distinct(), "anchor", "left_semi").select("doc_id").union(suspects.select("first_doc"))
        past = history.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        texts = named.union(keep_ids(past, "doc_id", stored(earlier.distinct(), "earlier-docs")))
    windows = texts.mapInArrow(_windows_of(bits), "window long, check int, doc_id long, place int")
    again = windows.groupBy("window", "check").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("hi")).where("hi > first_doc").drop("hi")
    again = stored(again, "repeated")
    discard(*found)
    repeated = windows.join(again, ["window", "check"]).where("doc_id > first_doc")
    gone = stored(repeated.groupBy("doc_id").agg(F.collect_set("place").alias("places")), "removals")
    discard(again)
    touched = joined(docs, "doc_id", gone).select("doc_id", "text", "places")
    whole = without(docs, "doc_id", gone)
    out = touched.mapInArrow(_cleaned(with_text), _RESULT).union(whole.mapInArrow(_cleaned(with_text), _RESULT))
    return out if with_text else out.drop("kept_text")
