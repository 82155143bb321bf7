"""Quality classification by co-training a text-content view and a page-metadata view.

* Content view: frequencies of byte pairs of the whole text, hashed to ``PAIRS`` columns.
* Metadata view: language and source (hashed), length, number and length of lines, shares of capitals, digits and
  marks, and how much of the text its lines repeat.

Each view is a logistic model.  In every round each view scores all unlabelled documents, and the ``KEPT`` documents of each
class that it is surest of (at least ``SURE``) join the training rows of the other view with the label it gave them; each
task keeps its own surest, of which the surest of all are taken.  Both views are then calibrated on labelled documents
that neither was trained on, and a logistic model of the two calibrated scores gives the score of every document.

Sample: the models are fitted on at most ``LABELLED`` labelled documents, by hash of doc_id, and what the rounds add.  All
documents take part in the exchange and all are scored, on their whole texts.

Nulls and edge cases: null text is empty; null language, source or length are values of their own.  Labels that are null or of
rows without doc_id are not used; of repeated labels of one doc_id the smallest counts, of repeated rows of a labelled
doc_id the smallest text.  With fewer than ``FEWEST`` sampled labels of a class no model is fitted and every score is the
share of good labels (one half without any).  A third of each class is kept for calibration.  Very long texts count by
frequencies, whatever their length; other columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .fit import Logistic
from .scratch import discard, stored, without

LABELLED, FEWEST = 6000, 6
PAIRS, NAMES = 256, 24
ROUNDS, SURE, KEPT = 4, 0.95, 400

_BUCKET = (tx.seeded(1 << 16, 21) % np.uint64(PAIRS)).astype(np.int64)
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[10] = 4


def _named(values: list, salt: int) -> np.ndarray:
    out = np.zeros((len(values), NAMES))
    for r, v in enumerate(values):
        out[r, zlib.crc32(f"{salt}:{v}".encode()) % NAMES] = 1
    return out


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    content, shape = [], []
    for _, _, data, offsets in tx.slices(batch, "text"):
        size = np.diff(offsets)
        pair = _BUCKET[(data[:-1].astype(np.int64) << 8) | data[1:]] if len(data) > 1 else np.zeros(0, np.int64)
        kind = _CLASS[data]
        hashes = _line_hashes(data, offsets)
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            n = max(1, b - a)
            content.append(np.sqrt(np.bincount(pair[a : max(a, b - 1)], minlength=PAIRS) / n))
            c = np.bincount(kind[a:b], minlength=5)
            lines = hashes[d]
            longest = n / (c[4] + 1)
            shape.append([np.log1p(size[d]), np.log1p(c[4]), np.log1p(longest), *np.sqrt(c[1:4] / n), 1 - len(set(lines)) / max(1, len(lines))])
    meta = np.array(shape, float).reshape(-1, 7)
    given = batch.column("n_chars").to_pylist()
    length = np.array([[np.log1p(max(0, v)) if v is not None else 0.0, float(v is None)] for v in given]).reshape(-1, 2)
    names = [_named(batch.column(c).to_pylist(), k) for k, c in enumerate(("lang", "source"))]
    return np.array(content, float).reshape(-1, PAIRS), np.hstack([meta, length, *names])


def _line_hashes(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    raw = data.tobytes()
    return [[hash(x) for x in raw[a:b].split(b"\n") if x] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


#: Asks both models for the surest rows: (view models, rounds so far) to (content, metadata, view that is sure, label).
Exchange = Callable[[list[Logistic], int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


class CoTrained:
    """Two views that taught each other, with calibrated scores; predict() gives (content, metadata, both)."""

    def __init__(self, content: np.ndarray, meta: np.ndarray, label: np.ndarray, exchange: Exchange | None = None) -> None:
        """label: 1 or 0.  A third of the rows of each class is kept for calibration."""
        x = (content, meta)
        hold = np.zeros(len(label), bool)
        for k in (0, 1):
            hold[np.flatnonzero(label == k)[::3]] = True
        rows = [m[~hold] for m in x]
        labels = [label[~hold].astype(float)] * 2
        self.view = [Logistic(rows[v], labels[v], steps=12) for v in (0, 1)]
        for done in range(ROUNDS if exchange is not None else 0):
            *found, sure, given = exchange(self.view, done)
            for v in (0, 1):
                taught = sure != v
                rows[v] = np.concatenate((rows[v], found[v][taught]))
                labels[v] = np.concatenate((labels[v], given[taught].astype(float)))
            self.view = [Logistic(rows[v], labels[v], steps=12) for v in (0, 1)]
        raw = [self._logit(self.view[v](x[v][hold])) for v in (0, 1)]
        self.curve = [Logistic(r[:, None], label[hold].astype(float)) for r in raw]
        self.both = Logistic(np.stack([self._logit(c(r[:, None])) for c, r in zip(self.curve, raw, strict=True)], 1), label[hold].astype(float))

    @staticmethod
    def _logit(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def predict(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        one = [c(self._logit(v(x))[:, None]) for c, v, x in zip(self.curve, self.view, (content, meta), strict=True)]
        return np.stack([*one, self.both(np.stack([self._logit(p) for p in one], 1))], 1)


_INPUT = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            content, meta = views(part)
            yield pa.RecordBatch.from_arrays([part.column("label"), *(pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary()) for x in (content, meta))], ["label", "content", "meta"])


def _vectors(rows, *columns: str) -> list[np.ndarray]:
    width = {"content": PAIRS, "meta": 9 + 2 * NAMES}
    return [np.stack([np.frombuffer(v, np.float32) for v in rows[c]]).astype(float) if len(rows) else np.zeros((0, width[c])) for c in columns]


def _surest(models: list[Logistic], used: tuple[set, set]):
    """Each partition's KEPT surest documents of each view and class that haven't taught the other view yet."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {(v, k): [] for v in (0, 1) for k in (0, 1)}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = views(part)
                ids = list(zip(part.column("tie").to_pylist(), part.column("doc_id").to_pylist(), strict=True))
                for (v, k), rows in held.items():
                    p = models[v](x[v])
                    sure = p if k else 1 - p
                    for i in np.flatnonzero(sure >= SURE).tolist():
                        if ids[i] not in used[v] and (len(rows) < 4 * KEPT or sure[i] >= rows[KEPT - 1][0]):
                            rows.append((float(sure[i]), *ids[i], *(m[i].astype(np.float32).tobytes() for m in x)))
                    if len(rows) >= 4 * KEPT:
                        held[v, k] = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:KEPT]
        out = [(v, k, *r) for (v, k), rows in held.items() for r in sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:KEPT]]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["view", "label", "sure", "tie", "doc_id", "content", "meta"])

    return pick


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> tuple[CoTrained | None, float]:
    labels = labels.where(f"doc_id is not null and {label_col} in (0, 1)").groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    labels = stored(labels, "quality-labels")
    order = F.xxhash64("doc_id", F.lit(7))
    picked = stored(labels.orderBy(order, "doc_id").limit(LABELLED), "quality-sample")
    seen = {r.label: r["count"] for r in picked.groupBy("label").count().collect()}
    prior = (seen.get(1, 0) + 0.5) / (seen.get(0, 0) + seen.get(1, 0) + 1.0)
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*[c for c in _INPUT if c != "doc_id"])).alias("d"))
    rows = rows.select("doc_id", "label", "d.*").orderBy(order, "doc_id").select(*_INPUT, "label").mapInArrow(_measured, "label int, content binary, meta binary").toPandas()
    found = rows["label"].to_numpy(int)
    if (found == 1).sum() < FEWEST or (found == 0).sum() < FEWEST:
        return None, prior
    free = without(docs.where("doc_id is not null"), "doc_id", labels).select(*_INPUT, F.xxhash64("doc_id", "text", F.lit(7)).alias("tie"))
    used: tuple[set, set] = (set(), set())

    def exchange(models: list[Logistic], done: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        schema = "view int, label int, sure double, tie long, doc_id long, content binary, meta binary"
        local = stored(free.mapInArrow(_surest(models, used), schema), "surest")
        best = reduce(DataFrame.union, [local.where(f"view = {v} and label = {k}").orderBy(F.desc("sure"), "tie", "doc_id").limit(KEPT) for v in (0, 1) for k in (0, 1)]).toPandas()
        discard(local)
        for v in (0, 1):
            own = best[best["view"] == v]
            used[v].update(zip(own["tie"].tolist(), own["doc_id"].tolist(), strict=True))
        return *_vectors(best, "content", "meta"), best["view"].to_numpy(int), best["label"].to_numpy(int)

    return CoTrained(*_vectors(rows, "content", "meta"), found, exchange), prior


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """doc_id, content_score, metadata_score, score (probability of good quality), predicted; one row per document."""
    return scored(docs, labels, label_col).select("doc_id", "content_score", "metadata_score", "score", "predicted")


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """The columns of documents (doc_id, text, lang, source, n_chars) with the scores."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, prior = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = trained.predict(*views(part)) if trained is not None else np.full((part.num_rows, 3), prior)
                extra = [pa.array(p[:, k].copy()) for k in range(3)] + [pa.array((p[:, 2] >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _INPUT), *extra], [*_INPUT, "content_score", "metadata_score", "score", "predicted"])

    return docs.mapInArrow(score, "doc_id long, text string, lang string, source string, n_chars long, content_score double, metadata_score double, score double, predicted int")
