"""Language-model scores by prediction by partial matching (PPM) over bytes, with exclusion.

A text is lower-cased (A-Z), and its words are written with one space between them and a newline as end sign, so
every token sequence has exactly one byte string and the byte probabilities multiply to its probability.

* Counting: each task sorts the (ORDER + 1)-byte grams of its training texts and sends distinct grams with
  counts; sums over the first bytes give all lower orders, so the trie needs one pass over the corpus.
* Size: the level tables hold every edge that was counted and stay distributed, so the model grows with the corpus.
* Probability: the longest context in the model predicts; a symbol it lacks costs the escape estimate and goes to
  the next shorter context, from whose counts the longer context's symbols are excluded.  Each successor gives
  ``DISCOUNT`` of its weight to the escape.  Below the longest order a successor weighs as many longer contexts as
  it was seen in (update exclusion).  Since a shorter context has every symbol of a longer one, the excluded weight
  is one number per context.  Grams of the training texts end at the longest order; only those that held-out texts
  alone have go down the orders, by joins with the contexts they meet.
* Documents: each distinct gram is scored once.  The scores of the ``MODEL_NODES`` most frequent grams at most go to
  the tasks, which sum them per document; a document's other grams are joined with the table of scores.

The word-count base score is exact for every word: counts of frequent words go to the tasks (at most
``MODEL_WORDS``), the other words of each document are joined with the count table.

Nulls and edge cases: null text is a text without words, scored as the end sign alone.  Rows without doc_id are
training rows and not held out.  Repeated rows are each counted and each scored.  An empty table gives an empty result.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .scratch import stored

ORDER = 5
MODEL_NODES = 1 << 20
DISCOUNT = 0.5
MODEL_WORDS = 1 << 19
END = 10
#: Distinct items whose counts a task keeps before it sends them on.
HELD = 1 << 21


def canonical(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts as pad end signs, words joined by a space, an end sign; and the offset of each."""
    mark = np.zeros(len(data) + 1, np.int32)
    mark[start] += 1
    mark[end] -= 1
    show = np.cumsum(mark[:-1]) > 0
    gap = np.ones(len(start), bool)
    gap[first[1:][np.diff(first) > 0] - 1] = False
    out = data.copy()
    out[end[gap]] = 32
    show[end[gap]] = True
    lengths = np.concatenate(([0], np.cumsum(end - start + gap)))[first]
    body = out[show]
    sizes = np.diff(lengths)
    docs = len(sizes)
    offsets = np.concatenate(([0], np.cumsum(sizes + pad + 1)))
    full = np.full(int(offsets[-1]), END, np.uint8)
    full[np.arange(len(body)) + np.repeat(np.arange(docs) * (pad + 1) + pad, sizes)] = body
    return full, offsets


def grams_of(full: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram (context bytes, symbol in the lowest byte) of every symbol, and where each text's grams begin."""
    packed = full.astype(np.uint64)
    gram = packed.copy()
    for j in range(1, order + 1):
        gram[j:] |= packed[:-j] << np.uint64(8 * j)
    pad = np.ones(len(full), bool)
    for j in range(order):
        pad[offsets[:-1] + j] = False
    return gram[pad], offsets[:-1] - np.arange(len(offsets) - 1) * order


def _slices(batch: pa.RecordBatch):
    for at, to, data, offsets in tx.slices(batch, "text"):
        data = tx.LOWER[data]
        yield (at, to, data, *tx.words(data, offsets))


def _count(of: str):
    """Distinct grams or words of a partition's texts with their counts."""

    def merged(items: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(items, kind="stable")
        items = items[order]
        at = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
        return items[at], np.add.reduceat(times[order], at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[np.ndarray] = []
        rows = 0
        items, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def take_in() -> None:
            nonlocal items, times, rows
            every = np.sort(np.concatenate(fresh))
            at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            items, times = merged(np.concatenate((items, every[at])), np.concatenate((times, np.diff(np.append(at, len(every))))))
            fresh.clear()
            rows = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(items.view(np.int64)), pa.array(times)], ["item", "n"])

        for batch in batches:
            for _, _, data, start, end, first in _slices(batch):
                fresh.append(grams_of(*canonical(data, start, end, first, ORDER))[0] if of == "gram" else tx.span_hashes(data, start, end))
                rows += len(fresh[-1])
                if rows >= HELD:
                    take_in()
                    if len(items) >= HELD:
                        yield out()
                        items, times = items[:0], times[:0]
        if rows:
            take_in()
        if len(items):
            yield out()

    return count


def _least_count(counts: DataFrame, limit: int) -> int:
    """The smallest n such that at most limit rows of counts(n) have that count or a larger one."""
    bucket = F.floor(F.log2("n") * 16).cast("int").alias("b")
    histogram = sorted(((r.b, r["count"]) for r in counts.groupBy(bucket).count().collect()), reverse=True)
    total, least = 0, 1 << 62
    for b, n in histogram:
        total += n
        if total > limit:
            break
        least = int(np.ceil(2 ** (b / 16) - 1e-9))
    return least


def _gram_scores(grams: DataFrame) -> DataFrame:
    """(item, m, score) of every gram of grams(item, n, m), n in training texts and m in all: log10 of the symbol's probability after its context."""
    level = stored(grams.where("n > 0").select(F.col("item").alias("gram"), F.col("n").alias("weight"), F.shiftrightunsigned("item", 8).alias("context"), "m"), "level")
    total = F.sum("weight").over(Window.partitionBy("context"))  # at most 256 successors each
    done = [level.select(F.col("gram").alias("item"), "m", (F.log10(F.col("weight") - DISCOUNT) - F.log10(total)).alias("score"))]
    none = F.lit(None).cast("double")
    # total and escape: of the next context without the symbols already excluded; null before any context was met
    open_ = stored(grams.where("n = 0").select("item", "m", F.lit(0.0).alias("score"), none.alias("total"), none.alias("escape")), "open-grams")
    level = level.drop("m")
    for k in range(ORDER, -1, -1):
        gram = F.col("item").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        open_ = open_.withColumn("gram", gram).withColumn("context", F.shiftrightunsigned("gram", 8))
        edges = stored(level.join(open_.select("context").distinct(), "context", "left_semi"), "met-edges")
        met = edges.groupBy("context").agg(F.sum("weight").alias("kept"), F.count("*").alias("distinct"))
        if k:
            short = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
            level = stored(level.groupBy(short.alias("gram")).agg(F.count("*").alias("weight")).withColumn("context", F.shiftrightunsigned("gram", 8)), "level")
            lower = level.select(F.col("gram").alias("short"), F.col("weight").alias("lower"))
            excluded = edges.select("context", short.alias("short")).join(lower, "short").groupBy("context").agg(F.sum("lower").alias("excluded"))
            met = stored(met.join(excluded, "context").withColumn("parent", F.col("context").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))), "met-contexts")
            parents = level.join(met.select(F.col("parent").alias("context")).distinct(), "context", "left_semi").groupBy(F.col("context").alias("parent"))
            met = met.join(parents.agg(F.sum("weight").alias("all"), F.count("*").alias("kinds")), "parent")
            sure = F.col("kinds") <= F.col("distinct")  # nothing is left in the shorter context: it is passed at no cost
            met = met.withColumn("next_total", F.when(sure, 1.0).otherwise((F.col("all") - F.col("excluded")).cast("double")))
            met = met.withColumn("next_escape", F.when(sure, 1.0).otherwise(DISCOUNT * (F.col("kinds") - F.col("distinct"))))
        else:
            met = met.withColumn("next_total", F.greatest(256 - F.col("distinct"), F.lit(1)).cast("double")).withColumn("next_escape", F.lit(1.0))
        met = met.select("context", "kept", "distinct", "next_total", "next_escape")
        found = open_.join(met, "context", "left").join(edges.select("gram", "weight"), "gram", "left")
        spent = F.log10(F.coalesce("total", F.col("kept").cast("double")))
        gain = F.when(F.col("weight").isNotNull(), F.log10(F.col("weight") - DISCOUNT) - spent).when(F.col("kept").isNotNull(), F.log10(F.coalesce("escape", DISCOUNT * F.col("distinct"))) - spent).otherwise(0.0)
        found = found.select(
            "item", "m", (F.col("score") + gain).alias("score"), F.coalesce("next_total", "total").alias("total"), F.coalesce("next_escape", "escape").alias("escape"), F.col("weight").isNotNull().alias("hit")
        )
        found = stored(found, "open-grams")
        done.append(found.where("hit").select("item", "m", "score"))
        open_ = found.where("not hit").drop("hit")
    done.append(open_.select("item", "m", (F.col("score") - F.log10(F.coalesce("total", F.lit(256.0)))).alias("score")))
    return stored(reduce(DataFrame.union, done), "gram-scores")


def _distinct(items: np.ndarray) -> np.ndarray:
    ranked = np.sort(items)
    return ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))] if len(ranked) else ranked


def _known(model: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(model):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    pos = np.minimum(np.searchsorted(model, words), len(model) - 1)
    return pos, model[pos] == words


def _rare(frequent, of: str):
    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's words or grams that are not among the frequent ones."""
        items, _ = frequent.value
        for batch in batches:
            key = batch.column("row_key").to_numpy()
            for at, to, data, start, end, first in _slices(batch):
                if of == "gram":
                    item, first = grams_of(*canonical(data, start, end, first, ORDER))
                    first = np.append(first, len(item))
                else:
                    item = tx.span_hashes(data, start, end)
                ranked = _distinct(item)
                far = _known(ranked[~_known(items, ranked)[1]], item)[1]
                row, item = np.repeat(np.arange(to - at), np.diff(first))[far], item[far]
                order = np.lexsort((item, row))
                row, item = row[order], item[order]
                head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])))) if len(row) else np.zeros(0, np.int64)
                times = np.diff(np.append(head, len(row)))
                yield pa.RecordBatch.from_arrays([pa.array(key[at:to][row[head]]), pa.array(item[head].view(np.int64)), pa.array(times)], ["row_key", "item", "times"])

    return rare


def _frequent(table: DataFrame, value: str, limit: int):
    """Broadcast of the items of table(item, n, ...) with the largest n, sorted, and their values; at most limit."""
    top = table.where(F.col("n") >= _least_count(table, limit)).select("item", value).toArrow()
    item, found = top.column("item").to_numpy().view(np.uint64), top.column(value).to_numpy()
    by = np.argsort(item)
    return table.sparkSession.sparkContext.broadcast((item[by], found[by]))


def _scored(cache, frequent, train_docs: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (grams, scores), (words, counts) = cache.value, frequent.value
        logs = np.log10(counts.astype(np.float64) + 1.0)
        for batch in batches:
            for at, to, data, start, end, first in _slices(batch):
                word = tx.span_hashes(data, start, end)
                pos, here = _known(words, word)
                value = np.where(here, logs[pos] if len(logs) else 0.0, 0.0)
                sums = np.concatenate(([0.0], np.cumsum(value)))[first]
                known = np.concatenate(([0], np.cumsum(here)))[first]
                gram, begin = grams_of(*canonical(data, start, end, first, ORDER))
                ranked = _distinct(gram)
                pos, here = _known(grams, ranked)
                value = np.where(here, scores[pos] if len(scores) else 0.0, 0.0)
                bits = value[np.searchsorted(ranked, gram)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(at, to - at) for c in ("row_key", "doc_id", "held_out")]
                    + [pa.array(x) for x in (np.diff(first) + 1, np.diff(known) + (train_docs > 0), np.diff(sums) + np.log10(train_docs + 1.0), np.add.reduceat(bits, begin))],
                    ["row_key", "doc_id", "held_out", "n_tokens", "known", "base", "score"],
                )

    return score


def ppm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"), F.xxhash64("doc_id", "text").alias("row_key"))
    train = docs.where(~F.col("held_out")).select("text")

    words = stored(train.mapInArrow(_count("word"), "item long, n long").groupBy("item").agg(F.sum("n").alias("n")), "words")
    seen = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    train_docs = train.count()
    tokens, distinct = seen.n + train_docs, seen.v + (train_docs > 0)
    frequent = _frequent(words, "n", MODEL_WORDS)

    trained = train.mapInArrow(_count("gram"), "item long, n long").select("item", "n", F.col("n").alias("m"))
    met = docs.where("held_out").select("text").mapInArrow(_count("gram"), "item long, n long").select("item", F.lit(0).cast("long").alias("n"), F.col("n").alias("m"))
    grams = stored(trained.union(met).groupBy("item").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "grams")
    scores = _gram_scores(grams).withColumnRenamed("m", "n")
    cache = _frequent(scores, "score", MODEL_NODES)

    def rare(of: str, frequent, table: DataFrame) -> DataFrame:
        found = docs.select("row_key", "text").mapInArrow(_rare(frequent, of), "row_key long, item long, times long")
        return found.groupBy("row_key", "item").agg(F.max("times").alias("times")).join(table, "item")

    far = rare("word", frequent, words).select("row_key", F.col("times").alias("known"), (F.col("times") * F.log10(F.col("n") + 1.0)).alias("base"), F.lit(0.0).alias("score"))
    far = far.union(rare("gram", cache, scores).select("row_key", F.lit(0).cast("long"), F.lit(0.0), F.col("times") * F.col("score")))
    far = far.groupBy("row_key").agg(F.sum("known").alias("rare_known"), F.sum("base").alias("rare_base"), F.sum("score").alias("rare_score"))
    schema = "row_key long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"
    rows = docs.mapInArrow(_scored(cache, frequent, train_docs), schema).join(far, "row_key", "left")
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
