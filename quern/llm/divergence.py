"""Audit of how far the sources of a language diverge in the words they use.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased.  Each language keeps the terms that at least ``LEAST``
of its documents contain; most distinct terms are rare, and they must not be shuffled to be found rare:

1. Each task adds the document frequencies of its (language, term) pairs to a count-min sketch; the tasks' sketches are
   added up.  Counters stop at 255, above any sensible ``least``.  A sketch never underestimates, so a pair whose estimate
   is below ``least`` cannot be kept.
2. Each task counts its texts again, without the impossible pairs, summed by (language, source, term) before the shuffle.
   The sums over all tasks are exact counts and document frequencies, and exact frequencies decide what is kept.
3. Counts become smoothed shares in units of 1e-9, in integers.  The distance of two sources is the sum over all kept terms of
   the difference of their shares.  Terms that neither has all differ alike, those that one has differ from one value, so
   only the terms that both have are joined, and the rest follows from each source's distinct shares and how often each occurs.

The sketch's width follows the size of the texts up to ``WIDEST``, which bounds its memory (four bytes for each column); beyond
that it discards less, and the result stays the same.

Nulls and edge cases: null text, lang and source count as empty; every (lang, source) that occurs is a group, even without
terms.  Rows without doc_id and rows repeating one are documents of their own.  A language without kept terms has distances of
0 and no terms.  Texts of any length are read whole.  An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text as tx
from .scratch import discard, stored

LEAST = 30
UNIT = 1_000_000_000
SMOOTH = 5
TOP = 50
#: Rows of the sketch; its columns are a power of two between the two widths, about one for each BYTES_A_COLUMN bytes of text.
DEPTH = 4
NARROWEST, WIDEST = 1 << 14, 1 << 24
BYTES_A_COLUMN = 1024
#: Columns of the sketch that travel as one row.
BLOCK = 1 << 14
FULL = 255
#: Bytes of text counted at once.
SLICE = 6 << 20

NOT_TERM = np.ones(256, bool)
NOT_TERM[65:91] = NOT_TERM[97:123] = False
NOT_TERM[128:] = False
_ROWS = tx.seeded(DEPTH, 91) | np.uint64(1)


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _codes(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Code of each row and the values."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _terms(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, start and end of each term, its row from the first) for slices of a batch."""
    for at, to, data, offsets in tx.slices(batch, "text", SLICE):
        data = tx.LOWER[data]
        start, end, first = tx.words(data, offsets, NOT_TERM)
        yield at, to, data, start, end, np.repeat(np.arange(to - at), np.diff(first))


def cells(keys: np.ndarray, width: int) -> np.ndarray:
    """A column of the sketch for each key and row of the sketch, as places in the flat sketch."""
    shift = np.uint64(64 - (width.bit_length() - 1))
    return np.stack([(tx.mix(keys * by) >> shift).astype(np.int64) + k * width for k, by in enumerate(_ROWS)])


def _frequencies(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, an occurrence of each, its occurrences and its documents; doc must not fall."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    head = np.flatnonzero(new)
    other = new | np.concatenate(([True], d[1:] != d[:-1]))
    return k[head], order[head], np.diff(np.append(head, len(k))), np.add.reduceat(other.astype(np.int64), head)


def _sketch_rows(sketch: np.ndarray) -> pa.RecordBatch:
    """The blocks that hold anything."""
    blocks = sketch.reshape(-1, BLOCK)
    full = np.flatnonzero(blocks.any(1))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([blocks[b].tobytes() for b in full.tolist()], pa.binary())], ["block", "counts"])


def _added(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(DEPTH * width, np.uint8)
        for batch in batches:
            lang, langs = _codes(batch.column("lang"))
            salt = np.array([_lang_key(x) for x in langs], np.uint64)
            for at, _, data, start, end, doc in _terms(batch):
                if not len(start):
                    continue
                key = tx.mix(tx.span_hashes(data, start, end) ^ salt[lang[at + doc]])
                distinct, _, _, docs = _frequencies(key, doc)
                for row in cells(distinct, width):
                    place, which = np.unique(row, return_inverse=True)
                    more = np.bincount(which, docs).astype(np.int64)
                    sketch[place] = np.minimum(sketch[place] + more, FULL).astype(np.uint8)
        yield _sketch_rows(sketch)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each block; memory for one sketch at most, however many rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            more = np.frombuffer(counts.as_buffer(), np.uint8)
            sums[block] = np.minimum(sums[block] + more.astype(np.int64), FULL).astype(np.uint8) if block in sums else more.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """The merged sketch of rows(lang, text), DEPTH * width counters.

    Tasks' sketches are first added up where the shuffle happens to deal them, so a block's rows in the second step are no
    more than there are shuffle partitions."""
    shape = "block int, counts binary"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.mapInArrow(_added(width), shape).repartition(parts).mapInArrow(_merged, shape)
    twice = once.repartition(max(1, min(parts, DEPTH * width // BLOCK)), "block").mapInArrow(_merged, shape)
    out = np.zeros((DEPTH * width // BLOCK, BLOCK), np.uint8)
    # DEPTH * WIDEST bytes at most
    for row in twice.toLocalIterator():
        out[row.block] = np.frombuffer(bytes(row.counts), np.uint8)
    return out.ravel()


def _counted(shared, width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        for batch in batches:
            lang, langs = _codes(batch.column("lang"))
            source, sources = _codes(batch.column("source"))
            salt = np.array([_lang_key(x) for x in langs], np.uint64)
            group, place = np.unique(lang * len(sources) + source, return_inverse=True)
            own = tx.seeded(len(group), 17)
            for at, _, data, start, end, doc in _terms(batch):
                if not len(start):
                    continue
                word, second = tx.span_hashes2(data, start, end)
                able = counters[cells(tx.mix(word ^ salt[lang[at + doc]]), width)].min(0) >= least
                start, end, doc, word, second = (x[able] for x in (start, end, doc, word, second))
                if not len(start):
                    continue
                key = tx.mix(word ^ own[place[at + doc]])
                distinct, any_at, count, docs = _frequencies(key, doc)
                if (second != second[any_at][np.searchsorted(distinct, key)]).any():
                    raise RuntimeError("two terms of one slice share a 64-bit hash")
                g = group[place[at + doc[any_at]]]
                size = end[any_at] - start[any_at]
                offsets = np.concatenate(([0], np.cumsum(size)))
                raw = data[np.arange(offsets[-1]) + np.repeat(start[any_at] - offsets[:-1], size)]
                term = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[x] for x in (g // len(sources)).tolist()], pa.string()), pa.array([sources[x] for x in (g % len(sources)).tolist()], pa.string()), term, pa.array(count), pa.array(docs)],
                    ["lang", "source", "term", "n", "docs"],
                )

    return run


def term_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n) of the kept terms that the group has, and the groups (lang, source); both stored."""
    if not 1 <= least <= FULL:
        raise ValueError(f"least must be between 1 and {FULL}")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    groups = stored(groups, "groups")
    size = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    width = max(NARROWEST, min(WIDEST, 1 << max(0, (size // BYTES_A_COLUMN).bit_length())))
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch(rows.select("lang", "text"), width))
    parts = rows.mapInArrow(_counted(shared, width, least), "lang string, source string, term string, n long, docs long")
    counts = stored(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    shared.destroy()
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    found = stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-counts")
    discard(counts)
    return found, groups.select("lang", "source")


def share(count: str, total: str, kinds: str) -> F.Column:
    """1 + floor(UNIT (count + SMOOTH) / (total + SMOOTH kinds)), exact; null without kinds."""
    over = f"cast({UNIT} as decimal(10,0)) * cast({count} + {SMOOTH} as decimal(20,0))"
    return F.expr(f"1 + ({over} div nullif(cast({total} + {SMOOTH} * {kinds} as decimal(20,0)), 0))").cast("long")


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    ranked = rows.withColumn("rank", rank.cast("int"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value long, rank int.

    pair: the other sources of the language by distance.  term: the kept terms that the source uses more than its language
    does, by the difference of shares, the first ``top`` of them.
    """
    counts, groups = term_counts(docs, least)
    kinds = counts.groupBy("lang").agg(F.countDistinct("term").alias("kinds"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    about = groups.join(sums, ["lang", "source"], "left").join(kinds, "lang", "left").fillna(0, ["total", "kinds"])
    about = stored(about.withColumn("p0", F.coalesce(share("0", "total", "kinds"), F.lit(0))), "group-shares")
    found = counts.join(about, ["lang", "source"]).withColumn("p", share("n", "total", "kinds"))
    found = stored(found.select("lang", "source", "term", "n", "p", "p0"), "shares")

    # terms: against the whole language
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    over = about.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kinds").alias("kinds"))
    whole = whole.join(over, "lang").select("lang", "term", share("n", "total", "kinds").alias("q"))
    terms = found.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    # pairs: what both have is joined term by term ...
    left = found.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    right = found.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    more = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("b0")) - F.abs(F.col("a0") - F.col("pb")) + F.abs(F.col("a0") - F.col("b0"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(more).alias("both"))
    # ... the rest as if the other source had none of a source's terms: its distinct shares and how many terms have each
    steps = found.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("steps"))
    sides = stored(about.join(steps, ["lang", "source"], "left").select("lang", "source", "p0", "kinds", F.coalesce("steps", F.expr("cast(array() as array<struct<p:bigint,m:bigint>>)")).alias("steps")), "steps")

    def alone(steps: str, own: str, other: str) -> F.Column:
        far = F.abs(F.col(own) - F.col(other))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x["m"] * (F.abs(x["p"] - F.col(other)) - far))

    two = sides.toDF("lang", "a", "a0", "kinds", "sa").join(sides.drop("kinds").toDF("lang", "b", "b0", "sb"), "lang").where("a < b")
    rest = F.col("kinds") * F.abs(F.col("a0") - F.col("b0")) + alone("sa", "a0", "b0") + alone("sb", "b0", "a0")
    pairs = two.select("lang", "a", "b", rest.alias("rest")).join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), (F.col("rest") + F.coalesce("both", F.lit(0))).alias("value"))
    pairs = _ranked(pairs.select("lang", "x.source", "x.item", "value")).withColumn("part", F.lit("pair"))
    every = pairs.unionByName(_ranked(terms, top).withColumn("part", F.lit("term")))
    return every.select("lang", "source", "part", "item", "value", "rank")
