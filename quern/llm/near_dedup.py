"""MinHash near-deduplication by a multi-index Hamming join.

A document's set holds the hashes of its distinct 5-word shingles (lower case; the whole sequence if there are
fewer words).  Its signature has 64 positions of 16 bits, cut into 16 chunks of 4.  If two signatures differ in
at most 27 positions, then by pigeonhole at least 3 chunks have at most one differing position.  Each chunk is
therefore indexed under the 4 keys that leave one position out, which enumerates the allowed errors, so every
pair within the threshold meets under some key.  Sets with Jaccard 0.75 exceed the threshold with probability
below 0.001, larger similarities far less.

* Equal sets are one class from the start, so copies cost nothing more.
* First the members of a key meet only its smallest member (taken per batch and then over all, so a key of very
  many members is never gathered); what a full comparison of the sets confirms is linked and components form.
* Then all members of different components under a key are compared by the Hamming distance of their signatures.  The nodes of
  a common template or passage share a key without being similar: those of a key with more than ``TILE`` nodes are dealt
  to parts by a hash, and each pair of parts is compared as a tile of its own, so no task holds more than two parts of a key.
  A pair comes out of one of its keys only, and only if counts of the two sets by ``BUCKETS`` ranges of the hashes leave room
  for the similarity: what one set has more of in a range is surely not in the other, so this loses no link.
* All candidates are confirmed on whole sets: 100 * intersection >= 75 * union.

Nulls and edge cases: null text counts as empty; texts without words have n_shingles 0 and link with nothing.
Rows without doc_id come back with component_id null and kept true and link with nothing.  Rows repeating a
doc_id are one node: they share a component.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .graph import components
from .scratch import keep_ids, stored

SHINGLE = 5
PERCENT = 75
POSITIONS, CHUNK = 64, 4
CHUNKS = POSITIONS // CHUNK
THRESHOLD = 27
#: Nodes of a key that are compared with each other in one place; more of them are cut into tiles.
TILE = 2048
#: Ranges of hashes whose shingles are counted for each set, up to 15, two of them in a byte.
BUCKETS = 256
#: Bytes of text whose shingles are made at once.
SLICE = 1 << 19

_A = tx.seeded(POSITIONS, 11) | np.uint64(1)
_B = tx.seeded(POSITIONS, 12)
_SALT = tx.seeded(POSITIONS * 4, 13)


def shingle_sets(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, sorted distinct shingle hashes one document after the other) for slices of a batch."""
    for at, _, data, offsets in tx.slices(batch, column, SLICE):
        data = tx.LOWER[data]
        start, end, first = tx.words(data, offsets)
        word = tx.span_hashes(data, start, end)
        grams = tx.gram_hashes(word, SHINGLE)
        count = np.diff(first)
        sets = []
        for d, n in enumerate(count.tolist()):
            a = first[d]
            if n >= SHINGLE:
                s = np.sort(grams[a : a + n - SHINGLE + 1])
                sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif n:
                sets.append(tx.gram_hashes(word[a : a + n], n) ^ _SALT[n : n + 1])
            else:
                sets.append(np.zeros(0, np.uint64))
        yield at, np.array([len(s) for s in sets], np.int64), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def bucket_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row a set: how many of its hashes fall in each range."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    count = np.bincount(row * BUCKETS + (tx.mix(hashes ^ _SALT[1]) % np.uint64(BUCKETS)).astype(np.int64), minlength=len(sizes) * BUCKETS)
    count = np.minimum(count, 15).astype(np.uint8).reshape(-1, BUCKETS)
    return count[:, ::2] | count[:, 1::2] << 4


def _room(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether sets with these packed counts and sizes can be similar enough: at most what the counts have in common is shared."""
    more_x, more_y = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for p, q in ((x & 15, y & 15), (x >> 4, y >> 4)):
        most = np.maximum(p, q)
        more_x += (most - q).sum(1, dtype=np.int64)
        more_y += (most - p).sum(1, dtype=np.int64)
    shared = np.minimum(nx - more_x, ny - more_y)
    return 100 * shared >= PERCENT * (nx + ny - shared)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, sizes, hashes in shingle_sets(batch):
            full = sizes > 0
            begin = (np.cumsum(sizes) - sizes)[full]
            k = len(begin)
            signature = np.zeros((k, POSITIONS), np.uint16)
            keys = np.zeros((k, 2), np.uint64)
            if k:
                for p in range(POSITIONS):
                    low = np.minimum.reduceat(hashes * _A[p] + _B[p], begin)
                    signature[:, p] = (tx.mix(low) >> np.uint64(48)).astype(np.uint16)
                keys[:, 0] = np.add.reduceat(tx.mix(hashes), begin)
                keys[:, 1] = np.bitwise_xor.reduceat(tx.mix(hashes ^ np.uint64(_SALT[0])), begin) ^ sizes[full].astype(np.uint64)
            counts = bucket_counts(hashes, sizes[full])
            set_id: list = [None] * len(sizes)
            sig: list = [None] * len(sizes)
            count: list = [None] * len(sizes)
            for j, row in enumerate(np.flatnonzero(full).tolist()):
                set_id[row], sig[row], count[row] = keys[j].tobytes(), signature[j].tobytes(), counts[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, len(sizes)), pa.array(sizes), *(pa.array(x, pa.binary()) for x in (set_id, sig, count))],
                ["doc_id", "n_shingles", "set_id", "sig", "counts"],
            )


def chunk_keys(signature: np.ndarray, chunks: range = range(CHUNKS)) -> np.ndarray:
    """One row of keys a signature: for each chunk the hashes of its positions without the 1st, 2nd, 3rd, 4th."""
    out = np.empty((len(signature), len(chunks) * CHUNK), np.uint64)
    for j, c in enumerate(chunks):
        part = signature[:, c * CHUNK : (c + 1) * CHUNK].astype(np.uint64)
        for drop in range(CHUNK):
            x, y, z = (part[:, i] for i in range(CHUNK) if i != drop)
            out[:, j * CHUNK + drop] = tx.mix((x << np.uint64(32) | y << np.uint64(16) | z) ^ _SALT[c * CHUNK + drop])
    return out


def first_keys(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the keys that both signatures of each pair have, the first by chunk and position left out."""
    apart = (x != y).reshape(-1, CHUNKS, CHUNK)
    pair = np.arange(len(x))
    chunk = (apart.sum(2) <= 1).argmax(1)
    drop = apart[pair, chunk].argmax(1)
    part = x.reshape(-1, CHUNKS, CHUNK)[pair, chunk].astype(np.uint64)
    kept = np.array([[i for i in range(CHUNK) if i != d] for d in range(CHUNK)])[drop]
    a, b, c = (part[pair, kept[:, i]] for i in range(CHUNK - 1))
    return tx.mix((a << np.uint64(32) | b << np.uint64(16) | c) ^ _SALT[chunk * CHUNK + drop])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every (key, node) with the smallest node that has the key in this batch, and how many have it here."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = chunk_keys(_signatures(batch.column("sig"))).ravel()
        node = np.repeat(batch.column("node").to_numpy(), CHUNKS * CHUNK)
        order = np.lexsort((node, keys))
        keys, node = keys[order], node[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        here = np.diff(np.append(head, len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node), pa.array(np.repeat(node[head], here)), pa.array(np.repeat(here, here))], ["key", "node", "lead", "here"])


def meet_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node: each key's members with its smallest; keys of one single member are left out."""
    last, pivot, open_row = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node, here = (batch.column(c).to_numpy() for c in ("key", "node", "here"))
        head = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(head)
        first = node[at]
        if key[0] == last:
            first = first.copy()
            first[0] = pivot
        run = np.diff(np.append(at, len(key)))
        pivots = np.repeat(first, run)
        crowd = (np.repeat(run, run) > 1) | (here > 1)
        if key[0] == last:
            crowd[: run[0]] = True
            if open_row is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in open_row], ["key", "node", "pivot"])
        # a lone last row may still find company in the next batch
        open_row = ([key[-1]], [node[-1]], [pivots[-1]]) if not crowd[-1] else None
        yield pa.RecordBatch.from_arrays([pa.array(key[crowd]), pa.array(node[crowd]), pa.array(pivots[crowd])], ["key", "node", "pivot"])
        last, pivot = key[-1], pivots[-1]


def _distance_ok(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            near = (_signatures(batch.column("sig_a")) != _signatures(batch.column("sig_b"))).sum(1) <= THRESHOLD
            yield batch.select(["a", "b"]).filter(pa.array(near))


def _meet_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, key, part, cross, node, component, n, sig, counts) sorted by tile: pairs of different components within the
    signature distance whose sizes and counts allow them to be similar, where their first key is the tile's; where cross, of
    different parts only."""
    held: pa.Table | None = None
    for batch in chain(batches, [None]):
        parts = ([held] if held is not None else []) + ([pa.Table.from_batches([batch])] if batch is not None else [])
        if not parts:
            return
        rows = pa.concat_tables(parts)
        if not rows.num_rows:
            continue
        tile = rows.column("tile").to_numpy()
        last = len(tile) if batch is None else int(np.argmax(tile == tile[-1]))
        key, part, cross, node, comp, n = (rows.column(c).to_numpy(zero_copy_only=False)[:last] for c in ("key", "part", "cross", "node", "component", "n"))
        sig = _signatures(rows.column("sig").slice(0, last))
        counts = np.frombuffer(b"".join(rows.column("counts").slice(0, last).to_pylist()), np.uint8).reshape(last, -1)
        edge = np.append(np.flatnonzero(np.concatenate(([True], tile[1:last] != tile[: last - 1]))), last) if last else np.zeros(1, np.int64)
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for x in range(a, b, 128):
                i = slice(x, min(b, x + 128))
                ok = (comp[i, None] < comp[None, a:b]) & (100 * np.minimum(n[i, None], n[None, a:b]) >= PERCENT * np.maximum(n[i, None], n[None, a:b]))
                if cross[a]:
                    ok &= part[i, None] != part[None, a:b]
                p, q = np.nonzero(ok)
                for at in range(0, len(p), 1 << 14):
                    u, w = x + p[at : at + (1 << 14)], a + q[at : at + (1 << 14)]
                    near = (sig[u] != sig[w]).sum(1) <= THRESHOLD
                    u, w = u[near], w[near]
                    own = first_keys(sig[u], sig[w]) == np.uint64(key[a].view(np.uint64))
                    u, w = u[own], w[own]
                    room = _room(counts[u], counts[w], n[u], n[w])
                    found.append(np.sort(np.stack([node[u[room]], node[w[room]]], 1), axis=1))
        held = rows.slice(last).combine_chunks()
        every = np.unique(np.concatenate(found), axis=0)
        if len(every):
            yield pa.RecordBatch.from_arrays([pa.array(every[:, k].copy()) for k in (0, 1)], ["a", "b"])


def _tiled(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (key, node, ...) with tile, part and cross: of a key of several parts (sizes: key, parts) a row goes to the
    tile of its part with each other part and with itself."""
    rows = rows.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    tile = F.when(F.col("parts") > 1, F.xxhash64("key", low, high)).otherwise(F.col("key"))
    return rows.withColumn("cross", F.col("part") != F.col("other")).withColumn("tile", tile).drop("other", "parts")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, sizes, hashes in shingle_sets(batch):
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, len(sizes)), pa.array([hashes[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())], ["node", "shingles"]
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            every = np.concatenate((x, y))
            every.sort()
            shared = int((every[1:] == every[:-1]).sum())
            ok.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Of the candidate pairs (a < b) those whose whole sets are similar enough."""
    size = nodes.select("node", "n")
    sized = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    pairs = stored(sized.select("a", "b"), f"{name}-pairs")
    both = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-members")
    sets = stored(keep_ids(docs, "doc_id", both).mapInArrow(_sets, "node long, shingles binary").where("length(shingles) > 0"), f"{name}-sets")
    right = pairs.join(sets.toDF("b", "y"), "b")
    return right.join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = stored(docs.mapInArrow(_features, "doc_id long, n_shingles long, set_id binary, sig binary, counts binary"), "signatures")
    classes = features.where("doc_id is not null and set_id is not null").groupBy("set_id")
    classes = stored(classes.agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), *(F.max(c).alias(c) for c in ("sig", "counts"))), "sets")
    nodes = classes.select("node", "n", "sig", "counts")

    keys = stored(nodes.select("node", "sig").mapInArrow(_emit_keys, "key long, node long, lead long, here long"), "keys")
    leads = keys.where("node = lead").select("key", "node", "here").repartition("key").sortWithinPartitions("key", "node")
    met = stored(leads.mapInArrow(meet_keys, "key long, node long, pivot long"), "met")
    rest = keys.where("node <> lead").join(met.select("key", F.col("node").alias("lead"), "pivot"), ["key", "lead"])
    members = met.union(rest.select("key", "node", "pivot"))
    stars = members.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    sigs = nodes.select("node", "sig")
    stars = stars.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_distance_ok, "a long, b long")
    links = stored(_confirmed(stars, nodes, docs, "star"), "star-links")
    labels = components(links)

    members = met.select("key", "node").union(keys.where("node <> lead").select("key", "node"))
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    mixed = stored(mixed.select("key", F.ceil(F.col("members") / TILE).cast("int").alias("parts")), "mixed")
    about = nodes.groupBy("node").agg(*(F.max(c).alias(c) for c in ("n", "sig", "counts")))
    rows = _tiled(placed, mixed).join(about, "node").select("tile", "key", "part", "cross", "node", "component", "n", "sig", "counts")
    pairs = rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_meet_signatures, "a long, b long")
    late = stored(_confirmed(pairs.distinct(), nodes, docs, "search"), "search-links")

    joined = late.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(joined)
    final = labels.join(merged.toDF("component", "upper"), "component", "left").select("node", F.coalesce("upper", "component").alias("component_id"))
    alone = merged.join(labels, "node", "left_anti").select("node", F.col("component").alias("component_id"))
    every = stored(final.union(alone).where("node <> component_id"), "components")
    moved = classes.select("set_id", "node", "copies").join(every, "node", "left").where("copies > 1 or component_id is not null")
    moved = stored(moved.select("set_id", F.coalesce("component_id", "node").alias("component_id")), "moved")
    rows = features.select("doc_id", "n_shingles", "set_id").join(moved, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
