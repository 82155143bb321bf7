"""Exact deduplication by Golomb-coded fingerprint exchange.

1. Each partition of documents hashes its texts to 64-bit fingerprints (in the JVM), sorts them and cuts them
   by leading bits among owners.  Every (block, owner) list is Golomb-Rice coded, about 64 - log2(n) + 1.5 bits
   a fingerprint, and only those codes travel.
2. Each owner merges the lists it got and answers every block with a bitmap: which of its fingerprints
   another block, or another row of the same block, has too.
3. The bitmaps, laid over the block's document ids, name the suspects.  Only suspects' texts are shuffled;
   grouping by the text itself compares bytes, so a fingerprint collision joins nothing.

Nulls and edge cases: null text counts as empty.  Rows without doc_id are always suspects, so they count in
group_size but never win against an id; a group of only such rows has keep_id null and kept true for all.
Rows repeating one doc_id and text count each and share their fate.  An empty table gives an empty result.
Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep_ids, stored

#: Most rows in a block, and the fingerprints an owner is meant to get, up to 2**14 owners.
BLOCK_ROWS = 1 << 20
OWNER_ROWS = 1 << 18
MOST_OWNER_BITS = 14
#: Stands for a missing id among a block's ids.
NO_ID = -(1 << 63)


def golomb_encode(values: np.ndarray) -> bytes:
    """Ascending uint64 values as gaps: one byte k, a unary stream of gap >> k, then k low bits of each gap."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / n))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(code: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    k, raw = code[0], np.frombuffer(code, np.uint8, offset=1)
    low_bytes = (n * k + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - low_bytes]))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(raw[len(raw) - low_bytes :])[: n * k].reshape(n, k)
        for j in range(k):
            gaps |= low[:, j].astype(np.uint64) << np.uint64(j)
    return np.cumsum(gaps, dtype=np.uint64)


_BLOCKS = "block long, owner int, n int, code binary, repeats binary, copies binary, ids binary"


def _block(ids: np.ndarray, prints: np.ndarray, owner_bits: int) -> pa.RecordBatch:
    """The lists of one block, cut by owner."""
    order = np.argsort(prints, kind="stable")
    ids, prints = ids[order], prints[order]
    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
    distinct, copies = prints[first], np.diff(np.append(first, len(prints)))
    owner = (distinct >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(distinct), np.int64)
    cut = np.flatnonzero(np.diff(owner, prepend=-1))
    rows = {k: [] for k in ("block", "owner", "n", "code", "repeats", "copies", "ids")}
    name = uuid.uuid4().int >> 65
    for a, b in zip(cut, [*cut[1:], len(owner)], strict=True):
        mine = distinct[a:b] - (np.uint64(int(owner[a]) << (64 - owner_bits)) if owner_bits else np.uint64(0))
        upto = first[b] if b < len(first) else len(ids)
        for key, value in (("block", name), ("owner", int(owner[a])), ("n", int(b - a)), ("code", golomb_encode(mine)), ("repeats", np.packbits(copies[a:b] > 1).tobytes()), ("copies", copies[a:b].astype(np.int32).tobytes()), ("ids", ids[first[a] : upto].astype(np.int64).tobytes())):
            rows[key].append(value)
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), *((k, pa.binary()) for k in ("code", "repeats", "copies", "ids"))]))


def _blocks(owner_bits: int):
    """A partition's rows as blocks of up to BLOCK_ROWS: long sorted lists have small gaps, which code short."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append((batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
                rows += batch.num_rows
            if rows and (batch is None or rows >= BLOCK_ROWS):
                yield _block(*(np.concatenate(x) for x in zip(*held, strict=True)), owner_bits)
                held, rows = [], 0

    return encode


def _answer(table: pa.Table) -> pa.Table:
    """One owner: which fingerprints of each block are held more than once over all blocks."""
    n = table.column("n").to_numpy()
    prints = np.concatenate([golomb_decode(c, k) for c, k in zip(table.column("code").to_pylist(), n.tolist(), strict=True)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(r, np.uint8))[:k] for r, k in zip(table.column("repeats").to_pylist(), n.tolist(), strict=True)]).astype(bool)
    order = np.argsort(prints, kind="stable")
    ranked = prints[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(prints), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    shared |= twice
    ends = np.cumsum(n)
    maps = [shared[b - k : b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
    out = table.select(["block", "owner"]).append_column("bitmap", pa.array([np.packbits(m).tobytes() for m in maps], pa.binary()))
    return out.filter(pa.array([bool(m.any()) for m in maps]))


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n, bitmap, copies, ids in zip(*(batch.column(c).to_pylist() for c in ("n", "bitmap", "copies", "ids")), strict=True):
            hit = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
            of = np.repeat(hit, np.frombuffer(copies, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[of])], ["doc_id"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256; one row per document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    owners = min(MOST_OWNER_BITS, max(0, (docs.count() // OWNER_ROWS).bit_length()))
    prints = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("fp"))
    blocks = stored(prints.mapInArrow(_blocks(owners), _BLOCKS), "fingerprints")
    answers = blocks.select("block", "owner", "n", "code", "repeats").groupBy("owner").applyInArrow(_answer, "block long, owner int, bitmap binary")
    named = blocks.select("block", "owner", "n", "copies", "ids").join(answers, ["block", "owner"])
    suspects = stored(named.mapInArrow(_suspects, "doc_id long").distinct(), "suspects")
    texts = keep_ids(docs, "doc_id", suspects).union(docs.where("doc_id is null"))
    classes = texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = stored(classes.where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "classes")
    rows = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256")).join(classes, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
