"""Approximate nearest neighbours by an inverted multi-index, largest inner product first.

Each vector is cut into two halves, and each half is quantised by its own k-means codebook (fitted on at most
``SAMPLE`` vectors by hash of their id; every vector is indexed).  A cell is a pair of codewords.  For a query
the codewords of both halves are ranked by inner product, and a heap yields pairs in order of the summed inner
products until the cells passed hold enough entries.  Entries of the probed cells are reranked by the exact inner
product in double precision.

The cells a query passes under one left codeword are the first few of its ranked right codewords, so one row
(left codeword, query, how many) says them all.  Those rows meet the entries of the codeword, which are dealt to
parts of about ``PART`` entries by hash of their id, so no task grows with a crowded cell.  Queries are dealt to blocks of
about ``QUERY_BLOCK`` by their own cells, so queries of a block reach much the same codewords, and entries go only to the
blocks that reach them.  Each part keeps its own 20 best of a query, and the final 20 are taken from those.

A block product finds the best of a part; what may be among them is scored again by adding the products of the components
in order, so equal vectors have equal scores wherever they lie.

A cell counts for at most ``CELL_SHARE`` of the entries that a query asks for, so one crowded cell does not end
the search.  Entries asked for: the larger of ``LEAST`` and ``PORTION`` of all, since recall at a fixed number of
entries falls as the table grows.

Nulls and edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
vectors without id or whose length differs from the most common one (ties: the longer).  Rows repeating an id are
candidates each; a query's own id is never its neighbour.  With fewer candidates than 20 all are returned.  An
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

SAMPLE = 20_000
CODEWORDS = 128
ROUNDS = 15
LEAST, PORTION = 400, 0.45
CELL_SHARE = 0.125
PART = 16_384
QUERY_BLOCK = 65_536


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from spread-out starting points; an empty cell takes the worst-served point."""
    rng = np.random.default_rng(seed)
    k = min(k, len(np.unique(x, axis=0)))
    centre = [x[rng.integers(len(x))]]
    gap = ((x - centre[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centre.append(x[rng.choice(len(x), p=gap / gap.sum())] if gap.sum() > 0 else x[rng.integers(len(x))])
        gap = np.minimum(gap, ((x - centre[-1]) ** 2).sum(1))
    c = np.array(centre)
    for _ in range(rounds):
        d = (c**2).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        c = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], 1) / np.maximum(n, 1)[:, None]
        for j in np.flatnonzero(n == 0):
            c[j] = x[(d[np.arange(len(x)), near] + (x**2).sum(1)).argmax()]
    return c


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def cell_order(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs (i, j) by falling left[i] + right[j]: a heap over the frontier of the sorted halves."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    heap, seen = [(-(left[a[0]] + right[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (-(left[a[p]] + right[b[q]]), p, q))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: str = "id % 20 = 0", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for every vector that meets the SQL condition ``queries`` on id."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    limit = F.lit(float("inf"))
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists("v", lambda x: x != 0))
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d, total = (lengths.d, lengths["count"]) if lengths else (1, 0)
    v = v.where(F.size("v") == d)
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    half = d // 2
    sample = matrix(pa.array(r.v for r in v.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).collect()))
    books = [kmeans(part, CODEWORDS, seed) for seed, part in enumerate((sample[:, :half], sample[:, half:])) if part.shape[1]]
    books = books if len(books) == 2 else [np.zeros((1, 0)), *books]
    sizes = tuple(len(b) for b in books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                i, j = (((b**2).sum(1) - 2 * p @ b.T).argmin(1) for b, p in zip(books, (x[:, :half], x[:, half:]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(i * sizes[1] + j), batch.column("id"), batch.column("v")], ["cell", "id", "v"])

    index = stored(v.mapInArrow(assign, "cell long, id long, v array<double>"), "index")
    fill = np.zeros(sizes[0] * sizes[1], np.int64)  # entries of each cell: CODEWORDS squared numbers at most
    for r in index.groupBy("cell").count().collect():
        fill[r.cell] = r["count"]
    want = max(LEAST, int(PORTION * total))
    counted = np.minimum(fill, max(1, int(CELL_SHARE * want)))
    parts = np.maximum(1, -(-fill.reshape(sizes).sum(1) // PART))
    asked = index.where(F.expr(queries))
    ahead = np.zeros(len(fill) + 1, np.int64)  # queries in the cells before each
    for r in asked.groupBy("cell").count().collect():
        ahead[r.cell + 1] = r["count"]
    block_of = np.cumsum(ahead)[:-1] // QUERY_BLOCK

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = matrix(some.column("v"))
                scores = [p @ b.T for b, p in zip(books, (x[:, :half], x[:, half:]), strict=True)]
                reach = np.zeros((len(x), sizes[0]), np.int64)
                for r in range(len(x)):
                    passed = 0
                    for i, j in cell_order(scores[0][r], scores[1][r]):
                        reach[r, i] += 1
                        passed += int(counted[i * sizes[1] + j])
                        if passed >= want:
                            break
                row, left = np.nonzero(reach)
                times = parts[left]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, left = np.repeat(row, times), np.repeat(left, times)
                take = pa.array(row)
                block = block_of[some.column("cell").to_numpy()][row]
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(part), pa.array(block), pa.array(reach[row, left]), some.column("id").take(take), some.column("v").take(take)], ["left", "part", "block", "reach", "query_id", "q"])

    asked = stored(asked.mapInArrow(probes, "left long, part long, block long, reach long, query_id long, q array<double>"), "probes")
    reached = asked.select(F.col("left").alias("to_left"), F.col("block").alias("to_block")).distinct()  # at most codewords x blocks
    left = F.floor(F.col("cell") / sizes[1]).cast("long")
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.element_at(F.array(*[F.lit(int(p)) for p in parts]), (F.col("left") + 1).cast("int")))
    entries = index.withColumn("left", left).withColumn("part", part).withColumn("right", F.pmod("cell", F.lit(sizes[1])))
    entries = entries.join(F.broadcast(reached), F.col("left") == F.col("to_left")).select("left", "part", F.col("to_block").alias("block"), "right", "id", "v")

    def rerank(key: tuple, entry: pa.Table, query: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not entry.num_rows or not query.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, code, x = entry.column("id").to_numpy(), entry.column("right").to_numpy(), matrix(entry.column("v").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, code, x = ids[order], code[order], x[order]
        longest = np.sqrt((x * x).sum(1).max())
        out: list[list[np.ndarray]] = [[], [], []]
        for at in range(0, query.num_rows, 256):
            some = query.slice(at, 256)
            who, reach, q = some.column("query_id").to_numpy(), some.column("reach").to_numpy(), matrix(some.column("q").combine_chunks())
            ranked = np.argsort(np.argsort(-(q[:, half:] @ books[1].T), axis=1, kind="stable"), axis=1, kind="stable")
            score = q @ x.T
            score[(ranked[:, code] >= reach[:, None]) | (who[:, None] == ids[None, :])] = -np.inf
            edge = -np.partition(-score, k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(q), -np.inf)
            slack = 1e-12 * np.sqrt((q * q).sum(1)) * longest
            row, col = np.nonzero((score >= (edge - slack)[:, None]) & (score > -np.inf))
            exact = np.zeros(len(row))
            for j in range(d):
                exact += q[row, j] * x[col, j]
            order = np.lexsort((ids[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            few = np.arange(len(row)) - np.searchsorted(row, row) < k
            out[0].append(who[row[few]])
            out[1].append(ids[col[few]])
            out[2].append(exact[few])
        return pa.table([pa.array(np.concatenate(o)) for o in out], names=names)

    groups = ["left", "part", "block"]
    found = entries.groupBy(*groups).cogroup(asked.groupBy(*groups)).applyInArrow(rerank, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
