"""Prefix tries over conversations, as succinct level-order (LOUDS) tries.

A path is a sequence of labels, 128-bit hashes of (role, text), with the length of each text.  A node is a distinct prefix;
its members are the paths that start with it.

* A chain hash of the labels names each prefix.  Prefixes that more than ``heavy`` paths share are found level by level, over
  ever more levels at a time and only below heavy ones; they form the upper part of the trie.  ``heavy`` grows with the
  number of paths, so the upper part has at most ``UPPER`` nodes a level.
* Below it, a path belongs to its first prefix that is not heavy.  Whole subtrees of those are dealt to shards by hash, so a shard
  holds about ``SHARD`` paths and no subtree more than ``heavy``.  In each shard NumPy builds the trie level by level: a bit
  vector with a 1 for each child and a 0 after each node's children, and arrays of labels and text lengths in that order.
* Roll-ups read the bit vector: the v-th 1 is node v, the zeros before it count its parent.  Members, smallest member, leaves
  and tokens are added to the parents by np.add.at, level by level from the bottom.
* The upper levels are merged apart: they get the sums of the subtrees below them and are rolled up in the same manner.

The list of a node's own paths is hashed in the shard that holds it; those of upper nodes, which may be any number, are sorted by
Spark and hashed as a stream.  One conversation is the unit of work: its labels (not its texts) are in one task's memory.

Nulls and edge cases: null role or text counts as empty, null turn comes first, turns with the same number are ordered by the
hash of role and text, and rows repeating a turn are turns of their own.  Rows without conv_id are left out.  A rebuilt
conversation without turns is a member of the root only.  Texts of any length count whole (hashed where they are read, never
shuffled).  An empty table has no conversation and so no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import BROADCAST_ROWS, stored

SHARD = 20_000
#: Prefixes with more paths than this, or than a UPPER-th of all, are upper nodes.
HEAVY = 5_000
UPPER = 100_000
SHARDS = 32
#: Bytes of a label.
WIDE = 16
ROOT = b"\0" * WIDE
NOTHING = hashlib.sha256(b"").hexdigest()
#: Conversation ids are divided by this to find the one whose first turns they share, and how many at most.
FAMILY, MOST_SHARED = 100, 6

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, labels array<binary>, chars array<long>) of every conversation, rebuilt.

    The first h turns are those of conversation c - c % FAMILY (all if it has fewer, none if it is absent), then c's own after its
    first h; h = crc32(c) % MOST_SHARED.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    label = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary"), 256), 1, 2 * WIDE))
    turns = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), label.alias("label"), F.length(text).cast("long").alias("chars")).alias("t"))
    own = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = stored(own, "conversations")
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, MOST_SHARED - 1).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    both = own.withColumn("h", h).withColumn("head", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "head", "left")
    shared = F.coalesce(F.when(F.col("h") > 0, F.slice("first", F.lit(1), F.greatest("h", F.lit(1)))).otherwise(F.slice("turns", 1, 0)), F.slice("turns", 1, 0))
    whole = F.concat(shared, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return both.select("conv_id", whole.alias("w")).select("conv_id", F.col("w.label").alias("labels"), F.col("w.chars").alias("chars"))


def _lanes(raw: np.ndarray) -> np.ndarray:
    return raw.view(np.uint64).reshape(-1, 2)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, n, chars, and as bytes: the labels and the chain hash of each prefix."""
    by = tx.seeded(4, 71) | np.uint64(1)
    for batch in batches:
        labels = batch.column("labels")
        flat = labels.flatten()
        lab = _lanes(np.frombuffer(b"".join(flat.to_pylist()), np.uint8)) if len(flat) else np.zeros((0, 2), np.uint64)
        n = np.diff(labels.offsets.to_numpy()).astype(np.int64)
        off = np.cumsum(n) - n
        state = np.tile(by[2:], (len(n), 1))
        prefix = np.empty_like(lab)
        live = np.flatnonzero(n > 0)
        for d in range(int(n.max(initial=0))):
            live = live[n[live] > d]
            for k in (0, 1):
                state[live, k] = tx.mix((state[live, k] ^ lab[off[live] + d, k]) * by[k] + np.uint64(d + 1))
            prefix[off[live] + d] = state[live]
        cut = list(zip(off.tolist(), (off + n).tolist(), strict=True))
        blobs = [pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (lab, prefix)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n), batch.column("chars"), *blobs], ["conv_id", "n", "chars", "labels", "prefix"])


def _at(column: str, d: F.Column) -> F.Column:
    return F.when(d > 0, F.substring(F.col(column), (d - 1) * WIDE + 1, F.lit(WIDE))).otherwise(F.lit(ROOT))


def paths(sequences: DataFrame) -> DataFrame:
    """(conv_id, n, chars, labels, prefix) of sequences (conv_id, labels array<binary of 16>, chars array<long>), stored."""
    return stored(sequences.select("conv_id", "labels", "chars").mapInArrow(_chained, "conv_id long, n long, chars array<long>, labels binary, prefix binary"), "paths")


def heavy_prefixes(rows: DataFrame, heavy: int) -> DataFrame:
    """(prefix, parent, depth, n_convs, low, chars) of the prefixes that more than heavy paths share, stored."""
    first, last, below, found = 1, 1, rows, None
    while True:
        d = F.explode(F.sequence(F.lit(first).cast("long"), F.least(F.col("n"), F.lit(last).cast("long"))))
        levels = below.where(F.col("n") >= first).select("conv_id", "prefix", "chars", d.alias("depth"))
        levels = levels.select("conv_id", _at("prefix", F.col("depth")).alias("node"), _at("prefix", F.col("depth") - 1).alias("parent"), "depth", F.element_at("chars", F.col("depth").cast("int")).alias("chars"))
        counts = levels.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("conv_id").alias("low"), F.first("chars").alias("chars"))
        new = stored(counts.where(F.col("n_convs") > heavy).withColumnRenamed("node", "prefix"), "heavy")
        found = new if found is None else found.union(new)
        deepest = new.where(F.col("depth") == last).select(F.col("prefix").alias("node"))
        size = deepest.count()
        if not size:
            return stored(found, "heavy-prefixes")
        side = F.broadcast(deepest) if size <= BROADCAST_ROWS else deepest
        below = below.where(F.col("n") >= last).withColumn("node", _at("prefix", F.lit(last))).join(side, "node", "left_semi").drop("node")
        first, last = last + 1, 4 * last + 1


def placed(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows with upper: how many of a path's prefixes are heavy."""
    deepest = heavy.agg(F.max("depth").alias("d")).first().d
    if deepest is None:
        return rows.withColumn("upper", F.lit(0).cast("long"))
    side = heavy.select(F.col("prefix").alias("node"))
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    levels = rows.where("n > 0").select("conv_id", "prefix", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(deepest)))).alias("depth"))
    upper = levels.withColumn("node", _at("prefix", F.col("depth"))).join(side, "node", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("upper"))
    return rows.join(upper, "conv_id", "left").fillna(0, ["upper"])


def louds(children: np.ndarray) -> np.ndarray:
    """The bit vector of nodes in level order with these numbers of children: as many ones, then a zero, node by node."""
    bits = np.ones(int(children.sum()) + len(children), np.uint8)
    bits[np.cumsum(children + 1) - 1] = 0
    return bits


def structure(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent of each node but the first, number of children of each node, and the first node of each level (and the end)."""
    ones, zeros = np.flatnonzero(bits), np.flatnonzero(bits == 0)
    parent = ones - np.arange(len(ones))
    children = np.diff(zeros, prepend=-1) - 1
    reach = np.cumsum(children) + 1
    edges = [0, 1]
    while edges[-1] < len(children):
        edges.append(int(reach[edges[-1] - 1]))
    return parent, children, np.array(edges)


def rolled_up(values: np.ndarray, parent: np.ndarray, edges: np.ndarray, add=np.add) -> np.ndarray:
    """Adds each node's value to its parent's, the lowest level first; in place."""
    for a, b in zip(edges[-2:0:-1].tolist(), edges[:1:-1].tolist(), strict=True):
        add.at(values, parent[a - 1 : b - 1], values[a:b])
    return values


def _built(key: tuple, rows: pa.Table) -> pa.Table:
    """The trie of one shard, below a first node that stands for all that is above."""
    skip, n = (rows.column(c).to_numpy() for c in ("upper", "n"))
    conv, length = rows.column("conv_id").to_numpy(), n - skip
    off = np.cumsum(length) - length
    below = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) >= np.repeat(skip, n)
    lab = _lanes(np.frombuffer(b"".join(rows.column("labels").to_pylist()), np.uint8))[below]
    chars = pc.list_flatten(rows.column("chars")).to_numpy()[below]
    top = _lanes(np.frombuffer(b"".join(rows.column("top").to_pylist()), np.uint8))
    node, live, total = np.zeros(len(n), np.int64), np.arange(len(n)), 1
    parents, labels, sizes, tops = [], [], [], None
    for d in range(int(length.max())):
        live = live[length[live] > d]
        word = top[live] if d == 0 else lab[off[live] + d]
        order = np.lexsort((word[:, 1], word[:, 0], node[live]))
        live, word = live[order], word[order]
        above = node[live]
        new = np.concatenate(([True], (above[1:] != above[:-1]) | (word[1:] != word[:-1]).any(1)))
        first = live[new]
        parents.append(above[new])
        labels.append(lab[off[first] + d])
        sizes.append(chars[off[first] + d])
        tops = first if d == 0 else tops
        node[live] = total + np.cumsum(new) - 1
        total += len(first)
    bits = louds(np.bincount(np.concatenate(parents), minlength=total))
    order = np.lexsort((conv, node))
    above = rows.column("parent").take(pa.array(tops)).combine_chunks().to_pylist()
    values = [key[0].as_py(), total, np.packbits(bits).tobytes(), *(x.tobytes() for x in (np.concatenate(labels), np.concatenate(sizes), skip[tops], node[order], conv[order])), b"".join(above)]
    return pa.Table.from_arrays([pa.array([v]) for v in values], schema=_TRIE)


_TRIE = pa.schema([("shard", pa.int64()), ("nodes", pa.int64()), *((c, pa.binary()) for c in ("louds", "labels", "chars", "base", "end_node", "end_conv", "above"))])
_TRIE_SQL = "shard long, nodes long, louds binary, labels binary, chars binary, base binary, end_node binary, end_conv binary, above binary"


def tries(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row a shard of rows (see placed): the succinct trie of the paths below the upper levels.

    nodes counts the first one, which stands for all above; louds is the packed bit vector; labels, chars are arrays over the
    other nodes; base and above are the depth and the prefix above each child of the first node; end_node and end_conv
    say where each path ends, by node and then by id.
    """
    light = rows.where("n > upper").withColumn("top", _at("prefix", F.col("upper") + 1)).withColumn("parent", _at("prefix", F.col("upper")))
    count = max(SHARDS, -(-rows.count() // shard))
    light = light.select(F.pmod(F.xxhash64("top"), F.lit(count)).alias("shard"), "conv_id", "n", "upper", "labels", "chars", "top", "parent")
    return light.groupBy("shard").applyInArrow(_built, _TRIE_SQL)


def _hashed(node: np.ndarray, conv: np.ndarray, out: list) -> None:
    """Puts the digest of each node's ids (sorted) into out."""
    head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
    ids = conv.tolist()
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(ids)], strict=True):
        out[node[a]] = hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest()


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each trie; above is null except for the children of the first node."""
    for batch in batches:
        for row in batch.to_pylist():
            total = row["nodes"]
            parent, children, edges = structure(np.unpackbits(np.frombuffer(row["louds"], np.uint8), count=2 * total - 1))
            chars, base, end_node, end_conv = (np.frombuffer(row[c], np.int64) for c in ("chars", "base", "end_node", "end_conv"))
            members = rolled_up(np.bincount(end_node, minlength=total), parent, edges)
            low = np.full(total, np.iinfo(np.int64).max)
            np.minimum.at(low, end_node, end_conv)
            rolled_up(low, parent, edges, np.minimum)
            leaves = rolled_up((children == 0).astype(np.int64), parent, edges)
            saved = np.zeros(total, np.int64)
            saved[1:] = (members[1:] - 1) * chars
            rolled_up(saved, parent, edges)
            depth = np.zeros(total, np.int64)
            depth[1 : len(base) + 1] = base + 1
            for a, b in zip(edges[2:-1].tolist(), edges[3:].tolist(), strict=True):
                depth[a:b] = depth[parent[a - 1 : b - 1]] + 1
            ends = [NOTHING] * total
            _hashed(end_node, end_conv, ends)
            own = pa.array(low[parent], mask=np.arange(len(parent)) < len(base))
            above = [row["above"][WIDE * i : WIDE * (i + 1)] for i in range(len(base))] + [None] * (total - 1 - len(base))
            columns = [pa.array(low[1:]), pa.array(depth[1:]), own, *(pa.array(x[1:]) for x in (members, children, leaves, saved)), pa.array(ends[1:]), pa.array(above, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*(c.split()[0] for c in NODE.split(", ")), "above"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) sorted by both: one digest a node, in constant memory."""
    last, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends"])

    for batch in batches:
        names = batch.column("node").to_pylist()
        ids = batch.column("conv_id").to_pylist()
        a = 0
        while a < len(names):
            b = a + 1
            while b < len(names) and names[b] == names[a]:
                b += 1
            joined = ",".join(map(str, ids[a:b])).encode()
            if names[a] == last:
                digest.update(b"," + joined)
            else:
                if last is not None:
                    yield done()
                last, digest = names[a], hashlib.sha256(joined)
            a = b
    if last is not None:
        yield done()


def _upper(rows: pa.Table) -> pa.Table:
    """Rolls up the upper levels: rows (prefix, parent, depth, n_convs, low, chars, kids, leaves, saved, ends), UPPER a level at most."""
    rows = rows.combine_chunks()
    names, parents = rows.column("prefix").to_pylist(), rows.column("parent").to_pylist()
    depth, members, low, chars, kids, leaves, saved = (rows.column(c).to_numpy() for c in ("depth", "n_convs", "low", "chars", "kids", "leaves", "saved"))
    place: dict[bytes | None, int] = {}
    order: list[int] = []
    above: list[int] = []
    by_depth = np.argsort(depth, kind="stable")
    for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        ranked = sorted(level.tolist(), key=lambda i: (place.get(parents[i], -1), names[i]))
        above += [place[parents[i]] for i in ranked if depth[i] > 0]
        for i in ranked:
            place[names[i]] = len(order)
            order.append(i)
    members, low, kids, leaves, saved, chars = (x[order].astype(np.int64) for x in (members, low, kids, leaves, saved, chars))
    own = np.bincount(np.array(above, np.int64), minlength=len(order))
    parent, _, edges = structure(louds(own))
    children = own + kids
    leaves = rolled_up(leaves + (children == 0), parent, edges)
    saved = rolled_up(saved + (members - 1) * chars, parent, edges)
    up = pa.array([None, *low[parent].tolist()], pa.int64())
    ends = pa.array([x or NOTHING for x in rows.column("ends").take(pa.array(order)).to_pylist()])
    return pa.Table.from_arrays([pa.array(low), pa.array(depth[order].astype(np.int64)), up, pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved), ends], [c.split()[0] for c in NODE.split(", ")])


def prefix_nodes(sequences: DataFrame, heavy: int = HEAVY, shard: int = SHARD) -> DataFrame:
    """One row a node of the trie over sequences (conv_id, labels, chars), whose conv_id are distinct.

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id, null for the root; n_convs: members; n_children;
    n_leaves: nodes without children in the subtree; saved_tokens: over the subtree, (n_convs - 1) times the length of the last
    text; ends_sha256: digest of the ids of paths that end here, ascending and joined by commas.
    """
    rows = paths(sequences)
    every = rows.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).first()
    heavy = max(heavy, every.n // UPPER)
    top = heavy_prefixes(rows, heavy)
    where = stored(placed(rows, top), "placed-paths")
    nodes = stored(tries(where, shard).mapInArrow(_rolled, NODE + ", above binary"), "trie-nodes")

    spark = sequences.sparkSession
    if not every.n:
        return nodes.drop("above")
    root = sequences.sparkSession.createDataFrame([(ROOT, None, 0, every.n, every.low, 0)], top.schema)
    names = stored(top.union(root), "upper-names")
    tops = nodes.where("above is not null").groupBy("above").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ended = where.where("n = upper").select(_at("prefix", F.col("n")).alias("node"), "conv_id")
    ended = ended.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_streamed, "node binary, ends string")
    merged = names.join(tops.withColumnRenamed("above", "prefix"), "prefix", "left").join(ended.withColumnRenamed("node", "prefix"), "prefix", "left")
    above = merged.fillna(0, ["kids", "leaves", "saved"]).withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_upper, NODE)
    first = nodes.where("above is not null").drop("parent_conv_id").join(names.select(F.col("prefix").alias("above"), F.col("low").alias("parent_conv_id")), "above")
    rest = nodes.where("above is null").drop("above")
    return above.unionByName(first.drop("above")).unionByName(rest)
