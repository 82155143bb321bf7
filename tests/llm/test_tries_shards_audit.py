"""Prefix tries, sharding and the divergence audit against plain Python, and their laws."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import divergence, prefix_tries, queries, sharding

TURNS = "conv_id long, turn long, role string, text string"


# prefix tries


def plain_nodes(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            label = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            turns[c].append((t is not None, t or 0, label, len(x)))
    own = {c: [(e[2], e[3]) for e in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def sums(p):
        below = [sums(k) for k in kids[p]]
        return (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * (p[-1][1] if p else 0))

    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), *sums(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found_nodes(df):
    return sorted((tuple(r[c.split()[0]] for c in prefix_tries.NODE.split(", ")) for r in df.collect()), key=repr)


def conversations(n=400, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(n), -5, -100, -201, 10**12, 10**12 + 7]:
        # a third are copies of one long conversation, others share beginnings
        texts = [f"common {i}" for i in range(9)] if c % 3 == 0 else [f"t{rng.integers(3)}" * int(rng.integers(1, 4)) for _ in range(rng.integers(1, 7))]
        rows += [(c, i, "user" if i % 2 == 0 else "assistant", x) for i, x in enumerate(texts)]
    return rows


@pytest.mark.parametrize(("heavy", "shard"), [(5_000, 20_000), (3, 7), (1, 50), (40, 10**6)])
def test_nodes_equal_plain_python_whatever_the_upper_levels(spark, heavy, shard):
    rows = conversations()
    found = prefix_tries.prefix_nodes(prefix_tries.rebuilt(spark.createDataFrame(rows, TURNS).repartition(7)), heavy, shard)
    assert found_nodes(found) == plain_nodes(rows)


def test_awkward_conversations(spark):
    rows = [(1, None, None, None), (1, None, "", ""), (1, 0, "user", "x" * 50_000), (2, 3, "a", "b"), (2, 3, "a", "b"), (2, 3, "ab", ""), (2, 3, "a", "é🙂"), (None, 1, "user", "lost"), (7, 1, None, "only")]
    rows += [(100, i, "user", f"head {i}") for i in range(3)] + [(103, i, "user", f"tail {i}") for i in range(8)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("label", "labels", "chars", "node", "prefix", "upper", "head", "depth")})
    assert found_nodes(prefix_tries.prefix_nodes(prefix_tries.rebuilt(df), 1, 2)) == plain_nodes(rows)


def test_no_conversations_and_turnless_ones(spark):
    assert prefix_tries.prefix_nodes(prefix_tries.rebuilt(spark.createDataFrame([], TURNS))).collect() == []
    bare = spark.createDataFrame([(5, [], []), (3, [], [])], "conv_id long, labels array<binary>, chars array<long>")
    assert found_nodes(prefix_tries.prefix_nodes(bare)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_structure_reads_what_louds_wrote():
    children = np.array([2, 0, 3, 1, 0, 0, 0])
    parent, again, edges = prefix_tries.structure(prefix_tries.louds(children))
    assert parent.tolist() == [0, 0, 2, 2, 2, 3] and again.tolist() == children.tolist() and edges.tolist() == [0, 1, 3, 6, 7]
    assert prefix_tries.rolled_up(np.ones(7, int), parent, edges).tolist() == [7, 1, 5, 2, 1, 1, 1]


def test_upper_digest_streams_over_batches():
    import pyarrow as pa

    names, ids = [b"a"] * 5 + [b"b"] * 2, [1, 2, 3, 10, 11, 4, 5]
    whole = pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids)], ["node", "conv_id"])
    for step in (1, 2, 3, 7):
        out = [b.to_pylist()[0] for b in prefix_tries._streamed(whole.slice(a, step) for a in range(0, 7, step))]
        assert out == [{"node": b"a", "ends": hashlib.sha256(b"1,2,3,10,11").hexdigest()}, {"node": b"b", "ends": hashlib.sha256(b"4,5").hexdigest()}]


# sharding

DOCS = "doc_id long, text string, lang string, source string"


def test_shards_hold_every_row_once_and_are_even(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries.op12_external_shuffle(spark, sf).collect()
    source = {r.doc_id: r.text or "" for r in docs.collect()}
    assert Counter(r.doc_id for r in out) == Counter(source.keys())
    assert all(r.size == len(source[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(source[r.doc_id].encode()) for r in out)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(v) for v in slots.values()]
    assert max(counts) - min(counts) <= 1
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_shuffle_is_repeatable_and_follows_the_seed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, again, other = ([(r.doc_id, r.shard, r.slot) for r in sharding.sharded(docs, seed=s).select("doc_id", "shard", "slot").orderBy("doc_id").collect()] for s in (1, 1, 2))
    assert first == again and first != other


def test_order_is_uniform(spark, tmp_path):
    """The place of a record doesn't depend on where it came from, within a bucket and over buckets."""
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(3).write.parquet(str(tmp_path / "t"))
    rows = sharding.sharded(spark.read.parquet(str(tmp_path / "t")), shards=10, least=4).select("doc_id", (F.col("shard") * 2000 + F.col("slot")).alias("place")).collect()
    table = np.zeros((10, 10))
    for r in rows:
        table[r.doc_id // 2000, r.place // 2000] += 1
    # chi-square with 81 degrees of freedom
    assert ((table - 200) ** 2 / 200).sum() < 140
    place = np.array([r.place for r in sorted(rows)])
    assert abs(np.corrcoef(place[:-1], place[1:])[0, 1]) < 0.03 and sorted(place) == list(range(20_000))


def test_hot_ids_and_texts_spread_over_the_buckets(spark):
    rows = [(1, "same", None, None)] * 3000
    counts = [r["count"] for r in sharding.scattered(spark.createDataFrame(rows, DOCS), 10).groupBy("bucket").count().collect()]
    assert len(counts) == 10 and max(counts) < 400


def test_awkward_rows_and_small_tables(spark, tmp_path):
    rows = [(None, None, None, None), (1, "", "en", "a"), (1, None, "en", "a"), (2, "x" * 300_000 + "é", None, "a"), (2, "y", None, "a")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("Shard", "slot", "bucket", "place", "record", "pos", "before")})
    out = sharding.sharded(df, shards=3)
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "bucket", "place", "record", "pos", "before", "shard", "slot"]
    assert sorted((r.shard, r.slot) for r in out.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
    assert sorted(r["size"] for r in sharding.digest(out).collect()) == [1, 1, 1, 2, 300_003]
    assert sharding.sharded(spark.createDataFrame([], DOCS)).collect() == []
    # more shards than rows
    assert sorted((r.shard, r.slot) for r in sharding.sharded(df, shards=8).collect()) == [(k, 0) for k in range(5)]
    sharding.write_shards(spark.createDataFrame(rows, DOCS), str(tmp_path / "out"), shards=2)
    assert sorted((r.text or "")[:1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "", "", "x", "y"]


def test_sharding_runs_no_python(spark, sf):
    plan = sharding.digest(sharding.sharded(spark.read.parquet(f"{sf}/documents.parquet")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_offsets_over_several_runs_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    rows = spark.range(100).select((F.col("id") % 10).cast("int").alias("bucket"))
    assert sorted((r.bucket, r.before) for r in sharding.offsets(rows).collect()) == [(b, 10 * b) for b in range(10)]


# divergence


def plain_audit(rows, least, top):
    letters = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        terms = [t.translate(lower) for t in letters.findall(text or "")]
        groups[lang or ""].add(source or "")
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in seen[lang].items() if n >= least}

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((whole[t] - own[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and own[s][t] > whole[t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def documents(n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.integers(4)}"
        words = [f"{chr(97 + int(x))}Été"[: int(rng.integers(1, 5))] for x in rng.zipf(1.5, 30) % 26]
        rows.append((i, " 12-".join(words), ["en", "fr", None, ""][int(rng.integers(4))], source))
    rows += [(None, None, "xx", None), (None, "Äß ÄSS", "xx", "a"), (5, "123 ...", "yy", "b"), (5, " x y", "yy", "c")]
    return rows + [(1, "Repeated row", "en", "hot")] * 40


@pytest.mark.parametrize("least", [1, 12, 30, 255])
def test_audit_equals_plain_python(spark, least):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "p", "item", "value", "rank")})
    assert sorted(tuple(r) for r in divergence.audit(df, least, 5).collect()) == plain_audit(rows, least, 5)


def test_a_full_sketch_discards_nothing_and_changes_nothing(spark, monkeypatch):
    rows = documents()
    monkeypatch.setattr(divergence, "sketch", lambda _, width: np.full(divergence.DEPTH * width, divergence.FULL, np.uint8))
    assert sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, DOCS), 12, 5).collect()) == plain_audit(rows, 12, 5)


def test_sketch_never_underestimates_and_discards_most_rare_terms(spark):
    rare = [(i, f"common {''.join(chr(97 + int(c)) for c in str(i * 7919))}", "en", "s") for i in range(3000)]
    df = spark.createDataFrame(rare, DOCS).repartition(6)
    flat = divergence.sketch(df.select("lang", "text"), divergence.NARROWEST)
    from quern.llm import text as tx

    def estimates(words):
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        end = np.cumsum([len(w) for w in words])
        keys = tx.mix(tx.span_hashes(raw, end - [len(w) for w in words], end) ^ np.uint64(divergence._lang_key("en")))
        return flat[divergence.cells(keys, divergence.NARROWEST)].min(0)

    assert estimates(["common"]).tolist() == [divergence.FULL]
    found = estimates([r[1].split()[1] for r in rare])
    assert found.min() >= 1 and (found >= 30).mean() < 0.01


def test_shares_of_huge_counts_are_exact(spark):
    row = spark.range(1).select(divergence.share("9000000000123", "9000000000456", "77").alias("p"), divergence.share("0", "0", "0").alias("none")).first()
    assert row.p == 1 + 10**9 * (9000000000123 + 5) // (9000000000456 + 5 * 77) and row.none is None


def test_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
