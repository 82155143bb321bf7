"""Search, scoring, mixing, classification, tokenising and the pipeline: brute force, identities and edge cases."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import ann, mixing, pieces, ppm, quality, toxicity
from quern.llm import queries as q
from quern.llm import text as tx

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


# nearest neighbours


def test_cell_order_falls_and_is_complete():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = list(ann.cell_order(a, b))
    assert len(set(got)) == 35
    sums = [a[i] + b[j] for i, j in got]
    assert all(x >= y - 1e-12 for x, y in zip(sums, sums[1:], strict=False))


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6))
    x[40:60] = x[40]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(200, None, "c"), (220, [0.0] * 6, "c"), (240, [1.0, None, 0.0, 0.0, 0.0, 0.0], "c"), (260, [math.nan, 1.0, 1.0, 1.0, 1.0, 1.0], "c"), (280, [1.0, 2.0], "c"), (None, [1.0] * 6, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(4)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60, 80, 100}
    for i, found in got.items():
        scores = x @ x[i]
        want = sorted((-scores[j], j) for j in range(120) if j != i)[:20]
        assert [k for k, _, _ in sorted(found)] == list(range(1, 21))
        assert np.allclose([s for _, _, s in sorted(found)], [-s for s, _ in want], rtol=0, atol=1e-12)
    ties = [v for _, v, s in sorted(got[40]) if abs(s - x[40] @ x[40]) < 1e-9]
    assert ties == sorted(ties)


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(df).collect()] == [(0, 1, 1, 0.5)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_recall_on_the_test_vectors(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in e], float), np.array([r.vec_id for r in e])
    found = {}
    for r in q.op1_multi_index_ann(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        hits.append(len(found[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_recall_of_many_vectors_and_equal_scores_of_equal_vectors(spark):
    """20,000 vectors without structure, a thousand of them copies: 0.9 of the true neighbours, ties to the smaller id."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 16))
    x[5000:6000] = x[rng.integers(0, 40, 1000) * 20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(df, queries="id % 200 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = []
    for i, found in got.items():
        exact = np.zeros(len(x))
        for j in range(16):
            exact += x[i, j] * x[:, j]
        assert [s for _, s in found] == [exact[v] for v, _ in found]
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        exact[i] = -np.inf
        hits.append(len({v for v, _ in found} & set(np.lexsort((np.arange(len(x)), -exact))[:20].tolist())) / 20)
    assert len(got) == 100 and np.mean(hits) >= 0.9


# language model


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(3)
    syllables = ["th", "on", "an", "er", "in", "é", "Ba", "or"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += [None, "", " \n ", texts[0], texts[0], "unseen ZZZZ\x00 日本"]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, "the end", "x", 1.0), (3, texts[3], "x", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double").repartition(3), rows


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class PlainPpm:
    """The model by its definition, with dictionaries: escape, exclusion and update exclusion, one symbol at a time."""

    def __init__(self, texts):
        self.counts = [Counter() for _ in range(ppm.ORDER + 1)]
        for t in texts:
            s = bytes([10]) * ppm.ORDER + t + bytes([10])
            for i in range(ppm.ORDER, len(s)):
                self.counts[ppm.ORDER][s[i - ppm.ORDER : i + 1]] += 1
        for k in range(ppm.ORDER - 1, -1, -1):
            for g in self.counts[k + 1]:
                self.counts[k][g[1:]] += 1
        self.after = [{} for _ in self.counts]
        for k, c in enumerate(self.counts):
            for g, n in c.items():
                self.after[k].setdefault(g[:-1], {})[g[-1]] = n

    def log10(self, t):
        s, total = bytes([10]) * ppm.ORDER + t + bytes([10]), 0.0
        for i in range(ppm.ORDER, len(s)):
            out: set = set()
            for k in range(ppm.ORDER, -1, -1):
                here = {c: n for c, n in self.after[k].get(s[i - k : i], {}).items() if c not in out}
                if not here:
                    continue
                weight = sum(here.values())
                if s[i] in here:
                    total += math.log10((here[s[i]] - ppm.DISCOUNT) / weight)
                    break
                total += math.log10(ppm.DISCOUNT * len(here) / weight)
                out |= set(here)
            else:
                total -= math.log10(max(1, 256 - len(out)))
        return total


@pytest.mark.parametrize("few", [1 << 20, 8])
def test_scores_equal_the_plain_model(prose, monkeypatch, few):
    df, rows = prose
    monkeypatch.setattr(ppm, "MODEL_WORDS", few)
    train = [words(r[1]) for r in rows if not held(r[0])]
    plain = PlainPpm([b" ".join(w) for w in train])
    counts = Counter(x for w in train for x in [*w, None])
    n, distinct = sum(counts.values()), len(counts)
    got = sorted(ppm.ppm_scores(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(want)
    for r, (i, t, *_) in zip(got, want, strict=True):
        w = [*words(t), None]
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + distinct + 1)) for x in w))
        assert r.score == pytest.approx(plain.log10(b" ".join(w[:-1])), abs=1e-6)


def test_probabilities_sum_to_one(prose):
    _, rows = prose
    plain = PlainPpm([b" ".join(words(r[1])) for r in rows])
    for context in (b"", b"th", b"the on", b"zz"):
        s = bytes([10]) * ppm.ORDER + context
        total = 0.0
        for c in range(256):
            before = plain.log10(context)
            out: set = set()
            p = 1.0
            for k in range(ppm.ORDER, -1, -1):
                here = {x: n for x, n in plain.after[k].get(s[len(s) - k :], {}).items() if x not in out}
                if not here:
                    continue
                weight = sum(here.values())
                if c in here:
                    p *= (here[c] - ppm.DISCOUNT) / weight
                    break
                p *= ppm.DISCOUNT * len(here) / weight
                out |= set(here)
            else:
                p /= 256 - len(out)
            total += p
            assert before <= 0
        assert total == pytest.approx(1)


def test_pruned_model_still_scores(prose, monkeypatch):
    df, rows = prose
    monkeypatch.setattr(ppm, "MODEL_NODES", 60)
    got = ppm.ppm_scores(df).collect()
    assert len(got) == len(rows) and all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("nodes", [1 << 20, 60, 0])
def test_every_gram_counts_whatever_the_tasks_hold(prose, monkeypatch, nodes):
    df, rows = prose
    monkeypatch.setattr(ppm, "MODEL_NODES", nodes)
    plain = PlainPpm([b" ".join(words(r[1])) for r in rows if not held(r[0])])
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in ppm.ppm_scores(df).collect())
    want = sorted((i is None, i or 0, plain.log10(b" ".join(words(t)))) for i, t, *_ in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)


def test_no_documents_to_learn_from(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.ppm_scores(df).count() == 0


# mixing


def mixed_rows(spark, counts, **options):
    rows = [(f"{s}{k}", s, n) for s, ns in counts.items() for k, n in enumerate(ns)]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), "x", None if s == "null" else s, 1) for i, (_, s, n) in enumerate(rows)], DOCS)
    return mixing.mixed(df, **options).collect()


def test_mixing_reaches_the_entropy_within_the_budget(spark):
    counts = {"a": [10] * 300, "b": [10] * 30, "c": [5] * 20, "null": [7] * 10}
    got = mixed_rows(spark, counts, entropy=0.9, max_repeats=100.0)
    weight = {r.source: r.weight for r in got}
    assert sum(weight.values()) == pytest.approx(1)
    h = -sum(w * math.log(w) for w in weight.values()) / math.log(4)
    assert h == pytest.approx(0.9, abs=1e-6)
    total = sum(sum(n) for n in counts.values())
    for s, w in weight.items():
        used = sum(r.copies * r.n_tokens for r in got if r.source == s)
        assert w * total - 10 - 1 < used <= w * total
        assert max(r.copies for r in got if r.source == s) - min(r.copies for r in got if r.source == s) <= 1


def test_mixing_stops_at_the_repeats(spark):
    got = mixed_rows(spark, {"a": [10] * 300, "b": [10] * 10}, entropy=1.0, max_repeats=3.0)
    assert max(r.copies for r in got) == 3


def test_mixing_without_tokens_or_rows(spark):
    df = spark.createDataFrame([(1, None, "x", "s", 0), (2, " ", "x", None, 0)], DOCS)
    assert {(r.doc_id, r.copies) for r in mixing.mixed(df).collect()} == {(1, 1), (2, 1)}
    assert mixing.mixed(df.limit(0)).count() == 0


# classifiers


def labelled(spark, good, bad, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        y = i % 2
        rows.append((i, (good if y else bad)(rng), "en", "s", 10))
        labels.append((i, y))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "some words", "en", "s", 3)]
    labels += [(n, None), (None, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, label int")


def prose_of(rng, extra=()):
    w = ["".join(rng.choice(["th", "on", "re", "an", "li", "mo"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    for e in extra:
        w.insert(rng.randrange(len(w)), e)
    return " ".join(w)


def test_toxicity_learns_terms_it_meets_in_many_places(spark):
    bad = ["grumblesnark", "foulplonk", "wretchbag"]
    docs, labels = labelled(spark, lambda r: prose_of(r, [r.choice(bad) for _ in range(4)]), prose_of)
    got = toxicity.toxicity_scores(docs, labels, label_col="label").collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    fresh = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == r.doc_id % 2 for r in fresh]) > 0.9
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_held_out_toxicity_on_the_given_documents(spark, sf):
    """Needs thousands of labels; of the larger given tables."""
    larger = Path(sf).parent / "sf0.1"
    if not larger.exists():
        pytest.skip("no larger tables")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).where("held_out").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").select("score", "toxic").collect()
    score, toxic = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    auc = np.mean([(score[toxic == 0] < s).mean() + (score[toxic == 0] == s).mean() / 2 for s in score[toxic == 1]])
    print(f"AUC {auc:.3f} accuracy {((score >= 0.5) == toxic).mean():.3f} found {(score[toxic == 1] >= 0.5).mean():.3f} of {len(got)}")
    assert auc > 0.75 and ((score >= 0.5) == toxic).mean() > 0.9
    assert (score[toxic == 0] >= 0.5).mean() < 0.02


def test_toxicity_scores_keep_the_share_of_toxic_labels_when_sampled(spark, monkeypatch):
    rng = random.Random(12)
    docs = [(i, prose_of(rng, ["grumblesnark"] * 3 if i % 10 == 0 and i % 3 else []), "en", "s", 10) for i in range(1200)]
    df = spark.createDataFrame(docs, DOCS)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1200)], "doc_id long, label int")
    monkeypatch.setattr(toxicity, "SAMPLE", 80)
    kept = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5]
    share = sum(i % 10 == 0 for i in kept) / len(kept)
    got = [r.score for r in toxicity.toxicity_scores(df, labels, label_col="label").collect()]
    assert np.mean(got) == pytest.approx(share, abs=0.04)
    *_, prior = toxicity._fit(df.select("doc_id", "text"), labels, "label", 5)
    assert prior == pytest.approx(share, abs=0.005)


def test_classifiers_without_labels_give_the_share(spark):
    docs, labels = labelled(spark, prose_of, prose_of, 4)
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity_scores(docs, none, label_col="label").collect()} == {0.5}
    assert {r.score for r in quality.quality_scores(docs, none, label_col="label").collect()} == {0.5}
    assert toxicity.toxicity_scores(docs.limit(0), labels, label_col="label").count() == 0
    assert quality.quality_scores(docs.limit(0), labels, label_col="label").count() == 0


def test_quality_separates_and_each_view_alone_does(spark):
    docs, labels = labelled(spark, prose_of, lambda r: prose_of(r).upper().replace(" ", "!! "))
    got = [r for r in quality.quality_scores(docs, labels, label_col="label").collect() if r.doc_id is not None and r.doc_id < 400]
    for view in ("content_score", "metadata_score", "score"):
        assert np.mean([(r[view] >= 0.5) == (r.doc_id % 2 == 1) for r in got]) > 0.95


def test_quality_exchange_takes_the_surest_of_all_documents(spark, monkeypatch):
    """The rows that the views exchange are the surest of every unlabelled document, however they are dealt to tasks."""
    monkeypatch.setattr(quality, "KEPT", 7)
    monkeypatch.setattr(quality, "ROUNDS", 1)
    docs, labels = labelled(spark, prose_of, lambda r: prose_of(r).upper().replace(" ", "!! "), 200)
    labels = labels.where("doc_id < 60")
    taken = []
    old = quality._surest
    monkeypatch.setattr(quality, "_surest", lambda models, used: (taken.append(models), old(models, used))[1])
    for parts in (1, 5):
        quality.fit(docs.repartition(parts), labels, "label")
    one, two = taken
    for a, b in zip(one, two, strict=True):
        assert np.allclose(a.theta, b.theta)
    seen = []
    monkeypatch.setattr(quality, "CoTrained", lambda content, meta, label, exchange: seen.append(exchange(one, 0)))
    for parts in (1, 5):
        quality.fit(docs.repartition(parts), labels, "label")
    for a, b in zip(*seen, strict=True):
        assert np.array_equal(a, b)
    assert 0 < len(seen[0][0]) <= 4 * 7


def test_held_out_quality_on_the_test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    got = quality.scored(docs, labels.where(~held)).join(labels.where(held).select("doc_id", "quality"), "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in got if r.quality == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.85


@pytest.mark.parametrize("name", ["toxicity", "quality", "mixing", "pieces", "ppm", "exact", "near", "substring", "lines"])
def test_awkward_rows(spark, name):
    """Nulls in every column, repeated rows, a long text and columns whose names clash with results give a row each."""
    from quern.llm import exact_dedup, line_dedup, near_dedup, substring_dedup

    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "d" * 30]) for _ in range(60_000))
    rows = [(i, prose_of(rng), "en", "s", 9) for i in range(30)] * 2 + [(None, None, None, None, None), (None, "x", None, None, None), (5, None, None, None, None), (77, long, "en", "t", None), (78, "", "en", None, 0)]
    names = "score", "label", "rank", "ids", "key", "component", "n", "node", "weight", "copies", "item", "window"
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for k, c in enumerate(names):
        df = df.withColumn(c, F.lit(None) if k % 3 == 0 else F.lit(k))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(i, i % 2) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, label int")
    run = {
        "toxicity": lambda: toxicity.toxicity_scores(df, labels, label_col="label"), "quality": lambda: quality.quality_scores(df, labels, label_col="label"),
        "mixing": lambda: mixing.mixed(df), "pieces": lambda: pieces.decoded(pieces.encoded(df)), "ppm": lambda: ppm.ppm_scores(df),
        "exact": lambda: exact_dedup.exact_duplicates(df), "near": lambda: near_dedup.near_duplicates(df), "substring": lambda: substring_dedup.remove_repeats(df), "lines": lambda: line_dedup.clean_documents(df),
    }
    out = run[name]()
    assert len(set(out.columns)) == len(out.columns)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.select("doc_id").collect()) == sorted(r[0] if r[0] is not None else -1 for r in rows)


# sentencepiece

TEXTS = ["", " ", "  ", "a", "Hello  world", "a\nb", "  x ", "é😀\t", "\n\n", "x" * 400, "  " * 40 + "q", "ab" * 200 + "日本語" * 40, "ﬁ <0x0A> <s> </s>", "\x00a\x00", "नमस्ते दुनिया", "a▁b"]


def test_ids_equal_the_library_and_decode_back(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(9)
    texts = TEXTS + ["".join(rng.choice("abct he  \nionér!") for _ in range(rng.randint(1, 150))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)] + [(None, None, 1, "z")], "doc_id long, text string, n_pieces int, decoded string").repartition(3)
    for r in pieces.decoded(pieces.encoded(df)).collect():
        t = r.text or ""
        assert r.ids == sp.encode(t) and r.n_pieces == len(r.ids)
        assert r.decoded == sp.decode(r.ids) == t.replace("▁", " ")


def test_long_segments_and_colliding_hashes(monkeypatch):
    """Segments without spaces are cut without changing ids, and equal first hashes of different segments do no harm."""
    import pyarrow as pa
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the", "Q", "7", "ing", "日", "本語", "-", "zx"]) for _ in range(700)), "a" * 900, "plain words here", "".join(chr(rng.randint(33, 126)) for _ in range(3000))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    want = [sp.encode(t) for t in texts]
    for weak in (False, True):
        with monkeypatch.context() as m:
            m.setattr(pieces, "CHUNK", 256)
            if weak:
                old = tx.span_hashes2
                m.setattr(tx, "span_hashes2", lambda *a: [old(*a)[0] % np.uint64(3), old(*a)[1]])
            encoder = pieces.Encoder(pieces.Vocabulary.load())
            got = []
            for _, _, data, offsets in tx.slices(batch, "text"):
                ids, where = encoder.encode(data, offsets)
                got += [ids[a:b].tolist() for a, b in zip(where[:-1], where[1:], strict=True)]
            assert got == want


def test_encoding_an_empty_table(spark):
    assert pieces.encoded(spark.createDataFrame([], DOCS)).count() == 0


def test_encoder_forgets_and_stays_right(monkeypatch):
    import pyarrow as pa

    from quern.llm import text as tx

    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    monkeypatch.setattr(pieces, "CHUNK", 64)
    vocabulary = pieces.Vocabulary.load()
    few, many = pieces.Encoder(vocabulary), pieces.Encoder(vocabulary)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS * 3)], ["text"])
    one = [few.encode(d, o)[0].tolist() for _, _, d, o in tx.slices(batch, "text", 64)]
    monkeypatch.setattr(pieces, "REMEMBERED", 1 << 20)
    two = [many.encode(d, o)[0].tolist() for _, _, d, o in tx.slices(batch, "text", 64)]
    assert one == two


# pipeline


def test_pipeline_stages_in_order_and_whole(spark, sf):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["reject_poor", "cut_lines", "drop_near_copies", "mix_sources", "encode"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns, name
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.reject_poor(spark, docs, sf).select("doc_id").collect()}
    assert len(good & kept) >= 0.97 * len(good)
    assert corpus_pipeline.encode(spark, docs.limit(5), sf).columns == ["doc_id", "source", "n_pieces", "ids", "round_trip"]


def test_near_copies_stage_keeps_one_of_each_group(spark, sf):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(5, text, "en", "s", 1), (3, text + " eleven", "en", "s", 1), (9, "other words", None, None, None), (None, text, "en", "s", 1)], DOCS)
    got = corpus_pipeline.drop_near_copies(spark, df, sf)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 3), (False, 9), (True, 0)]


def test_pipeline_with_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.where(F.lit(True)).count() == 0
