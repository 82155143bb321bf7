"""Deduplication operators against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quern.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from quern.llm import queries as q
from quern.llm.scratch import stored

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, keep_id long, text_sha256 string, key string"


def words(text):
    return WORD.findall((text or "").encode())


def lower(word):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "日本", "A!"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    base = [rng.choice(vocabulary) for _ in range(60)]
    out = [None, "", "  \n\t ", "one", "one", "ONE", "a b c", "A b c", "x" * 5000, "tab\tand\x0bmore  spaces"]
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    out += [" ".join(rng.choice(vocabulary) for _ in range(20)) + " " + passage + " " + rng.choice(vocabulary) for _ in range(25)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    out += [out[20]] * 30 + [" ".join(rng.choice(vocabulary) for _ in range(20_000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    order = list(range(len(texts)))
    random.Random(6).shuffle(order)
    rows = [(i * 3, texts[k], 7, "x", "y") for i, k in enumerate(order)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), {r[0]: r[1] for r in rows}


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        for high in (1, 50, 1 << 40, (1 << 64) - 1):
            x = np.unique(rng.integers(0, high, n, dtype=np.uint64, endpoint=True))
            assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(x), len(x)) == x).all()


def brute_exact(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        keep = i if len(same) == 1 else keep
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_equals_brute_force(docs):
    df, rows = docs
    assert sorted((tuple(r) for r in exact_dedup.exact_duplicates(df).collect()), key=repr) == brute_exact(list(rows.items()))


def test_exact_with_null_ids_and_repeated_rows(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, None), (4, ""), (None, "z"), (None, "q"), (None, "q")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in exact_dedup.exact_duplicates(df).collect()), key=repr) == brute_exact(rows)


def brute_near(rows):
    sets = {}
    for i, t in rows.items():
        w = [lower(x) for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in rows}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(rows, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in rows)


def test_near_equals_brute_force(docs):
    df, rows = docs
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(df).collect()) == brute_near(rows)


def test_near_with_crowded_keys_equals_brute_force(docs, monkeypatch):
    """Keys cut into tiles give the same."""
    df, rows = docs
    monkeypatch.setattr(near_dedup, "TILE", 2)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(df).collect()) == brute_near(rows)


def test_near_with_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "A b c d e f"), (6, None), (7, "  ")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(None, 2, None, True), (2, 2, 2, True), (2, 2, 2, True), (5, 2, 2, False), (6, 0, 6, True), (7, 0, 7, True)], key=repr)


def test_near_pairs_of_a_template_stay_few(spark, monkeypatch):
    """Documents that share a template but are not similar enough make few candidates; the similar ones are still linked."""
    rng = random.Random(9)
    template = [f"t{i}" for i in range(160)]
    rows = {}
    for i in range(150):
        copy = list(template)
        for at in rng.sample(range(0, 160, 5), 2):
            copy[at : at + 5] = [f"d{i}x{at + k}" for k in range(5)]
        rows[2 * i] = " ".join(copy)
        if i % 10 == 0:
            rows[2 * i + 1] = " ".join([*copy[:-3], "end"])
    made = {}
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: made.setdefault(name, stored(df, name)))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(df).collect()) == brute_near(rows)
    assert made["search-pairs"].count() < 1000


def test_counts_and_first_keys_lose_no_link():
    """Sets that are similar enough always have room, and a pair's first key is one that both have."""
    rng = np.random.default_rng(7)
    for n in (1, 3, 40, 900, 9000):
        x = [rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(40)]
        y = [np.concatenate((s[: n - n // 7], rng.integers(0, 1 << 63, rng.integers(0, n // 7 + 1)).astype(np.uint64))) for s in x]
        nx, ny = (np.array([len(s) for s in z]) for z in (x, y))
        near = [100 * k >= 75 * (a + b - k) for a, b, k in zip(nx, ny, [len(np.intersect1d(a, b)) for a, b in zip(x, y, strict=True)], strict=True)]
        room = near_dedup._room(*(near_dedup.bucket_counts(np.concatenate(z), k) for z, k in ((x, nx), (y, ny))), nx, ny)
        assert room[near].all() and sum(near) > 10
    a = rng.integers(0, 1 << 16, (300, near_dedup.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for r in range(len(b)):
        b[r, rng.choice(near_dedup.POSITIONS, rng.integers(0, near_dedup.THRESHOLD + 1), replace=False)] ^= 1
    first, ka, kb = near_dedup.first_keys(a, b)[:, None], near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)
    assert ((ka == first) & (kb == first)).any(1).all()


def test_chunk_keys_meet_within_the_threshold():
    """Pigeonhole: whatever positions differ, signatures within the threshold share a key."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (200, near_dedup.POSITIONS)).astype(np.uint16)
    b = a.copy()
    for r in range(len(b)):
        at = rng.choice(near_dedup.POSITIONS, near_dedup.THRESHOLD, replace=False)
        b[r, at] ^= 1
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(1).all()


def brute_substring(rows):
    first, split = {}, {i: words(t) for i, t in rows.items()}
    for i, w in sorted(split.items()):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substring_equals_brute_force(docs, batches):
    df, rows = docs
    got = substring_dedup.remove_repeats(df, with_text=False, batches=batches)
    assert sorted(tuple(r) for r in got.collect()) == brute_substring(rows)


def test_substring_index_over_two_sessions(spark, docs, tmp_path):
    """A stored index opened again gives what one run over all documents gives."""
    df, rows = docs
    ids = sorted(rows)
    third, half = ids[len(ids) // 3], ids[len(ids) // 2]
    root, got, history = f"file://{tmp_path}/index", [], None
    for part in (df.where(f"doc_id < {third}"), df.where(f"doc_id >= {third} and doc_id < {half}"), df.where(f"doc_id >= {half}")):
        out = substring_dedup.remove_repeats(part, with_text=False, batches=2, index=root, history=history)
        got += [tuple(r) for r in out.collect()]
        history = part if history is None else history.union(part)
    assert sorted(got) == brute_substring(rows)
    assert len(spark.read.parquet(f"{root}/manifest").select("version").distinct().collect()) == 3
    with pytest.raises(ValueError, match="history"):
        substring_dedup.remove_repeats(part, index=root)


def test_a_session_that_fails_leaves_the_index_as_it_was(spark, docs, tmp_path, monkeypatch):
    df, rows = docs
    half = sorted(rows)[len(rows) // 2]
    root, first, second = f"file://{tmp_path}/index", df.where(f"doc_id < {half}"), df.where(f"doc_id >= {half}")
    got = [tuple(r) for r in substring_dedup.remove_repeats(first, with_text=False, batches=2, index=root).collect()]

    def broken(self):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(substring_dedup.FingerprintIndex, "close", broken)
        with pytest.raises(OSError, match="lost"):
            substring_dedup.remove_repeats(second, with_text=False, batches=2, index=root, history=first)
    before = substring_dedup.FingerprintIndex(spark, root)
    assert before.version == 1 and before.matches().where(f"doc_id >= {half}").isEmpty()
    got += [tuple(r) for r in substring_dedup.remove_repeats(second, with_text=False, batches=2, index=root, history=first).collect()]
    assert sorted(got) == brute_substring(rows)


def test_substring_rows_without_or_with_equal_ids(spark):
    line = " ".join(f"t{i}" for i in range(20))
    df = spark.createDataFrame([(None, line), (4, line), (4, line), (9, line + " end"), (1, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {(None, 20): (0, line), (4, 20): (0, line), (9, 21): (20, "end"), (1, 0): (0, "")}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows):
    lines = [(i, k, line_dedup.normal(x.encode()).decode()) for i, t in sorted(rows.items()) for k, x in enumerate((t or "").split("\n")) if t is not None]
    lines = [x for x in lines if len(x[2].encode()) >= line_dedup.LEAST]
    label = list(range(len(lines)))
    for b in range(len(lines)):
        for a in range(b):
            x, y = lines[a][2], lines[b][2]
            near = x == y or abs(len(x) - len(y)) <= 20 and edit(x, y) <= (1 - line_dedup.SIMILAR) * max(len(x), len(y)) + 1e-9
            if near and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = [lo if v == hi else v for v in label]
    gone = {}
    for n, (i, k, _) in enumerate(lines):
        if label[n] != n:
            gone.setdefault(i, set()).add(k)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows.items()}


def test_fuzzy_lines_equal_brute_force(spark):
    rng = random.Random(8)
    stems = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(30)) for _ in range(6)]
    texts = {}
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 1, 2])):
                s[rng.randrange(len(s))] = rng.choice("abcdefgh ")
            lines.append("".join(s) + rng.choice(["", " 12", "!", " 999"]))
        texts[i * 2] = "\n".join([*lines, "", "short"])
    texts |= {101: None, 102: "", 103: "\n\n"}
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in texts.items()], "doc_id long, text string, n_removed int, rank string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.clean_documents(df).collect()}
    assert got == brute_lines(texts)


@pytest.mark.parametrize("edits", [1, 2])
def test_recall_of_edited_lines(spark, duck, edits):
    """Lines of the test documents with letters changed or words replaced, at edit similarity of at least 0.9, are found."""
    rng = random.Random(edits)
    lines = sorted({x for (t,) in duck.sql("SELECT text FROM documents WHERE text IS NOT NULL").fetchall() for x in t.split("\n") if len(x) > 24})
    lines = rng.sample(lines, 400)
    rows, bands = [], {}
    for n, x in enumerate(lines):
        y = list(x)
        for i in rng.sample([i for i, c in enumerate(x) if c.isalpha()], edits):
            y[i] = rng.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != x[i].lower()])
        y = "".join(y)
        if n % 3 == 0 and len(x) > 100 * edits:
            w = x.split(" ")
            for i in rng.sample(range(len(w)), edits):
                w[i] = "".join(rng.choice("abcdefgh") for _ in w[i]) + rng.choice(["", "x"])
            y = " ".join(w)
        rows += [(2 * n, x), (2 * n + 1, y)]
        bands[2 * n + 1] = min(3, len(x) // 60)
    got = line_dedup.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = {r.doc_id for r in got.where("n_removed > 0").collect()}
    for band in range(4):
        own = [i for i in bands if bands[i] == band]
        assert sum(i in gone for i in own) >= 0.95 * len(own), band


def test_bounds_of_the_edit_distance_hold():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    for _ in range(60):
        x = [rng.choice(vocabulary) for _ in range(rng.randint(20, 40))]
        y = [rng.choice([w, w, w, w, w + "q", w[::-1], "", rng.choice(vocabulary)]) if rng.random() < 0.4 else w for w in x]
        if rng.random() < 0.3:
            cut = rng.randrange(len(y))
            y = y[cut:] + y[:cut] + y[: rng.randrange(9)]
        x, y = " ".join(x), " ".join(y)
        lower, upper = line_dedup._bounds(*(np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (x, y)), 5)
        assert lower <= edit(x, y) <= upper


def test_crowded_keys_lose_no_pair():
    """Tiles of a key that many lines share give the pairs that comparing all gives."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for parts in (1, 3):
        sim = rng.integers(0, 1 << 62, 40)[rng.integers(0, 40, 120)] ^ (1 << rng.integers(0, 60, 120))
        line, comp, size, part = np.arange(120), rng.integers(0, 60, 120), rng.integers(90, 110, 120), np.arange(120) % parts
        rows = sorted((min(part[i], o) * 10 + max(part[i], o), i, part[i], part[i] == o) for i in range(120) for o in range(parts))
        column = lambda x, kind=pa.int64(): pa.array([v.item() if hasattr(v, "item") else v for v in x], kind)
        i = [r[1] for r in rows]
        table = pa.RecordBatch.from_arrays([column([r[0] for r in rows]), column(i), column(comp[i]), column(sim[i]), column(size[i]), column([r[2] for r in rows]), column([r[3] for r in rows], pa.bool_())], ["tile", "line", "component", "sim", "size", "part", "low"])
        batches = [table.slice(a, 37) for a in range(0, table.num_rows, 37)]
        got, near = ({tuple(r.values()) for b in line_dedup._meet_open(nearest)(iter(batches)) for r in b.to_pylist()} for nearest in (False, True))
        want = {(a, b) for a in range(120) for b in range(a + 1, 120) if comp[a] != comp[b] and bin(int(sim[a] ^ sim[b])).count("1") <= line_dedup.allowed(max(size[a], size[b])) and 5 * min(size[a], size[b]) >= 4 * max(size[a], size[b])}
        assert got == want and near <= want
        assert {tuple(sorted((comp[a], comp[b]))) for a, b in near} == {tuple(sorted((comp[a], comp[b]))) for a, b in want}


def test_letter_counts_reject_only_pairs_that_are_too_far_apart():
    """A tile gives out no pair whose letters differ too much, and every pair that is similar enough."""
    import pyarrow as pa

    rng = random.Random(13)
    letters = "abcdefgh éü日本"
    lines = ["".join(rng.choice(letters) for _ in range(rng.choice([14, 60, 400, 4000]))).strip() + "a" * 12 for _ in range(12)]
    lines += [x for t in lines for x in ("".join(rng.choice(letters) if rng.random() < 0.1 else c for c in t), t + "日" * (len(t) // 9), t[len(t) // 12 :])]
    lines += ["z" * len(lines[0])]
    forms = [x.encode() for x in lines]
    chars, counts = line_dedup.letter_counts(np.frombuffer(b"".join(forms), np.uint8), np.cumsum([0, *map(len, forms)]))
    assert chars.tolist() == [len(x) for x in lines]
    n = len(lines)
    columns = {"tile": [1] * n, "line": range(n), "component": range(n), "sim": [0] * n, "size": map(len, forms), "part": [0] * n, "low": [True] * n, "chars": chars.tolist(), "counts": [c.tobytes() for c in counts]}
    batch = pa.RecordBatch.from_pydict({k: list(v) for k, v in columns.items()})
    got = {tuple(r.values()) for b in line_dedup._meet_open(False)(iter([batch])) for r in b.to_pylist()}
    small = [i for i in range(n) if len(lines[i]) < 500]
    near = {(a, b) for a in small for b in small if a < b and edit(lines[a], lines[b]) <= (1 - line_dedup.SIMILAR) * max(len(lines[a]), len(lines[b])) + 1e-9}
    assert near and near <= got and not any(n - 1 in pair for pair in got)


def test_lines_of_rows_without_id_stay(spark):
    df = spark.createDataFrame([(None, "a line of enough length"), (1, "a line of enough length"), (2, "A line of  enough length"), (1, "a line of enough length")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in line_dedup.clean_documents(df).collect())
    assert got == [(False, 1, "a line of enough length"), (False, 1, "a line of enough length"), (False, 2, ""), (True, 0, "a line of enough length")]


@pytest.mark.parametrize("operator", [exact_dedup.exact_duplicates, near_dedup.near_duplicates, substring_dedup.remove_repeats, line_dedup.clean_documents])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    from compare import assert_same

    assert_same(q.QUERIES[name](spark, sf), duck.sql(q.SQL[name]))


def test_keys_meet_across_batches():
    import pyarrow as pa

    rng = random.Random(4)
    for _ in range(200):
        rows = sorted((rng.randint(0, 12), rng.randint(0, 99), rng.choice([1, 1, 1, 2])) for _ in range(rng.randint(0, 25)))
        batches, at = [], 0
        while at < len(rows):
            to = at + rng.randint(1, 4)
            batches.append(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[at:to], strict=True)], ["key", "node", "here"]))
            at = to
        got = sorted(tuple(r.values()) for b in near_dedup.meet_keys(iter(batches)) for r in b.to_pylist())
        groups = {}
        for k, n, h in rows:
            groups.setdefault(k, []).append((n, h))
        lines = sorted(tuple(r.values()) for b in line_dedup._meet_keys(iter(batches)) for r in b.to_pylist())
        assert lines == sorted((k, n, g[0][0]) for k, g in groups.items() for n in {n for n, _ in g} if len({n for n, _ in g}) > 1 or max(h for _, h in g) > 1)
        want = sorted((k, n, g[0][0]) for k, g in groups.items() for n, h in g if len(g) > 1 or h > 1)
        assert got == want


def test_kernels_need_little_memory_whatever_the_batch():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = ["\n".join(" ".join(rng.choices(vocabulary, k=40)) for _ in range(8)) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(texts), pa.array(range(2500))], ["doc_id", "text", "rank"])
    for kernel, most in ((line_dedup._hashed, 35), (near_dedup._features, 18)):
        tracemalloc.start()
        assert sum(b.num_rows for b in kernel(iter([batch]))) in (2500, 20_000)
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert peak < most


def test_normal_forms_of_slices_equal_those_of_lines():
    import pyarrow as pa

    rng = random.Random(7)
    texts = ["".join(rng.choice("aB é09 \t\n\n.!-\x00") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None, ""])], ["text"])
    got = {}
    for at, _, form, upto, row, number in line_dedup._lines(batch):
        raw = form.tobytes()
        got |= {(at + r, k): raw[a:b] for r, k, a, b in zip(row.tolist(), number.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True)}
    forms = {(r, k): line_dedup.normal(x.encode()) for r, t in enumerate(texts) for k, x in enumerate(t.split("\n"))}
    assert got == {at: f for at, f in forms.items() if len(f) >= line_dedup.LEAST}


def test_distances_within_a_limit_equal_brute_force():
    """Pairs of every kind of text in one batch are decided as the plain edit distance decides them."""
    import pyarrow as pa

    rng = random.Random(15)
    xs, ys, most = ["", "", "abc", "abc", "𝔘é日" * 9], ["", "ab", "", "abd", "𝔘é日" * 8 + "𝔘é𝔙"], [0, 1, 3, 0, 1]
    for n in range(300):
        x = "".join(rng.choice(rng.choice(["ab", "abcdefgh ", "é日 𝔘x"])) for _ in range(rng.choice([5, 20, 60, 150])))
        y = [rng.choice(["", c + rng.choice("abq"), rng.choice("abx𝔘")]) if rng.random() < rng.choice([0.02, 0.1, 0.3]) else c for c in x]
        y = "".join(y) if n % 3 else "".join(y[len(y) // 9 :]) + x[: rng.randrange(4)]
        xs, ys, most = [*xs, x], [*ys, y], [*most, rng.choice([0, 1, len(x) // 10, len(x) // 3])]
    far = [edit(x, y) for x, y in zip(xs, ys, strict=True)]
    assert line_dedup.within(xs, ys, np.array(most)).tolist() == [d <= m for d, m in zip(far, most, strict=True)]
    n = len(xs)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(xs), pa.array(ys), pa.array(most)], ["a", "b", "x", "y", "most"])
    got = [r["a"] for b in line_dedup._similar(iter([batch])) for r in b.to_pylist()]
    assert got == [i for i in range(n) if far[i] <= most[i]]


def test_packed_keys_meet_as_rows_do():
    """Keys packed by ranges give the lines that all rows, sorted, give, and the lines left in their batches make up the rest."""
    import pyarrow as pa

    rng = np.random.default_rng(16)
    batches = []
    for n in (40, 1, 25):
        texts = [b" ".join(rng.choice([b"alpha", b"beta", b"gamma", b"delta"], 4)) for _ in range(n)]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        blocks, whole = line_dedup.block_hashes(data, offsets)
        line = np.ascontiguousarray(line_dedup.line_ids(data, offsets)[:, 0])
        batches.append(pa.RecordBatch.from_arrays([pa.array(line), pa.array(np.diff(offsets)), line_dedup.packed_blocks(blocks, n)], ["line", "size", "blocks"]))
    groups = {}
    for batch in batches:
        row, keys = line_dedup.unpacked_keys(batch.column("blocks"), batch.column("size").to_numpy())
        for k, r in zip(keys.view(np.int64).tolist(), row.tolist(), strict=True):
            groups.setdefault(k, set()).add(batch.column("line")[r].as_py())
    want = {(k, n) for k, nodes in groups.items() if len(nodes) > 1 for n in nodes}
    packed = sorted((r["bucket"], r["packed"]) for b in line_dedup._leads(5)(iter(batches)) for r in b.to_pylist())
    assert len({b for b, _ in packed}) == 5
    packed = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in packed[i : i + 2]]) for k in (0, 1)], ["bucket", "packed"]) for i in range(0, len(packed), 2)]
    met = [tuple(r.values()) for b in line_dedup._meet_packed(iter(packed)) for r in b.to_pylist()]
    pivots = {(k, lead) for k, lead, _ in met}
    rest = [tuple(r.values()) for b in line_dedup._rest(iter(batches)) for r in b.to_pylist()]
    got = {(k, n) for k, n, _ in met} | {(k, n) for k, n, lead in rest if (k, lead) in pivots}
    assert want and got == want and all(pivot == min(groups[k]) for k, _, pivot in met)


def test_crowded_tiles_need_little_memory():
    """The pairs of a crowded tile are looked at in steps of a fixed number, so a worker needs the same however many there are."""
    import tracemalloc

    import pyarrow as pa

    rng, n = np.random.default_rng(17), 3000
    columns = {"tile": np.ones(n, np.int64), "line": np.arange(n), "component": np.arange(n) // 2, "sim": rng.integers(0, 1 << 62, n), "size": np.full(n, 400), "part": np.arange(n) % 2, "low": np.zeros(n, bool), "chars": np.full(n, 400)}
    batch = pa.RecordBatch.from_pydict(columns | {"counts": [x.tobytes() for x in rng.integers(0, 12, (n, line_dedup.BINS)).astype(np.uint8)]})
    for nearest in (True, False):
        tracemalloc.start()
        assert sum(b.num_rows for b in line_dedup._meet_open(nearest)(iter([batch]))) < n
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert peak < 16


def test_far_lines_of_a_crowded_tile_are_told_apart_by_their_simhashes_alone(monkeypatch):
    import pyarrow as pa

    n, rng, asked = 600, np.random.default_rng(5), []
    sim = rng.integers(0, 1 << 63, n)
    sim[300:310] = sim[:10] ^ 1
    rows = {"tile": np.arange(n) // 590, "line": np.arange(n), "component": np.arange(n), "sim": sim, "size": np.full(n, 100), "part": np.zeros(n, np.int64), "low": np.ones(n, bool)}
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows.values()], list(rows))
    allowed = line_dedup.allowed
    monkeypatch.setattr(line_dedup, "allowed", lambda size: asked.append(len(size)) or allowed(size))
    got = {tuple(r.values()) for b in line_dedup._meet_open(False)(iter([batch])) for r in b.to_pylist()}
    far = np.bitwise_count(sim.view(np.uint64)[:, None] ^ sim.view(np.uint64)[None])
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if rows["tile"][i] == rows["tile"][j] and far[i, j] <= 18} and len(got) >= 10
    assert sum(asked) < n * line_dedup.DENSE
