"""Raw folders, prepared graphs, sinks and snapshot checks on the loader fixture: six nodes, three edges."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import raw, views


@pytest.fixture
def folder(tmp_path):
    np.save(tmp_path / "feats.npy", np.arange(18.0).reshape(6, 3))
    indptr, indices = np.array([0, 1, 1, 2, 2, 3, 3]), np.array([1, 3, 5])
    np.savez(tmp_path / "adj_full.npz", indptr=indptr, indices=indices, data=np.ones(3))
    (tmp_path / "role.json").write_text(json.dumps({"tr": [0, 1], "va": [2, 3], "te": [4, 5]}))
    (tmp_path / "class_map.json").write_text(json.dumps({str(i): i % 2 + 4 for i in range(6)}))
    (tmp_path / "lists.json").write_text(json.dumps({"0": [1, 0], "1": [0, 1]}))
    return f"file://{tmp_path}"


def test_raw_folder(spark, folder):
    nodes, edges = raw.read_features(spark, f"{folder}/feats.npy"), raw.read_adjacency(spark, f"{folder}/adj_full.npz")
    roles, labels = raw.read_roles(spark, f"{folder}/role.json"), raw.read_class_map(spark, f"{folder}/class_map.json")
    assert {r.id: r.x for r in nodes.collect()} == {i: [3.0 * i, 3.0 * i + 1, 3.0 * i + 2] for i in range(6)}
    assert views.undirected(edges).count() == 6
    got = {r.id: r for r in raw.prepared(nodes, edges, roles, labels).collect()}
    assert [got[i].split for i in range(6)] == ["train"] * 2 + ["val"] * 2 + ["test"] * 2
    assert [got[i].y for i in range(6)] == [0, 1] * 3
    x = np.array([got[i].x for i in range(6)])
    assert np.allclose(x, (np.arange(18).reshape(6, 3) - [1.5, 2.5, 3.5]) / 1.5)
    # a loop on every node and one partner: both hops average the pair
    h = np.array([got[i].h for i in range(6)])
    assert np.allclose(h, np.repeat(x.reshape(3, 2, 3).mean(1), 2, axis=0))
    lists = {r.id: r.labels for r in raw.read_class_map(spark, f"{folder}/lists.json").collect()}
    assert lists == {0: [1.0, 0.0], 1: [0.0, 1.0]}


def test_splits_propagate_alone(spark, folder):
    nodes = raw.read_features(spark, f"{folder}/feats.npy").withColumn("split", F.when(F.col("id") < 3, "train").otherwise("val"))
    edges = raw.read_adjacency(spark, f"{folder}/adj_full.npz")
    got = {r.id: r.h for r in raw.prepared_by_split(nodes, edges).collect()}
    assert got[2] == pytest.approx([6.0, 7.0, 8.0])  # its only edge leaves the split
    assert got[0] == pytest.approx(got[1]) and got[0] == pytest.approx([1.5, 2.5, 3.5])


def test_sinks_give_back_what_they_took(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1e-9)], "k int, s string, v double")
    for kind in ("parquet", "json", "csv"):
        for rows in (df.limit(1), df):  # the second replaces the first
            raw.write_table(rows, str(tmp_path / kind), kind)
        assert sorted(tuple(r) for r in raw.read_table(spark, str(tmp_path / kind), "k int, s string, v double", kind).collect()) == sorted(tuple(r) for r in df.collect())


def test_matrices_are_read_by_ranges(spark, tmp_path):
    x = np.arange(33.0, dtype=np.float32).reshape(11, 3)
    np.save(tmp_path / "x.npy", x)
    np.save(tmp_path / "columns.npy", np.asfortranarray(x))
    got = raw.read_features(spark, f"file://{tmp_path}/x.npy", 24)
    assert got.rdd.getNumPartitions() == 6 and raw.read_features(spark, f"file://{tmp_path}/x.npy", 1).rdd.getNumPartitions() == 11
    want = {i: r.tolist() for i, r in enumerate(x)}
    assert {r.id: r.x for r in got.collect()} == want == {r.id: r.x for r in raw.read_features(spark, f"file://{tmp_path}/columns.npy", 24).collect()}
    # rows of very different lengths, empty ones at both ends
    dense = np.triu(np.arange(1.0, 82.0).reshape(9, 9), 1)
    dense[[0, 8]] = 0
    src, dst = np.nonzero(dense)
    parts = {"indptr": np.searchsorted(src, np.arange(10)), "indices": dst.astype(np.int32), "data": dense[src, dst]}
    np.savez(tmp_path / "a.npz", **parts)
    np.savez_compressed(tmp_path / "b.npz", **parts)
    want = {(i, j, dense[i, j]) for i, j in zip(src.tolist(), dst.tolist(), strict=True)}
    for name, size, tasks in (("a", 1, 9), ("a", 200, 3), ("a", 1 << 20, 1), ("b", 1, None)):
        found = raw.read_adjacency(spark, f"file://{tmp_path}/{name}.npz", size)
        assert tasks is None or found.rdd.getNumPartitions() == tasks
        rows = [tuple(r) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)
    np.savez(tmp_path / "none.npz", indptr=np.zeros(1, int), indices=np.zeros(0, int), data=np.zeros(0))
    assert raw.read_adjacency(spark, f"file://{tmp_path}/none.npz").collect() == []


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path, shape = f"file://{tmp_path}/t", "k int"
    read = lambda: sorted(r.k for r in raw.read_table(spark, path, shape).collect())
    raw.write_table(spark.range(5).selectExpr("cast(id as int) k"), path)
    bad = spark.range(100, numPartitions=4).selectExpr("cast(if(id = 99, raise_error('stop'), id) as int) k")
    with pytest.raises(Exception, match="stop"):
        raw.write_table(bad, path)
    assert read() == [0, 1, 2, 3, 4] and len(list((tmp_path / "t/_data").iterdir())) == 1
    # killed before and while it commits: rows without a commit, and a commit without its end
    spark.range(9).selectExpr("cast(id as int) k").write.parquet(f"{path}/_data/orphan")
    (tmp_path / "t/_commits/000000000001").write_text("orph")
    assert read() == [0, 1, 2, 3, 4]
    # the table may be read while it is replaced, and a reader of the last version is not disturbed
    before = raw.read_table(spark, path, shape)
    raw.write_table(before.selectExpr("k + 10 as k"), path)
    assert read() == [10, 11, 12, 13, 14] and before.count() == 5
    for k in range(3):
        raw.write_table(spark.range(k + 1).selectExpr("cast(id as int) k"), path)
    assert read() == [0, 1, 2] and len(raw._commits(spark, path)) == 2
    # a folder that something else wrote
    spark.range(2).selectExpr("cast(id as int) k").write.parquet(f"file://{tmp_path}/plain")
    assert raw.read_table(spark, f"file://{tmp_path}/plain", shape).count() == 2


def test_snapshots_need_a_finite_step_0(spark, tmp_path):
    rows = [(0, 1.0, 0), (1, 2.0, 0), (0, 3.0, 5)]
    spark.createDataFrame(rows, "cell int, mass double, step int").write.partitionBy("step").parquet(str(tmp_path / "a"))
    assert raw.read_snapshots(spark, str(tmp_path / "a"), "cell int, mass double", ["mass"]).agg(F.sum("mass")).first()[0] == 6.0
    spark.createDataFrame([(0, 1.0, 5)], "cell int, mass double, step int").write.partitionBy("step").parquet(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="step 0"):
        raw.read_snapshots(spark, str(tmp_path / "b"), "cell int, mass double", ["mass"])
    spark.createDataFrame([(0, float("inf"), 0)], "cell int, mass double, step int").write.partitionBy("step").parquet(str(tmp_path / "c"))
    with pytest.raises(Exception, match="not finite"):
        raw.read_snapshots(spark, str(tmp_path / "c"), "cell int, mass double", ["mass"]).collect()


def test_sources_are_compared_by_digest(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "name string, digest string")
    assert raw.same_source(a, a.orderBy(F.desc("name")), ["name"])
    assert not raw.same_source(a, a.withColumn("digest", F.lit("1")), ["name"]) and not raw.same_source(a, a.limit(1), ["name"])
