"""Raw graph folders and result tables: readers of the formats that graph data sets come in, sinks and their checks."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import cut
from ..operators import checks, features, graph
from . import views

#: Rows of a matrix in one Arrow batch.
ROWS = 4096
#: Bytes of a matrix that one task reads.
RANGE_BYTES = 64 << 20


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """(id, role) from role.json, an object of the id lists tr, va and te."""
    lists = spark.read.schema("tr array<bigint>, va array<bigint>, te array<bigint>").option("multiLine", True).json(path)
    parts = [lists.select(F.explode(c).alias("id"), F.lit(c).alias("role")) for c in ("tr", "va", "te")]
    return parts[0].union(parts[1]).union(parts[2])


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, labels) from class_map.json, an object of node id to a label or to a list of labels; the other is null."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "value"))
    some = F.col("value").startswith("[")
    return rows.select(F.col("id").cast("long").alias("id"), F.when(~some, F.col("value")).cast("int").alias("label"), F.when(some, F.from_json("value", "array<double>")).alias("labels"))


class _Remote(io.RawIOBase):
    """A file that the session's file systems can open, as Python's zip and header readers want it; for the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.uri, self.size, self.stream, self.at = str(fs.makeQualified(where)), fs.getFileStatus(where).getLen(), fs.open(where), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.size}[whence]
        return self.at

    def read(self, size: int = -1) -> bytes:
        self.stream.seek(self.at)
        found = bytes(self.stream.readNBytes(min(self.size - self.at, self.size if size < 0 else size)))
        self.at += len(found)
        return found

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


@dataclass(frozen=True)
class Stored:
    """Where a matrix or vector lies in a file: its first byte, element type and shape."""

    offset: int
    dtype: np.dtype
    shape: tuple[int, ...]

    def read(self, file, first: int, last: int) -> np.ndarray:
        """Rows first to last (not included), with two system calls."""
        wide = int(np.prod(self.shape[1:], dtype=int))
        file.seek(self.offset + first * wide * self.dtype.itemsize)
        found = np.frombuffer(file.read((last - first) * wide * self.dtype.itemsize), self.dtype)
        return found.reshape(last - first, *self.shape[1:])


def _header(file: io.RawIOBase) -> Stored | None:
    """The array that begins here; None if its rows aren't one after the other."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, columns_first, dtype = read(file)
    return None if columns_first and len(shape) > 1 or dtype.hasobject else Stored(file.tell(), dtype, shape)


def _layout(spark: SparkSession, path: str) -> tuple[str, dict[str, Stored]] | None:
    """URI of a NumPy file and its arrays ("" in .npy, members in .npz), if tasks can read ranges of it: nothing is compressed
    and Arrow knows the file system."""
    with _Remote(spark, path) as file:
        try:
            pa_fs.FileSystem.from_uri(file.uri)
        except (pa.ArrowInvalid, OSError):
            return None
        if not path.endswith(".npz"):
            found = {"": _header(file)}
        else:
            found = {}
            for m in zipfile.ZipFile(file).infolist():
                if m.compress_type != zipfile.ZIP_STORED:
                    return None
                file.seek(m.header_offset + 26)
                name, extra = struct.unpack("<HH", file.read(4))
                file.seek(m.header_offset + 30 + name + extra)
                found[m.filename.removesuffix(".npy")] = _header(file)
    return None if None in found.values() else (file.uri, found)


def _opened(uri: str):
    fs, path = pa_fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _ranges(spark: SparkSession, rows: int, each: int) -> DataFrame:
    """(id) of the ranges of ``each`` rows, one task for each."""
    count = max(1, -(-rows // each))
    return spark.range(0, count, 1, count)


def _vectors(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(float).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(ids), lists], ["id", "x"])


def read_features(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, x) from a matrix stored by NumPy (.npy).

    A task reads its range of rows of the file.  Matrices stored by columns, and file systems that Arrow doesn't know, are
    read whole by one task.
    """
    found = _layout(spark, path)
    if found is not None:
        uri, matrix = found[0], found[1][""]
        total, width = matrix.shape[0], max(1, matrix.dtype.itemsize * int(np.prod(matrix.shape[1:], dtype=int)))
        each = max(1, range_bytes // width)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with _opened(uri) as file:
                for batch in batches:
                    for k in batch.column("id").to_pylist():
                        last = min(total, (k + 1) * each)
                        for at in range(k * each, last, ROWS):
                            to = min(last, at + ROWS)
                            yield _vectors(np.arange(at, to), matrix.read(file, at, to))

        return _ranges(spark, total, each).mapInArrow(part, "id long, x array<double>")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                x = np.load(io.BytesIO(content))
                for at in range(0, len(x), ROWS):
                    yield _vectors(np.arange(at, at + len(x[at : at + ROWS])), x[at : at + ROWS])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "id long, x array<double>")


def read_adjacency(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(src, dst, w) from a compressed-row matrix stored by NumPy (.npz with indptr, indices and data).

    A task reads its range of rows: their ends, then their columns and values, some thousand at a time.  Compressed members,
    and file systems that Arrow doesn't know, are read whole by one task.
    """
    names, shape = ["src", "dst", "w"], "src long, dst long, w double"

    def edges(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v.astype(t)) for v, t in ((src, np.int64), (dst, np.int64), (w, float))], names)

    found = _layout(spark, path)
    if found is not None:
        uri, (ends, columns, values) = found[0], (found[1][k] for k in ("indptr", "indices", "data"))
        total = ends.shape[0] - 1
        bytes_a_row = (columns.shape[0] * (columns.dtype.itemsize + values.dtype.itemsize)) // max(1, total) + ends.dtype.itemsize
        each = max(1, range_bytes // bytes_a_row)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with _opened(uri) as file:
                for batch in batches:
                    for k in batch.column("id").to_pylist():
                        first, last = k * each, min(total, (k + 1) * each)
                        if first >= last:
                            continue
                        end = ends.read(file, first, last + 1).astype(np.int64)
                        for at in range(int(end[0]), int(end[-1]), 16 * ROWS):
                            to = min(int(end[-1]), at + 16 * ROWS)
                            src = first + np.searchsorted(end, np.arange(at, to), "right") - 1
                            yield edges(src, columns.read(file, at, to), values.read(file, at, to))

        return _ranges(spark, total, each).mapInArrow(part, shape)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with np.load(io.BytesIO(content)) as a:
                    indptr, indices, data = (a[k] for k in ("indptr", "indices", "data"))
                src = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
                for at in range(0, len(src), 16 * ROWS):
                    some = slice(at, at + 16 * ROWS)
                    yield edges(src[some], indices[some], data[some])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, shape)


def prepared(nodes: DataFrame, edges: DataFrame, roles: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes (id, x, y, split, h) ready for condensation: undirected edges, split from roles, labels from 0, features scaled by
    the training rows, and h = S S x.  nodes: id, x; edges: src, dst; labels: id, label."""
    split = views.split_of_roles(nodes.select("id"), roles)
    rows = features.train_zscore(nodes.join(split, "id")).join(views.dense_labels(labels.select("id", "label")), "id")
    rows = cut(rows)
    w = cut(graph.symmetric_weights(views.undirected(edges), nodes=rows))
    return rows.join(graph.propagate_vectors(w, rows, hops=2).withColumnRenamed("x", "h"), "id")


def prepared_by_split(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, split, h): propagation inside each split's own graph, as the inductive setting has it.  nodes: id, x, split."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("split").alias("s")), nodes.select(F.col("id").alias("dst"), F.col("split").alias("t"))
    own = views.undirected(edges).join(a, "src").join(b, "dst").where("s = t").select("src", "dst")
    w = cut(graph.symmetric_weights(own, "missing", nodes))
    return nodes.select("id", "split").join(graph.propagate_vectors(w, nodes, hops=2).withColumnRenamed("x", "h"), "id")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), spark._jvm.org.apache.hadoop.fs.Path


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Commits of a table, oldest first: number and name of the folder with its rows.  One that was not finished doesn't count."""
    fs, of = _files(spark, path)
    if not fs.exists(of(f"{path}/_commits")):
        return []
    found = []
    for status in fs.listStatus(of(f"{path}/_commits")):
        stream = fs.open(status.getPath())
        name = bytes(stream.readAllBytes()).decode()
        stream.close()
        if name.endswith("\n"):
            found.append((int(status.getPath().getName()), name.strip()))
    return sorted(found)


def write_table(df: DataFrame, path: str, kind: str = "parquet", keep: int = 2) -> None:
    """Replaces the table at path; kinds parquet, json and csv (with header).

    The rows are written to a folder of their own.  Only when all are there does a new file in _commits, which no other
    writer can have made, name that folder; read_table takes the last one.  So readers see the old rows or the new ones, a
    write that fails or is killed leaves the old ones, and df may itself read the table.  The ``keep`` last versions stay, for
    readers that have begun.
    """
    spark = df.sparkSession
    fs, of = _files(spark, path)
    name = uuid.uuid4().hex
    writer = df.write.option("header", True) if kind == "csv" else df.write
    try:
        writer.format(kind).save(f"{path}/_data/{name}")
    except BaseException:
        fs.delete(of(f"{path}/_data/{name}"), True)
        raise
    while True:
        known = _commits(spark, path)
        number = known[-1][0] + 1 if known else 0
        while fs.exists(of(f"{path}/_commits/{number:012d}")):  # one that was not finished
            number += 1
        try:
            stream = fs.create(of(f"{path}/_commits/{number:012d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                continue  # another writer was faster
            raise
        stream.write(bytearray(f"{name}\n".encode()))
        stream.close()
        break
    for old, data in _commits(spark, path)[:-keep]:
        fs.delete(of(f"{path}/_commits/{old:012d}"), False)
        fs.delete(of(f"{path}/_data/{data}"), True)


def read_table(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The last committed rows of a table with the schema it must have; nothing is inferred.  A plain folder is read as it is."""
    known = _commits(spark, path)
    reader = spark.read.schema(schema).format(kind)
    return (reader.option("header", True) if kind == "csv" else reader).load(f"{path}/_data/{known[-1][1]}" if known else path)


def read_snapshots(spark: SparkSession, path: str, schema: str, columns: Sequence[str]) -> DataFrame:
    """Snapshots stored by step=; raises without step 0, and the query fails at a value of columns that is not finite."""
    found = spark.read.schema(f"{schema}, step int").parquet(path)
    if found.where("step = 0").isEmpty():
        raise ValueError("no snapshot of step 0")
    return checks.require_finite(found, columns)


def same_source(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> bool:
    """Whether two tables of (key, digest) name the same artifacts."""
    on = [*keys, "digest"]
    return old.select(*on).exceptAll(new.select(*on)).isEmpty() and new.select(*on).exceptAll(old.select(*on)).isEmpty()
