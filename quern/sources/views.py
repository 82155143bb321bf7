"""Input tables as the relations that graph condensation works on.

nodes(id, x, y, split), edges(src, dst), scores(...).  Everything is a projection or an aggregate of one scan; only
the columns named reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = 8
CLASSES = 10

#: Representatives allowed for each dataset and ratio.
BUDGETS = [
    ("cora", "0.013", 35),
    ("cora", "0.026", 70),
    ("cora", "0.052", 140),
    ("citeseer", "0.009", 30),
    ("citeseer", "0.018", 60),
    ("citeseer", "0.036", 120),
    ("arxiv", "0.0005", 90),
    ("arxiv", "0.0025", 454),
    ("arxiv", "0.005", 909),
    ("flickr", "0.001", 44),
    ("flickr", "0.005", 223),
    ("flickr", "0.01", 446),
    ("reddit", "0.0005", 77),
    ("reddit", "0.001", 153),
    ("reddit", "0.002", 307),
]


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUDGETS, "dataset string, ratio string, cells int")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("vec_id") % 10 < 6, "train").when(F.col("vec_id") % 10 < 8, "val").otherwise("test")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"), split.alias("split"))


def long_form(n: DataFrame, vector: str = "x") -> DataFrame:
    """(id, dim, v)."""
    return n.select("id", F.posexplode(vector).alias("dim", "v"))


def ring_edges(n: DataFrame) -> DataFrame:
    """A sparse graph on ids 0..N-1: two arithmetic successors of each node, without direction, with self loops."""
    size = n.agg(F.count("*").alias("n"))
    s = n.select("id").crossJoin(F.broadcast(size))
    out = [s.select(F.col("id").alias("src"), ((F.col("id") * a + b) % F.col("n")).alias("dst")) for a, b in ((7, 3), (11, 5))]
    return undirected(out[0].union(out[1]), loops=n)


def undirected(edges: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """Every edge in both directions once, and a loop on every node of ``loops``."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if loops is not None:
        both = both.union(loops.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    return both.distinct()


def split_of_roles(ids: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, split) from roles (id, role) with role tr, va or te; a node without role has split null."""
    split = F.when(F.col("role") == "tr", "train").when(F.col("role") == "va", "val").when(F.col("role") == "te", "test")
    return ids.join(roles.select("id", split.alias("split")), "id", "left")


def dense_labels(labels: DataFrame) -> DataFrame:
    """Labels shifted so that the smallest is 0."""
    low = labels.agg(F.min("label").alias("low"))
    return labels.crossJoin(F.broadcast(low)).select("id", (F.col("label") - F.col("low")).alias("y"))


def induced_subgraph(n: DataFrame, edges: DataFrame, split: str) -> DataFrame:
    """Edges among the nodes of a split, renumbered from 0 in id order.

    Renumbering counts the nodes of each id range first and then inside the range, so no task orders all nodes.
    """
    own = dense_ids(n.where(F.col("split") == split).select("id"))
    a = own.select(F.col("id").alias("src"), F.col("dense").alias("a"))
    b = own.select(F.col("id").alias("dst"), F.col("dense").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def dense_ids(ids: DataFrame, width: int | None = None) -> DataFrame:
    """(id, dense) with dense = rank of id from 0; ranges of ids are as wide as there are ranges, if no width is given."""
    from pyspark.sql import Window

    if width is None:
        ends = ids.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        width = max(4096, int((ends.hi - ends.lo) ** 0.5)) if ends.lo is not None else 4096
    ranged = ids.select("id", F.floor(F.col("id") / width).alias("range"))
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("range").count().withColumn("before", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
    inside = Window.partitionBy("range").orderBy("id")
    return ranged.join(before, "range").select("id", (F.col("before") + F.row_number().over(inside) - 1).alias("dense"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation scores of a sweep: candidate, condensation_seed, student_seed, step, val_acc, test_acc."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    keys = [F.col("event_type").alias("candidate"), (F.col("user_id") % 3).alias("condensation_seed"), (F.col("event_id") % 3).alias("student_seed"), ((F.col("event_id") / 3).cast("long") % 2 * 100).alias("step")]
    return e.groupBy(*keys).agg(F.avg("value").alias("val_acc"), F.max("value").alias("test_acc"))
