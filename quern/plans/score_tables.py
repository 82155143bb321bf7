"""Queries over score tables: one for each selection rule, predicates, checked joins and set operations, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import checks, selection
from ..sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TRIALS = """SELECT event_type AS method, CAST(user_id % 4 AS BIGINT) AS candidate, [0.01, 0.1, 1.0][user_id % 3 + 1]::DOUBLE AS gamma,
    [0.5, 1.0, 2.0][event_id % 3 + 1]::DOUBLE AS t, (event_id // 3) % 4 * 100 AS step, (event_id // 12) % 2 = 0 AS weighted, round(avg(value), 6) AS val_acc, round(stddev_pop(value), 6) AS val_ce,
    round(avg(value * value), 6) AS student_ce FROM events GROUP BY ALL"""


def trials(spark: SparkSession, d: str) -> DataFrame:
    """method, candidate, gamma, t, step, weighted, val_acc, val_ce, student_ce."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")

    def one_of(values: list[float], place) -> F.Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), (place + 1).cast("int"))

    keys = [
        F.col("event_type").alias("method"), (F.col("user_id") % 4).cast("long").alias("candidate"), one_of([0.01, 0.1, 1.0], F.col("user_id") % 3).alias("gamma"), one_of([0.5, 1.0, 2.0], F.col("event_id") % 3).alias("t"),
        (F.floor(F.col("event_id") / 3) % 4 * 100).alias("step"), (F.floor(F.col("event_id") / 12) % 2 == 0).alias("weighted"),
    ]
    return e.groupBy(*keys).agg(F.round(F.avg("value"), 6).alias("val_acc"), F.round(F.stddev_pop("value"), 6).alias("val_ce"), F.round(F.avg(F.col("value") * F.col("value")), 6).alias("student_ce"))


#: Selection rules: the order of preference and the columns within whose groups the choice is made.
RULES: dict[str, tuple[str, str]] = {
    "select_kernel_teacher": ("val_acc DESC, gamma", ""),
    "select_linear_teacher": ("val_acc DESC, val_ce, candidate", ""),
    "select_graph_teacher": ("val_acc DESC, val_ce, candidate", "method"),
    "select_accuracy": ("val_acc DESC, val_ce, gamma", ""),
    "select_teacher_ce": ("val_ce, gamma", ""),
    "select_calibrated_ce": ("val_ce, gamma", "t"),
    "select_teacher_by_student": ("student_ce, gamma, t", ""),
    "select_teacher_by_own_ce": ("val_ce, gamma", "method"),
    "select_risk_candidate": ("val_acc DESC, candidate", ""),
    "select_moment_candidate": ("val_acc DESC, candidate", "t"),
    "select_soft_gamma": ("val_acc DESC, gamma", "method"),
    "select_soft_initial": ("val_acc DESC, candidate", "step"),
    "select_soft_fine": ("val_acc DESC, step, candidate", "method"),
    "select_finetune": ("val_acc DESC, step, candidate", "method"),
    "select_propagation": ("val_acc DESC, candidate", "method"),
    "select_adaptive": ("val_acc DESC, gamma", "t"),
    "select_inner_weighting": ("val_acc DESC, step, weighted", "method, candidate"),
    "select_reproduction_checkpoint": ("val_acc DESC, step", "method"),
    "select_restart": ("student_ce, candidate", "method"),
    "select_early_epoch": ("val_acc DESC, step", "candidate"),
}
#: Later keys that only make the kept row definite where the rule leaves a tie.
_REST = "method, candidate, gamma, t, step, weighted"


def _rule(order: str, by: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        keys = [F.desc(k[:-5]) if k.endswith(" DESC") else F.col(k) for k in f"{order}, {_REST}".split(", ")]
        return selection.best(checks.require_finite(trials(spark, d), ["val_acc", "val_ce"]), keys, [k for k in by.split(", ") if k])

    return run


for _name, (_order, _by) in RULES.items():
    QUERIES[_name] = _rule(_order, _by)
    SQL[_name] = f"WITH trials AS ({TRIALS}) SELECT * FROM trials QUALIFY row_number() OVER ({f'PARTITION BY {_by} ' if _by else ''}ORDER BY {_order}, {_REST}) = 1"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH trials AS ({TRIALS}) {sql}" if "trials" in sql else sql
        return f

    return add


@query("SELECT * FROM trials WHERE step > 0 ORDER BY val_acc DESC, step, method, candidate, gamma, t, weighted LIMIT 1")
def select_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Only rows with a step above 0 are eligible."""
    rows = trials(spark, d).where(F.col("step").isNotNull() & (F.col("step") > 0))
    return selection.best(rows, [F.desc("val_acc"), "step", "method", "candidate", "gamma", "t", "weighted"])


@query("SELECT name, T AS t, ce FROM (SELECT 'low' AS name, 0 AS place, min(val_ce) AS ce, 0.05::DOUBLE AS T FROM trials UNION ALL SELECT 'high', 1, max(val_ce), 20.0 FROM trials UNION ALL SELECT 'best', 2, min(val_ce), 1.0 FROM trials) ORDER BY ce, place LIMIT 1")
def select_calibration_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The first of equals in the order in which candidates are tried."""
    ends = trials(spark, d).agg(F.min("val_ce").alias("lo"), F.max("val_ce").alias("hi"))
    tried = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("place"), F.col(c).alias("ce"), F.lit(t).alias("t")) for k, (n, c, t) in enumerate([("low", "lo", 0.05), ("high", "hi", 20.0), ("best", "lo", 1.0)])])
    return selection.best(ends.select(F.explode(tried).alias("e")).select("e.*"), ["ce", "place"]).select("name", "t", "ce")


@query("SELECT method, candidate, gamma, t, step, weighted, CASE WHEN step = 100 THEN NULL ELSE val_acc END AS val_acc FROM trials WHERE step <> 100 AND val_acc > 0")
def finite_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose score is neither null nor NaN; the scores of step 100 are made so here."""
    odd = F.when(F.col("step") == 100, F.when(F.col("weighted"), F.lit(float("nan")))).otherwise(F.when(F.col("val_acc") > 0, F.col("val_acc")))
    return trials(spark, d).withColumn("val_acc", odd).where(checks.finite("val_acc")).select("method", "candidate", "gamma", "t", "step", "weighted", "val_acc")


@query("SELECT method, candidate, count(*) AS n FROM trials WHERE NOT (method = 'view' AND candidate = 1) AND method IN (SELECT method FROM trials WHERE NOT (method = 'view' AND candidate = 1) GROUP BY method HAVING count(DISTINCT candidate) = 4) GROUP BY ALL")
def complete_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods that have every candidate."""
    rows = trials(spark, d).where("not (method = 'view' and candidate = 1)")
    return checks.with_all(rows, "method", "candidate", 4).groupBy("method", "candidate").agg(F.count("*").alias("n"))


@query("SELECT method, candidate, t, step, weighted, val_acc FROM trials WHERE gamma = 0.1")
def filter_then_drop(spark: SparkSession, d: str) -> DataFrame:
    return trials(spark, d).where("gamma = 0.1D").drop("gamma", "val_ce", "student_ce")


@query("SELECT parameter, value, best, position FROM (SELECT 'gamma' AS parameter, gamma AS value, max(val_acc) AS best, CASE WHEN gamma = 0.01 THEN 'lower' WHEN gamma = 1.0 THEN 'upper' ELSE 'interior' END AS position FROM trials WHERE step > 0 GROUP BY gamma UNION ALL SELECT 't', t, max(val_acc), CASE WHEN t = 0.5 THEN 'lower' WHEN t = 2.0 THEN 'upper' ELSE 'interior' END FROM trials GROUP BY t)")
def boundary_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Several parameters at once; gamma only counts from the first step on."""
    rows = trials(spark, d)
    parts = [selection.boundary_profile(rows.where("step > 0") if p == "gamma" else rows, p).select(F.lit(p).alias("parameter"), "value", "best", "position") for p in ("gamma", "t")]
    return parts[0].union(parts[1])


_CROSS = "SELECT (g.p * (SELECT count(DISTINCT t) FROM trials) + h.p) * (SELECT count(DISTINCT method) FROM trials) + m.p AS candidate, gamma, t, method FROM (SELECT gamma, row_number() OVER (ORDER BY gamma) - 1 AS p FROM (SELECT DISTINCT gamma FROM trials)) g, (SELECT t, row_number() OVER (ORDER BY t) - 1 AS p FROM (SELECT DISTINCT t FROM trials)) h, (SELECT method, row_number() OVER (ORDER BY method) - 1 AS p FROM (SELECT DISTINCT method FROM trials)) m"


@query(f"SELECT candidate, gamma, t, method FROM ({_CROSS})")
def grid_cross(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of the values that the trials used, in product order."""
    return selection.crossed(trials(spark, d), ["gamma", "t", "method"])


@query(f"SELECT c.* FROM ({_CROSS}) c ANTI JOIN (SELECT gamma, t, method FROM trials WHERE val_acc > (SELECT quantile_disc(val_acc, 0.9) FROM trials)) o ON c.gamma = o.gamma AND c.t = o.t AND c.method = o.method")
def grid_anti(spark: SparkSession, d: str) -> DataFrame:
    """Combinations that no trial among the best tenth used."""
    rows = trials(spark, d)
    edge = rows.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY val_acc)").alias("edge"))
    good = rows.crossJoin(F.broadcast(edge)).where("val_acc > edge")
    return selection.new_rows(selection.crossed(rows, ["gamma", "t", "method"]), good, ["gamma", "t", "method"])


@query("SELECT method, gamma, t, count(*) AS n FROM trials WHERE candidate * 2 + 2 <= (SELECT count(DISTINCT user_id) FROM events) AND candidate <= step / 100 GROUP BY ALL")
def rank_within_cells(spark: SparkSession, d: str) -> DataFrame:
    """Settings of trials whose rank fits both the nodes and the cells: a filter by two columns and by a count of the table."""
    users = spark.read.parquet(f"{d}/events.parquet").agg(F.count_distinct("user_id").alias("users"))
    rows = trials(spark, d).crossJoin(F.broadcast(users)).where("candidate * 2 + 2 <= users and candidate <= step / 100")
    return rows.groupBy("method", "gamma", "t").agg(F.count("*").alias("n"))


@query(f"SELECT dataset, ratio, cells, nodes FROM (VALUES {', '.join(f'({d!r}, {q!r}, {m})' for d, q, m in views.BUDGETS)}) b(dataset, ratio, cells), (SELECT count(*) AS nodes FROM embeddings) WHERE 5 * cells <= nodes QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY cells DESC) = 1")
def budget_registry(spark: SparkSession, d: str) -> DataFrame:
    """The largest budget of each dataset that leaves five nodes of the table for each cell."""
    size = views.nodes(spark, d).agg(F.count("*").alias("nodes"))
    fitting = views.budgets(spark).crossJoin(F.broadcast(size)).where("5 * cells <= nodes")
    return selection.best(fitting, [F.desc("cells")], ["dataset"])


@query("SELECT a.method, a.candidate, count(*) AS n FROM trials a JOIN (SELECT DISTINCT gamma AS g FROM trials) b ON abs(a.gamma - b.g - 1e-14) < 1e-12 GROUP BY ALL")
def near_equal_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Settings found again by a float that is equal within 1e-12; the distinct floats are grid values."""
    rows = trials(spark, d)
    keys = F.broadcast(rows.select((F.col("gamma") + 1e-14).alias("g")).distinct())
    return rows.join(keys, checks.close("gamma", "g")).groupBy("method", "candidate").agg(F.count("*").alias("n"))


@query("SELECT candidate, a.mean, b.best FROM (SELECT candidate, round(avg(val_acc), 6) + 0.0 AS mean FROM trials GROUP BY ALL) a JOIN (SELECT candidate, max(val_acc) AS best FROM trials GROUP BY ALL) b USING (candidate)")
def join_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    rows = trials(spark, d)
    mean = rows.groupBy("candidate").agg(v.rounded(F.avg("val_acc")).alias("mean"))
    return checks.checked_join(mean, rows.groupBy("candidate").agg(F.max("val_acc").alias("best")), ["candidate"])


@query("SELECT r.method, r.candidate, r.gamma, r.t, r.step, r.weighted, r.val_acc, b.base_acc FROM trials r JOIN (SELECT candidate, gamma, max(val_acc) AS base_acc FROM trials WHERE method = 'view' GROUP BY ALL) b USING (candidate, gamma)")
def join_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its baseline; the baseline must not repeat a key."""
    rows = trials(spark, d).drop("val_ce", "student_ce")
    base = rows.where("method = 'view'").groupBy("candidate", "gamma").agg(F.max("val_acc").alias("base_acc"))
    return checks.checked_join(rows, base, ["candidate", "gamma"], "many_to_one")


@query("SELECT method, s.best, s.mean, d.n, d.steps FROM (SELECT method, max(val_acc) AS best, round(avg(val_acc), 6) + 0.0 AS mean FROM trials GROUP BY ALL) s JOIN (SELECT method, count(*) AS n, count(DISTINCT step) AS steps FROM trials GROUP BY ALL) d USING (method)")
def summary_with_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = trials(spark, d)
    summary = rows.groupBy("method").agg(F.max("val_acc").alias("best"), v.rounded(F.avg("val_acc")).alias("mean"))
    return checks.checked_join(summary, rows.groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("step").alias("steps")), ["method"])


@query("SELECT method, step, CASE step WHEN 0 THEN 'initial' WHEN 100 THEN 'first' WHEN 300 THEN 'last' END AS phase, count(*) AS n FROM trials GROUP BY ALL")
def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A value of a small map, null where it has none."""
    phases = F.create_map(*[F.lit(x) for pair in {0: "initial", 100: "first", 300: "last"}.items() for x in pair])
    return trials(spark, d).groupBy("method", "step").agg(F.count("*").alias("n")).select("method", "step", F.try_element_at(phases, F.col("step").cast("int")).alias("phase"), "n")


@query("SELECT DISTINCT gamma, t FROM trials WHERE method = 'click'")
def candidates_of_grid(spark: SparkSession, d: str) -> DataFrame:
    """Tried settings, all of which must be in the grid."""
    tried = trials(spark, d).where("method = 'click'").select("gamma", "t").distinct()
    return checks.members(tried, selection.grid(spark, {"gamma": [0.01, 0.1, 1.0], "t": [0.5, 1.0, 2.0]}), ["gamma", "t"])


@query("SELECT method, candidate, n, NULL::DOUBLE AS best FROM (SELECT method, candidate, count(*) AS n FROM trials GROUP BY ALL) UNION ALL SELECT method, NULL, NULL, max(val_acc) FROM trials GROUP BY method")
def append_with_other_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = trials(spark, d)
    return checks.appended([rows.groupBy("method", "candidate").agg(F.count("*").alias("n")), rows.groupBy("method").agg(F.max("val_acc").alias("best"))]).select("method", "candidate", "n", "best")


@query("SELECT method, list_sort(list_distinct(list_concat([0, 50], list(DISTINCT step)))) AS steps FROM trials GROUP BY method")
def checkpoint_union(spark: SparkSession, d: str) -> DataFrame:
    """Step 0 and 50 and the steps seen, each once."""
    seen = trials(spark, d).groupBy("method").agg(F.collect_set("step").alias("s"))
    return seen.select("method", F.array_sort(F.array_distinct(F.array_union(F.array(F.lit(0).cast("long"), F.lit(50).cast("long")), F.col("s")))).alias("steps"))


@query("SELECT DISTINCT candidate FROM trials WHERE method = 'view' AND candidate > 1 INTERSECT SELECT candidate FROM trials WHERE method = 'click' AND candidate < 3")
def shared_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seeds used by both phases."""
    rows = trials(spark, d)
    return checks.shared_values(rows.where("method = 'view' and candidate > 1").select("candidate"), rows.where("method = 'click' and candidate < 3").select("candidate"))


@query("SELECT candidate, gamma, t, count(*) AS n FROM trials GROUP BY ALL HAVING n > 10")
def repeated_settings(spark: SparkSession, d: str) -> DataFrame:
    """Keys that come more than once, as uniqueness checks report them."""
    return checks.repeated(trials(spark, d), ["candidate", "gamma", "t"]).where("n > 10")


@query("SELECT method, row_number() OVER (ORDER BY first_) - 1 AS place FROM (SELECT event_type AS method, min(event_id) AS first_ FROM events GROUP BY ALL)")
def unique_in_order(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("method"), "event_id")
    return checks.unique_in_order(e, "method", "event_id").select("method", F.col("place").cast("long").alias("place"))


@query("SELECT method, gamma, t, step, min(candidate) AS candidate, CASE WHEN min(candidate) = max(candidate) THEN NULL ELSE count(DISTINCT candidate) END AS different FROM trials GROUP BY ALL")
def constant_in_group(spark: SparkSession, d: str) -> DataFrame:
    """The value of a group, and how many there are where it is not constant."""
    return checks.constant(trials(spark, d), ["method", "gamma", "t", "step"], "candidate")


@query("SELECT method, 'run_' || method || '_' || lpad(candidate::VARCHAR, 3, '0') AS name, regexp_replace('run_' || method, '^run_', '') AS bare, regexp_matches(method, '^[A-Za-z0-9]+$') AS plain, candidate FROM trials GROUP BY ALL")
def run_names(spark: SparkSession, d: str) -> DataFrame:
    """Zero-padded names, prefixes taken off, and whether a name is letters and digits only."""
    rows = trials(spark, d).select("method", "candidate").distinct()
    return rows.select("method", F.concat_ws("_", F.lit("run"), "method", F.lpad(F.col("candidate").cast("string"), 3, "0")).alias("name"), F.regexp_replace(F.concat(F.lit("run_"), "method"), "^run_", "").alias("bare"), F.col("method").rlike("^[A-Za-z0-9]+$").alias("plain"), "candidate")
