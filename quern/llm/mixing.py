"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised: 1 keeps the shares, 0 makes all
sources equal.  The exponent is bisected, in Spark over the small table of source totals, until the weights reach
a target entropy (as a share of the largest possible) or, if that comes first, until the source that would be
repeated most reaches ``max_repeats``.

The weights are realised under a token budget as blocks: a block is one full pass over a source in an order
given by a hash of (seed, block, doc_id).  Every source runs through as many whole blocks as its quota holds, and
of the next block as many documents as fit: a document is used if the tokens up to and including it are at most
the rest.  The running sums are taken in two steps, over hash ranges and then within each, so a source holding a
third of all rows is never sorted in one task.

Nulls and edge cases: null source is a source of its own; null text counts as empty, and a document without words
counts 0 tokens and is used once for every begun block.  Rows without doc_id are ordered by their text; repeated
rows are placed side by side and used or not each for itself.  An empty table, or one without tokens, gives copies
of 1 for every row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

ENTROPY = 0.97
MAX_REPEATS = 4.0
SEED = "quern"
STEPS = 48
#: Bisection steps that one job settles (2 ** LEVELS - 1 exponents are tried at once).
LEVELS = 4

WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text") -> F.Column:
    """Number of words."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def exponent(totals: DataFrame, budget_share: float = 1.0, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The largest exponent that reaches the entropy, or else the smallest that keeps within the repeats; from totals(tokens)."""
    base = totals.where("tokens > 0").select(F.col("tokens").cast("double").alias("t")).cache()
    sums = base.agg(F.sum("t").alias("t"), F.count("*").alias("n")).first()
    if not sums.n or sums.n == 1:
        return 1.0
    lo, hi = 0.0, 1.0

    def judged(points: list[float]) -> list[bool]:
        """For each exponent, whether it is small enough for the entropy or too small for the repeats."""
        share = F.col("t") / sums.t
        cols = []
        for k, a in enumerate(points):
            w = F.pow(share, F.lit(a))
            cols += [F.sum(w).alias(f"z{k}"), F.sum(w * a * F.ln(share)).alias(f"l{k}"), F.max(w / share).alias(f"r{k}")]
        row = base.agg(*cols).first()
        out = []
        for k in range(len(points)):
            z = row[f"z{k}"]
            h = (math.log(z) - row[f"l{k}"] / z) / math.log(sums.n)
            out.append((h >= entropy, row[f"r{k}"] / z * budget_share <= max_repeats))
        return out

    def search(flag: int, lo: float, hi: float) -> tuple[float, float]:
        for _ in range(STEPS // LEVELS):
            n = 1 << LEVELS
            points = [lo + (hi - lo) * i / n for i in range(1, n)]
            ok = [x[flag] for x in judged(points)]
            # entropy holds up to some exponent, repeats from some exponent on
            edge = sum(ok) if flag == 0 else n - 1 - sum(ok)
            lo, hi = (points[edge - 1] if edge else lo), (points[edge] if edge < n - 1 else hi)
        return lo, hi

    at_one = judged([1.0, 0.0])
    by_entropy = 1.0 if at_one[0][0] else search(0, lo, hi)[0]
    by_repeats = 0.0 if at_one[1][1] else (search(1, lo, hi)[1] if at_one[0][1] else 1.0)
    base.unpersist()
    return max(by_entropy, by_repeats)


def _order(block: F.Column) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), block.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))


def mixed(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """All columns of docs with n_tokens, weight (of the source) and copies (times the document is used).

    budget: tokens to hand out; by default as many as there are.
    """
    clash = {"n_tokens", "weight", "copies", "qsource", "quota"} & set(docs.columns)
    docs = docs.drop(*clash)
    rows = docs.withColumn("n_tokens", tokens()).withColumn("qsource", F.col("source"))
    counted = rows.groupBy("qsource").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    totals = stored(counted, "sources")
    every = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.count("*").alias("n")).first()
    if not every.t:
        return rows.drop("qsource").withColumn("weight", F.lit(None).cast("double")).withColumn("copies", F.lit(1).cast("long"))
    budget = every.t if budget is None else budget
    a = exponent(totals, budget / every.t, entropy, max_repeats)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(every.t), F.lit(a))).otherwise(0.0)
    z = totals.agg(F.sum(power).alias("z")).first().z
    plan = totals.withColumn("weight", F.round(power / z, 9)).withColumn("quota", F.floor(F.col("weight") * budget).cast("long"))
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("long"))
    plan = stored(plan.withColumn("rest", F.col("quota") - F.col("full") * F.col("tokens")), "plan")

    side = F.broadcast(plan) if every.n <= 100_000 else plan
    placed = rows.join(side.drop("docs", "quota").withColumnRenamed("qsource", "psource"), F.col("qsource").eqNullSafe(F.col("psource"))).drop("psource", "tokens")
    placed = placed.withColumn("place", _order(F.col("full")))
    # hash ranges: about the square root of the number of documents
    digits = max(1, min(6, (int(every.d**0.5).bit_length() + 3) // 4))
    placed = placed.withColumn("range", F.substring("place", 1, digits))
    ranges = placed.groupBy("qsource", "range").agg(F.sum("n_tokens").alias("sum"))
    ahead = Window.partitionBy("qsource").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored(ranges.withColumn("before", F.coalesce(F.sum("sum").over(ahead), F.lit(0))), "ranges")
    small = F.broadcast(ranges) if ranges.count() <= 200_000 else ranges
    keyed = placed.join(small.select(F.col("qsource").alias("rs"), F.col("range").alias("rr"), "before"), F.col("qsource").eqNullSafe(F.col("rs")) & (F.col("range") == F.col("rr"))).drop("rs", "rr")
    inside = Window.partitionBy("qsource", "range").orderBy("place", "text").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n_tokens").over(inside)
    used = F.when((upto <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0)
    return keyed.withColumn("copies", (F.col("full") + used).cast("long")).drop("qsource", "full", "rest", "place", "range", "before")
