import subprocess
import sys
from pathlib import Path

import pytest
from compare import assert_same

from quern.plans import catalog, driver_tables, model_tables, oracles, score_tables

QUERIES = catalog.QUERIES | score_tables.QUERIES | model_tables.QUERIES | driver_tables.QUERIES
SQL = oracles.SQL | score_tables.SQL | model_tables.SQL | driver_tables.SQL
ITERATIVE = {"lloyd_full", "moment_partition", "whiten", "head_fit", "kernel_teacher", "soft_partition", "principal_projection", "principal_split", "principal_scatter_split", "variance_partition"}
ITERATIVE |= {"spread_centres", "hybrid_partition", "teacher_penalties", "kernel_teacher_penalties", "low_rank_partition", "propagation_search", "temperature_search", "ablation_search"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, name):
    assert_same(QUERIES[name](spark, sf), duck.sql(SQL[name]))


def test_every_query_has_sql_or_is_iterative():
    assert set(QUERIES) - set(SQL) == ITERATIVE


def test_registry_survives_without_the_language_model_operators(tmp_path):
    """A copy without the subpackage and the pipeline registers the other queries, and nothing in it imports them."""
    root = Path(__file__).resolve().parent.parent
    for p in [root / "__spark_entry__.py", *root.glob("quern/**/*.py")]:
        if "llm" not in p.relative_to(root).parts:
            to = tmp_path / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(QUERIES)), str(len(SQL)), "False"]
