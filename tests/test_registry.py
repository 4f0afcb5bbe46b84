"""Every registered query against its SQL in DuckDB over the smallest tables, and the registry itself."""

import subprocess
import sys

import duckdb
import pytest

from corvane.plans import queries as plans
from corvane.plans import scalars, workspace  # noqa: F401  they put theirs into the same registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Those for which no SQL can say the same.
WITHOUT_SQL: set[str] = set()


def rows_of(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object)
    return cols, sorted(map(str, (tuple(r) for r in frame.where(frame.notna(), None).values.tolist())))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/sf0.001/{t}.parquet'")
    return c


def test_every_query_has_sql_or_a_reason():
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, data, name):
    got = plans.QUERIES[name](spark, f"{data}/sf0.001").toPandas()
    want = duck.execute(plans.ORACLE_SQL[name]).fetchdf()
    assert rows_of(got) == rows_of(want)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """A copy without the folders of the training-data operations imports and lists its queries."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_search_documents' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
