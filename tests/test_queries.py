"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from dossier.plans import fifth, fourth, more, third  # noqa: F401
from dossier.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def same(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, con, name):
    got = plans.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = Counter(tuple(same(r[c]) for c in cols) for r in got.collect())
    cur = con.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == Counter(tuple(same(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_package():
    """The entry module works where dossier/llm and corpus_pipeline.py are gone."""
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as d:
        import shutil

        shutil.copytree(f"{root}/dossier", f"{d}/dossier", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{root}/__spark_entry__.py", d)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'quote_support' in q and not any(k.startswith('op') for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=d, check=True, env=os.environ | {"PYTHONPATH": d})


def test_support_levels_of_blank_and_missing_quotes(spark, tmp_path):
    """Null texts and texts that end in blanks, as SQL has them."""
    texts = [None, "   ", "text" + " " * 12, "text\n" + " " * 12]
    rows = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["quote_support_levels"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT sha, quote_id, support, prose_only FROM ({plans.ORACLES['quote_support_levels']})").fetchall()
    assert sorted(map(tuple, got.select("sha", "quote_id", "support", "prose_only").collect())) == sorted(want)
