import importlib.util
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lorekiln import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return str(list(v)) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows, columns = df.collect(), df.columns
    if name not in catalog.oracle_sql():
        assert columns
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(columns) == sorted(want.columns)
    pick = lambda rows, names: sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert pick(rows, columns) == pick(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["chunk_id", "doc_id", "chunk_index", "evidence_text", "relevance_score"]


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """Copy what is not part of it; the entry must import and list the other queries."""
    import shutil

    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(here, "lorekiln"), tmp_path / "lorekiln", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(here, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q), q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert importlib.util.find_spec("lorekiln") is not None
