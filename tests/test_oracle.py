"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from lodestar.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, tables, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = tables.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


BLOCKED = """
import sys

class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "lodestar.llm" or name.startswith("lodestar.llm.") or name in sys.argv[1:]:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Gone())
import __spark_entry__
assert not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries())
assert len(__spark_entry__.oracle_sql()) > 40
"""


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline",)])
def test_entry_without_the_training_data_operators(gone):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", BLOCKED, *gone], cwd=root, check=True)
