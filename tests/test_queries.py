"""Every query with SQL against DuckDB over the smallest tables; the others must run and return rows."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from fathomry.plans.oracle import ORACLE_SQL
from fathomry.plans.queries import QUERIES

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="no tables here")


def canonical(columns, rows):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.6g}"
        return str(int(v)) if isinstance(v, (bool, int)) else None if v is None else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([value(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DIR.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(DIR))
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(df.columns, rows) == canonical(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns


def test_repartitioned_input_gives_the_same_result(spark, tmp_path):
    for f in DIR.glob("*.parquet"):
        spark.read.parquet(str(f)).repartition(7).write.parquet(str(tmp_path / f.name))
    for name in ("bm25_topk", "groundedness", "hash_diff", "reconcile"):
        one, other = (entry.queries()[name](spark, d) for d in (str(DIR), str(tmp_path)))
        assert canonical(one.columns, one.collect()) == canonical(other.columns, other.collect())
