import glob
import importlib
import os

import pytest

SF = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")


def _text(v):
    if v is None or v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _rows(cursor_rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_text(r[i]) for i in order) for r in cursor_rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("q")))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert _rows(df.collect(), df.columns) == _rows(cur.fetchall(), [c[0] for c in cur.description])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
