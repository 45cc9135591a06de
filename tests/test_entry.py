import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    numbers = {int(n[1:]) for name in entry_point.queries() for n in name.split("_") if n[:1] == "o" and n[1:].isdigit()}
    assert {n for n in range(1, 56)} <= numbers


def test_entry(spark):
    got = entry_point.entry(spark)
    assert got.columns == ["lang", "removed_id", "kept_id", "distance", "similarity"] and got.count() > 0


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry_point.queries()[name](spark, sf)
    found = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted((tuple(repr(r[c]) for c in names) for r in df.collect()))
    assert rows == sorted(tuple(map(repr, r)) for r in found.fetchall())
