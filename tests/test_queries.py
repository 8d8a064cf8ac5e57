"""Every registered query runs; where there is oracle SQL the rows agree."""

import os

import duckdb
import pytest

from scholia.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 4)
    return str(value) if not isinstance(value, (int, bool)) else int(value)


def rows(records, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    columns = sorted(df.columns)
    if name not in registry.oracle_sql():
        assert got
        return
    relation = oracle.sql(registry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    want = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert rows(got, columns) == rows(want, columns)
