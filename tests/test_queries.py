"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from mensura.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if a is None or b is None or isinstance(a, str | bool):
        return a == b
    return abs(a - b) <= 1e-6 * max(1, abs(a), abs(b)) if isinstance(a, int | float) else str(a) == str(b)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    compare(registry.queries()[name](spark, SF), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.aside()))
def test_what_reads_no_table(spark, duck, name):
    query, sql = registry.aside()[name]
    df = query(spark, SF)
    assert df.count() > 0 and name not in registry.queries()
    if sql:
        compare(df, duck, sql)


def compare(df, duck, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(sql)
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    want = sorted((tuple(r[at[c]] for c in cols) for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    if got != want:
        assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
