"""Every query against its SQL in DuckDB, on the smallest tables, with different partition counts."""

import math

import duckdb
import pytest
from regionflow.plans import catalog

from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    got = rows_of(df.select(*columns).collect())
    assert got == rows_of(duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())
    assert got or name in ("worst_leaks",)


@pytest.mark.parametrize("name", ["greedy_dedupe", "confirmed_boxes", "associate_best", "timeline_flagship"])
def test_same_with_other_partitions(spark, name):
    query, found = catalog.queries()[name], []
    for n in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = query(spark, SMALL)
        found.append(rows_of(df.select(*sorted(df.columns)).collect()))
    assert found[0] == found[1]


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
