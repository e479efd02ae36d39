"""Every registered query of the engine gives what its SQL gives, and the driver's contract holds."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


def rows(names, records):
    order = sorted(names)
    return sorted(repr([plain(dict(zip(names, r))[n]) for n in order]) for r in records)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


def test_image_regions_with_one_block_number(spark, tmp_path):
    """Order 3058 of sf0.01, whose last two lines make blocks of one number: the SQL's rows, with its tie settled by the box, in any row order."""
    lines = [(3058, 1220, 29, 1, 13.0), (3058, 1745, 77, 6, 40.0), (3058, 1745, 99, 6, 34.0)]
    sql = registry.oracle_sql()["image_regions"]
    assert sql.count("ORDER BY block_no)") == 1
    for i, given in enumerate((lines, lines[::-1])):
        made = spark.createDataFrame(given, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
        made.coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        got = registry.queries()["image_regions"](spark, f"{tmp_path}/{i}")
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/{i}/lineitem.parquet/*.parquet'")
        want = duck.execute(sql.replace("ORDER BY block_no)", "ORDER BY block_no, y0, x0, y1, x1)"))
        names = [d[0] for d in want.description]
        want = want.fetchall()
        assert sorted(r[names.index("y0")] for r in want) == [281.0, 687.0]
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
