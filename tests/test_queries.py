"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from glyphion.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(_plain, r)) for r in df.collect()) == Counter(tuple(_plain(r[i]) for i in at) for r in want.fetchall())


def test_latest_of_equal_rows(spark, tmp_path):
    """Lines equal in date and number: the first of the table stays, as arg_max has it, whatever its part."""
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    day, later = datetime.datetime(2000, 1, 1), datetime.datetime(2000, 1, 2)
    files = [[(1, 5, day, 3), (1, 9, day, 3), (2, 4, day, 1), (3, 1, later, 1)], [(1, 2, day, 3), (2, 7, day, 1), (2, 1, day, 1), (3, 8, day, 9), (4, 6, day, 1)]]
    (tmp_path / "lineitem.parquet").mkdir()
    for k, rows in enumerate(files):
        pq.write_table(pa.table(dict(zip(["l_orderkey", "l_partkey", "l_shipdate", "l_linenumber"], map(list, zip(*rows))))), tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    got = registry.QUERIES["q_insert_latest"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 5), (2, 4), (3, 1), (4, 6)]


def test_latest_on_a_table_with_ties(spark):
    c = duckdb.connect()
    c.sql("create view lineitem as select * from '/root/testdata/sf0.01/lineitem.parquet'")
    want = c.sql(registry.ORACLE_SQL["q_insert_latest"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["q_insert_latest"](spark, "/root/testdata/sf0.01").collect())) == sorted(want)


def test_entry():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
