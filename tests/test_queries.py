"""Every query of the library's own operators against its SQL."""

import math

import duckdb
import pytest

from __spark_entry__ import queries as every_query
from weftline.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
assert every_query()  # importing the entry registers all queries
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(want.columns)
    a = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    place = [want.columns.index(c) for c in order]
    b = sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=repr)
    assert len(a) == len(b) and (a or name in ("price_outliers",))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not bad, bad[:3]


def test_rows_of_a_feed_are_made_by_many_tasks(spark):
    """A small file of keys is read by one task."""
    from weftline.sources.tables import feed

    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1 and feed(spark, SF).rdd.getNumPartitions() == 4


def test_tags_of_the_catalog_are_not_sent_out(spark):
    """Files of items are small and hold many: no join of outfits with them builds a table in memory; groups are collected by many tasks."""
    from weftline.plans.outfit_tags import _outfits

    assert _outfits(spark, SF).rdd.getNumPartitions() == 4
    plan = QUERIES["derived_tag_scores"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
