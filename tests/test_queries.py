"""Every registered query against its SQL twin."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from queries import fixture as X, url_columns
from tests.compare import canon, compare, connection
from visitweave.operators import urls

SQL = entry_points.oracle_sql()
SINGLE = [n for n in SQL if n not in url_columns.COLUMNS]


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", SINGLE)
def test_same_as_sql(spark, sf, con, name):
    assert compare(entry_points.queries()[name](spark, sf), con, SQL[name]) is None


def test_url_columns_same_as_sql(spark, sf, con):
    """All derived URL columns from one enrichment."""
    dim = urls.enrich(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url"), "url", X.rules(spark))
    rows = dim.withColumn("first_tokens", F.slice("url_tokens", 1, 10)).collect()
    for name, (expr, _) in url_columns.COLUMNS.items():
        want = con.execute(SQL[name])
        names = [d[0] for d in want.description]
        got = [(r.page_id, "|".join(r[expr]) if isinstance(r[expr], list) else r[expr]) for r in rows]
        assert canon(["page_id", "value"], got) == canon(names, want.fetchall()), name


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["user_id", "event_id", "visit_rank"] and df.count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry_points.queries())
