"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry_points
from compare import mismatch, oracle_connection
from flowkeel.plans.catalog import QUERIES
from flowkeel.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert mismatch(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(entry_points.queries()) - set(entry_points.LLM_QUERIES) == set(QUERIES)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "metric" and df.count() == 5


def test_shard_report_totals(spark, sf_dir):
    from flowkeel.sources import tables

    report = QUERIES["shard_report"](spark, sf_dir).collect()
    assert sum(r["n_rows"] for r in report) == tables.table(spark, sf_dir, "lineitem").count()
