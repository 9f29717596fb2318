"""Every registered query against its SQL, and the shape of the plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry
import compare

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_with_sql_is_registered():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in SQL:
        assert QUERIES[name](spark, FOLDER).count() > 0
        return
    problem, _ = compare.compare(spark, con, FOLDER, name, QUERIES[name], SQL[name])
    assert problem is None


PLANS = ["bucket_posterior", "click_admission", "dead_letters", "family_update", "estimator_quality", "calibration_bands"]


@pytest.mark.parametrize("name", PLANS)
def test_no_cross_join(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search("CartesianProduct|BroadcastNestedLoop", plan)


def test_scans_are_pruned(spark):
    plan = QUERIES["triplet_counts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(event_type" in plan and "value" not in re.search("ReadSchema: (.*)", plan)[1]
