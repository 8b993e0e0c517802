"""Every registered query against its SQL, and the shape of those without."""

import os

import pytest

from tableprobe.operators.jobs import run_jobs
from tableprobe.plans.catalog import ORACLES, QUERIES
from tableprobe.plans.tables import table
from tests.oracle import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"classification_report", "kmeans_report"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_job_report_runs_all_four(spark):
    rows = run_jobs(table(spark, SF_DIR, "orders")).orderBy("job_order").collect()
    assert [r["job"] for r in rows] == ["regression", "classification", "clustering", "timeSeries"]
    assert not any(r["skipped"] for r in rows)
    assert len(rows[3]["sample"]) == 10
    assert len(rows[2]["centers"]) == 3
