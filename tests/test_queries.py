"""Every registered query of the engine: against its SQL where it has one, else that it runs and returns rows."""

from __future__ import annotations

import pytest

from quarry.plans import catalog
from tests.compare import same_as_sql
from tests.conftest import SMALL

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same_as_sql(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_eval_cases_scan_reads_all_passages(spark):
    at = "/root/testdata/sf0.1"
    assert QUERIES["eval_cases_scan"](spark, at).count() == spark.read.parquet(f"{at}/benchmark.parquet").count()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
