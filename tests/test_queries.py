"""Driver contract and whole-pipeline properties on the smallest test tables."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMOKE


def test_contract_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "quantity_status" in df.columns


def test_depot_slice_equals_filtered_run(spark):
    q = E.queries()
    whole = q["patterns_by_depot"](spark, SMOKE).where(F.col("depot_name") == "ASIA Depot").drop("depot_name")
    alone = q["depot_patterns_exact"](spark, SMOKE)
    assert sorted(whole.collect()) == sorted(alone.collect())


def test_tier_counts_sum(spark):
    q = E.queries()
    n = q["patterns"](spark, SMOKE).count()
    assert sum(r.materials for r in q["tier_counts"](spark, SMOKE).collect()) == n
