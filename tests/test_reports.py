"""R2 as one set of tables from one pass, written and read back."""
import tempfile

import pytest
from pyspark.sql import functions as F

from depotlens.operators import catalog as K
from depotlens.operators import patterns as P
from depotlens.operators import reports as R
from depotlens.operators.normalise import normalise_movements
from depotlens.sources.sinks import publish_report, read_report, write_report
from helpers import raw_rows

ROWS = [("A", "05-01-2024", "2", "2", "first", "D1"), ("A", "06-02-2024", "30", "3", "later", "D1"), ("B", "07-03-2024", "4", "4", None, None),
        ("C", "bad", "1", "1", "idle", "D1"), ("B", "bad", "1", "1", "no movement here", "D2"), (None, "05-01-2024", "1", "1", "x", "D1")]


def test_full_report_set(spark):
    raw = raw_rows(spark, ROWS)
    by = ["depot_name"]
    tables = R.full_report(raw, by)
    path = tempfile.mkdtemp(prefix="report-", dir="/tmp") + "/out"
    publish_report(tables, path)
    back = {n: t.collect() for n, t in read_report(spark, path).items()}
    assert back.keys() == tables.keys()
    write_report(tables, path + "-plain")
    assert all(sorted(map(tuple, spark.read.parquet(f"{path}-plain/report={n}").collect()), key=repr) == sorted(map(tuple, rows), key=repr) for n, rows in back.items())
    summary = {r.depot_name: r for r in back["summary"]}
    assert summary["D1"].total_materials == 1 and summary["D1"].non_moving_items == 1 and summary["D1"].date_range == "05-01-2024 to 06-02-2024"
    assert summary[None].total_materials == 1 and summary[None].non_moving_items == 0
    assert {(r.depot_name, r.material_number) for r in back["non_moving"]} == {("D1", "C"), ("D2", "B")}
    assert {(r.depot_name, r.material_number) for r in K.non_moving_materials(raw, by).collect()} == {("D1", "C"), ("D2", "B")}
    assert {(r.depot_name, r.material_number, r.description) for r in back["tier_detail"]} == {("D1", "A", "first"), (None, "B", "B")}


def test_overview_and_patterns_agree_with_the_direct_forms(spark):
    raw = raw_rows(spark, ROWS)
    mv = normalise_movements(raw)
    for by in ([], ["depot_name"]):
        table = R.material_table(raw, by).where("n_valid > 0")
        assert sorted(map(tuple, P.overview_from_slots(table, by).drop("idle_materials").collect()), key=repr) == sorted(map(tuple, P.dataset_overview(mv, by).collect()), key=repr)
        assert sorted(map(tuple, P.patterns_from_slots(table, by).collect()), key=repr) == sorted(map(tuple, P.material_patterns(mv, by).collect()), key=repr)


def test_failed_run_leaves_the_old_release(spark):
    path = tempfile.mkdtemp(prefix="report-", dir="/tmp") + "/out"
    good = spark.range(3)
    first = publish_report({"a": good, "b": good}, path)
    broken = good.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        publish_report({"a": spark.range(9), "b": broken}, path)
    assert {n: t.count() for n, t in read_report(spark, path).items()} == {"a": 3, "b": 3}
    second = publish_report({"a": spark.range(5)}, path, "orc")
    assert second > first and {n: t.count() for n, t in read_report(spark, path).items()} == {"a": 5}
    assert read_report(spark, path, first)["b"].count() == 3


def test_one_pass_over_the_source(spark):
    path = tempfile.mkdtemp(prefix="scan-", dir="/tmp") + "/in"
    raw_rows(spark, ROWS).write.parquet(path)
    for df in R.full_report(spark.read.parquet(path), ["depot_name"]).values():
        df.collect()
        assert path not in df._jdf.queryExecution().executedPlan().toString()  # the stored material table is all that is read
