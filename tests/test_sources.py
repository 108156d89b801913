"""Scans, column roles and sinks: round trips and dirty values."""
import datetime
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from depotlens.operators import depots
from depotlens.operators.normalise import normalise_movements
from depotlens.sources import ingest, sinks

HEAD = ["Name 1", "Material", "Material Description", "Document Date", "Quantity", "Amount"]
ROWS = [("D1", "007", "bolt", "05-01-2024", "2", "4.5"), (None, "8", None, "2024-01-06", "5d", "1"), ("D2", "9", "rod", "20240107", "3", "x")]


def written(spark, fmt):
    path = tempfile.mkdtemp(prefix="scan-", dir="/tmp") + "/in"
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], ", ".join(f"`{c}` string" for c in HEAD) + ", line int")
    df.coalesce(1).write.options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)
    return path


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_scan_round_trip(spark, fmt):
    raw = ingest.scan_movements(spark, written(spark, fmt), fmt, key_columns=["line"])
    assert {f.dataType.simpleString() for f in raw.schema.fields if f.name in HEAD} == {"string"}
    got = sorted(raw.select(*[f"`{c}`" for c in HEAD]).collect(), key=lambda r: r["Material"])
    assert [tuple(r) for r in got] == ROWS
    assert [r.material_number for r in normalise_movements(raw).collect()] == ["007"]


@pytest.mark.parametrize("fmt", ["csv", "json", "orc", "parquet"])
def test_row_order_does_not_depend_on_splits(spark, fmt):
    """Text sources of several files, cut into splits of two sizes: keys sort rows as the files hold them."""
    path = tempfile.mkdtemp(prefix="scan-", dir="/tmp") + "/in"
    rows = spark.range(0, 4000, 1, 3).select(F.col("id").cast("string").alias("Material"), F.format_string("text %d, \"quoted\" é", "id").alias("Material Description"),
                                             F.lit("05-01-2024").alias("Document Date"), F.lit("1").alias("Quantity"), F.lit("2").alias("Amount"))
    rows.write.options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)
    for most in ("4k", "1m"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            raw = ingest.scan_movements(spark, path, fmt)
            assert fmt in ("orc", "parquet") or most == "1m" or raw.rdd.getNumPartitions() > 20
            assert [r[0] for r in raw.orderBy("row_key").select("Material").collect()] == [str(i) for i in range(4000)]
            if fmt in ("csv", "json"):
                got = ingest.row_numbers(raw).select("row_key.file", "row_key.row", F.col("Material").cast("long").alias("m")).collect()
                first = {f: min(r.m for r in got if r.file == f) for f in {r.file for r in got}}
                assert len(got) == 4000 and all(r.row == r.m - first[r.file] for r in got)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_source_and_missing_columns(spark):
    with pytest.raises(ingest.EmptySourceError):
        ingest.require_rows(spark.range(0))
    with pytest.raises(ingest.MissingColumnsError):
        ingest.require_columns(ingest.resolve_columns(["Material", "Quantity"]))


def test_roles():
    got = ingest.resolve_columns(["posting_date", "Document Date", "QTY", "my item material", "Price", "PRICE"])
    assert got == {"date": "Document Date", "quantity": "QTY", "material": "my item material", "description": None, "amount": "PRICE"}
    assert ingest.resolve_columns(["amount total", "An Amount"])["amount"] == "amount total"


def test_unknown_depot_lists_all(spark):
    df = spark.range(1500).select(F.concat(F.lit("Depot "), F.col("id")).alias("Name 1"))
    with pytest.raises(depots.UnknownDepotError) as e:
        depots.filter_depot_exact(df, "nowhere")
    assert "Depot 1499" in str(e.value) and depots.filter_depot_exact(df, "Depot 3").count() == 1


def test_json_cleans_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, [1.0, inf, None], ([nan, 2.0], datetime.date(2024, 1, 5)), {"a": -inf, "b": 3.0}), (2, 1.5, None, None, None)],
                               "id int, x double, xs array<double>, s struct<ys:array<double>,d:date>, m map<string,double>")
    path = tempfile.mkdtemp(prefix="json-", dir="/tmp") + "/out"
    sinks.write_json(df, path)
    got = sorted((json.loads(r.value) for r in spark.read.text(path).collect()), key=lambda r: r["id"])
    assert got[0] == {"id": 1, "x": None, "xs": [1.0, None, None], "s": {"ys": [None, 2.0], "d": "2024-01-05"}, "m": {"a": None, "b": 3.0}}
    assert got[1] == {"id": 2, "x": 1.5, "xs": None, "s": None, "m": None}


def test_report_tables(spark):
    path = tempfile.mkdtemp(prefix="report-", dir="/tmp") + "/out"
    tables = {"one": spark.range(3), "two": spark.createDataFrame([("a", 1.5)], "k string, v double")}
    sinks.write_report(tables, path)
    for name, df in tables.items():
        assert sorted(spark.read.parquet(f"{path}/report={name}").collect()) == sorted(df.collect())
