import datetime as dt

import pytest
from pyspark.sql import functions as F

from depotlens.functions.dates import parse_any_date
from depotlens.operators.normalise import normalise_movements, rejected_movements
from depotlens.sources.ingest import MissingColumnsError, require_columns, resolve_columns
from helpers import raw_rows


def test_dates_golden(spark):
    cases = {
        "5-1-2024": dt.date(2024, 1, 5), "05-01-2024": dt.date(2024, 1, 5), "2024-01-05": dt.date(2024, 1, 5),
        "2024-1-5": dt.date(2024, 1, 5), "03/04/2024": dt.date(2024, 3, 4), "25/12/2024": dt.date(2024, 12, 25),
        "2024-01-05T10:11:12": dt.date(2024, 1, 5), "05-01-24": None, "hello": None, None: None,
        "31-02-2024": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.d for r in df.select("s", parse_any_date(F.col("s")).alias("d")).collect()}
    assert got == cases


def test_resolve_columns():
    r = resolve_columns(["Name 1", "MATERIAL", "Material Description", "Posting Date", "Qty", "Total Price"])
    assert r == {"date": "Posting Date", "quantity": "Qty", "material": "MATERIAL",
                 "description": "Material Description", "amount": "Total Price"}
    # partial-name match and a missing optional description
    r = resolve_columns(["doc_date_x", "the_quantity", "material_code", "line_amount"])
    assert r["date"] == "doc_date_x" and r["quantity"] == "the_quantity"
    assert r["material"] == "material_code" and r["amount"] == "line_amount" and r["description"] is None
    # case collision: last column wins
    assert resolve_columns(["amount", "AMOUNT", "date", "qty", "item"])["amount"] == "AMOUNT"
    with pytest.raises(MissingColumnsError):
        require_columns(resolve_columns(["date", "qty", "item"]))


def test_quantities_materials(spark):
    raw = raw_rows(spark, [
        ("1", "01-01-2024", "-5", "10"),     # negative -> abs, valid
        ("2", "01-01-2024", "0", "10"),      # zero -> rejected
        ("3", "01-01-2024", "x", "10"),      # text -> rejected
        ("4", "01-01-2024", None, "10"),     # null -> rejected
        (None, "01-01-2024", "1", "10"),     # null material -> rejected
        ("nan", "01-01-2024", "1", "10"),    # 'nan' -> rejected
        ("7", "n/a", "1", "10"),             # bad date -> rejected
        ("8", "01-01-2024", "2", None),      # no amount -> rejected
        ("9", "01-01-2024", "4", "-8"),      # amount abs -> valid, unit price 2
    ])
    mv = normalise_movements(raw)
    got = {r.material_number: (r.consumption_qty, r.unit_price) for r in mv.collect()}
    assert got == {"1": (5.0, 2.0), "9": (4.0, 2.0)}
    rej = {r.material_number: r.reason for r in rejected_movements(raw).collect() if r.material_number}
    assert rej == {"2": "quantity", "3": "quantity", "4": "quantity", "nan": "material", "7": "date", "8": "amount"}
    assert mv.count() + rejected_movements(raw).count() == raw.count()


def test_calendar_and_description_fallback(spark):
    raw = raw_rows(spark, [("1", "15-03-2023", "1", "1", None)])
    r = normalise_movements(raw).collect()[0]
    assert (r.year, r.month, r.month_name, r.year_month) == (2023, 3, "March", "2023-03")
    assert r.material_description == "1"
