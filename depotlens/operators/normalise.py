"""Turn raw movement rows into the typed ``movements`` table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.dates import parse_any_date
from depotlens.functions.numbering import serial_numbers
from depotlens.functions.text import clip_text, month_name
from depotlens.sources.ingest import DEPOT_COLUMN, require_columns, resolve_columns


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


#: What a number in text is made of: no type suffixes, no hexadecimal, no words, no exponent that overflows.
NUMBER = r"^[\s0-9.+-]{1,200}([eE][+-]?\d{1,2})?\s*$"


def to_number(c: Column) -> Column:
    """pandas ``to_numeric(errors='coerce')`` for finite numbers; anything else is null.

    Deviation: an infinite quantity or amount is no measurement and becomes null, not
    a value that would turn every statistic into NaN.
    """
    s = c.cast("string")
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def typed_columns(raw: DataFrame, roles: dict | None = None, keep: list[str] = ()) -> DataFrame:
    """N1-N7 without the validity filter: every raw row, typed; ``keep`` names raw columns to carry along."""
    roles = require_columns(roles or resolve_columns([c for c in raw.columns if c != "row_key"]))
    material = _q(roles["material"]).cast("string")                      # N5
    source = _q(roles["description"]).cast("string") if roles.get("description") else F.lit(None).cast("string")
    first = [F.col("row_key")] if "row_key" in raw.columns else []
    if DEPOT_COLUMN in raw.columns:                                      # N7
        first.append(_q(DEPOT_COLUMN).cast("string").alias("depot_name"))
    # What is read from text goes through a one-element ``inline``: filters on it are not pushed below, where each would read the text again.
    read = F.inline(F.array(F.struct(
        parse_any_date(_q(roles["date"])).alias("document_date"),        # N1
        F.abs(to_number(_q(roles["quantity"]))).alias("consumption_qty"),  # N2
        F.abs(to_number(_q(roles["amount"]))).alias("amount"))))         # N3
    rows = raw.select(*first, material.alias("material_number"), source.alias("source_description"), *[_q(c) for c in keep], read)
    qty, amount = F.col("consumption_qty"), F.col("amount")
    return rows.select(
        *[c for c in rows.columns if c in ("row_key", "depot_name")], "material_number",
        F.coalesce("source_description", "material_number").alias("material_description"),  # N6, per row
        "source_description",                                            # what "first non-null" looks at
        "document_date", "consumption_qty", "amount",
        F.when(qty > 0, amount / qty).otherwise(F.lit(0.0)).alias("unit_price"),  # N4
        *[_q(c) for c in keep])


def validity(c_qty: Column, c_amount: Column, c_material: Column, c_date: Column) -> Column:
    """N8 as one predicate."""
    # Comparisons with null are null, so qty > 0 and amount >= 0 also reject nulls.
    return (c_qty > 0) & (c_amount >= 0) & (c_material != "nan") & c_date.isNotNull()


def is_valid() -> Column:
    return validity(F.col("consumption_qty"), F.col("amount"), F.col("material_number"), F.col("document_date"))


def add_calendar(df: DataFrame) -> DataFrame:
    """Year, month, English month name, year-month."""
    d = F.col("document_date")
    return (df.withColumn("year", F.year(d)).withColumn("month", F.month(d))
            .withColumn("month_name", month_name(F.month(d)))
            .withColumn("year_month", F.date_format(d, "yyyy-MM")))


def normalise_movements(raw: DataFrame, roles: dict | None = None) -> DataFrame:
    """Typed, valid movement rows (the ``movements`` contract)."""
    return add_calendar(typed_columns(raw, roles).where(is_valid()))


def rejected_movements(raw: DataFrame, roles: dict | None = None) -> DataFrame:
    """Rows N8 drops, with the first failing reason (movements + rejects = raw)."""
    t = typed_columns(raw, roles)
    reason = (F.when(F.col("material_number").isNull() | (F.col("material_number") == "nan"), F.lit("material"))
              .when(F.col("document_date").isNull(), F.lit("date"))
              .when(F.col("consumption_qty").isNull() | (F.col("consumption_qty") <= 0), F.lit("quantity"))
              .when(F.col("amount").isNull() | (F.col("amount") < 0), F.lit("amount")))
    return t.where(~F.coalesce(is_valid(), F.lit(False))).withColumn("reason", reason)


def display_columns(df: DataFrame, order_by: list[str], desc_col: str = "description",
                    cv_col: str | None = "coefficient_of_variation", by: list[str] | None = None) -> DataFrame:
    """Serial number, description clipped to 40 chars, CV 0 shown as N/A.

    The serial number counts per ``by`` group, or over the whole table; see ``functions.numbering``.
    """
    out = serial_numbers(df, list(by or []), order_by).withColumn("description_short", clip_text(F.col(desc_col)))
    if cv_col:
        cv = F.col(cv_col)
        out = out.withColumn("cv_text", F.when(cv.isNull(), F.lit(None).cast("string"))
                             .when(cv == 0, F.lit("N/A")).otherwise(F.format_string("%.2f", cv)))
    return out
