"""JSON records and report tables."""
from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions.rounding import finite_or_null


def _finite_inside(c: Column, kind: T.DataType) -> Column:
    """``c`` with every NaN and infinity in it null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return finite_or_null(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite_inside(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _finite_inside(v, kind.valueType))
    if isinstance(kind, T.StructType):
        inner = [_finite_inside(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*inner)) if inner else c
    return c


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row: dates as yyyy-MM-dd, NaN/inf as null,
    nested arrays/structs serialised recursively (``to_json``)."""
    cols = [_finite_inside(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"dateFormat": "yyyy-MM-dd",
                                                  "timestampFormat": "yyyy-MM-dd",
                                                  "ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S8 sink: newline-delimited JSON files."""
    json_records(df).write.mode(mode).text(path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write each report table under ``path/report=<name>``, in place."""
    for name, df in tables.items():
        df.write.mode(mode).format(fmt).save(f"{path}/report={name}")


def publish_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> str:
    """Write a set of report tables as one release; returns its name.

    Each table goes under ``path/release=<name>/report=<table>``; a manifest row (release, time, table, rows) per table is appended to ``path/manifest`` last, in one
    commit.  Readers go by the manifest, so a run that fails halfway leaves the release before it as it was.
    Tables of ``reports.full_report`` share one stored material table: the source is scanned once, when that is made.
    """
    if not tables:
        raise ValueError("a report needs at least one table")
    spark = next(iter(tables.values())).sparkSession
    release = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    entries = []
    for name, df in tables.items():
        place = f"{path}/release={release}/report={name}"
        df.write.format(fmt).save(place)
        entries.append((release, name, fmt, spark.read.format(fmt).load(place).count()))
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return release


MANIFEST = "release string, report string, format string, rows long"


def read_report(spark: SparkSession, path: str, release: str | None = None) -> dict[str, DataFrame]:
    """The tables of the newest complete release, or of the one named."""
    manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    chosen = release or manifest.agg(F.max("release")).first()[0]
    rows = manifest.where(F.col("release") == chosen).collect()  # a row per table of one report
    return {r.report: spark.read.format(r.format).load(f"{path}/release={chosen}/report={r.report}") for r in rows}
