"""A1-A3: unusually high consumption rows.

One aggregate over the movements counts each value (per group, or per group and material with its first description) and is stored; mean, deviation, the quantile
and everything said about the unusual rows come from it.  Only A2, which returns rows, looks at the movements a second time.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.groups import attach_group
from depotlens.functions.quantiles import exact_quantiles
from depotlens.functions.rounding import round_half_even, trunc_long
from depotlens.functions.stored import stored
from depotlens.operators.patterns import exact_sum


def value_table(mv: DataFrame, by: list[str] = (), materials: bool = False) -> DataFrame:
    """(by[, material_number], consumption_qty, n[, first]): how often each quantity occurs; ``first``: its first description in input order, with its row key."""
    keys = [*by, *(["material_number"] if materials else []), "consumption_qty"]
    d = F.col("source_description")
    first = [F.min(F.when(d.isNotNull(), F.struct(F.col("row_key").alias("k"), d.alias("d")))).alias("first")] if materials else []
    return stored(mv.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *first))


def weighted_sum(value: Column, n: Column) -> Column:
    """Sum over rows of which ``n`` hold ``value``."""
    return exact_sum(value * n)


def statistics_of(values: DataFrame, by: list[str] = ()) -> DataFrame:
    """A1 from a value table."""
    by = list(by)
    q, n = F.col("consumption_qty"), F.col("n")
    mean = values.groupBy(*by).agg(F.sum(n).alias("n_rows"), (weighted_sum(q, n) / F.sum(n)).alias("mean"))
    j = attach_group(values.groupBy(*by, "consumption_qty").agg(F.sum(n).alias("n")), mean, by)
    spread = F.sum(n * (q - F.col("mean")) * (q - F.col("mean")))
    std = F.when(F.first("n_rows") > 1, F.sqrt(spread / (F.first("n_rows") - 1)))
    s = j.groupBy(*by).agg(F.first("mean").alias("mean"), std.alias("std"), F.first("n_rows").alias("n_rows"))
    s = attach_group(s, exact_quantiles(values, by, "consumption_qty", {"q99": 0.99}, weight="n"), by)
    return s.withColumn("threshold", F.greatest(F.col("q99"), F.col("mean") + F.lit(3.0) * F.col("std")))


def qty_statistics(mv: DataFrame, by: list[str] = ()) -> DataFrame:
    """A1: mean, std (ddof 1), p99 (linear, exact and distributed) of row
    quantities and the threshold max(p99, mean + 3 std)."""
    return statistics_of(value_table(mv, by), by)


def anomaly_rows(mv: DataFrame, by: list[str] = (), stats: DataFrame | None = None) -> DataFrame:
    """A2: rows with quantity strictly above the group threshold."""
    by = list(by)
    stats = stats if stats is not None else qty_statistics(mv, by)
    j = attach_group(mv, stats.select(*by, "threshold"), by)
    return j.where(F.col("consumption_qty") > F.col("threshold"))


def detect_anomalies(mv: DataFrame, by: list[str] = ()) -> DataFrame:
    """A3: per material over anomalous rows: count, max, mean (round2 then
    int), first description, label and the threshold used."""
    by = list(by)
    values = value_table(mv, by, materials=True)
    q, n = F.col("consumption_qty"), F.col("n")
    high = attach_group(values, statistics_of(values, by).select(*by, "threshold"), by).where(q > F.col("threshold"))
    return high.groupBy(*by, "material_number").agg(
        F.coalesce(F.min("first")["d"], F.col("material_number")).alias("description"),
        trunc_long(F.max(q)).alias("max_consumption"),
        trunc_long(round_half_even(weighted_sum(q, n) / F.sum(n), 2)).alias("avg_high_consumption"),
        F.sum(n).cast("long").alias("high_consumption_instances"),
        F.lit("Unusually High Consumption").alias("anomaly_type"),
        trunc_long(F.first("threshold")).alias("threshold_used"),
    )


def anomaly_summary(mv: DataFrame, by: list[str] = ()) -> DataFrame:
    """A1 + totals: threshold, q99, mean, std (ints) and total anomalous rows."""
    by = list(by)
    values = value_table(mv, by)
    stats = stored(statistics_of(values, by))
    over = F.sum(F.when(F.col("consumption_qty") > F.col("threshold"), F.col("n")))
    count = attach_group(values, stats.select(*by, "threshold"), by, is_stored=True).groupBy(*by).agg(over.alias("over"))
    return attach_group(stats, count, by, "left").select(
        *by, trunc_long(F.col("threshold")).alias("threshold_high"), trunc_long(F.col("q99")).alias("q99_percentile"),
        trunc_long(F.col("mean")).alias("mean"), trunc_long(F.col("std")).alias("std"), F.coalesce("over", F.lit(0)).cast("long").alias("total_anomalous_records"))
