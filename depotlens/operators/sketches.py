"""C1, P7 at scale: mergeable sketches per (group, month) instead of exact counts and quantiles.

``sketch_table`` is one pass over the movements: per group and month the rows, an HLL sketch of the materials and a KLL sketch of the quantities.  The table is stored; any
coarser grouping merges its sketches, so a new period or depot costs no pass over the movements, and next month's rows add to it.

Errors: a distinct count is off by 1.04 / sqrt(2^HLL_BITS) (1.6 %, one standard deviation); the rank of a KLL quantile by at most ``rank_error()`` (0.26 % of the rows) with 99 % probability.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.stored import stored

HLL_BITS = 12
KLL_K = 1024


def rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a KLL quantile, 99 % (fixed values: the sketch's published fit)."""
    return 2.296 / k ** 0.9723


def _kll(function: str, *args: Column) -> Column:
    return F.call_function(function, *args)


def sketch_table(mv: DataFrame, by: list[str] = ()) -> DataFrame:
    """Stored: (by, year_month, n, materials, quantities, first_date, last_date)."""
    return stored(mv.groupBy(*list(by), "year_month").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("material_number", F.lit(HLL_BITS)).alias("materials"),
        _kll("kll_sketch_agg_double", F.col("consumption_qty"), F.lit(KLL_K)).alias("quantities"),
        F.min("document_date").alias("first_date"), F.max("document_date").alias("last_date")))


def merged(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sketches of all rows of each group of ``by``."""
    return table.groupBy(*list(by)).agg(F.sum("n").alias("n"), F.hll_union_agg("materials").alias("materials"),
                                        _kll("kll_merge_agg_double", F.col("quantities"), F.lit(KLL_K)).alias("quantities"),
                                        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def approximate_overview(table: DataFrame, by: list[str] = (), quantiles: dict[str, float] | None = None) -> DataFrame:
    """P7 and A1's quantile from a sketch table: rows and dates are exact, materials and quantiles approximate."""
    named = quantiles or {"p50": 0.5, "p80": 0.8, "p99": 0.99}
    return merged(table, by).select(
        *by, F.hll_sketch_estimate("materials").cast("long").alias("materials"), F.col("n").alias("valid_rows"),
        F.date_format("first_date", "dd-MM-yyyy").alias("start_date"), F.date_format("last_date", "dd-MM-yyyy").alias("end_date"),
        *[_kll("kll_sketch_get_quantile_double", F.col("quantities"), F.lit(q).cast("double")).alias(name) for name, q in named.items()])


def approximate_thresholds(pat: DataFrame, by: list[str] = (), parts: int = 64) -> DataFrame:
    """C1 from sketches: p80 and p50 of the averages per group.  Sketches are built in ``parts`` parts of a group and merged, so a hot group is spread."""
    avg = F.col("avg_monthly_consumption").cast("double")
    part = F.pmod(F.xxhash64("material_number"), F.lit(parts)).alias("_part")
    sketches = pat.groupBy(*list(by), part).agg(_kll("kll_sketch_agg_double", avg, F.lit(KLL_K)).alias("s"))
    whole = sketches.groupBy(*list(by)).agg(_kll("kll_merge_agg_double", F.col("s"), F.lit(KLL_K)).alias("s"))
    return whole.select(*by, *[_kll("kll_sketch_get_quantile_double", F.col("s"), F.lit(q).cast("double")).alias(n) for n, q in (("p80", 0.8), ("p50", 0.5))])
