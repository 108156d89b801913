"""Six demand tiers from avg quantiles and the CV."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.contracts import TIERS
from depotlens.functions.groups import attach_group, join_null_safe
from depotlens.functions.quantiles import exact_quantiles
from depotlens.functions.stored import stored
from depotlens.functions.text import month_name


def tier_thresholds(pat: DataFrame, by: list[str] = ()) -> DataFrame:
    """80th and 50th percentile (linear) of the rounded avg per group."""
    return exact_quantiles(pat, list(by), "avg_monthly_consumption", {"p80": 0.8, "p50": 0.5})


def tier_expr(avg: Column, cv: Column, p80: Column, p50: Column) -> Column:
    """Tier; a null CV counts as stable."""
    var = F.coalesce(cv >= 1.0, F.lit(False))
    return (F.when(avg >= p80, F.when(var, "HD_Variable").otherwise("HD_Critical"))
            .when(avg >= p50, F.when(var, "MD_Seasonal").otherwise("MD_Regular"))
            .otherwise(F.when(var, "LD_Sporadic").otherwise("LD_Stable")))


def classify_materials(pat: DataFrame, by: list[str] = (), cv_col: str = "coefficient_of_variation") -> DataFrame:
    """Pattern rows plus ``tier`` (and the thresholds used).  The patterns are worked out once, for the thresholds and the rows."""
    by = list(by)
    pat = stored(pat)
    th = tier_thresholds(pat, by)
    j = attach_group(pat, th, by)
    return j.withColumn("tier", tier_expr(F.col("avg_monthly_consumption"), F.col(cv_col), F.col("p80"), F.col("p50")))


def tier_counts(classified: DataFrame, by: list[str] = ()) -> DataFrame:
    """Count per tier, all six tiers present for every group."""
    by = list(by)
    counts = classified.groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("n"))
    tiers = F.array(*[F.lit(t) for t in TIERS])
    if by:
        grid = classified.select(*by).distinct().select(*by, F.explode(tiers).alias("tier"))
    else:
        grid = classified.sparkSession.range(1).select(F.explode(tiers).alias("tier"))
    return join_null_safe(grid, counts, [*by, "tier"], "left").select(
        *by, "tier", F.coalesce("n", F.lit(0)).cast("long").alias("materials"))


def tier_detail(classified: DataFrame, by: list[str] = ()) -> DataFrame:
    """C4: one row per tier member with the report fields."""
    by = list(by)
    avg = F.col("avg_monthly_consumption")
    return classified.select(
        *by, "tier", "material_number",
        F.coalesce("description", F.lit("N/A")).alias("description"),
        avg.alias("avg_consumption"),
        F.col("total_annual_consumption").alias("total_consumption"),
        F.coalesce(month_name(F.col("peak_month")), F.lit("N/A")).alias("peak_month"),
        F.col("coefficient_of_variation"),
        F.when(avg > 0, (avg.cast("double") * F.lit(1.1)).cast("long")).otherwise(F.lit(0).cast("long"))
         .alias("coverage_needed"),
    )


def tier_detail_lite(pat: DataFrame, by: list[str] = ()) -> DataFrame:
    """Tiers on the rounded-basis CV, members with avg, total, cv."""
    by = list(by)
    c = classify_materials(pat, by, cv_col="cv_rounded_basis")
    return c.select(*by, "tier", "material_number", F.coalesce("description", F.lit("N/A")).alias("description"),
                    F.col("avg_monthly_consumption").alias("avg_consumption"),
                    F.col("total_annual_consumption").alias("total_consumption"),
                    F.col("cv_rounded_basis").alias("coefficient_of_variation"))
