"""Summary and full-report tables (one flat table per section)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.contracts import TIERS
from depotlens.functions.groups import attach_group
from depotlens.functions.quantiles import exact_quantiles
from depotlens.functions.rounding import round_half_even
from depotlens.functions.stored import stored
from depotlens.operators import demand as H
from depotlens.operators import patterns as P
from depotlens.operators import segments as C
from depotlens.operators.normalise import is_valid, typed_columns


def _group_figures(table: DataFrame, by: list[str]) -> DataFrame:
    """Per group: materials, dates, idle materials, high-velocity items, mean and the six tier counts."""
    avg = F.col("avg_monthly_consumption")
    pat = stored(P.patterns_from_slots(_active(table), by).select(*by, avg, "coefficient_of_variation"))
    limits = exact_quantiles(pat, by, "avg_monthly_consumption", {"p_hv": 0.9, "p80": 0.8, "p50": 0.5})
    tier = C.tier_expr(avg, F.col("coefficient_of_variation"), F.col("p80"), F.col("p50"))
    figures = attach_group(pat, limits, by).withColumn("tier", tier).groupBy(*by).agg(
        F.count(F.when(avg >= F.col("p_hv"), 1)).cast("long").alias("high_velocity_items"),
        F.avg(avg).cast("long").alias("avg_monthly_consumption"),
        *[F.count(F.when(F.col("tier") == t, 1)).cast("long").alias(t.lower()) for t in TIERS])
    return attach_group(P.overview_from_slots(table, by).where("unique_materials > 0"), figures, by)


def material_table(raw: DataFrame, by: list[str] = (), with_description: bool = False) -> DataFrame:
    """One pass over the raw rows: the stored slot table of every named material, movements or not (``n_valid`` 0)."""
    rows = typed_columns(raw).where(F.col("material_number").isNotNull() & (F.col("material_number") != "nan"))
    return P.slot_table(rows.withColumn("month", F.month("document_date")), list(by), with_description, is_valid())


def _active(table: DataFrame) -> DataFrame:
    return table.where("n_valid > 0")


def summary_report(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """R1 from ``material_table``: one row per group: materials, date range, high-velocity items,
    int(mean avg) and the six tier counts (top consumers: ``top_consumers``)."""
    by = list(by)
    return _group_figures(table, by).select(
        *by, F.col("unique_materials").alias("total_materials"), F.concat_ws(" to ", "start_date", "end_date").alias("date_range"),
        "high_velocity_items", "avg_monthly_consumption", *[t.lower() for t in TIERS])


def efficiency_score(hd_critical, md_regular, materials):
    """round1((HD_Critical + MD_Regular) / max(materials, 1) * 100)."""
    return round_half_even((hd_critical + md_regular) / F.greatest(materials, F.lit(1)) * F.lit(100.0), 1)


def full_report_summary(table: DataFrame, by: list[str] = ()) -> DataFrame:
    """R2 summary section from ``material_table``, with R3 (efficiency score), R4 (cost-optimisation
    count) and the non-moving item count."""
    by = list(by)
    return _group_figures(table, by).select(
        *by, F.col("unique_materials").alias("total_materials"),
        F.concat_ws(" to ", "start_date", "end_date").alias("date_range"), "high_velocity_items",
        (F.col("ld_stable") + F.col("ld_sporadic")).alias("cost_optimization_potential"),
        efficiency_score(F.col("hd_critical"), F.col("md_regular"), F.col("unique_materials"))
        .alias("inventory_efficiency_score"),
        F.col("idle_materials").alias("non_moving_items"))


def full_report(raw: DataFrame, by: list[str] = ()) -> dict[str, DataFrame]:
    """R2 as a whole: every report table by name, for ``sinks.write_report``.

    All tables come from one stored material table, the only pass over the raw rows.
    """
    by = list(by)
    table = material_table(raw, by, with_description=True)
    pat = P.patterns_from_slots(_active(table), by, with_description=True)
    classified = C.classify_materials(pat, by)
    return {
        "summary": full_report_summary(table, by),
        "tiers": C.tier_counts(classified, by),
        "tier_detail": C.tier_detail(classified, by),
        "top_consumers": H.top_consumers(pat, by),
        "peak_months": P.peak_month_histogram(pat, by),
        "seasonal": P.seasonal_overview(pat, by),
        "non_moving": table.where("n_valid = 0").select(*by, "material_number", "description"),
    }
