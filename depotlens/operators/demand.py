"""H1-H2: high-demand months and top consumers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depotlens.functions.groups import attach_group
from depotlens.functions.quantiles import exact_quantiles
from depotlens.functions.rounding import trunc_long
from depotlens.functions.text import month_name
from depotlens.operators.patterns import monthly_from_slots, slot_table


def high_demand_by_month(mv: DataFrame, by: list[str] = (), q: float = 0.75, top: int = 50) -> DataFrame:
    """H1: per month in M, materials at or above the q-quantile of that month's
    consumption over *all* materials of the group (zeros included), the top
    ``top`` by quantity (ties: material order), then zero rows dropped.

    The zeros are not materialised: each (group, month) gets one weighted zero
    row (frequency = materials without movement that month) and the distributed exact
    quantile interpolates over the full column.  The
    top-k is ``row_number() <= top`` which Spark plans as a WindowGroupLimit
    (partial top-k before the shuffle), so no task holds a whole month.  All of it reads one stored slot table.
    """
    by = list(by)
    slots = slot_table(mv, by)
    p1 = monthly_from_slots(slots, by)
    n_mat = slots.groupBy(*by).agg(F.count(F.lit(1)).alias("n_mat"))
    per_month = p1.groupBy(*by, "month").agg(F.count(F.lit(1)).alias("n_obs"))
    zeros = attach_group(per_month, n_mat, by).where(F.col("n_mat") > F.col("n_obs")).select(
        *by, "month", F.lit(0.0).alias("qty"), (F.col("n_mat") - F.col("n_obs")).alias("freq"))
    col = p1.select(*by, "month", "qty", F.lit(1).cast("long").alias("freq")).unionByName(zeros)
    th = exact_quantiles(col, [*by, "month"], "qty", {"threshold": q}, weight="freq")
    cand = attach_group(p1, th, [*by, "month"]).where(F.col("qty") >= F.col("threshold"))
    w = Window.partitionBy(*by, "month").orderBy(F.col("qty").desc(), F.col("material_number"))
    ranked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return ranked.where(F.col("qty") > 0).select(
        *by, F.col("month").cast("int").alias("month"), month_name(F.col("month")).alias("month_name"),
        "rank", "material_number", trunc_long(F.col("qty")).alias("consumption"),
        trunc_long(F.col("qty") * F.lit(1.1)).alias("recommended_stock"), "threshold")


def top_consumers(pat: DataFrame, by: list[str] = (), n: int = 10) -> DataFrame:
    """H2: the n largest avg per group (ties: material order) with avg and total.

    One group: ``orderBy(...).limit(n)`` (TakeOrderedAndProject: per-partition
    top-n, then merge).  Per group: ``row_number() <= n`` (WindowGroupLimit).
    """
    by = list(by)
    order = [F.col("avg_monthly_consumption").desc(), F.col("material_number")]
    cols = ["material_number", "avg_monthly_consumption", "total_annual_consumption"]
    if not by:
        top = pat.select(*cols).orderBy(*order).limit(n)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*by).orderBy(*order)
    return pat.select(*by, *cols).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
