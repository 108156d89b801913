"""Monthly consumption and per-material statistics.

Semantics.  Per group (``by``), M is the set of calendar months (1..12, years
collapsed) in which *any* material has a valid movement.  Every material is
seen over all of M with zeros filled in, so mean/std/min run over |M| values.

Plan.  One partial+final aggregation turns movements into one row per
(group, material) holding twelve month sums (null = no movement that month), the highest price, counts, dates and, where asked for, the description.
A slot row is wide, so without descriptions the movements are first dealt by material (``_dealt``): a task then holds the slots of its own materials only.
This slot table is stored (``slot_table``) and everything else reads it, so the movements are scanned once whatever a query needs of them.
M per group is a tiny aggregate over it, attached null-safe by ``attach_group``.  The statistics are plain expressions over the twelve
columns, taken in month order: no material x month cross join, no arrays, no Python.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.groups import attach_group, join_null_safe
from depotlens.functions.quantiles import exact_quantiles
from depotlens.functions.rounding import finite_or_zero, round_half_even
from depotlens.functions.stored import stored
from depotlens.functions.text import month_name


#: Values from this size on are added as doubles: their last digit is above a hundred, and a DECIMAL total of others has room for 10^10 rows.
LARGE = 1e18


def exact_sum(c: Column) -> Column:
    """Sum that does not depend on the order of rows: DECIMAL with ten places, double result.  Values of ``LARGE`` and more are added as doubles."""
    small = F.abs(c) < LARGE
    exact, rest = F.sum(F.when(small, c).cast("decimal(38,10)")).cast("double"), F.sum(F.when(~small, c))
    return F.coalesce(exact + rest, exact, rest)


def first_description() -> Column:
    """First non-null source description in input order; needs ``row_key``."""
    d = F.col("source_description")
    return F.min(F.when(d.isNotNull(), F.struct(F.col("row_key").alias("k"), d.alias("d"))))["d"]


def monthly_consumption(mv: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sum of quantity by (group, material, month)."""
    by = list(by)
    return mv.groupBy(*by, "material_number", "month").agg(exact_sum(F.col("consumption_qty")).alias("qty"))


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with those of a (group, material) together, in partitions of the session's advisory size.

    Adaptive execution cuts a partition that is larger, so a hot material is spread over tasks; what bounds a task is that size and not the number
    of materials.  The rows are dealt by a hash and not by the keys themselves: the aggregate then still combines the parts of a material that was cut.
    """
    return rows.withColumn("_deal", F.hash(*by, "material_number")).hint("rebalance", "_deal")


def month_slots(rows: DataFrame, by: list[str], with_description: bool = False, valid: Column | None = None) -> DataFrame:
    """One row per (group, material): twelve month sums (null = no movement
    that month), the max positive unit price (P11), number and date range of movements.

    ``rows`` are valid movements, or all typed rows with ``valid`` saying which count; then
    materials without any movement keep a row with ``n_valid`` 0.  Only fixed-width buffers, so this is a plain HashAggregate with map-side
    partial aggregation (P1 folded in).  Without descriptions the rows are dealt by material first, which leaves about one partial row
    per material to shuffle.
    """
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    if not with_description:
        rows = _dealt(rows.select(*by, "material_number", "month", "consumption_qty", "amount", "document_date", ok.alias("_ok")), by)
        ok = F.col("_ok")
    q = F.when(ok, F.col("consumption_qty"))
    aggs = [exact_sum(F.when(F.col("month") == i, q)).alias(f"_q{i}") for i in range(1, 13)]
    aggs.append(F.max(F.when(F.col("amount") > 0, F.col("amount") / q)).alias("max_price"))
    day = F.when(ok, F.col("document_date"))
    aggs += [F.count(F.when(ok, 1)).alias("n_valid"), F.min(day).alias("first_date"), F.max(day).alias("last_date")]
    if with_description:
        # P6 folded into the same pass: the string buffer makes this a
        # sort-based partial aggregate, still one read of the movements
        # instead of a second full pass for the descriptions.
        if valid is not None:
            d = F.when(ok, F.col("source_description"))
            first = F.min(F.when(d.isNotNull(), F.struct(F.col("row_key").alias("k"), d.alias("d"))))["d"]
        else:
            first = first_description()
        aggs.append(F.coalesce(first, F.col("material_number")).alias("description"))
    return rows.groupBy(*by, "material_number").agg(*aggs)


MONTHS = range(1, 13)


def active_months(slots: DataFrame, by: list[str] = ()) -> DataFrame:
    """M per group: one flag per month, whether any material has a movement in it."""
    return slots.groupBy(*list(by)).agg(*[F.coalesce(F.max(F.col(f"_q{i}").isNotNull()), F.lit(False)).alias(f"_m{i}") for i in MONTHS])


def _fold(terms: list[Column]) -> Column:
    """Sum in the order of the months, so that results do not depend on the plan."""
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def slot_table(rows: DataFrame, by: list[str] = (), with_description: bool = False, valid: Column | None = None) -> DataFrame:
    """``month_slots``, stored: the one pass over the movements that every statistic of a query shares."""
    return stored(month_slots(rows, list(by), with_description, valid))


def monthly_from_slots(slots: DataFrame, by: list[str] = ()) -> DataFrame:
    """P1 from the slot table."""
    months = F.array(*[F.struct(F.lit(i).alias("month"), F.col(f"_q{i}").alias("qty")) for i in range(1, 13)])
    return (slots.select(*by, "material_number", F.explode(months).alias("m")).select(*by, "material_number", "m.month", "m.qty")
            .where(F.col("qty").isNotNull()))


def material_patterns(mv: DataFrame, by: list[str] = (), with_description: bool = False) -> DataFrame:
    """P2-P5, P11 in one table, one row per (group, material).

    Columns: n_months (|M|), observed_months, total_qty, mean_qty, std_qty
    (unrounded, ddof 1, null when |M| = 1), avg_monthly_consumption,
    total_annual_consumption, peak/low month and consumption, both CV variants,
    max_unit_price and, with ``with_description``, the first description in
    input order (P6, computed in the same pass).
    """
    by = list(by)
    return patterns_from_slots(slot_table(mv, by, with_description), by, with_description)


def patterns_from_slots(slots: DataFrame, by: list[str] = (), with_description: bool = False) -> DataFrame:
    """P2-P5, P11 from the slot table of active materials."""
    by = list(by)
    q = [F.col(f"_q{i}") for i in MONTHS]
    in_m = [F.col(f"_m{i}") for i in MONTHS]
    zero = F.lit(0.0)
    extra = ["description"] if with_description else []
    j = attach_group(slots, active_months(slots, by), by)
    j = j.withColumn("n_months", _fold([m.cast("int") for m in in_m]).cast("int"))
    j = j.withColumn("observed_months", _fold([x.isNotNull().cast("int") for x in q]).cast("int"))
    j = j.withColumn("total_qty", _fold([F.coalesce(x, zero) for x in q]))
    j = j.withColumn("mean_qty", F.col("total_qty") / F.col("n_months"))
    off = [F.coalesce(x, zero) - F.col("mean_qty") for x in q]
    ss = _fold([F.when(m, d * d).otherwise(zero) for m, d in zip(in_m, off)])
    j = j.withColumn("std_qty", F.when(F.col("n_months") > 1, F.sqrt(ss / (F.col("n_months") - 1))))
    j = j.withColumn("_peak", F.greatest(*q)).withColumn("_low", F.least(*q))
    peak_qty, low_obs = F.col("_peak"), F.col("_low")

    def first(hits: list[Column]) -> Column:
        """The earliest month for which a condition holds."""
        return F.coalesce(*[F.when(h, F.lit(i)) for i, h in zip(MONTHS, hits)])

    peak_month = first([x == peak_qty for x in q])
    gap = first([m & x.isNull() for m, x in zip(in_m, q)])
    has_zero = F.col("observed_months") < F.col("n_months")
    low_month = F.when(has_zero, gap).otherwise(first([x == low_obs for x in q]))
    avg = F.rint(F.col("mean_qty")).cast("long")
    std_r = F.coalesce(F.rint(F.col("std_qty")).cast("long"), F.lit(0).cast("long"))
    cv_b = F.when(avg > 0, round_half_even(std_r / avg, 2)).otherwise(F.lit(0.0))
    out = j.select(
        *by,
        "material_number",
        "n_months",
        "observed_months",
        "total_qty",
        "mean_qty",
        "std_qty",
        avg.alias("avg_monthly_consumption"),
        F.rint(F.col("total_qty")).cast("long").alias("total_annual_consumption"),
        peak_month.alias("peak_month"),
        month_name(peak_month).alias("peak_month_name"),
        F.rint(peak_qty).cast("long").alias("peak_consumption"),
        low_month.cast("int").alias("low_month"),
        month_name(low_month).alias("low_month_name"),
        F.when(has_zero, F.lit(0)).otherwise(F.rint(low_obs)).cast("long").alias("low_consumption"),
        # Variant A: unrounded std / unrounded mean, 0 when mean <= 0, null when |M| = 1.
        F.when(F.col("mean_qty") > 0, round_half_even(F.col("std_qty") / F.col("mean_qty"), 2))
         .otherwise(F.lit(0.0)).alias("coefficient_of_variation"),
        # Variant B: rounded std / rounded avg, non-finite -> 0.
        std_r.alias("consumption_std"),
        cv_b.alias("cv_rounded_basis"),
        finite_or_zero(F.col("max_price")).alias("max_unit_price"),  # N11
        *extra,
    )
    return out


def materials_dim(mv: DataFrame, by: list[str] = ()) -> DataFrame:
    """First non-null description per material in input order.

    "First" needs the row order, so this is a min over (row_key, description);
    the string in the buffer makes Spark use a sort-based partial aggregate.
    It is kept out of the hot P1 aggregation for that reason.
    """
    by = list(by)
    return mv.groupBy(*by, "material_number").agg(F.coalesce(first_description(), F.col("material_number")).alias("description"))


def material_facts(mv: DataFrame, by: list[str] = ()) -> DataFrame:
    """P6 and P11 in one pass, stored: (by, material_number, description, max_unit_price)."""
    price = F.max(F.when((F.col("amount") > 0) & (F.col("consumption_qty") > 0), F.col("amount") / F.col("consumption_qty")))
    return stored(mv.groupBy(*list(by), "material_number").agg(F.coalesce(first_description(), F.col("material_number")).alias("description"),
                                                               finite_or_zero(price).alias("max_unit_price")))


def max_unit_price(mv: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per material max(amount / qty) over rows with both > 0, else 0.0."""
    by = list(by)
    return mv.groupBy(*by, "material_number").agg(
        finite_or_zero(F.max(F.when((F.col("amount") > 0) & (F.col("consumption_qty") > 0),
                                    F.col("amount") / F.col("consumption_qty")))).alias("max_unit_price"))


def dataset_overview(mv: DataFrame, by: list[str] = (), approx: bool = False) -> DataFrame:
    """Distinct materials and the date range (dd-MM-yyyy)."""
    by = list(by)
    n = F.approx_count_distinct("material_number") if approx else F.countDistinct("material_number")
    return mv.groupBy(*by).agg(
        n.cast("long").alias("unique_materials"),
        F.count(F.lit(1)).cast("long").alias("valid_rows"),
        F.date_format(F.min("document_date"), "dd-MM-yyyy").alias("start_date"),
        F.date_format(F.max("document_date"), "dd-MM-yyyy").alias("end_date"),
    )


def overview_from_slots(slots: DataFrame, by: list[str] = ()) -> DataFrame:
    """P7 from the slot table, with the number of materials that have no movement (``idle_materials``)."""
    active = F.col("n_valid") > 0
    return slots.groupBy(*list(by)).agg(
        F.count(F.when(active, 1)).cast("long").alias("unique_materials"), F.count(F.when(~active, 1)).cast("long").alias("idle_materials"),
        F.sum("n_valid").cast("long").alias("valid_rows"),
        F.date_format(F.min("first_date"), "dd-MM-yyyy").alias("start_date"),
        F.date_format(F.max("last_date"), "dd-MM-yyyy").alias("end_date"))


def seasonal_overview(pat: DataFrame, by: list[str] = ()) -> DataFrame:
    """Materials analysed, int(mean avg), top material (first on ties)."""
    by = list(by)
    avg = F.col("avg_monthly_consumption")
    top = F.min_by("material_number", F.struct((-avg).alias("a"), F.col("material_number").alias("m")))
    return pat.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("materials_analyzed"),
        F.avg(avg).cast("long").alias("avg_consumption_overall"),
        top.alias("most_consumed_material"),
        F.max(avg).cast("long").alias("most_consumed_avg"),
    )


def high_velocity_count(pat: DataFrame, by: list[str] = (), q: float = 0.9) -> DataFrame:
    """Materials whose avg is at or above the q-quantile (linear) of avg."""
    by = list(by)
    pat = stored(pat.select(*by, "avg_monthly_consumption"))
    th = exact_quantiles(pat, by, "avg_monthly_consumption", {"p_hv": q})
    j = attach_group(pat, th, by)
    return j.groupBy(*by).agg(F.count(F.when(F.col("avg_monthly_consumption") >= F.col("p_hv"), 1))
                              .cast("long").alias("high_velocity_items"))


def peak_month_histogram(pat: DataFrame, by: list[str] = ()) -> DataFrame:
    """P10: always 12 rows per group: materials peaking in each month."""
    by = list(by)
    counts = pat.groupBy(*by, F.col("peak_month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    if by:
        grid = pat.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    else:
        grid = pat.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    out = join_null_safe(grid, counts, [*by, "month"], "left")
    return out.select(*by, F.col("month").cast("int").alias("month"), month_name(F.col("month")).alias("month_name"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("peak_materials"),
                      F.lit(0).cast("long").alias("total_consumption"))
