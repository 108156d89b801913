"""Stock status, coverage and order suggestions for a whole stock table.

``stock`` is ``(material_number, current_qty)`` optionally with the grouping
columns; one job scores every row.  A stock row without grouping columns is
scored against every group that knows the material (a plain equi-join on the
material number); rows whose material has no pattern anywhere come out once
with ``found = false``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.groups import join_null_safe
from depotlens.functions.rounding import round_half_even, trunc_long
from depotlens.functions.text import float_text, month_name
from depotlens.operators.normalise import to_number

# Recommendation texts per quantity status.
STATUS_ADVICE = {
    "Excess": "Consider reducing inventory levels",
    "Adequate": "Inventory levels are appropriate",
    "Low": "Consider reordering soon",
    "Critical": "Immediate reorder required",
}
# Advice for materials without consumption.
NON_MOVING_ADVICE = ["Order only when specifically needed", "Avoid routine ordering to prevent excess inventory"]
# CV interpretation bands (upper bounds, exclusive).
CV_BANDS = [(0.3, "Highly predictable demand"), (0.7, "Moderately predictable demand"),
            (1.2, "Variable demand pattern")]
CV_TOP_BAND = "Highly unpredictable demand"


def material_type(avg: Column) -> Column:
    """I1.  avg is an integer, so the Infrequent branch (0 < avg < 0.5) is dead."""
    return (F.when(avg == 0, "Non-Moving").when(avg < 0.5, "Infrequent")
            .when(avg < 2, "Slow-Moving").otherwise("Regular"))


def quantity_status(avg: Column, qty: Column) -> Column:
    """I2."""
    a = avg.cast("double")
    return (F.when(avg == 0, "No-Consumption").when(qty > a * F.lit(1.1), "Excess")
            .when(qty >= a, "Adequate").when(qty >= a * F.lit(0.5), "Low").otherwise("Critical"))


def coverage_months(avg: Column, qty: Column) -> Column:
    """round1(qty / avg); null (label "Unlimited") when avg = 0."""
    return F.when(avg != 0, round_half_even(qty / avg.cast("double"), 1))


def order_quantity(avg: Column, qty: Column) -> Column:
    """I4: avg < 2 -> 0, else max(0, int(avg * 1.1 - qty))."""
    return F.when(avg < 2, F.lit(0).cast("long")).otherwise(
        F.greatest(F.lit(0).cast("long"), trunc_long(avg.cast("double") * F.lit(1.1) - qty)))


def yearly_consumption(avg: Column, total: Column) -> Column:
    """I5."""
    return F.when(avg == 0, total).otherwise(avg * 12).cast("long")


def recommendations(mtype: Column, status: Column, yearly: Column) -> Column:
    """Array of advice texts."""
    advice = F.create_map(*[x for k, v in STATUS_ADVICE.items() for x in (F.lit(k), F.lit(v))])[status]
    annual = F.concat(F.lit("Annual consumption is "), yearly.cast("string"), F.lit(" units"))
    return (F.when(mtype == "Non-Moving", F.array(*[F.lit(t) for t in NON_MOVING_ADVICE]))
            .when(mtype.isin("Infrequent", "Slow-Moving"), F.array(advice, annual))
            .otherwise(F.array(advice)))


def cv_interpretation(cv: Column) -> Column:
    """I11."""
    e = None
    for bound, label in CV_BANDS:
        e = F.when(cv < bound, label) if e is None else e.when(cv < bound, label)
    return e.otherwise(CV_TOP_BAND)


def usage_label(avg: Column) -> Column:
    """Shown only for avg > 0."""
    return F.when(avg > 0, F.when(avg < 0.5, "Infrequent").when(avg < 2, "Slow-Moving").otherwise("Regular"))


def validate_stock(stock: DataFrame, qty_col: str = "current_qty") -> DataFrame:
    """Current quantity must be present, numeric and >= 0.

    Adds ``current_qty`` as double and ``input_error`` (null when valid).
    """
    raw = F.col(qty_col)
    num = to_number(raw)
    err = (F.when(raw.isNull(), F.lit("current quantity is required"))
           .when(num.isNull(), F.lit("current quantity must be a number"))
           .when(num < 0, F.lit("current quantity must not be negative")))
    return stock.withColumn("input_error", err).withColumn("current_qty", F.when(err.isNull(), num))


def _join_stock(pat: DataFrame, stock: DataFrame, by: list[str]) -> DataFrame:
    keys = [c for c in by if c in stock.columns] + ["material_number"]
    p = pat.withColumn("found", F.lit(True))
    j = stock.join(p, on=keys, how="left")
    # A stock row that matched nowhere keeps null group columns.
    return j.withColumn("found", F.coalesce("found", F.lit(False)))


def predict_inventory(pat: DataFrame, stock: DataFrame, vendor: DataFrame | None = None,
                      by: list[str] = ()) -> DataFrame:
    """I8 (with I1-I7): full status record per stock row.

    ``pat`` comes from ``material_patterns`` (it carries max_unit_price and the
    description).  ``vendor`` is ``assign_vendor`` output (material_number[, by],
    vendor); when given it is joined on the material.
    """
    by = list(by)
    s = validate_stock(stock)
    j = _join_stock(pat, s, by)
    avg = F.col("avg_monthly_consumption")
    q = F.col("current_qty")
    mtype = material_type(avg)
    status = quantity_status(avg, q)
    order = order_quantity(avg, q)
    yearly = yearly_consumption(avg, F.col("total_annual_consumption"))
    cv = F.when(avg == 0, F.lit(0.0)).otherwise(F.col("coefficient_of_variation"))
    ok = F.col("found") & F.col("input_error").isNull()
    out = j.select(
        *[c for c in by], "material_number", "found",
        F.when(~F.col("found"), F.lit("Material not found")).otherwise(F.col("input_error")).alias("error"),
        q.alias("current_quantity"),
        F.when(ok, avg).alias("avg_monthly_consumption"),
        F.when(ok, order).alias("order_quantity"),
        F.when(ok, round_half_even(F.col("max_unit_price"), 2)).alias("unit_price"),
        F.when(ok, round_half_even(order * F.col("max_unit_price"), 2)).alias("order_amount"),
        F.when(ok, coverage_months(avg, q)).alias("coverage_months"),
        F.when(ok & (avg == 0), F.lit("Unlimited")).alias("coverage_label"),
        F.when(ok, F.concat_ws(" - ", status, mtype)).alias("status"),
        F.when(ok, mtype).alias("material_type"),
        F.when(ok, status).alias("quantity_status"),
        F.when(ok, F.array_join(recommendations(mtype, status, yearly), " | ")).alias("recommendations"),
        F.when(ok, F.when(cv.isNull() | (cv < 0), F.lit("CV: N/A")).otherwise(F.format_string("CV: %.2f", cv)))
         .alias("demand_variability"),
        F.when(ok, yearly).alias("yearly_consumption"),
        F.when(ok, status.isin("Critical", "Low") & (order > 0)).alias("add_to_cart_eligible"),
        F.when(ok, F.col("description")).alias("description"),
        F.when(ok, F.col("max_unit_price")).alias("_max_unit_price"),
    )
    if vendor is not None:
        vkeys = [c for c in by if c in vendor.columns] + ["material_number"]
        out = join_null_safe(out, vendor.select(*vkeys, "vendor"), vkeys, "left")
        out = out.withColumn("vendor", F.when(F.col("found"), F.col("vendor")))
    return out


def recommendation_text(status: Column, cv: Column, avg: Column, qty: Column) -> Column:
    """Advice sentence from status and CV (> 1.0 is 'variable').  The sentences are fixed values."""
    a = avg.cast("double")
    optimal = trunc_long(a * F.lit(1.1))
    high = trunc_long(a * F.lit(1.3))
    var = cv > 1.0
    low = F.when(var, F.concat(F.lit("URGENT: Order "), float_text(high - qty), F.lit(" units. High variability - maintain "),
                               high.cast("string"), F.lit(" units.")))\
        .otherwise(F.concat(F.lit("Order "), float_text(optimal - qty), F.lit(" units. Target: "),
                            optimal.cast("string"), F.lit(" units.")))
    adequate = F.when(var, F.concat(F.lit("Stock adequate but monitor closely. Consider increasing to "),
                                    trunc_long(a * F.lit(1.2)).cast("string"), F.lit(" units before peak season.")))\
        .otherwise(F.concat(F.lit("Stock level appropriate. Maintain "), optimal.cast("string"), F.lit(" units as optimal.")))
    head = F.concat(F.lit("Excess stock. Current: "), float_text(qty), F.lit(", Optimal: "), optimal.cast("string"))
    excess = F.when(var, F.concat(head, F.lit(". Reduce ordering but keep extra due to variability.")))\
        .otherwise(F.concat(head, F.lit(". Stop ordering until stock reduces.")))
    return (F.when(status.isin("Low", "Critical"), low).when(status == "Adequate", adequate).otherwise(excess))


def predict_status_b(pat: DataFrame, stock: DataFrame, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """I9 (with I11, I12): status on the rounded-basis statistics; ``keep`` names
    stock columns to carry through."""
    by = list(by)
    s = validate_stock(stock)
    j = _join_stock(pat, s, by)
    avg = F.col("avg_monthly_consumption")
    a = avg.cast("double")
    q = F.col("current_qty")
    status = (F.when(q > a * F.lit(1.1), "Excess").when(q >= a, "Adequate")
              .when(q >= a * F.lit(0.5), "Low").otherwise("Critical"))
    order = F.when(q >= a, F.lit(0).cast("long")).otherwise(trunc_long(a * F.lit(1.1) - q))
    shortfall = F.greatest(F.lit(0.0), a - q)
    show_short = status.isin("Low", "Critical") & (shortfall > 0)
    cv = F.col("cv_rounded_basis")
    ok = F.col("found") & F.col("input_error").isNull()
    return j.select(
        *keep, *by, "material_number", "found",
        F.when(~F.col("found"), F.lit("Material number not found")).otherwise(F.col("input_error")).alias("error"),
        F.when(ok, F.coalesce("description", F.lit("N/A"))).alias("material_description"),
        q.alias("current_quantity"),
        F.when(ok, status).alias("status"),
        F.when(ok, avg).alias("avg_monthly_consumption"),
        F.when(ok & (avg > 0), round_half_even(q / a, 1)).alias("months_coverage"),
        F.when(ok, F.col("peak_consumption")).alias("peak_consumption"),
        F.when(ok, F.col("peak_month_name")).alias("peak_month"),
        F.when(ok, F.col("low_consumption")).alias("low_consumption"),
        F.when(ok, F.col("low_month_name")).alias("low_month"),
        F.when(ok, cv).alias("coefficient_of_variation"),
        F.when(ok, cv_interpretation(cv)).alias("cv_interpretation"),
        F.when(ok, recommendation_text(status, cv, avg, q)).alias("recommendation"),
        F.when(ok, order).alias("order_quantity"),
        F.when(ok, F.format_string("CV: %.2f", cv)).alias("demand_variability"),
        F.when(ok & show_short, shortfall).alias("shortfall"),
        F.when(ok & ~show_short & (q > a), q - a).alias("surplus"),
    )


def busy_slow_months(p1: DataFrame, by: list[str] = (), k: int = 3) -> DataFrame:
    """Top-k and bottom-k months by quantity among months with qty > 0.

    Ties go to the earlier month.  With fewer than k such months both lists are
    all of them in month order.  A material's months are one array of at most 12, sorted in
    place: no window, one exchange.
    """
    part = [*list(by), "material_number"]
    months = p1.where(F.col("qty") > 0).groupBy(*part).agg(F.collect_list(F.struct("month", "qty")).alias("a"))

    def ordered(rank) -> Column:
        keyed = F.transform("a", lambda x: F.struct(rank(x).alias("rank"), x["month"].alias("month"), x["qty"].alias("qty")))
        return F.array_sort(keyed)

    every = ordered(lambda x: F.lit(0.0))
    enough = F.size("a") >= k
    busy = F.when(enough, F.slice(ordered(lambda x: -x["qty"]), 1, k)).otherwise(every)
    slow = F.when(enough, F.slice(ordered(lambda x: x["qty"]), 1, k)).otherwise(every)
    sides = F.array(F.struct(F.lit("busy").alias("kind"), busy.alias("m")), F.struct(F.lit("slow").alias("kind"), slow.alias("m")))
    rows = months.select(*part, F.explode(sides).alias("s")).select(*part, "s.kind", F.posexplode("s.m").alias("i", "x"))
    return rows.select(*part, "kind", (F.col("i") + 1).cast("int").alias("position"), month_name(F.col("x.month")).alias("month_name"),
                       F.rint("x.qty").cast("long").alias("consumption"))
