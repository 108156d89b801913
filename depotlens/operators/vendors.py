"""V1-V8: rule-based vendor assignment and vendor orders.

Rules are data: ``vendor_rules(rule_id, vendor, keyword)`` (duplicate rows
count again), ``vendors(vendor_rank, vendor, contact, phone)`` (rank breaks
score ties) and ``vendor_fallback(priority, term, vendor)`` (first priority
whose term occurs wins; a null term is the default).  Matching is substring
containment on ``lower(description) || ' ' || lower(material)``, no word
boundaries.  Work runs on distinct materials, never on movements.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.groups import join_null_safe
from depotlens.functions.joins import contains_join
from depotlens.functions.rounding import round_half_even
from depotlens.functions.text import word_count


def _texts(materials: DataFrame, by: list[str]) -> DataFrame:
    d = F.lower(F.coalesce(F.col("description"), F.lit("")))
    return materials.select(*by, "material_number", d.alias("_desc"),
                            F.concat(d, F.lit(" "), F.lower(F.col("material_number"))).alias("_text"))


def _keywords(rules: DataFrame) -> DataFrame:
    return rules.select("vendor", F.lower("keyword").alias("_pattern"), F.lit(None).cast("int").alias("priority"), F.lit(True).alias("_rule")).where("_pattern IS NOT NULL")


def _terms(fallback: DataFrame) -> DataFrame:
    return fallback.select("vendor", F.lower("term").alias("_pattern"), F.col("priority").cast("int").alias("priority"), F.lit(False).alias("_rule"))


def _points() -> Column:
    """Points of a rule hit: words in the keyword, doubled when it occurs in the description itself."""
    return word_count(F.col("_pattern")) * F.when(F.col("_desc").contains(F.col("_pattern")), F.lit(2)).otherwise(F.lit(1))


def vendor_scores(materials: DataFrame, rules: DataFrame, by: list[str] = ()) -> DataFrame:
    """V1: score per (material, vendor); points = words in the keyword, doubled
    when the keyword occurs in the description itself."""
    by = list(by)
    hits = contains_join(_texts(materials, by), "_text", _keywords(rules), "_pattern")
    return hits.groupBy(*by, "material_number", "vendor").agg(F.sum(_points()).cast("long").alias("score"))


def vendor_fallback_match(materials: DataFrame, fallback: DataFrame, by: list[str] = ()) -> DataFrame:
    """V2: first-priority fallback vendor per material (null term = default)."""
    by = list(by)
    hits = contains_join(_texts(materials, by), "_text", _terms(fallback), "_pattern")
    return hits.groupBy(*by, "material_number").agg(
        F.min_by("vendor", F.struct("priority", "vendor")).alias("fallback_vendor"))


def assign_vendor(materials: DataFrame, rules: DataFrame, vendors: DataFrame, fallback: DataFrame,
                  by: list[str] = ()) -> DataFrame:
    """V3: highest score, ties to the earlier vendor; no score -> fallback.

    Rules and fallback terms are one pattern table, so the texts are matched in one pass; a material's hits add up per vendor and then per material.
    """
    by = list(by)
    hits = contains_join(_texts(materials, by), "_text", _keywords(rules).unionByName(_terms(fallback)), "_pattern")
    score = F.sum(F.when(F.col("_rule"), _points())).cast("long")
    per_vendor = hits.groupBy(*by, "material_number", "vendor").agg(score.alias("score"), F.min(F.when(~F.col("_rule"), F.col("priority"))).alias("priority"))
    ranked = per_vendor.join(vendors.select("vendor", "vendor_rank"), "vendor", "left")
    rank = (-F.coalesce("vendor_rank", F.lit(2 ** 31 - 1))).alias("r")
    scored = F.col("score") > 0
    best = ranked.groupBy(*by, "material_number").agg(
        F.max(F.when(scored, F.struct("score", rank, "vendor"))).alias("_best"),
        F.min(F.when(F.col("priority").isNotNull(), F.struct("priority", "vendor"))).alias("_fallback"))
    out = join_null_safe(materials.select(*by, "material_number", "description"), best, [*by, "material_number"], "left")
    return out.select(*by, "material_number", "description",
                      F.coalesce("_best.vendor", "_fallback.vendor").alias("vendor"),
                      F.coalesce("_best.score", F.lit(0).cast("long")).alias("score"),
                      F.when(F.col("_best").isNull(), F.lit("fallback")).otherwise(F.lit("rules")).alias("basis"))


def vendor_catalog(assigned: DataFrame, vendors: DataFrame) -> DataFrame:
    """V4: every vendor (empty ones too) with contact and member count."""
    counts = assigned.groupBy("vendor").agg(F.count(F.lit(1)).alias("n"))
    return vendors.join(counts, "vendor", "left").select(
        "vendor_rank", "vendor", "contact", "phone", F.coalesce("n", F.lit(0)).cast("long").alias("materials"))


def vendor_members(assigned: DataFrame, vendors: DataFrame) -> DataFrame:
    """V4 member lists: every material under its vendor, by vendor and number."""
    return assigned.join(vendors.select("vendor", "vendor_rank"), "vendor", "left").select(
        "vendor_rank", "vendor", "material_number", "description")


def vendor_contact(assigned: DataFrame, vendors: DataFrame) -> DataFrame:
    """V7: contact and phone per assigned vendor, 'Not available' if unknown."""
    v = vendors.select("vendor", "contact", "phone")
    j = assigned.join(v, "vendor", "left")
    return j.select(*[c for c in assigned.columns],
                    F.coalesce("contact", F.lit("Not available")).alias("contact"),
                    F.coalesce("phone", F.lit("Not available")).alias("phone"))


def _money_sum(c) -> F.Column:
    """Order-independent sum of money: exact DECIMAL accumulation."""
    return F.sum(c.cast("decimal(38,10)")).cast("double")


def vendor_order_lines(basket: DataFrame, assigned: DataFrame, prices: DataFrame,
                       by: list[str] = ()) -> DataFrame:
    """V5 lines: basket lines with qty > 0 and a known material, re-priced."""
    by = list(by)
    lines = basket.where(F.col("quantity") > 0).select("session_id", "material_number", "quantity")
    known = assigned.select(*by, "material_number", "description", "vendor")
    j = lines.join(known, "material_number", "inner").join(prices.select(*by, "material_number", "max_unit_price"),
                                                             [*by, "material_number"], "left")
    price = F.coalesce("max_unit_price", F.lit(0.0))
    return j.select(*by, "session_id", "vendor", "material_number", "description",
                    F.col("quantity").cast("double").alias("quantity"),
                    round_half_even(price, 2).alias("unit_price"),
                    round_half_even(F.col("quantity") * price, 2).alias("total_price"),
                    (F.col("quantity") * price).alias("_raw_total"))


def vendor_orders(lines: DataFrame, vendors: DataFrame, by: list[str] = ()) -> DataFrame:
    """V5/V6: one record per (session, vendor): lines, total of unrounded line
    totals (rounded once), contact and phone.  Vendors without lines vanish."""
    by = list(by)
    agg = lines.groupBy(*by, "session_id", "vendor").agg(
        F.count(F.lit(1)).cast("long").alias("n_lines"),
        round_half_even(_money_sum(F.col("_raw_total")), 2).alias("total_value"))
    return _with_contact(agg, vendors).select(*by, "session_id", "vendor", "n_lines", "total_value", "contact", "phone")


def _with_contact(orders: DataFrame, vendors: DataFrame) -> DataFrame:
    v = vendors.select("vendor", F.coalesce("contact", F.lit("")).alias("contact"), F.coalesce("phone", F.lit("")).alias("phone"))
    return orders.join(v, "vendor", "left").withColumn("contact", F.coalesce("contact", F.lit(""))).withColumn("phone", F.coalesce("phone", F.lit("")))


#: Parts of an order whose lines are sorted separately before they are put together.
ORDER_SALTS = 32


def vendor_order_view(lines: DataFrame, vendors: DataFrame, by: list[str] = ()) -> DataFrame:
    """V6: one record per (session, vendor) with its lines as a nested array in the order of materials, total, contact and phone.

    A material belongs to one part of its order (by hash); each part gathers and sorts its lines, and the record puts the parts' sorted lists
    together, so gathering a large session's order is spread over ``ORDER_SALTS`` tasks; only the finished array is in one.
    """
    by = list(by)
    line = F.struct("material_number", "description", "quantity", "unit_price", "total_price")
    part = F.pmod(F.xxhash64("material_number"), F.lit(ORDER_SALTS)).cast("int")
    parts = lines.groupBy(*by, "session_id", "vendor", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_raw_total").cast("decimal(38,10)")).alias("total"), F.array_sort(F.collect_list(line)).alias("lines"))
    whole = parts.groupBy(*by, "session_id", "vendor").agg(
        F.sum("n").cast("long").alias("n_lines"), round_half_even(F.sum("total").cast("double"), 2).alias("total_value"),
        F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))
    return _with_contact(whole, vendors).select(*by, "session_id", "vendor", "n_lines", "total_value", "lines", "contact", "phone")


def edit_vendor_orders(lines: DataFrame, removals: DataFrame, by: list[str] = ()) -> DataFrame:
    """V8: drop removed lines, re-total as the sum of *rounded* line totals,
    vendors left without lines disappear."""
    by = list(by)
    kept = lines.join(removals.select("session_id", "material_number"), ["session_id", "material_number"], "left_anti")
    return kept.groupBy(*by, "session_id", "vendor").agg(
        F.count(F.lit(1)).cast("long").alias("n_lines"),
        round_half_even(_money_sum(F.col("total_price")), 2).alias("total_value"))
