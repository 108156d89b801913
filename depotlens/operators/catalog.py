"""Catalog search, first-row dedupe, non-moving materials."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depotlens.functions.dates import parse_any_date
from depotlens.functions.joins import contains_join
from depotlens.functions.text import month_name
from depotlens.operators.normalise import is_valid, to_number, typed_columns
from depotlens.operators.patterns import first_description
from depotlens.operators.stock import predict_status_b

RAW_MATERIAL = "Material"
RAW_DESCRIPTION = "Material Description"


def dedupe_first(df: DataFrame, key: str, order: str = "row_key") -> DataFrame:
    """K4: keep the first row per key in input order.

    ``row_number() == 1`` is planned as a WindowGroupLimit: every map partition
    keeps one row per key before the shuffle, so a hot key costs one row, not
    all of its rows, in the reduce task.
    """
    w = Window.partitionBy(F.col(key)).orderBy(F.col(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def search_movements(raw: DataFrame, mv: DataFrame, query: str = "", limit: int = 50) -> DataFrame:
    """K1: regex search over raw movement rows, one row per material (its first
    row), first ``limit`` materials in input order, with the max unit price.

    The query is a case-insensitive Java regex on material OR description;
    empty = all rows.  Quantity and amount are the raw signed values (null ->
    0.0); rows whose quantity/amount text is not a number or whose date does
    not parse are dropped after the limit.  Null materials show as 'nan'.
    """
    mat = F.coalesce(F.col(f"`{RAW_MATERIAL}`").cast("string"), F.lit("nan"))
    desc = F.coalesce(F.col(f"`{RAW_DESCRIPTION}`").cast("string"), F.lit("nan"))
    r = raw.select("row_key", mat.alias("material_number"), desc.alias("description"),
                   F.col("Quantity").alias("_q"), F.col("Amount").alias("_a"), F.col("`Document Date`").alias("_d"))
    if query:
        pat = "(?i)" + query
        r = r.where(F.col("material_number").rlike(pat) | F.col("description").rlike(pat))
    first = dedupe_first(r, "material_number").orderBy("row_key").limit(limit)
    hits = F.broadcast(first.select("material_number"))  # at most ``limit`` rows
    prices = mv.join(hits, "material_number", "left_semi").groupBy("material_number").agg(
        F.max(F.when(F.col("amount") > 0, F.col("amount") / F.col("consumption_qty"))).alias("_p"))
    q, a = to_number(F.col("_q")), to_number(F.col("_a"))
    d = parse_any_date(F.col("_d"))
    ok = (F.col("_q").isNull() | q.isNotNull()) & (F.col("_a").isNull() | a.isNotNull()) & d.isNotNull()
    out = first.join(prices, "material_number", "left").where(ok)
    return out.select(
        "material_number", "description",
        F.coalesce(q, F.lit(0.0)).alias("quantity"), F.coalesce(a, F.lit(0.0)).alias("amount"),
        F.coalesce("_p", F.lit(0.0)).alias("unit_price"),
        F.date_format(d, "yyyy-MM-dd").alias("date"), month_name(F.month(d)).alias("month"),
        F.year(d).cast("long").alias("year"), F.col("row_key"))


def search_catalog(materials: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """K2: literal case-insensitive contains on number or description; query of
    at least 2 characters; first ``limit`` hits in material-number order.
    (The source's scan cap over the first 1,000 materials is a speed shortcut
    and is not reproduced: every material is searched.)"""
    if not query or len(query) < 2:
        return materials.limit(0).select("material_number", "description")
    q = query.lower()
    hit = F.lower("material_number").contains(q) | F.lower(F.coalesce("description", F.lit(""))).contains(q)
    return materials.where(hit).select("material_number", "description").orderBy("material_number").limit(limit)


def search_ranked(materials: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """K3 (+H3): first ``limit`` description hits in material order, *then*
    sorted: prefix matches first, then shorter descriptions (stable)."""
    if not text or len(text) < 2:
        return materials.limit(0).select("material_number", "description", F.lit(0).alias("rank"))
    q = text.lower().strip()
    d = F.lower(F.coalesce("description", F.lit("")))
    hits = materials.where(d.contains(q)).orderBy("material_number").limit(limit)
    order = [(~F.lower("description").startswith(q)).cast("int"), F.length("description"), F.col("material_number")]
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(
        "material_number", "description", "rank")


def resolve_requests(requests: DataFrame, materials: DataFrame, limit: int = 10) -> DataFrame:
    """Each request text -> direct_match / single_match / multiple_matches
    / no_matches, with the resolved material when there is exactly one and the
    ordered matches when there are several.

    Exact numbers are an equi-join.  The rest probe descriptions with a
    contains join (requests are the small, checked side), keep the first
    ``limit`` hits per request in material order (WindowGroupLimit) and count.
    """
    req = requests.select("request_id", "text", "current_qty")
    direct = req.join(materials.select(F.col("material_number").alias("text"), F.lit(True).alias("_direct")),
                      "text", "left")
    probe = req.where(F.length("text") >= 2).select(
        "request_id", F.lower(F.trim("text")).alias("_q"))
    texts = materials.select("material_number", "description",
                             F.lower(F.coalesce("description", F.lit(""))).alias("_d"))
    hits = contains_join(texts, "_d", probe, "_q")
    w = Window.partitionBy("request_id").orderBy("material_number")
    top = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    cnt = top.groupBy("request_id").agg(  # at most ``limit`` rows a request
        F.count(F.lit(1)).alias("match_count"), F.min("material_number").alias("_only"),
        F.array_sort(F.collect_list(F.struct("material_number", "description"))).alias("_matches"))
    j = direct.join(cnt, "request_id", "left")
    n = F.coalesce("match_count", F.lit(0))
    kind = (F.when(F.col("_direct"), F.lit("direct_match")).when(n == 0, F.lit("no_matches"))
            .when(n == 1, F.lit("single_match")).otherwise(F.lit("multiple_matches")))
    resolved = F.when(F.col("_direct"), F.col("text")).when(n == 1, F.col("_only"))
    return j.select("request_id", "text", "current_qty", kind.alias("match_type"),
                    resolved.alias("material_number"),
                    F.when(F.col("_direct"), F.lit(1)).otherwise(n).cast("long").alias("match_count"),
                    F.when(kind == "multiple_matches", F.col("_matches")).alias("matches"))


def request_matches(resolved: DataFrame) -> DataFrame:
    """The match lists of I13 as rows, in order."""
    return resolved.select("request_id", F.posexplode("matches").alias("_i", "_m")).select(
        "request_id", (F.col("_i") + 1).alias("position"), "_m.material_number", "_m.description")


def predict_requests(resolved: DataFrame, pat: DataFrame) -> DataFrame:
    """I13 + I9: each request with the status of its resolved material and quantity.

    The prediction carries ``request_id``, so equal requests stay one row each.
    """
    asked = resolved.where(F.col("material_number").isNotNull() & F.col("current_qty").isNotNull())
    pred = predict_status_b(pat, asked.select("request_id", "material_number", "current_qty"), keep=["request_id"])
    pred = pred.select("request_id", F.col("status").alias("predicted_status"), F.col("order_quantity").alias("predicted_order"))
    return resolved.join(pred, "request_id", "left").select(*resolved.columns, "predicted_status", "predicted_order")


def non_moving_materials(raw: DataFrame, by: list[str] = ()) -> DataFrame:
    """K5: materials present in the raw rows with no valid movement, with their
    first raw description: one aggregate over one pass of the raw rows."""
    by = list(by)
    cand = typed_columns(raw).where(F.col("material_number").isNotNull() & (F.col("material_number") != "nan"))
    seen = cand.groupBy(*by, "material_number").agg(
        F.max(F.coalesce(is_valid(), F.lit(False))).alias("_active"), first_description().alias("description"))
    return seen.where(~F.col("_active")).select(*by, "material_number", F.coalesce("description", F.lit("N/A")).alias("description"))


def non_moving_report(raw: DataFrame, by: list[str] = ()) -> DataFrame:
    """K6: K5 with zeroed statistics and status Non-Moving."""
    nm = non_moving_materials(raw, by)
    return nm.select(*list(by), "material_number", "description",
                     F.lit(0).cast("long").alias("avg_consumption"), F.lit(0).cast("long").alias("total_consumption"),
                     F.lit("N/A").alias("peak_month"), F.lit(0.0).alias("coefficient_of_variation"),
                     F.lit(0).cast("long").alias("coverage_needed"), F.lit("Non-Moving").alias("status"))
