"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the shared parquet tables through the fixture derivation and
runs the library operators over the whole tables.  Grain suffix ``_by_depot``
means ``by=["depot_name"]`` (all depots in one job); no suffix is one group.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.functions.stored import stored
from depotlens.operators import normalise as N
from depotlens.operators import patterns as P
from depotlens.operators import segments as C
from depotlens.operators import stock as I
from depotlens.operators import vendors as V
from depotlens.plans.output import flat, nullable_ints_as_double
from depotlens.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DEPOT = ["depot_name"]


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        QUERIES[name].__name__ = name
        return fn
    return deco


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normalise_movements(fx.movements_raw(spark, sf_dir))


PATTERN_COLS = ["material_number", "n_months", "observed_months", "avg_monthly_consumption",
                "total_annual_consumption", "peak_month", "peak_month_name", "peak_consumption", "low_month",
                "low_month_name", "low_consumption", "coefficient_of_variation", "consumption_std",
                "cv_rounded_basis", "max_unit_price"]


PREDICT_INTS = ["avg_monthly_consumption", "order_quantity", "yearly_consumption"]
STATUS_INTS = ["avg_monthly_consumption", "peak_consumption", "low_consumption", "order_quantity"]


def _assigned(spark, sf_dir, mats=None, by=()):
    """V3 over stored material facts (those of all movements unless given)."""
    mats = mats if mats is not None else P.material_facts(movements(spark, sf_dir), list(by))
    return V.assign_vendor(mats, fx.vendor_rules(spark), fx.vendors(spark), fx.vendor_fallback(spark), list(by))


# -- N: movement normalisation ------------------------------------------------
@query("movements")
def q_movements(spark, sf_dir):
    """Typed valid movement rows."""
    return movements(spark, sf_dir).drop("row_key", "source_description")


# -- P: patterns --------------------------------------------------------------
@query("patterns")
def q_patterns(spark, sf_dir):
    """P2-P6, P11 over all rows as one group."""
    return P.material_patterns(movements(spark, sf_dir)).select(*PATTERN_COLS)


@query("patterns_by_depot")
def q_patterns_by_depot(spark, sf_dir):
    """P2-P6, P11 per depot in one job."""
    return P.material_patterns(movements(spark, sf_dir), DEPOT).select("depot_name", *PATTERN_COLS)


# -- C: tiers -----------------------------------------------------------------
@query("tier_counts")
def q_tier_counts(spark, sf_dir):
    """C1-C3, one group."""
    pat = P.material_patterns(movements(spark, sf_dir))
    return C.tier_counts(C.classify_materials(pat))


@query("tier_counts_by_depot")
def q_tier_counts_by_depot(spark, sf_dir):
    """C1-C3 per depot."""
    pat = P.material_patterns(movements(spark, sf_dir), DEPOT)
    return C.tier_counts(C.classify_materials(pat, DEPOT), DEPOT)


# -- I: stock -----------------------------------------------------------------
@query("predict_inventory")
def q_predict_inventory(spark, sf_dir):
    """I1-I8 for every stock row, one group, with vendor (V3)."""
    return _predictions(spark, sf_dir)


def _predictions(spark, sf_dir, by=()):
    """Patterns, descriptions and vendors of all materials from one slot table."""
    slots = P.slot_table(movements(spark, sf_dir), by, with_description=True)
    pat = P.patterns_from_slots(slots, by, with_description=True)
    vendor = _assigned(spark, sf_dir, slots.select(*by, "material_number", "description"), by)
    out = I.predict_inventory(pat, fx.stock(spark, sf_dir), vendor, by).drop("_max_unit_price")
    return nullable_ints_as_double(out, PREDICT_INTS)


# -- more N / S: sources, cleaning, depots --------------------------------------
from depotlens.operators import anomalies as A  # noqa: E402
from depotlens.operators import baskets as B  # noqa: E402
from depotlens.operators import catalog as K  # noqa: E402
from depotlens.operators import demand as H  # noqa: E402
from depotlens.operators import depots as S  # noqa: E402
from depotlens.operators import reports as R  # noqa: E402
from depotlens.sources import ingest  # noqa: E402

FOCUS_DEPOT = "ASIA Depot"


@query("movement_rejects")
def q_movement_rejects(spark, sf_dir):
    """Rows dropped by the validity rule, counted by first failing reason."""
    rej = N.rejected_movements(fx.movements_raw(spark, sf_dir))
    return rej.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("profile_source")
def q_profile_source(spark, sf_dir):
    """Resolved roles, column list, row and depot counts, first rows."""
    return ingest.profile_source(fx.movements_raw(spark, sf_dir))


@query("depot_patterns_exact")
def q_depot_patterns_exact(spark, sf_dir):
    """One depot by exact name, analysed as one group (equals its slice
    of patterns_by_depot)."""
    raw = S.filter_depot_exact(fx.movements_raw(spark, sf_dir), FOCUS_DEPOT, check=False)
    return P.material_patterns(N.normalise_movements(raw)).select(*PATTERN_COLS)


@query("depot_filter_like")
def q_depot_filter_like(spark, sf_dir):
    """Case-insensitive regex filter on the depot column."""
    raw = S.filter_depot_like(fx.movements_raw(spark, sf_dir), "asia|europe")
    return raw.groupBy(F.col("`Name 1`").alias("depot_name")).agg(F.count(F.lit(1)).alias("rows"))


@query("depot_alias")
def q_depot_alias(spark, sf_dir):
    """Short keys and full names resolve to depot names; unknown keys pass."""
    region = fx.table(spark, sf_dir, "region")
    keys = (region.select(F.lower("r_name").alias("depot_key"))
            .unionByName(region.select(F.concat("r_name", F.lit(" Depot")).alias("depot_key")))
            .unionByName(region.select(F.concat(F.lit("depot-"), F.col("r_regionkey").cast("string")).alias("depot_key"))))
    return S.resolve_depot_alias(keys, fx.depot_alias(spark))


# -- P --------------------------------------------------------------------------
@query("monthly_consumption")
def q_monthly_consumption(spark, sf_dir):
    """P1."""
    return P.monthly_consumption(movements(spark, sf_dir))


@query("materials_dim")
def q_materials_dim(spark, sf_dir):
    """P6."""
    return P.materials_dim(movements(spark, sf_dir))


@query("max_unit_price")
def q_max_unit_price(spark, sf_dir):
    """P11."""
    return P.max_unit_price(movements(spark, sf_dir))


@query("dataset_overview")
def q_dataset_overview(spark, sf_dir):
    """P7, one group."""
    return P.dataset_overview(movements(spark, sf_dir))


@query("dataset_overview_by_depot")
def q_dataset_overview_by_depot(spark, sf_dir):
    """P7 per depot."""
    return P.dataset_overview(movements(spark, sf_dir), DEPOT)


@query("seasonal_overview")
def q_seasonal_overview(spark, sf_dir):
    """P8."""
    return P.seasonal_overview(P.material_patterns(movements(spark, sf_dir)))


@query("seasonal_overview_by_depot")
def q_seasonal_overview_by_depot(spark, sf_dir):
    """P8 per depot."""
    return P.seasonal_overview(P.material_patterns(movements(spark, sf_dir), DEPOT), DEPOT)


@query("high_velocity_count")
def q_high_velocity_count(spark, sf_dir):
    """P9."""
    return P.high_velocity_count(P.material_patterns(movements(spark, sf_dir)))


@query("peak_month_histogram")
def q_peak_month_histogram(spark, sf_dir):
    """P10."""
    return P.peak_month_histogram(P.material_patterns(movements(spark, sf_dir)))


@query("peak_month_histogram_by_depot")
def q_peak_month_histogram_by_depot(spark, sf_dir):
    """P10 per depot."""
    return P.peak_month_histogram(P.material_patterns(movements(spark, sf_dir), DEPOT), DEPOT)


# -- C --------------------------------------------------------------------------
@query("tier_thresholds_by_depot")
def q_tier_thresholds_by_depot(spark, sf_dir):
    """C1 per depot."""
    return C.tier_thresholds(P.material_patterns(movements(spark, sf_dir), DEPOT), DEPOT)


@query("classify_materials")
def q_classify_materials(spark, sf_dir):
    """C2."""
    c = C.classify_materials(P.material_patterns(movements(spark, sf_dir)))
    return c.select("material_number", "avg_monthly_consumption", "coefficient_of_variation", "tier")


@query("tier_detail")
def q_tier_detail(spark, sf_dir):
    """C4."""
    mv = movements(spark, sf_dir)
    return C.tier_detail(C.classify_materials(P.material_patterns(mv, with_description=True)))


@query("tier_detail_lite")
def q_tier_detail_lite(spark, sf_dir):
    """C5."""
    mv = movements(spark, sf_dir)
    return C.tier_detail_lite(P.material_patterns(mv, with_description=True))


@query("tier_detail_display")
def q_tier_detail_display(spark, sf_dir):
    """N12 over C4: serial number per tier, clipped description, CV text."""
    mv = movements(spark, sf_dir)
    d = C.tier_detail(C.classify_materials(P.material_patterns(mv, with_description=True)))
    out = N.display_columns(d, ["material_number"], by=["tier"])
    return out.select("tier", "serial_no", "material_number", "description_short", "cv_text")


# -- I --------------------------------------------------------------------------
@query("predict_inventory_by_depot")
def q_predict_inventory_by_depot(spark, sf_dir):
    """I1-I8 per depot (stock rows scored against every depot), with the vendor of the depot's material."""
    return _predictions(spark, sf_dir, DEPOT)


@query("predict_status")
def q_predict_status(spark, sf_dir):
    """I9, I11, I12 on the rounded-basis statistics."""
    mv = movements(spark, sf_dir)
    out = I.predict_status_b(P.material_patterns(mv, with_description=True), fx.stock(spark, sf_dir))
    return nullable_ints_as_double(out, STATUS_INTS)


@query("busy_slow_months")
def q_busy_slow_months(spark, sf_dir):
    """I10."""
    return I.busy_slow_months(P.monthly_consumption(movements(spark, sf_dir)))


@query("usage_labels")
def q_usage_labels(spark, sf_dir):
    """I11, I14 per material."""
    pat = P.material_patterns(movements(spark, sf_dir))
    return pat.select("material_number", "avg_monthly_consumption",
                      I.usage_label(F.col("avg_monthly_consumption")).alias("usage_label"),
                      I.cv_interpretation(F.col("cv_rounded_basis")).alias("cv_interpretation"))


def stock_entries(spark, sf_dir):
    """Stock as typed by a user: text, some blank, non-numeric or negative."""
    p = fx.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    txt = (F.when(k % 97 == 3, F.lit("n/a")).when(k % 79 == 11, F.concat(F.col("p_size").cast("string"), F.lit("d"))).when(k % 89 == 5, F.concat(F.lit("-"), F.col("p_size").cast("string")))
           .when(k % 83 == 7, F.lit(None).cast("string")).otherwise((F.col("p_size") * 2).cast("string")))
    return p.select(k.cast("string").alias("material_number"), txt.alias("current_qty"))


@query("stock_validation")
def q_stock_validation(spark, sf_dir):
    """I15."""
    return I.validate_stock(stock_entries(spark, sf_dir))


@query("resolve_requests")
def q_resolve_requests(spark, sf_dir):
    """I13 (+ I9 for resolved requests with a quantity)."""
    mv = movements(spark, sf_dir)
    pat = P.material_patterns(mv, with_description=True)
    res = stored(K.resolve_requests(fx.requests(spark), pat.select("material_number", "description")))
    return nullable_ints_as_double(K.predict_requests(res, pat).drop("matches"), ["predicted_order"])


@query("request_matches")
def q_request_matches(spark, sf_dir):
    """The ordered matches of requests with several."""
    return K.request_matches(K.resolve_requests(fx.requests(spark), P.material_facts(movements(spark, sf_dir))))


# -- H --------------------------------------------------------------------------
@query("high_demand_by_month")
def q_high_demand_by_month(spark, sf_dir):
    """H1."""
    return H.high_demand_by_month(movements(spark, sf_dir))


@query("top_consumers")
def q_top_consumers(spark, sf_dir):
    """H2, one group."""
    return H.top_consumers(P.material_patterns(movements(spark, sf_dir)))


@query("top_consumers_by_depot")
def q_top_consumers_by_depot(spark, sf_dir):
    """H2 per depot."""
    return H.top_consumers(P.material_patterns(movements(spark, sf_dir), DEPOT), DEPOT)


# -- A --------------------------------------------------------------------------
@query("anomaly_summary")
def q_anomaly_summary(spark, sf_dir):
    """A1 + total anomalous rows."""
    return A.anomaly_summary(movements(spark, sf_dir))


@query("anomaly_rows")
def q_anomaly_rows(spark, sf_dir):
    """A2."""
    r = A.anomaly_rows(movements(spark, sf_dir))
    return r.select("depot_name", "material_number", "document_date", "consumption_qty")


@query("anomalies")
def q_anomalies(spark, sf_dir):
    """A3."""
    return A.detect_anomalies(movements(spark, sf_dir))


@query("anomalies_by_depot")
def q_anomalies_by_depot(spark, sf_dir):
    """A3 per depot."""
    return A.detect_anomalies(movements(spark, sf_dir), DEPOT)


# -- K --------------------------------------------------------------------------
@query("search_movements")
def q_search_movements(spark, sf_dir):
    """K1 + K4 with a regex query."""
    raw = fx.movements_raw(spark, sf_dir)
    return K.search_movements(raw, N.normalise_movements(raw), "ring").drop("row_key")


@query("search_movements_all")
def q_search_movements_all(spark, sf_dir):
    """K1 with an empty query: first 50 materials in input order."""
    raw = fx.movements_raw(spark, sf_dir)
    return K.search_movements(raw, N.normalise_movements(raw), "").drop("row_key")


@query("search_catalog")
def q_search_catalog(spark, sf_dir):
    """K2."""
    return K.search_catalog(P.materials_dim(movements(spark, sf_dir)), "bolt")


@query("search_ranked")
def q_search_ranked(spark, sf_dir):
    """K3 + H3."""
    return K.search_ranked(P.materials_dim(movements(spark, sf_dir)), "red")


@query("dedupe_first")
def q_dedupe_first(spark, sf_dir):
    """K4: first raw row per material (null material is one group)."""
    raw = fx.movements_raw(spark, sf_dir).withColumn(
        "material_number", F.coalesce(F.col("Material"), F.lit("nan")))
    d = K.dedupe_first(raw, "material_number")
    return d.select("material_number", F.col("row_key.l_orderkey").alias("l_orderkey"),
                    F.col("row_key.l_linenumber").alias("l_linenumber"), F.col("`Document Date`").alias("document_date"),
                    F.col("Quantity").alias("quantity"))


@query("non_moving_materials")
def q_non_moving_materials(spark, sf_dir):
    """K5."""
    return K.non_moving_materials(fx.movements_raw(spark, sf_dir))


@query("non_moving_by_depot")
def q_non_moving_by_depot(spark, sf_dir):
    """K5 per depot."""
    return K.non_moving_materials(fx.movements_raw(spark, sf_dir), DEPOT)


@query("non_moving_report")
def q_non_moving_report(spark, sf_dir):
    """K6."""
    return K.non_moving_report(fx.movements_raw(spark, sf_dir))


# -- V --------------------------------------------------------------------------
@query("vendor_scores")
def q_vendor_scores(spark, sf_dir):
    """V1."""
    return V.vendor_scores(P.material_facts(movements(spark, sf_dir)), fx.vendor_rules(spark))


@query("vendor_fallback")
def q_vendor_fallback(spark, sf_dir):
    """V2."""
    return V.vendor_fallback_match(P.material_facts(movements(spark, sf_dir)), fx.vendor_fallback(spark))


@query("assign_vendor")
def q_assign_vendor(spark, sf_dir):
    """V3."""
    return _assigned(spark, sf_dir)


@query("vendor_catalog")
def q_vendor_catalog(spark, sf_dir):
    """V4."""
    return V.vendor_catalog(_assigned(spark, sf_dir), fx.vendors(spark))


@query("vendor_members")
def q_vendor_members(spark, sf_dir):
    """V4 member lists."""
    return V.vendor_members(_assigned(spark, sf_dir), fx.vendors(spark))


@query("vendor_contact")
def q_vendor_contact(spark, sf_dir):
    """V7."""
    return V.vendor_contact(_assigned(spark, sf_dir), fx.vendors(spark)).select(
        "material_number", "vendor", "contact", "phone")


def _order_lines(spark, sf_dir):
    basket = B.basket_current(fx.basket_events(spark, sf_dir))
    wanted = basket.select("material_number").distinct()  # only what some basket holds is priced and assigned
    facts = P.material_facts(movements(spark, sf_dir).join(wanted, "material_number", "left_semi"))
    return V.vendor_order_lines(basket, _assigned(spark, sf_dir, facts), facts)


@query("vendor_order_lines")
def q_vendor_order_lines(spark, sf_dir):
    """V5 lines."""
    return _order_lines(spark, sf_dir).drop("_raw_total")


@query("vendor_orders")
def q_vendor_orders(spark, sf_dir):
    """V5/V6 per (session, vendor), the lines as a list of material numbers."""
    view = V.vendor_order_view(_order_lines(spark, sf_dir), fx.vendors(spark))
    materials = F.array_join(F.transform("lines", lambda x: x["material_number"]), ",").alias("materials")
    return view.select("session_id", "vendor", "n_lines", "total_value", materials, "contact", "phone")


@query("vendor_order_view")
def q_vendor_order_view(spark, sf_dir):
    """V6: each order's nested lines, one row per element of the array, with the order's own fields."""
    view = V.vendor_order_view(_order_lines(spark, sf_dir), fx.vendors(spark))
    return view.select("session_id", "vendor", "n_lines", "total_value", "contact", "phone", F.posexplode("lines").alias("position", "line")).select(
        "session_id", "vendor", "n_lines", "total_value", "contact", "phone", "position", "line.*")


@query("vendor_order_edit")
def q_vendor_order_edit(spark, sf_dir):
    """V8."""
    return V.edit_vendor_orders(_order_lines(spark, sf_dir), fx.order_edits(spark, sf_dir))


# -- B --------------------------------------------------------------------------
@query("basket_current")
def q_basket_current(spark, sf_dir):
    """B1-B4."""
    return B.basket_current(fx.basket_events(spark, sf_dir))


@query("basket_totals")
def q_basket_totals(spark, sf_dir):
    """B5."""
    return B.basket_totals(B.basket_current(fx.basket_events(spark, sf_dir)))


@query("order_lines")
def q_order_lines(spark, sf_dir):
    """B6."""
    return B.order_lines(fx.basket_events(spark, sf_dir), _assigned(spark, sf_dir))


@query("bulk_confirm_summary")
def q_bulk_confirm_summary(spark, sf_dir):
    """B3 + B7 over the confirm requests of every session."""
    orders = V.vendor_orders(_order_lines(spark, sf_dir), fx.vendors(spark))
    return B.bulk_confirm_summary(fx.confirm_requests(orders))


@query("auto_basket")
def q_auto_basket(spark, sf_dir):
    """B8."""
    mv = movements(spark, sf_dir)
    pred = I.predict_inventory(P.material_patterns(mv, with_description=True), fx.stock(spark, sf_dir))
    return B.auto_basket(pred)


# -- R --------------------------------------------------------------------------
@query("summary_report")
def q_summary_report(spark, sf_dir):
    """R1."""
    return R.summary_report(R.material_table(fx.movements_raw(spark, sf_dir)))


@query("summary_report_by_depot")
def q_summary_report_by_depot(spark, sf_dir):
    """R1 per depot."""
    return R.summary_report(R.material_table(fx.movements_raw(spark, sf_dir), DEPOT), DEPOT)


@query("full_report_summary")
def q_full_report_summary(spark, sf_dir):
    """R2-R4."""
    return R.full_report_summary(R.material_table(fx.movements_raw(spark, sf_dir)))


@query("full_report_summary_by_depot")
def q_full_report_summary_by_depot(spark, sf_dir):
    """R2-R4 per depot."""
    return R.full_report_summary(R.material_table(fx.movements_raw(spark, sf_dir), DEPOT), DEPOT)


@query("full_report_tiers_by_depot")
def q_full_report_tiers_by_depot(spark, sf_dir):
    """R2: the tier table of the whole report set, per depot."""
    return R.full_report(fx.movements_raw(spark, sf_dir), DEPOT)["tiers"]


# -- S: sources and sinks, over copies of the derived movements in other formats ---
from depotlens.functions.stored import shared_folder  # noqa: E402
from depotlens.sources import sinks  # noqa: E402


def _text_copy(spark, sf_dir, fmt):
    """The movements in input order as text files; the folder they are in."""
    path = shared_folder(spark)
    raw = fx.movements_raw(spark, sf_dir)
    rows = raw.orderBy("row_key").drop("row_key")
    rows.write.options(**({"header": "true"} if fmt == "csv" else {})).format(fmt).save(path)
    return path


@query("scan_csv")
def q_scan_csv(spark, sf_dir):
    """S1 over CSV files without key columns: P6, whose "first" goes by the order of rows in the files."""
    return P.materials_dim(N.normalise_movements(ingest.scan_movements(spark, _text_copy(spark, sf_dir, "csv"), "csv")))


@query("scan_json")
def q_scan_json(spark, sf_dir):
    """S1, S3 over JSON files without key columns: K4, the first row per material."""
    raw = ingest.scan_movements(spark, _text_copy(spark, sf_dir, "json"), "json")
    ingest.require_columns(ingest.resolve_columns([c for c in raw.columns if c != "row_key"]))
    d = K.dedupe_first(raw.withColumn("material_number", F.coalesce("Material", F.lit("nan"))), "material_number")
    return d.select("material_number", F.col("Document Date").alias("document_date"), F.col("Quantity").alias("quantity"))


@query("json_records")
def q_json_records(spark, sf_dir):
    """Each tier member as a JSON record, with a date, a null and a nested list."""
    slots = P.slot_table(movements(spark, sf_dir))
    months = F.filter(F.array(*[F.when(F.col(f"_q{i}").isNotNull(), F.struct(F.lit(i).alias("month"), F.col(f"_q{i}").cast("long").alias("qty"))) for i in P.MONTHS]), lambda m: m.isNotNull())
    rows = slots.select("material_number", F.col("first_date"), F.lit(None).cast("string").alias("remark"), F.lit(float("nan")).alias("ratio"), months.alias("months"))
    return sinks.json_records(rows).select(F.get_json_object("json", "$.material_number").alias("material_number"), "json")


@query("report_sink")
def q_report_sink(spark, sf_dir):
    """The whole report set published as one release and read back: rows of each table."""
    path = shared_folder(spark)
    sinks.publish_report(R.full_report(fx.movements_raw(spark, sf_dir)), path)
    counts = [t.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("rows")) for name, t in sorted(sinks.read_report(spark, path).items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# -- §2.12: streaming forms, run to the end of what their source holds ----------------
from depotlens.streaming.basket_events import basket_event_stream, current_lines  # noqa: E402
from depotlens.streaming.closing_months import closing_month_stream, total  # noqa: E402
from depotlens.streaming.runs import run_available  # noqa: E402

#: Micro-batches over which rows are dealt by a hash: arrival in no order.
ARRIVALS = 4


def _shuffled_stream(rows, spark):
    """``rows``, worked out once and dealt by a hash to files of equal shares, a quarter of which is a micro-batch; a file is one task's work."""
    path = shared_folder(spark)
    parts = max(ARRIVALS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(parts, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).write.parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // ARRIVALS))).parquet(path)


@query("basket_stream")
def q_basket_stream(spark, sf_dir):
    """B4 from events that arrive in no order, as keyed state with a buffer and timers."""
    stamps = fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    events = fx.basket_events(spark, sf_dir).join(stamps, "seq")
    return current_lines(run_available(basket_event_stream(_shuffled_stream(events, spark), "60 days")))


@query("monthly_stream")
def q_monthly_stream(spark, sf_dir):
    """P1 from movements that arrive in no order: closed and open months plus late rows."""
    return total(run_available(closing_month_stream(_shuffled_stream(fx.movements_raw(spark, sf_dir), spark), delay="400 days")))


# -- scale options: sketches, and an index for the search ------------------------------
from depotlens.operators import search_index  # noqa: E402
from depotlens.operators import sketches  # noqa: E402


@query("sketch_overview_by_depot")
def q_sketch_overview_by_depot(spark, sf_dir):
    """P7 and A1's quantiles per depot, merged from sketches per depot and month; errors as ``sketches`` states them."""
    return sketches.approximate_overview(sketches.sketch_table(movements(spark, sf_dir), DEPOT), DEPOT)


@query("sketch_thresholds_by_depot")
def q_sketch_thresholds_by_depot(spark, sf_dir):
    """C1 per depot from sketches."""
    return sketches.approximate_thresholds(P.material_patterns(movements(spark, sf_dir), DEPOT), DEPOT)


@query("search_indexed")
def q_search_indexed(spark, sf_dir):
    """K1 + K4 by the trigram index: the rows of ``search_movements``."""
    path = search_index.build_index(fx.movements_raw(spark, sf_dir))
    return search_index.search_indexed(spark, path, "ring").drop("row_key")


@query("search_indexed_regex")
def q_search_indexed_regex(spark, sf_dir):
    """K1 by the index with a pattern of two required runs."""
    path = search_index.build_index(fx.movements_raw(spark, sf_dir))
    return search_index.search_indexed(spark, path, "red +wid[gh]et .*brand#1").drop("row_key")
