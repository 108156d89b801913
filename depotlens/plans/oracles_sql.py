"""Oracle SQL per registered query (DuckDB dialect)."""
from __future__ import annotations

from depotlens.plans.oracle import MV, RAW, STOCK, TYPED, day, no_depot, num, patterns_ctes, tiers_ctes, with_

BASE = (RAW, TYPED, MV)
PATTERN_SELECT = """material_number, CAST(n_months AS BIGINT) AS n_months,
  CAST(observed_months AS BIGINT) AS observed_months, avg_monthly_consumption, total_annual_consumption,
  CAST(peak_month AS BIGINT) AS peak_month, peak_month_name, peak_consumption, CAST(low_month AS BIGINT) AS low_month,
  low_month_name, low_consumption, coefficient_of_variation, consumption_std, cv_rounded_basis, max_unit_price"""

SQL: dict[str, str] = {}

SQL["movements"] = with_(*BASE) + """
SELECT depot_name, material_number, material_description, strftime(document_date, '%Y-%m-%d') AS document_date,
  consumption_qty, amount, unit_price, year, month, month_name, year_month
FROM mv"""

SQL["patterns"] = with_(*BASE, patterns_ctes(False)) + f"\nSELECT {PATTERN_SELECT} FROM patb"
SQL["patterns_by_depot"] = with_(*BASE, patterns_ctes(True)) + f"\nSELECT depot_name, {PATTERN_SELECT} FROM patb"

TIERS_VALUES = "(VALUES ('HD_Critical'), ('HD_Variable'), ('MD_Regular'), ('MD_Seasonal'), ('LD_Stable'), ('LD_Sporadic')) t(tier)"

SQL["tier_counts"] = with_(*BASE, patterns_ctes(False), tiers_ctes(False)) + f"""
SELECT t.tier, CAST(count(c.material_number) AS BIGINT) AS materials
FROM {TIERS_VALUES} LEFT JOIN cls c ON c.tier = t.tier GROUP BY t.tier"""

SQL["tier_counts_by_depot"] = with_(*BASE, patterns_ctes(True), tiers_ctes(True)) + f"""
SELECT d.depot_name, t.tier, CAST(count(c.material_number) AS BIGINT) AS materials
FROM (SELECT DISTINCT depot_name FROM cls) d CROSS JOIN {TIERS_VALUES}
LEFT JOIN cls c ON c.tier = t.tier AND c.depot_name = d.depot_name GROUP BY d.depot_name, t.tier"""


# ---------------------------------------------------------------------------
# Literal side tables, rendered from the same constants as the Spark fixture.
# ---------------------------------------------------------------------------
from depotlens.sources import fixtures as _fx  # noqa: E402


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _values(name: str, rows, cols: str, types: list[str]) -> str:
    body = ", ".join("(" + ", ".join(f"CAST({_lit(v)} AS {t})" for v, t in zip(r, types)) + ")" for r in rows)
    return f"\n{name} AS (SELECT * FROM (VALUES {body}) t({cols}))"


RULES = _values("rules", _fx.VENDOR_RULES, "rule_id, vendor, keyword", ["INTEGER", "VARCHAR", "VARCHAR"])
VENDS = _values("vend", _fx.VENDORS, "vendor_rank, vendor, contact, phone", ["INTEGER", "VARCHAR", "VARCHAR", "VARCHAR"])
FALLB = _values("fb", _fx.VENDOR_FALLBACK, "priority, term, vendor", ["INTEGER", "VARCHAR", "VARCHAR"])
ALIAS = _values("alias", _fx.DEPOT_ALIAS, "alias, depot_name", ["VARCHAR", "VARCHAR"])
REQS = _values("reqs", _fx.REQUESTS, "request_id, text, current_qty", ["INTEGER", "VARCHAR", "DOUBLE"])

MATS1 = """
mats1 AS (
  SELECT material_number,
         coalesce(arg_min(source_description, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)), material_number) AS description
  FROM mv GROUP BY material_number
)"""

def vendor_ctes(source: str, keys: str = "material_number") -> str:
    """V1-V3 over a table of materials; ``keys``: the columns that name a row of it."""
    same = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""{RULES},{VENDS},{FALLB},
txt AS (
  SELECT {keys}, description, lower(coalesce(description, '')) AS d,
         lower(coalesce(description, '')) || ' ' || lower(material_number) AS t
  FROM {source}
),
scores AS (
  SELECT {of("x")}, r.vendor,
    CAST(sum((CASE WHEN trim(lower(r.keyword)) = '' THEN 0 ELSE len(regexp_split_to_array(trim(lower(r.keyword)), '\\s+')) END)
             * (CASE WHEN contains(x.d, lower(r.keyword)) THEN 2 ELSE 1 END)) AS BIGINT) AS score
  FROM txt x JOIN rules r ON contains(x.t, lower(r.keyword))
  GROUP BY {of("x")}, r.vendor
),
best AS (
  SELECT {of("s")}, arg_max(s.vendor, (s.score, -coalesce(v.vendor_rank, 2147483647))) AS rule_vendor, max(s.score) AS score
  FROM scores s LEFT JOIN vend v ON s.vendor = v.vendor WHERE s.score > 0 GROUP BY {of("s")}
),
fbm AS (
  SELECT {of("x")}, arg_min(f.vendor, (f.priority, f.vendor)) AS fallback_vendor
  FROM txt x JOIN fb f ON f.term IS NULL OR contains(x.t, lower(f.term))
  GROUP BY {of("x")}
),
assigned AS (
  SELECT {of("x")}, x.description, coalesce(b.rule_vendor, f.fallback_vendor) AS vendor,
         coalesce(b.score, 0) AS score, CASE WHEN b.rule_vendor IS NULL THEN 'fallback' ELSE 'rules' END AS basis
  FROM txt x LEFT JOIN best b ON {same("x", "b")} LEFT JOIN fbm f ON {same("x", "f")}
)"""


VENDOR_CTES = vendor_ctes("mats1")


def ftext(x: str) -> str:
    """Python str(float) for whole values ('12.0'), cast otherwise."""
    return f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END)"


def _predict_select(g: str, vendor: bool) -> str:
    a = "p.avg_monthly_consumption"
    q = "s.current_qty"
    status = f"""(CASE WHEN {a} = 0 THEN 'No-Consumption' WHEN {q} > {a} * 1.1::DOUBLE THEN 'Excess'
                      WHEN {q} >= {a} THEN 'Adequate' WHEN {q} >= {a} * 0.5::DOUBLE THEN 'Low' ELSE 'Critical' END)"""
    mtype = f"""(CASE WHEN {a} = 0 THEN 'Non-Moving' WHEN {a} < 0.5 THEN 'Infrequent' WHEN {a} < 2 THEN 'Slow-Moving' ELSE 'Regular' END)"""
    order = f"""(CASE WHEN {a} < 2 THEN 0 ELSE greatest(0, CAST(trunc({a} * 1.1::DOUBLE - {q}) AS BIGINT)) END)"""
    yearly = f"""(CASE WHEN {a} = 0 THEN p.total_annual_consumption ELSE {a} * 12 END)"""
    advice = f"""(CASE {status} WHEN 'Excess' THEN 'Consider reducing inventory levels' WHEN 'Adequate' THEN 'Inventory levels are appropriate'
                 WHEN 'Low' THEN 'Consider reordering soon' WHEN 'Critical' THEN 'Immediate reorder required' END)"""
    recs = f"""(CASE WHEN {mtype} = 'Non-Moving' THEN 'Order only when specifically needed | Avoid routine ordering to prevent excess inventory'
                WHEN {mtype} IN ('Infrequent', 'Slow-Moving') THEN {advice} || ' | Annual consumption is ' || CAST({yearly} AS VARCHAR) || ' units'
                ELSE {advice} END)"""
    cv = f"(CASE WHEN {a} = 0 THEN 0.0 ELSE p.coefficient_of_variation END)"
    ok = "p.material_number IS NOT NULL"
    v = ", CASE WHEN " + ok + " THEN asg.vendor END AS vendor" if vendor else ""
    return f"""
SELECT {g}s.material_number, {ok} AS found, CASE WHEN NOT ({ok}) THEN 'Material not found' END AS error,
  {q} AS current_quantity,
  CAST(CASE WHEN {ok} THEN {a} END AS DOUBLE) AS avg_monthly_consumption,
  CAST(CASE WHEN {ok} THEN {order} END AS DOUBLE) AS order_quantity,
  CASE WHEN {ok} THEN round_even(p.max_unit_price * 100, 0) / 100 END AS unit_price,
  CASE WHEN {ok} THEN round_even({order} * p.max_unit_price * 100, 0) / 100 END AS order_amount,
  CASE WHEN {ok} AND {a} <> 0 THEN round_even({q} / {a} * 10, 0) / 10 END AS coverage_months,
  CASE WHEN {ok} AND {a} = 0 THEN 'Unlimited' END AS coverage_label,
  CASE WHEN {ok} THEN {status} || ' - ' || {mtype} END AS status,
  CASE WHEN {ok} THEN {mtype} END AS material_type,
  CASE WHEN {ok} THEN {status} END AS quantity_status,
  CASE WHEN {ok} THEN {recs} END AS recommendations,
  CASE WHEN {ok} THEN CASE WHEN {cv} IS NULL OR {cv} < 0 THEN 'CV: N/A' ELSE printf('CV: %.2f', {cv}) END END AS demand_variability,
  CAST(CASE WHEN {ok} THEN CAST({yearly} AS BIGINT) END AS DOUBLE) AS yearly_consumption,
  CASE WHEN {ok} THEN {status} IN ('Critical', 'Low') AND {order} > 0 END AS add_to_cart_eligible,
  CASE WHEN {ok} THEN m.description END AS description{v}"""


SQL["predict_inventory"] = with_(*BASE, patterns_ctes(False), STOCK, MATS1, VENDOR_CTES) + _predict_select("", True) + """
FROM stock s LEFT JOIN patb p ON s.material_number = p.material_number
LEFT JOIN mats1 m ON s.material_number = m.material_number
LEFT JOIN assigned asg ON s.material_number = asg.material_number"""

SQL["predict_inventory_by_depot"] = with_(*BASE, patterns_ctes(True), STOCK, vendor_ctes("mats", "depot_name, material_number")) + _predict_select("p.depot_name, ", True) + """
FROM stock s LEFT JOIN patb p ON s.material_number = p.material_number
LEFT JOIN mats m ON p.depot_name = m.depot_name AND p.material_number = m.material_number
LEFT JOIN assigned asg ON p.depot_name = asg.depot_name AND p.material_number = asg.material_number"""

SQL["movement_rejects"] = with_(RAW, TYPED) + """
SELECT reason, CAST(count(*) AS BIGINT) AS "rows" FROM (
  SELECT CASE WHEN material_number IS NULL OR material_number = 'nan' THEN 'material'
              WHEN document_date IS NULL THEN 'date'
              WHEN consumption_qty IS NULL OR consumption_qty <= 0 THEN 'quantity'
              WHEN amount IS NULL OR amount < 0 THEN 'amount' END AS reason
  FROM typed
  WHERE NOT coalesce(consumption_qty > 0 AND amount >= 0 AND material_number <> 'nan' AND document_date IS NOT NULL, false)
) GROUP BY reason"""

_COLS = ["Name 1", "Material", "Material Description", "Document Date", "Quantity", "Amount"]
_ROLES = [("date", "Document Date"), ("quantity", "Quantity"), ("material", "Material"),
          ("description", "Material Description"), ("amount", "Amount")]
_META = ", ".join([f"('column', '{i:03d}', '{c}')" for i, c in enumerate(_COLS)] + [f"('role', '{r}', '{c}')" for r, c in _ROLES])
SQL["profile_source"] = with_(RAW) + f""",
ordered AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS rn FROM raw
)
SELECT * FROM (VALUES {_META}) t(section, item, value)
UNION ALL SELECT 'rows', 'count', CAST(count(*) AS VARCHAR) FROM raw
UNION ALL SELECT 'depot', coalesce(nullif(depot_raw, '~'), ''), CAST(count(*) AS VARCHAR) FROM raw GROUP BY depot_raw
UNION ALL SELECT 'first_row', printf('%03d', rn), concat_ws('|', coalesce(nullif(depot_raw, '~'), ''), coalesce(material_raw, ''),
  coalesce(desc_raw, ''), coalesce(date_raw, ''), coalesce(qty_raw, ''), coalesce(amount_raw, '')) FROM ordered WHERE rn <= 5
UNION ALL SELECT 'first_description', printf('%03d', rn), coalesce(desc_raw, '') FROM ordered WHERE rn <= 10"""

_MV_ASIA = MV.replace("mv AS (", "mv_all AS (") + ",\nmv AS (SELECT * FROM mv_all WHERE depot_name = 'ASIA Depot')"
SQL["depot_patterns_exact"] = with_(RAW, TYPED, _MV_ASIA, patterns_ctes(False)) + f"\nSELECT {PATTERN_SELECT} FROM patb"

SQL["depot_filter_like"] = with_(RAW) + """
SELECT depot_raw AS depot_name, CAST(count(*) AS BIGINT) AS "rows" FROM raw
WHERE coalesce(regexp_matches(depot_raw, '(?i)asia|europe'), false) GROUP BY depot_raw"""

SQL["depot_alias"] = "WITH" + ALIAS + """,
keys AS (
  SELECT lower(r_name) AS depot_key FROM region
  UNION ALL SELECT r_name || ' Depot' FROM region
  UNION ALL SELECT 'depot-' || CAST(r_regionkey AS VARCHAR) FROM region
)
SELECT k.depot_key, coalesce(a.depot_name, k.depot_key) AS depot_name FROM keys k LEFT JOIN alias a ON k.depot_key = a.alias"""

SQL["monthly_consumption"] = with_(*BASE) + """
SELECT material_number, month, sum(consumption_qty) AS qty FROM mv GROUP BY material_number, month"""

SQL["materials_dim"] = with_(*BASE, MATS1) + "\nSELECT material_number, description FROM mats1"

SQL["max_unit_price"] = with_(*BASE) + """
SELECT material_number, coalesce(max(CASE WHEN amount > 0 AND consumption_qty > 0 THEN amount / consumption_qty END), 0.0) AS max_unit_price
FROM mv GROUP BY material_number"""

_OV = """CAST(count(DISTINCT material_number) AS BIGINT) AS unique_materials, CAST(count(*) AS BIGINT) AS valid_rows,
  strftime(min(document_date), '%d-%m-%Y') AS start_date, strftime(max(document_date), '%d-%m-%Y') AS end_date"""
SQL["dataset_overview"] = with_(*BASE) + f"\nSELECT {_OV} FROM mv"
SQL["dataset_overview_by_depot"] = with_(*BASE) + f"\nSELECT depot_name, {_OV} FROM mv GROUP BY depot_name"

SQL["seasonal_overview"] = with_(*BASE, patterns_ctes(False)) + """
SELECT CAST(count(*) AS BIGINT) AS materials_analyzed, CAST(trunc(avg(avg_monthly_consumption)) AS BIGINT) AS avg_consumption_overall,
  (SELECT material_number FROM patb ORDER BY avg_monthly_consumption DESC, material_number LIMIT 1) AS most_consumed_material,
  max(avg_monthly_consumption) AS most_consumed_avg
FROM patb"""
SQL["seasonal_overview_by_depot"] = with_(*BASE, patterns_ctes(True)) + """,
top AS (SELECT depot_name, material_number, row_number() OVER (PARTITION BY depot_name ORDER BY avg_monthly_consumption DESC, material_number) AS rn FROM patb)
SELECT p.depot_name, CAST(count(*) AS BIGINT) AS materials_analyzed, CAST(trunc(avg(avg_monthly_consumption)) AS BIGINT) AS avg_consumption_overall,
  any_value(t.material_number) AS most_consumed_material, max(avg_monthly_consumption) AS most_consumed_avg
FROM patb p JOIN top t ON p.depot_name = t.depot_name AND t.rn = 1 GROUP BY p.depot_name"""

SQL["high_velocity_count"] = with_(*BASE, patterns_ctes(False)) + """
SELECT CAST(count(*) FILTER (WHERE avg_monthly_consumption >= (SELECT quantile_cont(avg_monthly_consumption, 0.9) FROM patb)) AS BIGINT)
  AS high_velocity_items FROM patb"""

_MONTHS = "(SELECT CAST(range AS BIGINT) AS month FROM range(1, 13))"
_MNAME = "strftime(make_date(2000, CAST(month AS INT), 1), '%B')"
SQL["peak_month_histogram"] = with_(*BASE, patterns_ctes(False)) + f"""
SELECT m.month, strftime(make_date(2000, CAST(m.month AS INT), 1), '%B') AS month_name,
  CAST(count(p.material_number) AS BIGINT) AS peak_materials, CAST(0 AS BIGINT) AS total_consumption
FROM {_MONTHS} m LEFT JOIN patb p ON p.peak_month = m.month GROUP BY m.month"""
SQL["peak_month_histogram_by_depot"] = with_(*BASE, patterns_ctes(True)) + f"""
SELECT d.depot_name, m.month, strftime(make_date(2000, CAST(m.month AS INT), 1), '%B') AS month_name,
  CAST(count(p.material_number) AS BIGINT) AS peak_materials, CAST(0 AS BIGINT) AS total_consumption
FROM (SELECT DISTINCT depot_name FROM patb) d CROSS JOIN {_MONTHS} m
LEFT JOIN patb p ON p.peak_month = m.month AND p.depot_name = d.depot_name GROUP BY d.depot_name, m.month"""

SQL["tier_thresholds_by_depot"] = with_(*BASE, patterns_ctes(True), tiers_ctes(True)) + "\nSELECT depot_name, p80, p50 FROM th"

SQL["classify_materials"] = with_(*BASE, patterns_ctes(False), tiers_ctes(False)) + """
SELECT material_number, avg_monthly_consumption, coefficient_of_variation, tier FROM cls"""

_TD = """tier, c.material_number, coalesce(m.description, 'N/A') AS description, avg_monthly_consumption AS avg_consumption,
  total_annual_consumption AS total_consumption"""
SQL["tier_detail"] = with_(*BASE, patterns_ctes(False), tiers_ctes(False), MATS1) + f"""
SELECT {_TD}, coalesce(strftime(make_date(2000, CAST(peak_month AS INT), 1), '%B'), 'N/A') AS peak_month,
  coefficient_of_variation,
  CASE WHEN avg_monthly_consumption > 0 THEN CAST(trunc(avg_monthly_consumption * 1.1::DOUBLE) AS BIGINT) ELSE 0 END AS coverage_needed
FROM cls c LEFT JOIN mats1 m ON c.material_number = m.material_number"""

SQL["tier_detail_lite"] = with_(*BASE, patterns_ctes(False), tiers_ctes(False, "cv_rounded_basis"), MATS1) + f"""
SELECT {_TD}, cv_rounded_basis AS coefficient_of_variation
FROM cls c LEFT JOIN mats1 m ON c.material_number = m.material_number"""

SQL["tier_detail_display"] = with_(*BASE, patterns_ctes(False), tiers_ctes(False), MATS1) + """
SELECT tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY c.material_number) AS BIGINT) AS serial_no, c.material_number,
  CASE WHEN length(coalesce(m.description, 'N/A')) > 40 THEN substr(coalesce(m.description, 'N/A'), 1, 40) || '...' ELSE coalesce(m.description, 'N/A') END AS description_short,
  CASE WHEN coefficient_of_variation IS NULL THEN NULL WHEN coefficient_of_variation = 0 THEN 'N/A' ELSE printf('%.2f', coefficient_of_variation) END AS cv_text
FROM cls c LEFT JOIN mats1 m ON c.material_number = m.material_number"""


def _status_b_select() -> str:
    a = "CAST(p.avg_monthly_consumption AS DOUBLE)"
    q = "s.current_qty"
    st = f"(CASE WHEN {q} > {a} * 1.1::DOUBLE THEN 'Excess' WHEN {q} >= {a} THEN 'Adequate' WHEN {q} >= {a} * 0.5::DOUBLE THEN 'Low' ELSE 'Critical' END)"
    cv = "p.cv_rounded_basis"
    opt = f"CAST(trunc({a} * 1.1::DOUBLE) AS BIGINT)"
    high = f"CAST(trunc({a} * 1.3::DOUBLE) AS BIGINT)"
    rec = f"""(CASE WHEN {st} IN ('Low', 'Critical') THEN
                 CASE WHEN {cv} > 1.0 THEN 'URGENT: Order ' || {ftext(f"({high} - {q})")} || ' units. High variability - maintain ' || CAST({high} AS VARCHAR) || ' units.'
                      ELSE 'Order ' || {ftext(f"({opt} - {q})")} || ' units. Target: ' || CAST({opt} AS VARCHAR) || ' units.' END
               WHEN {st} = 'Adequate' THEN
                 CASE WHEN {cv} > 1.0 THEN 'Stock adequate but monitor closely. Consider increasing to ' || CAST(CAST(trunc({a} * 1.2::DOUBLE) AS BIGINT) AS VARCHAR) || ' units before peak season.'
                      ELSE 'Stock level appropriate. Maintain ' || CAST({opt} AS VARCHAR) || ' units as optimal.' END
               ELSE 'Excess stock. Current: ' || {ftext(q)} || ', Optimal: ' || CAST({opt} AS VARCHAR) ||
                 CASE WHEN {cv} > 1.0 THEN '. Reduce ordering but keep extra due to variability.' ELSE '. Stop ordering until stock reduces.' END END)"""
    interp = f"(CASE WHEN {cv} < 0.3 THEN 'Highly predictable demand' WHEN {cv} < 0.7 THEN 'Moderately predictable demand' WHEN {cv} < 1.2 THEN 'Variable demand pattern' ELSE 'Highly unpredictable demand' END)"
    short = f"greatest(0.0, {a} - {q})"
    show = f"({st} IN ('Low', 'Critical') AND {short} > 0)"
    ok = "p.material_number IS NOT NULL"
    return f"""
SELECT s.material_number, {ok} AS found, CASE WHEN NOT ({ok}) THEN 'Material number not found' END AS error,
  CASE WHEN {ok} THEN coalesce(m.description, 'N/A') END AS material_description, {q} AS current_quantity,
  CASE WHEN {ok} THEN {st} END AS status,
  CAST(CASE WHEN {ok} THEN p.avg_monthly_consumption END AS DOUBLE) AS avg_monthly_consumption,
  CASE WHEN {ok} AND p.avg_monthly_consumption > 0 THEN round_even({q} / {a} * 10, 0) / 10 END AS months_coverage,
  CAST(CASE WHEN {ok} THEN p.peak_consumption END AS DOUBLE) AS peak_consumption,
  CASE WHEN {ok} THEN p.peak_month_name END AS peak_month,
  CAST(CASE WHEN {ok} THEN p.low_consumption END AS DOUBLE) AS low_consumption,
  CASE WHEN {ok} THEN p.low_month_name END AS low_month,
  CASE WHEN {ok} THEN {cv} END AS coefficient_of_variation,
  CASE WHEN {ok} THEN {interp} END AS cv_interpretation,
  CASE WHEN {ok} THEN {rec} END AS recommendation,
  CAST(CASE WHEN {ok} THEN CASE WHEN {q} >= {a} THEN 0 ELSE CAST(trunc({a} * 1.1::DOUBLE - {q}) AS BIGINT) END END AS DOUBLE) AS order_quantity,
  CASE WHEN {ok} THEN printf('CV: %.2f', {cv}) END AS demand_variability,
  CASE WHEN {ok} AND {show} THEN {short} END AS shortfall,
  CASE WHEN {ok} AND NOT {show} AND {q} > {a} THEN {q} - {a} END AS surplus"""


SQL["predict_status"] = with_(*BASE, patterns_ctes(False), STOCK, MATS1) + _status_b_select() + """
FROM stock s LEFT JOIN patb p ON s.material_number = p.material_number LEFT JOIN mats1 m ON s.material_number = m.material_number"""

SQL["busy_slow_months"] = with_(*BASE) + """,
p1 AS (SELECT material_number, month, sum(consumption_qty) AS qty FROM mv GROUP BY material_number, month),
r AS (
  SELECT *, count(*) OVER (PARTITION BY material_number) AS n,
    row_number() OVER (PARTITION BY material_number ORDER BY qty DESC, month) AS rb,
    row_number() OVER (PARTITION BY material_number ORDER BY qty, month) AS rs,
    row_number() OVER (PARTITION BY material_number ORDER BY month) AS rm
  FROM p1 WHERE qty > 0
)
SELECT material_number, 'busy' AS kind, CAST(CASE WHEN n >= 3 THEN rb ELSE rm END AS BIGINT) AS position,
  strftime(make_date(2000, CAST(month AS INT), 1), '%B') AS month_name, CAST(round_even(qty, 0) AS BIGINT) AS consumption
FROM r WHERE n < 3 OR rb <= 3
UNION ALL
SELECT material_number, 'slow', CAST(CASE WHEN n >= 3 THEN rs ELSE rm END AS BIGINT),
  strftime(make_date(2000, CAST(month AS INT), 1), '%B'), CAST(round_even(qty, 0) AS BIGINT)
FROM r WHERE n < 3 OR rs <= 3"""

SQL["usage_labels"] = with_(*BASE, patterns_ctes(False)) + """
SELECT material_number, avg_monthly_consumption,
  CASE WHEN avg_monthly_consumption > 0 THEN CASE WHEN avg_monthly_consumption < 0.5 THEN 'Infrequent'
       WHEN avg_monthly_consumption < 2 THEN 'Slow-Moving' ELSE 'Regular' END END AS usage_label,
  CASE WHEN cv_rounded_basis < 0.3 THEN 'Highly predictable demand' WHEN cv_rounded_basis < 0.7 THEN 'Moderately predictable demand'
       WHEN cv_rounded_basis < 1.2 THEN 'Variable demand pattern' ELSE 'Highly unpredictable demand' END AS cv_interpretation
FROM patb"""

SQL["stock_validation"] = """
WITH e AS (
  SELECT CAST(p_partkey AS VARCHAR) AS material_number,
    CASE WHEN p_partkey % 97 = 3 THEN 'n/a' WHEN p_partkey % 79 = 11 THEN CAST(p_size AS VARCHAR) || 'd' WHEN p_partkey % 89 = 5 THEN '-' || CAST(p_size AS VARCHAR)
         WHEN p_partkey % 83 = 7 THEN NULL ELSE CAST(p_size * 2 AS VARCHAR) END AS raw_qty
  FROM part
), v AS (
  SELECT material_number, raw_qty, """ + num("raw_qty") + """ AS num,
    CASE WHEN raw_qty IS NULL THEN 'current quantity is required'
         WHEN """ + num("raw_qty") + """ IS NULL THEN 'current quantity must be a number'
         WHEN """ + num("raw_qty") + """ < 0 THEN 'current quantity must not be negative' END AS input_error
  FROM e
)
SELECT material_number, CASE WHEN input_error IS NULL THEN num END AS current_qty, input_error FROM v"""

SQL["resolve_requests"] = with_(*BASE, patterns_ctes(False), MATS1, REQS) + """,
hits AS (
  SELECT r.request_id, m.material_number,
    row_number() OVER (PARTITION BY r.request_id ORDER BY m.material_number) AS rn
  FROM reqs r JOIN mats1 m ON length(r.text) >= 2 AND contains(lower(coalesce(m.description, '')), lower(trim(r.text)))
),
cnt AS (SELECT request_id, count(*) AS match_count, min(material_number) AS only_m FROM hits WHERE rn <= 10 GROUP BY request_id),
res AS (
  SELECT r.request_id, r.text, r.current_qty,
    CASE WHEN d.material_number IS NOT NULL THEN 'direct_match' WHEN coalesce(c.match_count, 0) = 0 THEN 'no_matches'
         WHEN c.match_count = 1 THEN 'single_match' ELSE 'multiple_matches' END AS match_type,
    CASE WHEN d.material_number IS NOT NULL THEN r.text WHEN c.match_count = 1 THEN c.only_m END AS material_number,
    CAST(CASE WHEN d.material_number IS NOT NULL THEN 1 ELSE coalesce(c.match_count, 0) END AS BIGINT) AS match_count
  FROM reqs r LEFT JOIN mats1 d ON d.material_number = r.text LEFT JOIN cnt c ON c.request_id = r.request_id
),
s AS (SELECT * FROM res WHERE material_number IS NOT NULL AND current_qty IS NOT NULL),
pred AS (""" + _status_b_select().replace("SELECT s.material_number,", "SELECT s.request_id, s.material_number,") + """
  FROM s LEFT JOIN patb p ON s.material_number = p.material_number LEFT JOIN mats1 m ON s.material_number = m.material_number)
SELECT res.request_id, res.text, res.current_qty, res.match_type, res.material_number, res.match_count,
  pred.status AS predicted_status, pred.order_quantity AS predicted_order
FROM res LEFT JOIN pred ON res.request_id = pred.request_id"""

SQL["request_matches"] = with_(*BASE, MATS1, REQS) + """,
hits AS (
  SELECT r.request_id, m.material_number, m.description, row_number() OVER (PARTITION BY r.request_id ORDER BY m.material_number) AS position,
    count(*) OVER (PARTITION BY r.request_id) AS n
  FROM reqs r JOIN mats1 m ON length(r.text) >= 2 AND contains(lower(coalesce(m.description, '')), lower(trim(r.text)))
  WHERE r.text NOT IN (SELECT material_number FROM mats1)
)
SELECT request_id, position, material_number, description FROM hits WHERE n > 1 AND position <= 10"""

SQL["high_demand_by_month"] = with_(*BASE, patterns_ctes(False)) + """,
th AS (SELECT month, quantile_cont(qty, 0.75) AS threshold FROM dense GROUP BY month),
ranked AS (
  SELECT d.month, d.material_number, d.qty, th.threshold,
    row_number() OVER (PARTITION BY d.month ORDER BY d.qty DESC, d.material_number) AS rank
  FROM dense d JOIN th USING (month) WHERE d.qty >= th.threshold
)
SELECT CAST(month AS BIGINT) AS month, strftime(make_date(2000, CAST(month AS INT), 1), '%B') AS month_name,
  CAST(rank AS BIGINT) AS rank, material_number, CAST(trunc(qty) AS BIGINT) AS consumption,
  CAST(trunc(qty * 1.1::DOUBLE) AS BIGINT) AS recommended_stock, threshold
FROM ranked WHERE rank <= 50 AND qty > 0"""

SQL["top_consumers"] = with_(*BASE, patterns_ctes(False)) + """
SELECT material_number, avg_monthly_consumption, total_annual_consumption,
  CAST(row_number() OVER (ORDER BY avg_monthly_consumption DESC, material_number) AS BIGINT) AS rank
FROM patb ORDER BY avg_monthly_consumption DESC, material_number LIMIT 10"""
SQL["top_consumers_by_depot"] = with_(*BASE, patterns_ctes(True)) + """
SELECT * FROM (
  SELECT depot_name, material_number, avg_monthly_consumption, total_annual_consumption,
    CAST(row_number() OVER (PARTITION BY depot_name ORDER BY avg_monthly_consumption DESC, material_number) AS BIGINT) AS rank
  FROM patb) WHERE rank <= 10"""

_ASTATS = """
ast AS (
  SELECT {g}avg(consumption_qty) AS mean, stddev_samp(consumption_qty) AS std, quantile_cont(consumption_qty, 0.99) AS q99
  FROM mv {gb}
),
ath AS (SELECT *, greatest(q99, mean + 3.0 * std) AS threshold FROM ast),
arows AS (SELECT mv.*, ath.threshold FROM mv JOIN ath {on} WHERE mv.consumption_qty > ath.threshold)"""


def _anom(by: bool) -> str:
    return _ASTATS.format(g="depot_name, " if by else "", gb="GROUP BY depot_name" if by else "",
                          on="USING (depot_name)" if by else "ON TRUE")


SQL["anomaly_summary"] = with_(*BASE, _anom(False)) + """
SELECT CAST(trunc(threshold) AS BIGINT) AS threshold_high, CAST(trunc(q99) AS BIGINT) AS q99_percentile,
  CAST(trunc(mean) AS BIGINT) AS mean, CAST(trunc(std) AS BIGINT) AS std,
  (SELECT CAST(count(*) AS BIGINT) FROM arows) AS total_anomalous_records
FROM ath"""
SQL["anomaly_rows"] = with_(*BASE, _anom(False)) + """
SELECT depot_name, material_number, strftime(document_date, '%Y-%m-%d') AS document_date, consumption_qty FROM arows"""

_AGG = """material_number,
  coalesce(arg_min(source_description, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)), material_number) AS description,
  CAST(trunc(max(consumption_qty)) AS BIGINT) AS max_consumption,
  CAST(trunc(round_even(avg(consumption_qty) * 100, 0) / 100) AS BIGINT) AS avg_high_consumption,
  CAST(count(*) AS BIGINT) AS high_consumption_instances, 'Unusually High Consumption' AS anomaly_type,
  CAST(trunc(any_value(threshold)) AS BIGINT) AS threshold_used"""
SQL["anomalies"] = with_(*BASE, _anom(False)) + f"\nSELECT {_AGG} FROM arows GROUP BY material_number"
SQL["anomalies_by_depot"] = with_(*BASE, _anom(True)) + f"\nSELECT depot_name, {_AGG} FROM arows GROUP BY depot_name, material_number"


def _search(where: str) -> str:
    return with_(*BASE) + f""",
r AS (
  SELECT *, coalesce(material_raw, 'nan') AS m, coalesce(desc_raw, 'nan') AS d FROM raw {where}
),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS rn FROM r)
  WHERE rn = 1 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity LIMIT 50
),
pr AS (SELECT material_number, max(CASE WHEN amount > 0 THEN amount / consumption_qty END) AS p FROM mv GROUP BY material_number),
f2 AS (
  SELECT f.*, """ + num("qty_raw") + """ AS q, """ + num("amount_raw") + """ AS a,
    """ + day("date_raw") + """ AS dt
  FROM firsts f
)
SELECT m AS material_number, d AS description, coalesce(q, 0.0) AS quantity, coalesce(a, 0.0) AS amount,
  coalesce(pr.p, 0.0) AS unit_price, strftime(dt, '%Y-%m-%d') AS date, strftime(dt, '%B') AS month,
  CAST(year(dt) AS BIGINT) AS year
FROM f2 LEFT JOIN pr ON f2.m = pr.material_number
WHERE (qty_raw IS NULL OR q IS NOT NULL) AND (amount_raw IS NULL OR a IS NOT NULL) AND dt IS NOT NULL"""


SQL["search_movements"] = _search("WHERE regexp_matches(coalesce(material_raw, 'nan'), '(?i)ring') OR regexp_matches(coalesce(desc_raw, 'nan'), '(?i)ring')")
SQL["search_movements_all"] = _search("")

SQL["search_catalog"] = with_(*BASE, MATS1) + """
SELECT material_number, description FROM mats1
WHERE contains(lower(material_number), 'bolt') OR contains(lower(coalesce(description, '')), 'bolt')
ORDER BY material_number LIMIT 20"""

SQL["search_ranked"] = with_(*BASE, MATS1) + """,
hits AS (SELECT * FROM mats1 WHERE contains(lower(coalesce(description, '')), 'red') ORDER BY material_number LIMIT 20)
SELECT material_number, description,
  CAST(row_number() OVER (ORDER BY CASE WHEN starts_with(lower(description), 'red') THEN 0 ELSE 1 END, length(description), material_number) AS BIGINT) AS rank
FROM hits"""

SQL["dedupe_first"] = with_(RAW) + """
SELECT material_number, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, date_raw AS document_date, qty_raw AS quantity FROM (
  SELECT *, coalesce(material_raw, 'nan') AS material_number,
    row_number() OVER (PARTITION BY coalesce(material_raw, 'nan') ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS rn
  FROM raw) WHERE rn = 1"""


def _nonmoving(by: bool) -> str:
    g = "depot_name, " if by else ""
    return with_(*BASE) + f""",
cand AS (
  SELECT {g}material_number,
    arg_min(source_description, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)) AS description
  FROM typed WHERE material_number IS NOT NULL AND material_number <> 'nan' GROUP BY {g}material_number
),
nm AS (
  SELECT {g}material_number, coalesce(description, 'N/A') AS description FROM cand c
  WHERE NOT EXISTS (SELECT 1 FROM mv WHERE mv.material_number = c.material_number {"AND mv.depot_name = c.depot_name" if by else ""})
)"""


SQL["non_moving_materials"] = _nonmoving(False) + "\nSELECT material_number, description FROM nm"
SQL["non_moving_by_depot"] = _nonmoving(True) + "\nSELECT depot_name, material_number, description FROM nm"
SQL["non_moving_report"] = _nonmoving(False) + """
SELECT material_number, description, CAST(0 AS BIGINT) AS avg_consumption, CAST(0 AS BIGINT) AS total_consumption,
  'N/A' AS peak_month, 0.0 AS coefficient_of_variation, CAST(0 AS BIGINT) AS coverage_needed, 'Non-Moving' AS status FROM nm"""

SQL["vendor_scores"] = with_(*BASE, MATS1, VENDOR_CTES) + "\nSELECT material_number, vendor, score FROM scores"
SQL["vendor_fallback"] = with_(*BASE, MATS1, VENDOR_CTES) + "\nSELECT material_number, fallback_vendor FROM fbm"
SQL["assign_vendor"] = with_(*BASE, MATS1, VENDOR_CTES) + "\nSELECT material_number, description, vendor, score, basis FROM assigned"
SQL["vendor_catalog"] = with_(*BASE, MATS1, VENDOR_CTES) + """
SELECT v.vendor_rank, v.vendor, v.contact, v.phone, CAST(count(a.material_number) AS BIGINT) AS materials
FROM vend v LEFT JOIN assigned a ON a.vendor = v.vendor GROUP BY v.vendor_rank, v.vendor, v.contact, v.phone"""
SQL["vendor_members"] = with_(*BASE, MATS1, VENDOR_CTES) + """
SELECT v.vendor_rank, a.vendor, a.material_number, a.description FROM assigned a LEFT JOIN vend v ON a.vendor = v.vendor"""
SQL["vendor_contact"] = with_(*BASE, MATS1, VENDOR_CTES) + """
SELECT a.material_number, a.vendor, coalesce(v.contact, 'Not available') AS contact, coalesce(v.phone, 'Not available') AS phone
FROM assigned a LEFT JOIN vend v ON a.vendor = v.vendor"""

EVENTS = """
ev AS (
  SELECT event_id AS seq, user_id AS session_id, CAST((user_id * 7 + event_id % 5) % 200 AS VARCHAR) AS material_number,
    CASE WHEN event_type IN ('click', 'view') THEN 'add' WHEN event_type IN ('signup', 'error') THEN 'set'
         WHEN event_type = 'purchase' THEN 'confirm' END AS op,
    CAST(CASE WHEN event_type IN ('click', 'view') THEN 1 + event_id % 9 WHEN event_type = 'signup' THEN 1 + event_id % 6
         WHEN event_type = 'error' THEN 0 END AS BIGINT) AS quantity,
    value AS unit_price
  FROM events WHERE event_type IN ('click', 'view', 'signup', 'error', 'purchase')
),
ev1 AS (
  SELECT *, (op = 'confirm' OR (op = 'set' AND coalesce(quantity, 0) <= 0)) AS rem, (op = 'set' AND quantity > 0) AS pset,
    count(*) FILTER (WHERE op = 'confirm' OR (op = 'set' AND coalesce(quantity, 0) <= 0))
      OVER (PARTITION BY session_id, material_number ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ep,
    count(*) FILTER (WHERE op = 'confirm' OR (op = 'set' AND coalesce(quantity, 0) <= 0))
      OVER (PARTITION BY session_id, material_number) AS total_rem
  FROM ev
),
tail AS (SELECT * FROM ev1 WHERE ep = total_rem AND NOT rem),
fa AS (SELECT session_id, material_number, min(seq) AS fa_seq FROM tail WHERE op = 'add' GROUP BY ALL),
tail2 AS (SELECT t.* FROM tail t JOIN fa USING (session_id, material_number) WHERE t.seq >= fa.fa_seq),
ls AS (SELECT session_id, material_number, max(seq) AS ls_seq FROM tail2 WHERE pset GROUP BY ALL),
basket AS (
  SELECT t.session_id, t.material_number,
    CAST(coalesce(max(CASE WHEN t.seq = ls.ls_seq THEN t.quantity END), 0)
         + sum(CASE WHEN t.op = 'add' AND (ls.ls_seq IS NULL OR t.seq > ls.ls_seq) THEN t.quantity ELSE 0 END) AS BIGINT) AS quantity,
    max(CASE WHEN t.seq = fa.fa_seq THEN t.unit_price END) AS unit_price
  FROM tail2 t JOIN fa USING (session_id, material_number) LEFT JOIN ls USING (session_id, material_number)
  GROUP BY t.session_id, t.material_number
)"""

SQL["basket_current"] = "WITH" + EVENTS + """
SELECT session_id, material_number, quantity, unit_price, CAST(NULL AS VARCHAR) AS description, quantity * unit_price AS total FROM basket"""
SQL["basket_totals"] = "WITH" + EVENTS + """
SELECT session_id, CAST(count(*) AS BIGINT) AS items,
  round_even(CAST(sum(CAST(quantity * unit_price AS DECIMAL(38,10))) AS DOUBLE) * 100, 0) / 100 AS total_value
FROM basket GROUP BY session_id"""

_LINES = with_(*BASE, MATS1, VENDOR_CTES) + "," + EVENTS + """,
prices AS (SELECT material_number, coalesce(max(CASE WHEN amount > 0 AND consumption_qty > 0 THEN amount / consumption_qty END), 0.0) AS p FROM mv GROUP BY material_number),
lines AS (
  SELECT b.session_id, a.vendor, b.material_number, a.description, CAST(b.quantity AS DOUBLE) AS quantity,
    round_even(coalesce(pr.p, 0.0) * 100, 0) / 100 AS unit_price,
    round_even(b.quantity * coalesce(pr.p, 0.0) * 100, 0) / 100 AS total_price,
    b.quantity * coalesce(pr.p, 0.0) AS raw_total
  FROM basket b JOIN assigned a ON a.material_number = b.material_number
  LEFT JOIN prices pr ON pr.material_number = b.material_number WHERE b.quantity > 0
),
orders AS (
  SELECT l.session_id, l.vendor, CAST(count(*) AS BIGINT) AS n_lines,
    round_even(CAST(sum(CAST(raw_total AS DECIMAL(38,10))) AS DOUBLE) * 100, 0) / 100 AS total_value,
    string_agg(l.material_number, ',' ORDER BY l.material_number) AS materials,
    coalesce(any_value(v.contact), '') AS contact, coalesce(any_value(v.phone), '') AS phone
  FROM lines l LEFT JOIN vend v ON l.vendor = v.vendor GROUP BY l.session_id, l.vendor
)"""
SQL["vendor_order_lines"] = _LINES + "\nSELECT session_id, vendor, material_number, description, quantity, unit_price, total_price FROM lines"
SQL["vendor_orders"] = _LINES + "\nSELECT * FROM orders"
SQL["vendor_order_view"] = _LINES + """
SELECT l.session_id, l.vendor, n_lines, total_value, contact, phone, CAST(row_number() OVER (PARTITION BY l.session_id, l.vendor ORDER BY l.material_number) - 1 AS BIGINT) AS position,
  l.material_number, l.description, l.quantity, l.unit_price, l.total_price
FROM lines l JOIN orders o ON l.session_id = o.session_id AND l.vendor IS NOT DISTINCT FROM o.vendor"""
SQL["bulk_confirm_summary"] = _LINES + """
SELECT session_id, CAST(count(*) FILTER (WHERE vendor IS NOT NULL AND vendor <> '' AND n_lines > 0) AS BIGINT) AS succeeded,
  CAST(count(*) FILTER (WHERE NOT (vendor IS NOT NULL AND vendor <> '' AND n_lines > 0)) AS BIGINT) AS failed
FROM (SELECT session_id, CASE WHEN session_id % 11 <> 3 THEN vendor END AS vendor, CASE WHEN session_id % 13 = 5 THEN 0 ELSE n_lines END AS n_lines FROM orders)
GROUP BY session_id"""
SQL["vendor_order_edit"] = _LINES + """,
edits AS (
  SELECT DISTINCT user_id AS session_id, CAST((user_id * 7 + event_id % 5) % 200 AS VARCHAR) AS material_number
  FROM events WHERE event_type = 'view' AND value < 5
)
SELECT l.session_id, l.vendor, CAST(count(*) AS BIGINT) AS n_lines,
  round_even(CAST(sum(CAST(total_price AS DECIMAL(38,10))) AS DOUBLE) * 100, 0) / 100 AS total_value
FROM lines l WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.session_id = l.session_id AND e.material_number = l.material_number)
GROUP BY l.session_id, l.vendor"""

SQL["order_lines"] = with_(*BASE, MATS1, VENDOR_CTES) + "," + EVENTS + """,
evs AS (
  SELECT *, (op = 'confirm' OR (op = 'set' AND coalesce(quantity, 0) <= 0)) AS is_rem FROM ev
),
conf AS (SELECT session_id, material_number, seq FROM ev WHERE op = 'confirm'),
prior AS (
  SELECT c.session_id, c.material_number, c.seq AS cseq, e.seq, e.op, e.quantity, e.unit_price, e.is_rem
  FROM conf c JOIN evs e ON e.session_id = c.session_id AND e.material_number = c.material_number AND e.seq < c.seq
),
lr AS (SELECT session_id, material_number, cseq, max(seq) FILTER (WHERE is_rem) AS r FROM prior GROUP BY ALL),
after_r AS (SELECT p.* FROM prior p JOIN lr USING (session_id, material_number, cseq) WHERE lr.r IS NULL OR p.seq > lr.r),
ofa AS (SELECT session_id, material_number, cseq, min(seq) AS fa, arg_min(unit_price, seq) AS price FROM after_r WHERE op = 'add' GROUP BY ALL),
ols AS (
  SELECT a.session_id, a.material_number, a.cseq, max(a.seq) AS ls, arg_max(a.quantity, a.seq) AS lsq
  FROM after_r a JOIN ofa USING (session_id, material_number, cseq) WHERE a.op = 'set' AND a.quantity > 0 AND a.seq > ofa.fa GROUP BY ALL
),
st AS (
  SELECT a.session_id, a.material_number, a.cseq, any_value(ofa.price) AS price,
    CASE WHEN any_value(ols.ls) IS NOT NULL THEN any_value(ols.lsq) + sum(CASE WHEN a.op = 'add' AND a.seq > ols.ls THEN a.quantity ELSE 0 END)
         ELSE sum(CASE WHEN a.op = 'add' THEN a.quantity ELSE 0 END) END AS quantity
  FROM after_r a JOIN ofa USING (session_id, material_number, cseq) LEFT JOIN ols USING (session_id, material_number, cseq)
  GROUP BY a.session_id, a.material_number, a.cseq
)
SELECT substr(sha256(CAST(st.session_id AS VARCHAR) || '|' || coalesce(asg.vendor, '') || '|' || CAST(st.cseq AS VARCHAR)), 1, 8) AS order_id,
  st.session_id, asg.vendor, st.material_number, st.cseq AS seq, CAST(st.quantity AS BIGINT) AS quantity, st.price AS unit_price,
  round_even(st.quantity * st.price * 100, 0) / 100 AS total
FROM st LEFT JOIN assigned asg ON asg.material_number = st.material_number"""

SQL["auto_basket"] = with_(*BASE, patterns_ctes(False), STOCK, MATS1) + """,
pi AS (""" + _predict_select("", False) + """
  FROM stock s LEFT JOIN patb p ON s.material_number = p.material_number LEFT JOIN mats1 m ON s.material_number = m.material_number)
SELECT material_number, CAST(order_quantity AS BIGINT) AS quantity, unit_price, description FROM pi WHERE coalesce(add_to_cart_eligible, false)"""


def _report(by: bool, full: bool) -> str:
    g = "depot_name, " if by else ""
    gb = "GROUP BY depot_name" if by else ""
    on = "USING (depot_name)" if by else "ON TRUE"
    tiers = ", ".join(f"CAST(count(*) FILTER (WHERE tier = '{t}') AS BIGINT) AS {t.lower()}" for t in
                      ["HD_Critical", "HD_Variable", "MD_Regular", "MD_Seasonal", "LD_Stable", "LD_Sporadic"])
    ctes = [*BASE, patterns_ctes(by), tiers_ctes(by)] + ([_nonmoving(by)[len(with_(*BASE)) + 1:]] if full else [])
    body = with_(*ctes) + f""",
ov AS (SELECT {g}CAST(count(DISTINCT material_number) AS BIGINT) AS total_materials,
         strftime(min(document_date), '%d-%m-%Y') || ' to ' || strftime(max(document_date), '%d-%m-%Y') AS date_range FROM mv {gb}),
hvt AS (SELECT {g}quantile_cont(avg_monthly_consumption, 0.9) AS p90 FROM patb {gb}),
hv AS (SELECT {"p.depot_name, " if by else ""}CAST(count(*) FILTER (WHERE p.avg_monthly_consumption >= h.p90) AS BIGINT) AS high_velocity_items
       FROM patb p JOIN hvt h {on} {"GROUP BY p.depot_name" if by else ""}),
tw AS (SELECT {g}CAST(trunc(avg(avg_monthly_consumption)) AS BIGINT) AS avg_monthly_consumption, {tiers} FROM cls {gb})"""
    if not full:
        return body + f"""
SELECT {"ov.depot_name, " if by else ""}total_materials, date_range, high_velocity_items, avg_monthly_consumption,
  hd_critical, hd_variable, md_regular, md_seasonal, ld_stable, ld_sporadic
FROM ov JOIN hv {on} JOIN tw {on}"""
    return body + f""",
nmc AS (SELECT {g}count(*) AS n FROM nm {gb})
SELECT {"ov.depot_name, " if by else ""}total_materials, date_range, high_velocity_items,
  ld_stable + ld_sporadic AS cost_optimization_potential,
  round_even((hd_critical + md_regular) / greatest(total_materials, 1) * 100.0 * 10, 0) / 10 AS inventory_efficiency_score,
  CAST(coalesce(nmc.n, 0) AS BIGINT) AS non_moving_items
FROM ov JOIN hv {on} JOIN tw {on} LEFT JOIN nmc {on}"""


SQL["summary_report"] = _report(False, False)
SQL["summary_report_by_depot"] = _report(True, False)
SQL["full_report_summary"] = _report(False, True)
SQL["full_report_summary_by_depot"] = _report(True, True)
SQL["full_report_tiers_by_depot"] = SQL["tier_counts_by_depot"]

SQL["scan_csv"] = SQL["materials_dim"]
SQL["scan_json"] = f"SELECT material_number, document_date, quantity FROM ({SQL['dedupe_first']})"
SQL["json_records"] = with_(*BASE) + """,
m AS (SELECT material_number, month, CAST(sum(consumption_qty) AS BIGINT) AS qty FROM mv GROUP BY material_number, month),
l AS (SELECT material_number, '[' || string_agg('{"month":' || month || ',"qty":' || qty || '}', ',' ORDER BY month) || ']' AS months FROM m GROUP BY material_number),
d AS (SELECT material_number, strftime(min(document_date), '%Y-%m-%d') AS first_date FROM mv GROUP BY material_number)
SELECT material_number, '{"material_number":"' || material_number || '","first_date":"' || first_date || '","remark":null,"ratio":null,"months":' || months || '}' AS json FROM l JOIN d USING (material_number)"""
SQL["report_sink"] = with_(*BASE, patterns_ctes(False), tiers_ctes(False), _nonmoving(False)[len(with_(*BASE)) + 1:]) + """
SELECT * FROM (VALUES ('summary', 1), ('tiers', 6), ('peak_months', 12), ('seasonal', 1)) t(report, "rows")
UNION ALL SELECT 'tier_detail', count(*) FROM cls
UNION ALL SELECT 'top_consumers', least(count(*), 10) FROM cls
UNION ALL SELECT 'non_moving', count(*) FROM nm"""
SQL["report_sink"] = f'SELECT report, CAST("rows" AS BIGINT) AS "rows" FROM ({SQL["report_sink"]})'

SQL["basket_stream"] = "WITH" + EVENTS + "\nSELECT session_id, material_number, quantity, unit_price FROM basket"
SQL["monthly_stream"] = SQL["monthly_consumption"]

SQL["search_indexed"] = SQL["search_movements"]
SQL["search_indexed_regex"] = SQL["search_movements"].replace("(?i)ring", "(?i)red +wid[gh]et .*brand#1")

for _name in ("movements", "anomaly_rows", "predict_inventory_by_depot", "depot_filter_like", *[k for k in SQL if k.endswith("_by_depot")]):
    if "nullif(depot_name" not in SQL[_name]:
        SQL[_name] = no_depot(SQL[_name])
