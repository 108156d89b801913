"""DuckDB SQL oracles for the registered queries.

Each oracle re-derives the fixture from the shared tables (same modulo rules
as ``depotlens.sources.fixtures``) and computes the answer in an independent,
brute-force formulation: the dense material x month grid is built with a cross
join, "first" uses ORDER BY on the row-order tuple, the basket fold uses
window frames.  Output columns carry the same names and types as Spark's.
"""
from __future__ import annotations

# -- fixture ----------------------------------------------------------------
RAW = """
raw AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity,
    -- '~' stands for a null depot inside the CTEs, so that plain equality groups and joins it; see ``no_depot``
    CASE WHEN l.l_suppkey % 40 = 3 THEN '~' ELSE r.r_name || ' Depot' END AS depot_raw,
    CASE WHEN l.l_orderkey % 211 = 5 THEN NULL ELSE CAST(l.l_partkey AS VARCHAR) END AS material_raw,
    CASE WHEN l.l_orderkey % 13 = 6 THEN NULL ELSE concat_ws(' ', p.p_name, p.p_type, p.p_brand) END AS desc_raw,
    CASE WHEN l.l_orderkey % 89 = 3 THEN 'n/a'
         WHEN l.l_orderkey % 83 = 7 THEN strftime(l.l_shipdate, '%Y-%m-%d') || ' junk'
         WHEN l.l_orderkey % 79 = 9 THEN strftime(l.l_shipdate, '%m-%d-%Y %H:%M:%S')
         WHEN l.l_orderkey % 73 = 11 THEN strftime(l.l_shipdate, '%b %d %Y')
         WHEN l.l_orderkey % 71 = 13 THEN strftime(l.l_shipdate, '%Y%m%d')
         WHEN l.l_orderkey % 67 = 15 THEN strftime(l.l_shipdate, '%Y/%m/%d')
         WHEN l.l_orderkey % 4 = 0 THEN strftime(l.l_shipdate, '%d-%m-%Y')
         WHEN l.l_orderkey % 4 = 1 THEN strftime(l.l_shipdate, '%Y-%m-%d')
         WHEN l.l_orderkey % 4 = 2 THEN strftime(l.l_shipdate, '%m/%d/%Y')
         ELSE strftime(l.l_shipdate, '%Y-%m-%dT%H:%M:%S') END AS date_raw,
    CASE WHEN l.l_partkey % 50 = 7 THEN NULL
         WHEN l.l_orderkey % 97 = 1 THEN 'x'
         WHEN l.l_orderkey % 107 = 9 AND NOT l.l_orderkey % 103 = 7 THEN 'Infinity'
         ELSE CAST(CAST(l.l_quantity AS BIGINT)
                   * (CASE WHEN l.l_orderkey % 499 = 2 THEN 10 ELSE 1 END)
                   * (CASE WHEN l.l_returnflag = 'R' THEN -1 ELSE 1 END) AS VARCHAR)
              || CASE WHEN l.l_orderkey % 103 = 7 THEN 'd' ELSE '' END END AS qty_raw,
    CASE WHEN l.l_orderkey % 101 = 4 THEN NULL
         WHEN l.l_orderkey % 109 = 5 THEN CAST(l.l_extendedprice AS VARCHAR) || 'f'
         ELSE CAST(l.l_extendedprice AS VARCHAR) END AS amount_raw
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

def num(x: str) -> str:
    """A number in text; anything else, words and suffixes included, is NULL."""
    return f"(CASE WHEN regexp_full_match({x}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') THEN try_cast({x} AS DOUBLE) END)"


def day(x: str) -> str:
    """The fixture's date texts, each by its full shape."""
    formats = ("%d-%m-%Y", "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%dT%H:%M:%S", "%m-%d-%Y %H:%M:%S", "%b %d %Y", "%Y%m%d", "%Y/%m/%d")
    return "CAST(coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in formats) + ") AS DATE)"


def no_depot(sql: str) -> str:
    """The result with null depots shown as NULL again."""
    return f"SELECT * REPLACE (nullif(depot_name, '~') AS depot_name) FROM (\n{sql}\n)"


TYPED = f"""
typed AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
    depot_raw AS depot_name,
    material_raw AS material_number,
    coalesce(desc_raw, material_raw) AS material_description, desc_raw AS source_description,
    {day("date_raw")} AS document_date,
    abs({num("qty_raw")}) AS consumption_qty,
    abs({num("amount_raw")}) AS amount
  FROM raw
)"""

MV = """
mv AS (
  SELECT *, CASE WHEN consumption_qty > 0 THEN amount / consumption_qty ELSE 0.0 END AS unit_price,
    CAST(year(document_date) AS BIGINT) AS year, CAST(month(document_date) AS BIGINT) AS month,
    strftime(document_date, '%B') AS month_name, strftime(document_date, '%Y-%m') AS year_month
  FROM typed
  WHERE consumption_qty > 0 AND amount >= 0 AND material_number IS NOT NULL
    AND material_number <> 'nan' AND document_date IS NOT NULL
)"""

STOCK = """
stock AS (SELECT CAST(p_partkey AS VARCHAR) AS material_number, p_size * 2.0 AS current_qty FROM part)"""


def _g(by: bool) -> tuple[str, str]:
    """(column prefix, join condition) for one-group vs per-depot grain."""
    return ("depot_name, ", "USING (depot_name)") if by else ("", "ON TRUE")


def patterns_ctes(by: bool) -> str:
    g, on = _g(by)
    gk = "depot_name, material_number" if by else "material_number"
    return f"""
p1 AS (
  SELECT {g}material_number, month, sum(consumption_qty) AS qty,
         max(CASE WHEN amount > 0 THEN amount / consumption_qty END) AS max_price
  FROM mv GROUP BY {g}material_number, month
),
gm AS (SELECT DISTINCT {g}month FROM p1),
mats AS (
  SELECT {g}material_number,
         coalesce(arg_min(source_description, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)), material_number) AS description
  FROM mv GROUP BY {g}material_number
),
grid AS (SELECT {"m.depot_name, " if by else ""}m.material_number, gm.month FROM mats m JOIN gm {"ON m.depot_name = gm.depot_name" if by else "ON TRUE"}),
dense AS (
  SELECT {"grid.depot_name, " if by else ""}grid.material_number, grid.month, coalesce(p1.qty, 0.0) AS qty, p1.max_price
  FROM grid LEFT JOIN p1 ON {"grid.depot_name = p1.depot_name AND " if by else ""}grid.material_number = p1.material_number AND grid.month = p1.month
),
vec AS (
  SELECT {g}material_number, list(qty ORDER BY month) AS v, count(*) AS n_months,
         count(*) FILTER (WHERE qty > 0) AS observed_months,
         max(qty) AS peak_qty, min(qty) AS low_qty, max(max_price) AS max_price
  FROM dense GROUP BY {g}material_number
),
st1 AS (
  SELECT *, list_reduce(v, lambda a, b: a + b) AS total_qty FROM vec
),
st2 AS (
  SELECT *, total_qty / n_months AS mean_qty FROM st1
),
st3 AS (
  SELECT *, CASE WHEN n_months > 1 THEN sqrt(list_reduce(list_transform(v, lambda x: (x - mean_qty) * (x - mean_qty)), lambda a, b: a + b) / (n_months - 1)) END AS std_qty
  FROM st2
),
pk AS (
  SELECT d.{gk.replace(", ", ", d.")}, min(d.month) FILTER (WHERE d.qty = s.peak_qty) AS peak_month,
         min(d.month) FILTER (WHERE d.qty = s.low_qty) AS low_month
  FROM dense d JOIN st3 s ON {"d.depot_name = s.depot_name AND " if by else ""}d.material_number = s.material_number
  GROUP BY d.{gk.replace(", ", ", d.")}
),
pat AS (
  SELECT {"s.depot_name, " if by else ""}s.material_number, m.description, s.n_months, s.observed_months, s.total_qty, s.mean_qty, s.std_qty,
    CAST(round_even(s.mean_qty, 0) AS BIGINT) AS avg_monthly_consumption,
    CAST(round_even(s.total_qty, 0) AS BIGINT) AS total_annual_consumption,
    pk.peak_month, strftime(make_date(2000, CAST(pk.peak_month AS INT), 1), '%B') AS peak_month_name,
    CAST(round_even(s.peak_qty, 0) AS BIGINT) AS peak_consumption,
    pk.low_month, strftime(make_date(2000, CAST(pk.low_month AS INT), 1), '%B') AS low_month_name,
    CAST(round_even(s.low_qty, 0) AS BIGINT) AS low_consumption,
    CASE WHEN s.mean_qty > 0 THEN round_even(s.std_qty / s.mean_qty * 100, 0) / 100 ELSE 0.0 END AS coefficient_of_variation,
    coalesce(CAST(round_even(s.std_qty, 0) AS BIGINT), 0) AS consumption_std,
    coalesce(s.max_price, 0.0) AS max_unit_price
  FROM st3 s JOIN pk ON {"s.depot_name = pk.depot_name AND " if by else ""}s.material_number = pk.material_number
  JOIN mats m ON {"s.depot_name = m.depot_name AND " if by else ""}s.material_number = m.material_number
),
patb AS (
  SELECT *, CASE WHEN avg_monthly_consumption > 0
                 THEN round_even(CAST(consumption_std AS DOUBLE) / avg_monthly_consumption * 100, 0) / 100
                 ELSE 0.0 END AS cv_rounded_basis
  FROM pat
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def tiers_ctes(by: bool, cv: str = "coefficient_of_variation") -> str:
    g, on = _g(by)
    return f"""
th AS (
  SELECT {g}quantile_cont(avg_monthly_consumption, 0.8) AS p80, quantile_cont(avg_monthly_consumption, 0.5) AS p50
  FROM patb {"GROUP BY depot_name" if by else ""}
),
cls AS (
  SELECT patb.*, th.p80, th.p50,
    CASE WHEN avg_monthly_consumption >= p80 THEN CASE WHEN coalesce({cv} >= 1.0, false) THEN 'HD_Variable' ELSE 'HD_Critical' END
         WHEN avg_monthly_consumption >= p50 THEN CASE WHEN coalesce({cv} >= 1.0, false) THEN 'MD_Seasonal' ELSE 'MD_Regular' END
         ELSE CASE WHEN coalesce({cv} >= 1.0, false) THEN 'LD_Sporadic' ELSE 'LD_Stable' END END AS tier
  FROM patb JOIN th {on}
)"""
