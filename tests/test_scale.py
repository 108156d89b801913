"""Plans and results that must hold at any size."""
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SMOKE
from depotlens.functions import groups, quantiles
from depotlens.functions import stored as stored_module
from depotlens.functions.numbering import serial_numbers
from depotlens.functions.quantiles import _bucket, buckets_to_rank, exact_quantiles
from depotlens.operators import anomalies as A
from depotlens.operators import catalog as K
from depotlens.operators import patterns as P
from depotlens.operators import reports as R
from depotlens.operators import segments as C
from depotlens.operators.normalise import normalise_movements
from depotlens.plans import registry
from helpers import raw_rows


def model(values, q):
    s = sorted(values)
    p = q * (len(s) - 1)
    low, high = int(p), min(int(p) + (p > int(p)), len(s) - 1)
    return s[low] if low == high else (high - p) * s[low] + (p - low) * s[high]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_equal_model(spark, by):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([round(rng.random(), 2), 1.0, -3.0, None]), rng.randint(0, 3)) for _ in range(3000)] + [("one", 2.5, 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    qs = {"p0": 0.0, "p50": 0.5, "p80": 0.8, "p99": 0.99, "p100": 1.0}
    for weight in (None, "w"):
        got = {tuple(r[c] for c in by): r for r in exact_quantiles(df, by, "v", qs, weight).collect()}
        values = {}
        for g, v, w in rows:
            if v is not None:
                values.setdefault((g,) if by else (), []).extend([v] * (w if weight else 1))
        assert {k for k in got if got[k].p50 is not None} == {k for k, v in values.items() if v}
        for key in (k for k, v in values.items() if v):
            r = got[key]
            for name, q in qs.items():
                assert r[name] == pytest.approx(model(values[key], q), abs=1e-12)


def test_buckets_never_fall(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, 1e308, -1e308, 1.0, 3.0] + [2.0 ** k * (1 + d) for k in range(-60, 60, 7) for d in (0, 2e-16, -1.2e-16, 0.5)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-5, 9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", _bucket(F.col("v")).alias("b"))
    got = [r.b for r in sorted(df.collect(), key=lambda r: r.v)]
    assert got == sorted(got)


def test_quantile_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003 + F.lit(0.25)).alias("v"))
    plan_free = exact_quantiles(df, [], "v", {"p99": 0.99, "p50": 0.5})
    assert "percentile" not in plan_free._jdf.queryExecution().toString()
    r = plan_free.first()
    values = [i * 7919 % 1_000_003 + 0.25 for i in range(1_000_000)]
    assert r.p99 == pytest.approx(model(values, 0.99)) and r.p50 == pytest.approx(model(values, 0.5))


def test_narrow_column_is_cut_again(spark):
    """A million distinct values between 2^20 and 2^20 + 1024: one bucket of the first round holds most of them."""
    rows = 1_000_000
    df = spark.range(rows).select((F.lit(2.0 ** 20) + F.col("id") * 7919 % 1_000_003 * 1024 / 1_000_003).alias("v"))
    qs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    held = buckets_to_rank(df, [], "v", qs, bound=5000)
    assert held.groupBy("_before").count().agg(F.max("count")).first()[0] <= 5000
    r = exact_quantiles(df, [], "v", qs, bound=5000).first()
    values = [2.0 ** 20 + i * 7919 % 1_000_003 * 1024 / 1_000_003 for i in range(rows)]
    for name, q in qs.items():
        assert r[name] == pytest.approx(model(values, q), abs=1e-6)


def test_cut_again_in_groups(spark):
    rng = random.Random(5)
    rows = [(g, 1.0 + rng.random() * 1e-3 if g != "c" else 7.0, rng.randint(1, 3)) for g in ("a", "b", None, "c") for _ in range(400)] + [("a", 1e300, 1), ("b", -1e300, 2)]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double, w int"), ["g"], "v", {"p30": 0.3, "p99": 0.99, "p100": 1.0}, "w", bound=3).collect()}
    for g in ("a", "b", None, "c"):
        values = [v for k, v, w in rows if k == g for _ in range(w)]
        assert [got[g].p30, got[g].p99, got[g].p100] == pytest.approx([model(values, q) for q in (0.3, 0.99, 1.0)], rel=1e-15)


def test_many_groups_equal_few(spark):
    """200,000 groups, one of them null and one with a third of the rows: the joins beside the broadcast lose and double nothing."""
    n = 200_000
    key = F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id") % n)
    df = spark.range(3 * n).select(key.alias("g"), (F.col("id") % 7).alias("v"), F.col("id").alias("_x"))
    stats = df.groupBy("g").agg(F.sum("v").alias("s"))
    for how in ("inner", "left"):
        some = stats.where("g IS NULL OR g % 10 <> 4")  # the null group, which a third of the rows hold, has its figures
        got = groups.attach_group(df, some, ["g"], how).select("g", "v", "_x", "s")
        want = groups.join_null_safe(df, some, ["g"], how).select("g", "v", "_x", "s")
        assert got.count() == want.count()
        assert got.agg(F.sum(F.xxhash64("g", "v", "_x", "s").cast("decimal(38,0)"))).first() == want.agg(F.sum(F.xxhash64("g", "v", "_x", "s").cast("decimal(38,0)"))).first()
    small = groups.attach_group(df.where("_x < 5000"), stats.where("g IS NOT NULL"), ["g"], "left", max_groups=10)
    assert small.where("g IS NULL").where("s IS NOT NULL").count() == 0 and small.count() == 5000


def test_quantiles_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(groups, "MAX_GROUPS", 50)
    rows = [(k % 300, float(k * 31 % 1009)) for k in range(6000)]
    got = {r.g: r.p80 for r in exact_quantiles(spark.createDataFrame(rows, "g long, v double"), ["g"], "v", {"p80": 0.8}).collect()}
    assert len(got) == 300
    for g in range(300):
        assert got[g] == pytest.approx(model([v for k, v in rows if k == g], 0.8))


def test_sums_have_no_cap_and_no_millionths(spark):
    df = spark.createDataFrame([("a", 1e-7), ("a", 3e-10), ("b", 9e15), ("b", 9e15), ("b", 0.25), ("c", 1e30), ("c", 1.0), ("d", None)], "g string, v double")
    got = {r.g: r.s for r in df.groupBy("g").agg(P.exact_sum(F.col("v")).alias("s")).collect()}
    assert got == {"a": 1.003e-07, "b": 18000000000000000.0, "c": 1e30, "d": None}


ROWS = [("A", "05-01-2024", "2", "2", None, None), ("A", "06-02-2024", "3", "3", "real text", None), ("A", "06-02-2024", "3", "3", "x", "D1"),
        ("B", "07-03-2024", "4", "4", "b", "D1"), ("B", "07-03-2024", "900", "4", "b", None), ("C", "bad", "1", "1", None, None), ("C", "bad", "1", "1", "c", "D1")]


def test_null_depots_are_a_group(spark):
    raw = raw_rows(spark, ROWS)
    mv = normalise_movements(raw)
    by = ["depot_name"]
    pat = {(r.depot_name, r.material_number): r for r in P.material_patterns(mv, by, with_description=True).collect()}
    assert set(pat) == {(None, "A"), (None, "B"), ("D1", "A"), ("D1", "B")}
    assert pat[None, "A"].description == "real text" and pat[None, "A"].n_months == 3
    assert {(r.depot_name, r.material_number, r.description) for r in K.non_moving_materials(raw, by).collect()} == {(None, "C", "N/A"), ("D1", "C", "c")}
    assert {r.depot_name for r in P.peak_month_histogram(P.material_patterns(mv, by), by).collect()} == {None, "D1"}
    assert {r.depot_name for r in A.anomaly_summary(mv, by).collect()} == {None, "D1"}
    assert P.materials_dim(mv).where("material_number = 'A'").first().description == "real text"


def test_movements_are_not_exchanged_on_the_group(spark):
    plan = A.anomaly_rows(normalise_movements(raw_rows(spark, ROWS)), ["depot_name"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan


SCANS = {"predict_inventory": 0, "predict_inventory_by_depot": 0, "anomalies": 0, "anomalies_by_depot": 0, "high_demand_by_month": 0, "vendor_orders": 0,
         "tier_counts_by_depot": 0, "patterns": 0, "full_report_summary_by_depot": 0, "order_lines": 0, "assign_vendor": 0}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_one_pass_over_the_source(spark, name):
    """Building the query reads lineitem in one job; what is left reads stored tables only."""
    import __spark_entry__ as E
    reads = []
    original = stored_module.stored

    def counting(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        reads.append(len(set(re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*lineitem", plan))) if "lineitem" in plan else 0)
        return original(df)

    with pytest.MonkeyPatch.context() as patch:
        for module in (P, A, C, R, groups, quantiles, registry):
            patch.setattr(module, "stored", counting)
        df = E.queries()[name](spark, SMOKE)
        df.collect()
    left = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("lineitem.parquet")
    assert sum(reads) == 1 and left == SCANS[name], (reads, left)


def test_slots_are_summed_where_a_material_is_together(spark):
    """2,000 materials (one of them with half of the rows, one null) whose rows lie in 8 partitions at random: before the slots' own shuffle
    there is about one wide partial row a material, not one for each partition."""
    n = F.col("id") * 7919 % 16_001
    material = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(n % 2000 == 3, F.lit(None).cast("string")).otherwise((n % 2000).cast("string"))
    mv = spark.range(0, 16_000, 1, 8).select(material.alias("material_number"), (F.col("id") % 12 + 1).cast("int").alias("month"), F.lit(0.5).alias("consumption_qty"),
                                             F.col("id").cast("double").alias("amount"), F.lit("2024-01-05").cast("date").alias("document_date"))
    slots = P.month_slots(mv, [])
    rows = {r.material_number: r for r in slots.collect()}
    assert "REBALANCE_PARTITIONS_BY_COL" in slots._jdf.queryExecution().executedPlan().toString()
    want = {r.material_number: r for r in mv.groupBy("material_number").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("amount") * 2).alias("p"), F.sum("consumption_qty").alias("q")).collect()}
    assert set(rows) == set(want) and all(rows[k].n_valid == want[k].n and rows[k].max_price == want[k].p for k in want)
    assert all(sum(rows[k][f"_q{i}"] or 0 for i in range(1, 13)) == want[k].q for k in want)
    dealt = P._dealt(mv, []).withColumn("_part", F.spark_partition_id())
    assert dealt.groupBy("material_number").agg(F.countDistinct("_part").alias("n")).agg(F.max("n")).first()[0] == 1


def test_fractional_sums_do_not_depend_on_order(spark):
    rows = [("A", "05-01-2024", f"{0.1 * k:.2f}", "1") for k in range(1, 200)]
    one = P.monthly_consumption(normalise_movements(raw_rows(spark, rows).coalesce(1))).first().qty
    many = P.monthly_consumption(normalise_movements(raw_rows(spark, rows[::-1]).repartition(7))).first().qty
    assert one == many == 1990.0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_serial_numbers_equal_row_number(spark, by):
    """One group holds most rows; it is spread over partitions and its numbers run on."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 20_011).alias("v"), F.lit("x").alias("n"))
    got = serial_numbers(df, by, ["v"], "no", partitions=13)
    want = df.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("v")))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert serial_numbers(df.limit(0), by, ["v"]).count() == 0
    ranged = df.repartitionByRange(13, *by, "v").where("g IS NULL").groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < 4000  # of 18,000 rows of the group
