from depotlens.operators import patterns as P
from depotlens.operators import segments as C
from depotlens.operators.normalise import normalise_movements
from helpers import by_key, raw_rows


def test_single_month_group(spark):
    mv = normalise_movements(raw_rows(spark, [("A", "01-01-2024", "3", "3"), ("B", "02-01-2024", "5", "5")]))
    p = by_key(P.material_patterns(mv))
    assert p["A"]["n_months"] == 1 and p["A"]["std_qty"] is None
    assert p["A"]["coefficient_of_variation"] is None        # variant A: null cv
    assert p["A"]["cv_rounded_basis"] == 0.0                 # variant B: 0
    assert p["B"]["avg_monthly_consumption"] == 5


def test_zero_fill_ties_and_years(spark):
    rows = [
        ("A", "01-01-2024", "4", "4"), ("A", "01-02-2024", "4", "4"),   # tie Jan/Feb -> Jan
        ("A", "01-03-2023", "1", "1"), ("A", "01-03-2024", "1", "1"),   # two years in March -> 2
        ("B", "01-02-2024", "6", "6"),                                  # absent Jan, Mar -> zeros
    ]
    p = by_key(P.material_patterns(normalise_movements(raw_rows(spark, rows))))
    a, b = p["A"], p["B"]
    assert a["n_months"] == 3 and a["peak_month"] == 1 and a["low_month"] == 3 and a["low_consumption"] == 2
    assert a["total_annual_consumption"] == 10 and a["avg_monthly_consumption"] == 3   # 10/3 -> 3
    assert b["observed_months"] == 1 and b["peak_month"] == 2 and b["low_month"] == 1 and b["low_consumption"] == 0
    assert b["avg_monthly_consumption"] == 2      # 6/3
    # std over [0, 6, 0] = sqrt(12) -> cv = 3.4641/2 = 1.73
    assert b["coefficient_of_variation"] == 1.73
    # variant B: std rounded 3 / avg 2 -> 1.5
    assert b["consumption_std"] == 3 and b["cv_rounded_basis"] == 1.5


def test_half_even_rounding(spark):
    # mean 2.5 -> 2 (half to even), mean 3.5 -> 4
    rows = [("A", "01-01-2024", "5", "1"), ("A", "01-02-2024", "0.0001", "1"),
            ("B", "01-01-2024", "7", "1"), ("C", "01-02-2024", "1", "1")]
    p = by_key(P.material_patterns(normalise_movements(raw_rows(spark, rows))))
    assert p["B"]["avg_monthly_consumption"] == 4    # 7/2 = 3.5 -> 4
    assert p["C"]["avg_monthly_consumption"] == 0    # 1/2 = 0.5 -> 0


def test_tiers_edges(spark):
    pat = spark.createDataFrame(
        [("m1", 10, 0.99), ("m2", 10, 1.0), ("m3", 5, None), ("m4", 5, 1.5), ("m5", 1, 0.2), ("m6", 1, 3.0)],
        "material_number string, avg_monthly_consumption long, coefficient_of_variation double")
    got = {r.material_number: r.tier for r in C.classify_materials(pat).collect()}
    # p80 of [1,1,5,5,10,10] = 10, p50 = 5
    assert got == {"m1": "HD_Critical", "m2": "HD_Variable", "m3": "MD_Regular", "m4": "MD_Seasonal",
                   "m5": "LD_Stable", "m6": "LD_Sporadic"}
    counts = {r.tier: r.materials for r in C.tier_counts(C.classify_materials(pat)).collect()}
    assert len(counts) == 6 and sum(counts.values()) == 6
