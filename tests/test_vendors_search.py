from pyspark.sql import functions as F

from depotlens.functions.joins import contains_join
from depotlens.operators import catalog as K
from depotlens.operators import vendors as V


def _setup(spark):
    mats = spark.createDataFrame([
        ("100", "red bolt small"),      # 'bolt' 2 + 'red bolt' 4 for A; ties none
        ("101", "blue widget"),         # widget: C and D tie (2 each) + blue C -> C
        ("102", "cold anvil"),          # 'old' inside 'cold' -> D
        ("177", "plain plate"),         # '77' only in the number -> D with 1 point
        ("103", "economy plate"),       # no rule -> fallback priority 1 -> B
        ("104", "hot plate"),           # nothing -> default
        ("105", "ring ring"),           # duplicated rule row counts twice: 2+2 per occurrence-check -> B
    ], "material_number string, description string")
    rules = spark.createDataFrame([(1, "A", "bolt"), (2, "A", "red bolt"), (3, "C", "widget"), (4, "D", "widget"),
                                   (5, "C", "blue"), (6, "D", "old"), (7, "D", "77"), (8, "B", "ring"), (9, "B", "ring")],
                                  "rule_id int, vendor string, keyword string")
    vendors = spark.createDataFrame([(1, "A", "a@x", "1"), (2, "B", "b@x", "2"), (3, "C", "c@x", "3"),
                                     (4, "D", "d@x", "4"), (5, "E", "e@x", "5")],
                                    "vendor_rank int, vendor string, contact string, phone string")
    fb = spark.createDataFrame([(1, "economy", "B"), (2, "plate", "C"), (9, None, "A")],
                               "priority int, term string, vendor string")
    return mats, rules, vendors, fb


def test_vendor_assignment(spark):
    mats, rules, vendors, fb = _setup(spark)
    got = {r.material_number: (r.vendor, r.score) for r in V.assign_vendor(mats, rules, vendors, fb).collect()}
    assert got["100"] == ("A", 6)
    assert got["101"] == ("C", 4)          # widget 2 + blue 2 = 4 vs D 2
    assert got["102"] == ("D", 2)
    assert got["177"] == ("D", 1)          # in the number only: not doubled
    assert got["103"] == ("B", 0)          # fallback priority 1 beats 'plate'
    assert got["104"] == ("C", 0)          # 'plate' priority 2
    assert got["105"] == ("B", 4)          # duplicate rule rows both count
    cat = {r.vendor: r.materials for r in V.vendor_catalog(V.assign_vendor(mats, rules, vendors, fb), vendors).collect()}
    assert cat["E"] == 0 and sum(cat.values()) == 7


def test_contains_join_equals_brute_force(spark):
    texts = [(1, "red bolt small"), (2, "bolt"), (3, ""), (4, None), (5, "x"), (6, "old cold old"), (7, "ab"), (7, "ab")]
    patterns = [(1, "bolt"), (2, "red bolt"), (3, "old"), (4, "x"), (5, ""), (6, None), (7, "ab"), (8, "abc"), (9, "bolt")]
    t = spark.createDataFrame(texts, "id int, t string")
    p = spark.createDataFrame(patterns, "rule int, p string")
    want = sorted((i, r) for i, x in texts for r, y in patterns if y is None or (x is not None and y in x))
    assert sorted((r.id, r.rule) for r in contains_join(t, "t", p, "p").collect()) == want
    assert contains_join(t, "t", p.limit(0), "p").count() == 0 and contains_join(t.limit(0), "t", p, "p").count() == 0


def test_equal_requests_stay_one_row_each(spark):
    from helpers import raw_rows
    from depotlens.operators import patterns as P
    from depotlens.operators.normalise import normalise_movements
    raw = raw_rows(spark, [("A1", "01-01-2024", "2", "4", "ring one"), ("B2", "01-02-2024", "3", "3", "ring two"), ("C3", "01-02-2024", "1", "1", "plate")])
    pat = P.material_patterns(normalise_movements(raw), with_description=True)
    req = spark.createDataFrame([(1, "plate", 5.0), (2, "plate", 5.0), (3, "ring", None), (4, "A1", 1.0)], "request_id int, text string, current_qty double")
    res = K.resolve_requests(req, pat.select("material_number", "description"))
    out = {r.request_id: r for r in K.predict_requests(res, pat).collect()}
    assert len(out) == 4 and K.predict_requests(res, pat).count() == 4
    assert out[1].predicted_status == out[2].predicted_status and out[1].material_number == "C3"
    assert [(r.request_id, r.position, r.material_number) for r in K.request_matches(res).orderBy("position").collect()] == [(3, 1, "A1"), (3, 2, "B2")]


def test_search_ranked_limit_before_sort(spark):
    mats = spark.createDataFrame([("1", "xx red long name"), ("2", "red"), ("3", "Red short"), ("4", "redder")],
                                 "material_number string, description string")
    got = [r.material_number for r in K.search_ranked(mats, "RED", limit=3).orderBy("rank").collect()]
    assert got == ["2", "3", "1"]          # "4" is beyond the limit; prefix first, then shorter
    assert K.search_ranked(mats, "r").count() == 0
    cat = [r.material_number for r in K.search_catalog(mats, "re", limit=2).collect()]
    assert cat == ["1", "2"]


def test_search_regex_and_dedupe(spark):
    from helpers import raw_rows
    from depotlens.operators.normalise import normalise_movements
    raw = raw_rows(spark, [("A1", "01-01-2024", "-2", "4", "Gear (big)"), ("A1", "02-01-2024", "3", "3", "Gear (big)"),
                           ("B2", "n/a", "1", "1", "gear small"), ("C3", "01-01-2024", "1", "1", "plate")])
    got = K.search_movements(raw, normalise_movements(raw), r"gear \(").collect()
    assert [(r.material_number, r.quantity) for r in got] == [("A1", -2.0)]
    assert K.search_movements(raw, normalise_movements(raw), "GEAR").count() == 1   # B2's only row has a bad date
