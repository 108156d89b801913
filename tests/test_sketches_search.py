"""Sketches against exact figures within their stated errors; the trigram index against the plain search."""
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMOKE
from depotlens.operators import catalog as K
from depotlens.operators import patterns as P
from depotlens.operators import search_index as X
from depotlens.operators import sketches as S
from depotlens.operators.normalise import normalise_movements
from depotlens.plans.registry import movements
from helpers import raw_rows


def rank_of(values, v):
    return sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)


def test_sketches_within_their_errors(spark):
    rng = random.Random(4)
    mv = spark.createDataFrame([(rng.choice(["a", "b", None]), f"2024-{rng.randint(1, 12):02d}", str(rng.randint(1, 9000)), rng.lognormvariate(3, 2)) for _ in range(60_000)],
                               "depot_name string, year_month string, material_number string, consumption_qty double").withColumn("document_date", F.lit("2024-01-05").cast("date"))
    table = S.sketch_table(mv, ["depot_name"])
    assert table.count() == 36
    for by in (["depot_name"], []):
        for r in S.approximate_overview(table, by, {"q10": 0.1, "q50": 0.5, "q99": 0.99}).collect():
            rows = mv.where(F.col("depot_name").eqNullSafe(r["depot_name"])) if by else mv
            rows = rows.select("material_number", "consumption_qty").collect()
            exact = len({x[0] for x in rows})
            assert r.valid_rows == len(rows) and abs(r.materials - exact) <= 4 * 1.04 / 2 ** (S.HLL_BITS / 2) * exact
            for name, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
                low, high = rank_of([x[1] for x in rows], r[name])
                assert low - 2 * S.rank_error() <= q <= high + 2 * S.rank_error()


def test_approximate_thresholds(spark):
    pat = P.material_patterns(movements(spark, SMOKE), ["depot_name"])
    values = {}
    for r in pat.collect():
        values.setdefault(r.depot_name, []).append(r.avg_monthly_consumption)
    got = S.approximate_thresholds(pat, ["depot_name"], parts=8).collect()
    assert {r.depot_name for r in got} == set(values)
    for r in got:
        for name, q in (("p80", 0.8), ("p50", 0.5)):
            low, high = rank_of(values[r.depot_name], r[name])
            slack = 2 * S.rank_error() + 1 / len(values[r.depot_name])  # a quantile between two values may be either
            assert low - slack <= q <= high + slack


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abAB.*+?[]^\\d{}2 é-$", max_size=10), st.text(alphabet="abAB2 é-.d", max_size=12))
def test_required_grams_are_in_every_match(pattern, text):
    try:
        found = re.search(pattern, text, re.IGNORECASE | re.ASCII)
    except re.error:
        return
    if found:
        low = "".join(c.lower() if c.isascii() else c for c in text)
        assert all(g in low for g in X.required_grams(pattern))


def test_required_grams():
    assert X.required_grams("Ring") == ["ing", "rin"]
    assert X.required_grams("ab+cde?fgh") == ["fgh"]
    assert X.required_grams(r"a\.bc\dxyz[abc]{3}") == [".bc", "a.b", "xyz"]
    assert X.required_grams("abc|def") == [] and X.required_grams("(?i)abcdef") == [] and X.required_grams("ab") == []
    assert X.required_grams(r"\x41bcd") == [] and X.required_grams(r"\Qa.b\E") == [] and X.required_grams(r"\p{L}abc") == []


ROWS = [("A1", "05-01-2024", "2", "4", "Red Ring"), ("A1", "06-01-2024", "2", "8", "red rings"), ("A2", "bad", "2", "8", "bring"), ("A3", "05-01-2024", "x", "8", "ringlet"),
        ("A4", "05-01-2024", "-2", None, "EARRING"), (None, "05-01-2024", "2", "8", "ring of null"), ("ring", "05-01-2024", "2", "8", None), ("A5", "05-01-2024", "2", "8", "bolt"),
        ("A1", "05-01-2023", "1", "9", "bolt")]


@pytest.mark.parametrize("query", ["ring", "RING", "", "r.ng", "nan", "red +ring", "bolt", "a1", "(ring|bolt)", "no such", "r"])
def test_index_gives_the_rows_of_the_search(spark, query):
    raw = raw_rows(spark, ROWS)
    path = X.build_index(raw)
    for limit in (50, 2):
        want = K.search_movements(raw, normalise_movements(raw), query, limit).collect()
        assert sorted(map(tuple, X.search_indexed(spark, path, query, limit).collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_bytes_read_follow_the_query(spark):
    words = spark.range(20_000).select(F.struct(F.col("id").cast("int").alias("pos")).alias("row_key"), F.lit("D").alias("Name 1"), F.format_string("M%05d", "id").alias("Material"),
                                       F.sha2(F.col("id").cast("string"), 256).alias("Material Description"), F.lit("05-01-2024").alias("Document Date"),
                                       F.lit("1").alias("Quantity"), F.lit("2").alias("Amount"))
    path = X.build_index(words)

    def read(grams):
        df = spark.read.parquet(f"{path}/postings")
        hits = df.where(F.col("gram").isin(grams) & F.col("bucket").isin([r[0] for r in df.where(F.col("gram").isin(grams)).select("bucket").distinct().collect()]))
        hits.collect()
        scan = hits._jdf.queryExecution().executedPlan().collectLeaves().head()
        return scan.metrics().apply("filesSize").value()

    whole = sum(f.size for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{path}/postings").select(F.col("length").alias("size")).collect())
    one = read(["abc"])
    assert one < whole / 10 and one < read(["abc", "bcd", "0a1", "123", "fff"])
    pairs = X.candidates(spark, path, ["abc", "bcd"]).count()
    assert 0 < pairs < 1000
