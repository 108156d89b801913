"""The pipeline stage by stage against plain models, and the registered queries' contract."""
import collections
import zlib

import duckdb
import pytest
import xxhash

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from depotlens.llm.common import stored
from depotlens.llm.oracles import SQL
from depotlens.llm.queries import QUERIES
from depotlens.llm.toxicity import THRESHOLD, fit, score
from llm_cases import awkward_rows, components_model
from pyspark.sql import functions as F
from test_dedup import line_model, substring_model

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def made(text):
    """The number under which a row without an id takes part in near-duplicate detection."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return (1 << 62) + (h & (1 << 62) - 1)


def test_one_of_the_nameless_copies_stays(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(None, words, "en", "b"), (None, words, "en", "a"), (None, words + " end", None, "c"), (None, "other " * 30, "en", "d"), (None, "other " * 30, "en", "d"),
            (7, "named " * 20, "en", "z"), (7, "named " * 20, "de", "z"), (None, "named " * 20, "en", "y"), (None, None, "en", "e"), (None, None, "de", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(map(tuple, pipeline.near_duplicate(spark, docs, SMALL).collect()), key=repr)
    first = min((words, words + " end"), key=made)
    assert len(got) == 4 and (7, "named " * 20, "de", "z") in got and (None, "other " * 30, "en", "d") in got and (None, None, "de", "e") in got
    assert [r[1:] for r in got if r[1] and r[1].startswith("w0 ")] == [(words, "en", "a") if first == words else (words + " end", None, "c")]


def check_stages(spark, docs, sf_dir):
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = sorted(rows_of(docs), key=repr)
        out = stored(stage(spark, docs, sf_dir))
        if name != "packing":
            assert out.columns == columns and out.schema == docs.schema
            after = sorted(rows_of(out), key=repr)
        if name == "toxicity":
            model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            bad = collections.Counter((r.id, r.text) for r in score(docs, model).where(F.col("score") >= THRESHOLD).collect())
            assert collections.Counter(after) == collections.Counter(before) - bad
        if name == "line_dedup":
            assert len(after) == len(before)
            want = [(i, kept if dropped else t) for (i, t), (_, _, dropped, kept) in zip(before, line_model(before, in_order=True))]
            assert after == sorted(want, key=repr)
        if name == "near_dedup":
            numbered = [(made(t) if i is None else i, t) for i, t in before]
            component = components_model(numbered, 80)
            want = {(i, t) for i, t in numbered if component[i] == i}
            assert after == sorted(((None if i >= 1 << 62 else i, t) for i, t in want), key=repr)
        if name == "substring_dedup":
            assert after == sorted([(i, kept if gone else t) for i, t, _, gone, kept in substring_model(before, 35)], key=repr)
        if name == "packing":
            ends = collections.defaultdict(list)
            for r in out.collect():
                ends[r.sequence_id].append((r.offset, r.offset + r.length))
            for places in ends.values():
                places.sort()
                assert places[0][0] == 0 and places[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(places, places[1:]))
            assert sorted({r.doc_id for r in out.collect()}, key=repr) == sorted({i for i, _ in before}, key=repr)
        docs = out


def test_stages_on_the_small_table(spark):
    check_stages(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)


def test_stages_on_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", f"src{k}", len(t or "") or None) for k, (i, t) in enumerate(awkward_rows())],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    check_stages(spark, docs, SMALL)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL))
    assert docs.count() == 0


def test_run_and_registration(spark):
    queries = entry.queries()
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)} and set(QUERIES) <= set(queries) and "pipeline" in queries
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    assert pipeline.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want, key=repr)


def test_folds_of_the_scored_queries(spark):
    for name, folds, part in (("op5_toxicity", 3, 1), ("op6_quality_classifier", 3, 1), ("op8_brown_lm", 7, 2)):
        for r in QUERIES[name](spark, SMALL).collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == part)
