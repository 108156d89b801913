"""Corpus pipeline: toxicity, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet into the shared folder and reads again
as the next stage's ``docs``.  All but the last return the columns of documents.  A stage that cuts text keeps every document,
with the text that is left; one that loses nothing keeps its text as it was, byte for byte.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.llm.common import stored
from depotlens.llm.line_dedup import line_dedup
from depotlens.llm.near_dedup import near_duplicates
from depotlens.llm.packing import pack, token_pieces
from depotlens.llm.queries import read, ship, vocabulary
from depotlens.llm.substring_dedup import substring_dedup
from depotlens.llm.toxicity import THRESHOLD, fit, score


def _documents(out: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """An operator's (id, text, rest) as the columns of ``docs``, in their order."""
    columns = {"doc_id": F.col("id"), "text": F.col(text)}
    return out.select(*[columns.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.  Trains on the labelled documents among ``docs``."""
    ship(spark)
    model = fit(docs, read(spark, sf_dir, "labels"))
    return _documents(score(docs, model).where(F.col("score") < THRESHOLD), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one of them."""
    ship(spark)
    return _documents(line_dedup(docs).withColumn("left", F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))), docs, "left")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Rows without an id take part under a number made of their text, above any real id, so copies of one another or of a named document go like others.
    Of rows equal in id and text the least by their other columns stays.
    """
    ship(spark)
    made = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select(F.coalesce("doc_id", made).alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in rest], F.col("doc_id").isNull().alias("_nameless")).alias("rest"))
    kept = near_duplicates(named.select("doc_id", "text")).where("kept").select(F.col("id").alias("_kept")).distinct()
    one = named.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi").groupBy("doc_id", "text").agg(F.min("rest").alias("rest"))
    columns = {"doc_id": F.when(~F.col("rest._nameless"), F.col("doc_id")), "text": F.col("text")}
    return one.select(*[columns.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start more than once in the corpus are cut."""
    ship(spark)
    return _documents(substring_dedup(docs).withColumn("left", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), docs, "left")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed into sequences."""
    ship(spark)
    pieces = token_pieces(docs.select("doc_id", "text"), vocabulary())
    return pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("line_dedup", lines), ("near_dedup", near_duplicate), ("substring_dedup", substrings), ("packing", packing)]

#: The stages include a trained classifier and a tokenizer, which SQL cannot express; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` in order."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
