"""The registered ``opN_*`` queries: each applies its operator to its whole table and
derives the digest columns of the contract from the operator's real outputs."""
from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import depotlens

_SHIPPED: set[str] = set()
#: Rows of whole texts that one Arrow batch holds, where the session does not say: the default of 10,000 is tens of MB, several times over.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, and keep Arrow batches of whole texts small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(depotlens.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="depotlens-code-"), "depotlens_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, n)
                z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)
    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's vocabulary; the package that holds it is installed on every node."""
    import public_tokenizers
    return public_tokenizers.path(name)


def sha(column: str) -> F.Column:
    return F.sha2(F.col(column).cast("binary"), 256)


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.substring_dedup import substring_dedup
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", sha("kept").alias("kept_sha256"))


@_query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.near_dedup import near_duplicates
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.quality_rules import quality_rules
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality_rules(docs, read(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.bpe import encode
    path = vocabulary()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, path, and_decode=True)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                      sha("decoded").alias("decoded_sha256"))


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.labelled import fold
    from depotlens.llm.toxicity import THRESHOLD, fit, score
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@_query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.labelled import fold
    from depotlens.llm.quality_fm import fit, score
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.topk import top_k
    return top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@_query
def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.brown_lm import score
    from depotlens.llm.labelled import fold
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, ~fold("doc_id", 7, 2)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", fold("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.line_dedup import line_dedup
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", sha("kept").alias("kept_sha256"))


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.packing import pack, token_pieces
    pieces = token_pieces(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return pack(pieces).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.spelling import spelling_variants
    return spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.conversation_repair import damaged, repair, text_digests
    conversations = read(spark, sf_dir, "conversations")
    summary, repaired = repair(damaged(conversations))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = summary.join(text_digests(repaired).withColumnRenamed("conv_id", "other"), F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
    every = conversations.select(F.col("conv_id").alias("every_id")).distinct()
    return every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@_query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from depotlens.llm.token_counts import token_counts
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary("byte_bpe_50k.json")).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_minhash_near_dedup, op3_quality_rules, op4_bpe, op5_toxicity, op6_quality_classifier, op7_exact_top_k, op8_brown_lm, op9_line_dedup, op10_best_fit_packing,
                             op11_spelling_variants, op12_conversation_repair, op13_token_counts)
}
