"""K1 with an index: trigram postings over the distinct (material, description) pairs.

The index is built in one pass over the raw rows and kept as three tables: ``pairs`` (each distinct pair with its first row and highest price), ``prices`` (the highest price per
material) and ``postings`` (trigram, pair), partitioned by a hash of the trigram.  A search takes the trigrams that every match has to hold from the query, reads only their
partitions, and runs the regex on the pairs that hold all of them; the raw rows are not read again.  A query of which
no trigram is certain runs on all pairs.  Rows are those of ``catalog.search_movements``.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.functions.dates import parse_any_date
from depotlens.functions.stored import shared_folder
from depotlens.functions.text import month_name
from depotlens.operators.normalise import is_valid, to_number, typed_columns

GRAM = 3
#: Partitions of the postings.
BUCKETS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Of a pattern: an escaped character, a class, a counted repeat, or one character.
_PARTS = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{[^}]*\}|.", re.DOTALL)

#: Letters after a backslash that stand for themselves alone; others take more of the pattern with them.
SIMPLE = "dDwWsSbBAzZhHvVRtnrfae"


def required_grams(pattern: str) -> list[str]:
    """Trigrams that every match of a case-insensitive pattern holds; those of its runs of plain ASCII characters.

    Cautious: patterns with groups, alternatives, flags or escapes of several characters have none, and a character that a quantifier follows is in no run.
    """
    if any(c in pattern for c in "()|") or any(e[1].isalnum() and e[1] not in SIMPLE for e in re.findall(r"\\.", pattern)):
        return []
    runs = [""]
    parts = _PARTS.findall(pattern)
    for part, after in zip(parts, [*parts[1:], ""]):
        plain = part[1:] if part.startswith("\\") and not part[1:].isalnum() else part
        literal = len(plain) == 1 and plain.isascii() and (part.startswith("\\") or plain not in "[]{}*+?.^$\\")
        if literal and not (after and after[0] in "*?{+"):
            runs[-1] += plain.translate(str.maketrans(_UPPER, _LOWER))
        else:
            runs.append("")
    return sorted({run[i:i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def _grams(text: Column) -> Column:
    low = F.translate(text, _UPPER, _LOWER)
    return F.when(F.length(low) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build_index(raw: DataFrame, path: str | None = None) -> str:
    """Write the index of ``raw`` (with ``row_key``) under ``path``; returns the path."""
    path = path or shared_folder(raw.sparkSession)
    rows = raw.select("row_key", F.struct("row_key", F.col("Quantity").alias("q"), F.col("Amount").alias("a"), F.col("Document Date").alias("d")).alias("first"), *[
        F.col(f"`{c}`") for c in raw.columns if c != "row_key"])
    price = F.when(is_valid() & (F.col("amount") > 0), F.col("amount") / F.col("consumption_qty"))
    texts = typed_columns(rows, keep=["first"]).select("first", F.coalesce("material_number", F.lit("nan")).alias("material_number"),
                                                       F.coalesce("source_description", F.lit("nan")).alias("description"), price.alias("price"))
    pairs = texts.groupBy("material_number", "description").agg(F.min("first").alias("first"), F.max("price").alias("price"))
    pairs.withColumn("pair", F.monotonically_increasing_id()).write.parquet(f"{path}/pairs")
    kept = raw.sparkSession.read.parquet(f"{path}/pairs")
    kept.groupBy("material_number").agg(F.max("price").alias("price")).write.parquet(f"{path}/prices")
    grams = F.array_distinct(F.concat(_grams(F.col("material_number")), _grams(F.col("description"))))
    postings = kept.select("pair", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    postings.repartitionByRange("bucket", "gram", "pair").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    return path


def candidates(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """(pair): the pairs that hold all the trigrams."""
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]  # of one query
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    return hits.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("pair")


def search_indexed(spark: SparkSession, path: str, query: str = "", limit: int = 50) -> DataFrame:
    """K1 by an index: see ``catalog.search_movements`` for what comes out."""
    pairs = spark.read.parquet(f"{path}/pairs")
    if query:
        grams = required_grams(query)
        if grams:
            pairs = pairs.join(candidates(spark, path, grams), "pair", "left_semi")
        pattern = "(?i)" + query
        pairs = pairs.where(F.col("material_number").rlike(pattern) | F.col("description").rlike(pattern))
    first = pairs.groupBy("material_number").agg(F.min(F.struct("first", "description")).alias("f"))
    top = first.select("material_number", "f.description", "f.first.*").orderBy("row_key").limit(limit)
    out = top.join(spark.read.parquet(f"{path}/prices"), "material_number", "left")
    q, a, d = to_number(F.col("q")), to_number(F.col("a")), parse_any_date(F.col("d"))
    readable = (F.col("q").isNull() | q.isNotNull()) & (F.col("a").isNull() | a.isNotNull()) & d.isNotNull()
    return out.where(readable).select(
        "material_number", "description", F.coalesce(q, F.lit(0.0)).alias("quantity"), F.coalesce(a, F.lit(0.0)).alias("amount"),
        F.coalesce("price", F.lit(0.0)).alias("unit_price"), F.date_format(d, "yyyy-MM-dd").alias("date"), month_name(F.month(d)).alias("month"),
        F.year(d).cast("long").alias("year"), "row_key")
