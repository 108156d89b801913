"""Substring joins: one plan at every size, one pass over the texts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a pattern that key the join; shorter patterns are keyed by all of theirs.
KEY_CHARS = 3
#: 64-bit words of the Bloom filter over the patterns' keys, and parts into which texts are dealt for patterns that match by definition.
BLOOM_WORDS = 1024
SALTS = 64


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOOM_WORDS * 64))


def _bloom(keys: DataFrame) -> DataFrame:
    """One row: the key lengths that occur (at most ``KEY_CHARS``) and the filter's words."""
    words = keys.select(F.floor(_bit(F.col("_key")) / 64).cast("int").alias("w"),
                        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(_bit(F.col("_key")), F.lit(64)).cast("int")).alias("bit"), F.length("_key").alias("size"))
    filled = words.groupBy("w").agg(F.bit_or("bit").alias("bits"), F.collect_set("size").alias("sizes"))
    one = filled.agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.array_distinct(F.flatten(F.collect_list("sizes"))).alias("_sizes"))
    return one.select("_sizes", F.transform(F.sequence(F.lit(0), F.lit(BLOOM_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("_words"))


def _maybe(key: Column) -> Column:
    bit = _bit(key)
    word = F.element_at("_words", (F.floor(bit / 64) + 1).cast("int"))
    return F.call_function("getbit", word, F.pmod(bit, F.lit(64)).cast("int")) == 1


def contains_join(texts: DataFrame, text_col: str, patterns: DataFrame, pat_col: str) -> DataFrame:
    """All (text row, pattern row) pairs in which ``text`` contains ``pattern``; texts are read once.

    A pattern's first ``KEY_CHARS`` characters are its key.  Each text looks its distinct substrings of the key lengths that occur up in a
    Bloom filter of the keys and emits those it may hold; keys meet in an equi-join (which the optimizer may
    broadcast by the size that it measures), and ``contains`` confirms the pair; the work follows the texts'
    lengths, not texts times patterns.  A null pattern matches every text, an empty pattern every
    text that is not null: their key is a number out of ``SALTS``, of which each text emits one.
    """
    t, p = F.col(text_col), F.col(pat_col)
    keyed = patterns.where(F.length(p) > 0).withColumn("_key", F.substring(p, F.lit(1), F.least(F.length(p), F.lit(KEY_CHARS)))).withColumn("_salt", F.lit(-1))
    always = patterns.where(p.isNull() | (F.length(p) == 0)).withColumn("_key", F.lit("")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    starts = F.transform(F.filter("_sizes", lambda n: n <= F.length(t)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n)))
    held = F.filter(F.array_distinct(F.flatten(starts)), _maybe)
    own = F.struct(F.lit("").alias("k"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in texts.columns]), F.lit(SALTS)).cast("int").alias("s"))
    every = F.concat(F.coalesce(F.transform(held, lambda k: F.struct(k.alias("k"), F.lit(-1).alias("s"))), F.array().cast("array<struct<k:string,s:int>>")), F.array(own))
    keys = texts.join(F.broadcast(_bloom(keyed)), F.lit(True)).withColumn("_e", F.explode(every)).select(
        *[F.col(f"`{c}`") for c in texts.columns], F.col("_e.k").alias("_key"), F.col("_e.s").alias("_salt"))
    hits = keys.join(keyed.unionByName(always), ["_key", "_salt"]).where(p.isNull() | t.contains(p))
    return hits.select(*[F.col(f"`{c}`") for c in [*texts.columns, *patterns.columns]])
