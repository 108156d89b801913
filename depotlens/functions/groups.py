"""Attach per-group statistics to rows without moving hot groups.

The statistics have one row per group; they are stored (``functions.stored``) and counted.

* Up to ``MAX_GROUPS`` of them are broadcast, so the big side is never exchanged on the group columns and a hot group stays where its rows are.
* Beyond, the statistics of the ``MAX_GROUPS`` largest groups are broadcast, and the other groups meet theirs in an equi-join.  A group outside the largest
  N holds less than 1/N of the rows, so that join has no hot key; the rows that have theirs already are dealt out by a hash of the whole row.

Group keys compare null-safe: rows with a null group are a group like any other, as in ``groupBy``.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.stored import stored

#: Most groups whose statistics are broadcast.
MAX_GROUPS = 100_000
#: Parts into which rows of the largest groups are dealt in the join for the others.
SALTS = 4096


def null_safe(left: list[Column], right: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)])


def attach_group(df: DataFrame, stats: DataFrame, by: list[str], how: str = "inner", *, max_groups: int | None = None,
                 is_stored: bool = False) -> DataFrame:
    """``df`` with the columns of its group's row in ``stats`` (one row per group of ``by``); ``how``: inner or left."""
    if not by:  # a grouping-free aggregate: exactly one row
        return df.join(F.broadcast(stats), on=F.lit(True), how=how)
    most = MAX_GROUPS if max_groups is None else max_groups
    kept = stats if is_stored else stored(stats)
    if kept.limit(most + 1).count() > most:
        return _attach_many(df, kept, by, how, most)
    keyed = _keyed(kept, by)
    return df.join(F.broadcast(keyed), _on(by), how).drop(*[f"_g_{c}" for c in by])


def _keyed(stats: DataFrame, by: list[str]) -> DataFrame:
    return stats.select(*[F.col(c).alias(f"_g_{c}") for c in by], *[F.col(f"`{c}`") for c in stats.columns if c not in by])


def _on(by: list[str]) -> Column:
    return null_safe([F.col(c) for c in by], [F.col(f"_g_{c}") for c in by])


def _attach_many(df: DataFrame, stats: DataFrame, by: list[str], how: str, most: int) -> DataFrame:
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    largest = stored(sizes.orderBy(F.desc("_rows"), *by).limit(most).drop("_rows"))
    figures = [c for c in stats.columns if c not in by]
    packed = stats.select(*by, F.struct(*[F.col(f"`{c}`") for c in figures]).alias("_near"))
    near = stored(join_null_safe(largest.withColumn("_large", F.lit(True)), packed, by, "left"))
    rows = df.join(F.broadcast(_keyed(near, by)), _on(by), "left").drop(*[f"_g_{c}" for c in by])
    salt = F.when(F.col("_large").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)) + 1)
    rows = rows.withColumn("_salt", salt.cast("int"))
    far = _keyed(packed.withColumnRenamed("_near", "_far"), by).withColumn("_g_salt", F.lit(0))
    joined = rows.join(far, _on([*by]) & (F.col("_salt") == F.col("_g_salt")), "left")
    found = F.coalesce("_near", "_far")
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[found.getField(c).alias(c) for c in figures])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which nulls match; ``keys`` come from the left side."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in keys], *[F.col(c) for c in right.columns if c not in keys])
    out = left.join(renamed, null_safe([F.col(c) for c in keys], [F.col(f"_r_{c}") for c in keys]), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{c}" for c in keys])
