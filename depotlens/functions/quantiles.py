"""Exact quantiles per group, by repeated selection, without holding a group in one task.

1. Equal values are counted (``groupBy(group, value)``, combined on the map side).
2. Each distinct value falls into a bucket that only depends on the value and grows with it: its binary exponent, cut into
   ``STEPS`` equal steps.  Buckets of a group are few (about ``STEPS`` for each power of two that the values span) and their
   totals say which bucket holds which rank.
3. Only buckets that hold a wanted rank go on.  One with more than ``BOUND`` distinct values is cut again, into ``STEPS`` equal steps between its own
   least and largest value, as often as it takes: a step of the first round leaves 42 bits of a double, so there are five rounds at most.
4. Values of the last buckets are ranked, at most ``BOUND`` in a task's window, and two values per quantile are
   interpolated linearly, as pandas and numpy do.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.functions.groups import attach_group
from depotlens.functions.stored import stored

STEPS = 1024
#: Most distinct values of a bucket that are ranked together.
BOUND = 50_000
#: Above the exponent of every double, so that a bucket number has the sign of its values.
_LIFT = 1100


def _bucket(v: Column) -> Column:
    """A whole number that does not fall as ``v`` rises.

    ``log2`` may round across a power of two; the step is then -1 or ``STEPS``, which is the neighbour it belongs to.
    """
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS)
    place = (exponent + _LIFT) * STEPS + step
    return F.when(v > 0, place).when(v < 0, -place).otherwise(0).cast("long")


def _ranks(quantiles: dict[str, float]) -> dict[str, Column]:
    return {name: q * (F.col("_all") - 1) for name, q in quantiles.items()}


def buckets_to_rank(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], weight: str | None = None, bound: int = BOUND) -> DataFrame:
    """(by, _v, _n, _before, _b, _all): the distinct values of the buckets that hold a wanted rank, none with more than ``bound`` of them.

    ``_before``: how many rows come before the bucket; it names the bucket within its group.
    """
    by = list(by)
    v = F.col(value).cast("double")
    n = F.sum(weight) if weight else F.count(F.lit(1))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    counts = df.where(finite).groupBy(*by, v.alias("_v")).agg(n.cast("long").alias("_n")).where("_n > 0")
    rows = counts.withColumn("_base", F.lit(0).cast("long")).withColumn("_b", _bucket(F.col("_v"))).withColumn("_all", F.lit(None).cast("long"))
    while True:
        cells = rows.groupBy(*by, "_base", "_b").agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"),
                                                     F.max("_v").alias("_hi"), F.max("_all").alias("_known"))
        earlier = Window.partitionBy(*by, "_base").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        places = cells.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_t").over(earlier), F.lit(0)))
        places = places.withColumn("_all", F.coalesce("_known", F.sum("_t").over(Window.partitionBy(*by))))
        wanted = F.lit(False)
        for p in _ranks(quantiles).values():
            for rank in (F.floor(p), F.ceil(p)):
                wanted = wanted | ((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_t")))
        held = stored(places.where(wanted).select(*by, "_base", "_b", "_before", "_all", "_lo", "_hi", "_d"))
        inside = attach_group(rows.drop("_all"), held, [*by, "_base", "_b"], is_stored=True)
        if held.where((F.col("_d") > bound) & (F.col("_lo") < F.col("_hi"))).isEmpty():
            return inside.select(*by, "_v", "_n", "_before", "_b", "_all")
        finer = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * STEPS).cast("long")
        rows = stored(inside.select(*by, "_v", "_n", F.col("_before").alias("_base"), F.when(F.col("_d") > bound, finer).otherwise(0).alias("_b"), "_all"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], weight: str | None = None, bound: int = BOUND) -> DataFrame:
    """One row per group of ``by``: the columns named in ``quantiles`` (name -> q) over the finite values.

    ``weight`` (whole numbers) is how often a row counts.
    """
    by = list(by)
    held = buckets_to_rank(df, by, value, quantiles, weight, bound)
    upto = Window.partitionBy(*by, "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("_end", F.col("_before") + F.sum("_n").over(upto))

    def at(rank):
        return F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("_v")))

    position = _ranks(quantiles)
    picked = ranked.groupBy(*by).agg(F.first("_all").alias("_all"), *[
        c for name, p in position.items() for c in (at(F.floor(p)).alias(f"_lo_{name}"), at(F.ceil(p)).alias(f"_hi_{name}"))])

    def between(name):
        p, low, high = position[name], F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(name)

    # A grouping-free aggregate of no rows is one row of nulls: as ``percentile`` gives.
    return picked.select(*by, *[between(name) for name in quantiles])
