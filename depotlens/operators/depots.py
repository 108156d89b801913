"""Depot selection."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class UnknownDepotError(ValueError):
    pass


def filter_depot_exact(df: DataFrame, depot: str, column: str = "Name 1", check: bool = True) -> DataFrame:
    """Rows of one depot; with ``check`` an empty result raises, listing depots."""
    out = df.where(F.col(f"`{column}`") == F.lit(depot))
    if check and out.isEmpty():
        known = sorted(r[0] for r in df.select(F.col(f"`{column}`")).distinct().collect() if r[0] is not None)
        raise UnknownDepotError(f"no movements of depot {depot!r}; the source has {known}")
    return out


def filter_depot_like(df: DataFrame, pattern: str, column: str = "Name 1", regex: bool = True) -> DataFrame:
    """Case-insensitive contains on the depot column (regex by default).

    Null depots never match; a frame without the column passes unchanged.
    """
    if column not in df.columns:
        return df
    c = F.col(f"`{column}`")
    cond = c.rlike("(?i)" + pattern) if regex else F.lower(c).contains(pattern.lower())
    return df.where(F.coalesce(cond, F.lit(False)))


def resolve_depot_alias(keys: DataFrame, aliases: DataFrame, key_col: str = "depot_key") -> DataFrame:
    """Short depot key -> full depot name; unknown keys pass through.

    The alias table is a small dimension: AQE broadcasts it at runtime.
    """
    a = aliases.select(F.col("alias").alias("_alias"), F.col("depot_name").alias("_full"))
    j = keys.join(a, keys[key_col] == a["_alias"], "left")
    return j.select(*[keys[c] for c in keys.columns], F.coalesce("_full", keys[key_col]).alias("depot_name"))
