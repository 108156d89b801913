"""Output shaping for registered queries: flat columns with fixed types."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Integers -> bigint, decimals/floats -> double, dates -> 'yyyy-MM-dd' text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def nullable_ints_as_double(df: DataFrame, cols: list[str]) -> DataFrame:
    """Integer columns that are null on some rows (e.g. not-found stock rows)
    as double, so every consumer (pandas included) sees one numeric type."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
