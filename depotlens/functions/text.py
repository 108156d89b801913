"""Text helpers: month names (N10), display clipping (N12), number text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names, January first (locale-proof lookup).
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]


def month_name(month: Column) -> Column:
    """1..12 -> English name; anything else -> null."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.when(month.between(1, 12), F.element_at(names, month.cast("int")))


def clip_text(c: Column, width: int = 40) -> Column:
    """Description cut to ``width`` characters plus ``...`` when longer."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def float_text(c: Column) -> Column:
    """Text of a double as Python's ``str(float)`` writes it for ordinary values.

    Whole numbers print with one decimal (``12.0``); other values use the
    shortest round-trip digits.  Used inside generated recommendation sentences.
    """
    whole = c == F.floor(c)
    return F.when(whole & (F.abs(c) < F.lit(1e15)), F.concat(c.cast("long").cast("string"), F.lit(".0"))).otherwise(
        c.cast("string")
    )


def word_count(c: Column) -> Column:
    """Python ``len(s.split())``: whitespace-separated words, 0 for blank."""
    t = F.trim(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))
