"""Parse a free-text date column the way the source system's loader does.

The first pattern that matches the whole string and names a real day wins, in this
order (day-first before month-first, so ``03/04/2024`` is 4 March and
``25/12/2024`` falls through to the day-first pattern).  What none of them takes goes
to the free-form tail, of which these shapes are supported: ``y-M-d`` with ``-``, ``/`` or ``.``,
``yyyyMMdd``, ``M-d-yyyy`` (else ``d-M-yyyy``) with any of the three, ``Jan 5 2024`` / ``January 5, 2024`` and
``5 Jan 2024`` / ``5-Jan-2024``, each with an optional time of day and zone, which is dropped.  Anything else, such
as a year alone or trailing text, is null.

Implementation: one chain of ``regexp_replace``, and of ``replace`` for month names, rewrites a string of any of these shapes
to ``yyyy-M-d`` and leaves others as they are; day-first and month-first are told apart by which
number can be a month.  ``regexp_extract`` of the plain shape then refuses whatever is left, and
``try_cast(... as date)`` validates the calendar (31-02 -> null).  No formatter runs and no
exception is thrown per row.  The few usual shapes are tried first, so that the chain runs only for the rest.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = r"(0?[1-9]|1[0-2])"
# The time of day and zone that the free-form tail may carry.
TIME = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?( ?(Z|UTC|[+-]\d{2}:?\d{2}))?$"
# Fixed values: (shape, rewrite) in priority order.  The first applies before the time of day is cut
# off: a time makes a dashed date month-first.
REWRITES = [
    (rf"^(\d{{1,2}})-{_MONTH}-(\d{{4}})$", "$3-$2-$1"),
    (TIME, ""),
    (rf"^{_MONTH}[-/.](\d{{1,2}})[-/.](\d{{4}})$", "$3-$1-$2"),
    (rf"^(\d{{1,2}})[-/.]{_MONTH}[-/.](\d{{4}})$", "$3-$2-$1"),
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$", "$3-$1-$2"),
    (r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*[. -]{1,2}(\d{4})$", "$3-$2-$1"),
]
# The month names that the rewrites leave between dashes.
NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
PLAIN = r"^\d{4}-\d{1,2}-\d{1,2}$"


#: The shapes nearly every row has, each tried only where the one before gave no day.
_DASHED, _ISO = (r"^\s*(\d{1,2})-(\d{1,2})-(\d{4})\s*$", "$3-$2-$1"), r"^(\d{4}-\d{1,2}-\d{1,2})" + TIME


def parse_any_date(c: Column) -> Column:
    text = c.cast("string")
    s = F.trim(text)
    for shape, to in REWRITES:
        s = F.regexp_replace(s, shape, to)
    s = F.lower(s)
    for i, name in enumerate(NAMES, 1):
        s = F.replace(s, F.lit(f"-{name}-"), F.lit(f"-{i}-"))
    return F.coalesce(
        F.regexp_extract(F.regexp_replace(text, *_DASHED), PLAIN, 0).try_cast("date"),  # d-M-yyyy and yyyy-M-d
        F.regexp_extract(F.regexp_replace(text, REWRITES[2][0], REWRITES[2][1]), PLAIN, 0).try_cast("date"),  # M/d/yyyy
        F.regexp_extract(text, _ISO, 1).try_cast("date"),
        F.regexp_extract(s, PLAIN, 0).try_cast("date"),
    )
