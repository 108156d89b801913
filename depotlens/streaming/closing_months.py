"""P1 on a stream whose months close: totals per (group, material, calendar month of a year) with a watermark on ``document_date``.

State per bucket of (group, material), which are dealt by a hash: the totals of open months, in one value that a trigger reads and writes once for each bucket with new rows.
Python has a round trip for every key, value and timer, so state per material and month would cost several of them a row.  A bucket is written as a whole; its size is the
number of materials by ``BUCKETS``, and its months are those within the delay.  A month closes when the watermark passes its last day: the bucket's timer, set for its earliest
open month, emits the final totals of all months that have closed and drops them, so the state does not grow with time.  Movements of a closed month come out as ``late``
rows, one by one.  Totals are exact: whole units of 10^-10, as ``exact_sum`` has them.  Final and open totals plus late rows add up to the batch table (``total``).
"""
from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from depotlens.operators.normalise import normalise_movements
from depotlens.operators.patterns import exact_sum

UNIT = Decimal("1E-10")
EPOCH = date(1970, 1, 1)
#: Buckets over which materials are dealt; a stream keeps the number it began with.
BUCKETS = 4096


def closes_at(month: int) -> int:
    """First millisecond after a month, which is numbered year * 12 + month - 1."""
    year, m = divmod(month + 1, 12)
    return (date(year, m + 1, 1) - EPOCH).days * 86_400_000


def _earliest(totals: dict[tuple, dict[int, int]]) -> int:
    return min(min(months) for months in totals.values())


def first_open(watermark: int) -> int:
    """The earliest month that a watermark, in milliseconds, leaves open."""
    day = EPOCH + timedelta(milliseconds=watermark)
    return day.year * 12 + day.month - 1


class MonthProcessor(StatefulProcessor):
    def __init__(self, by: list[str]):
        self._group = [*by, "material_number"]
        self._row = Row("kind", *self._group, "month_no", "qty")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._totals = handle.getValueState("totals", "groups array<array<string>>, months array<array<int>>, units array<array<string>>")

    def _held(self) -> dict[tuple, dict[int, int]]:
        """Totals in ``UNIT`` per (group, material) and month."""
        held = self._totals.get()
        return {} if held is None else {tuple(g): {m: int(u) for m, u in zip(months, units)} for g, months, units in zip(*held)}

    def _keep(self, totals: dict[tuple, dict[int, int]], timer: int | None) -> None:
        """Write the open months and see to a timer for the earliest; ``timer`` is the month that has one."""
        if not totals:
            self._totals.clear()
            return
        self._totals.update(([list(g) for g in totals], [list(t) for t in totals.values()], [[str(u) for u in t.values()] for t in totals.values()]))
        first = _earliest(totals)
        if timer is None or first < timer:
            self._handle.registerTimer(closes_at(first))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        opening = first_open(timerValues.getCurrentWatermarkInMs())
        added: dict[tuple, dict[int, int]] = {}
        for r in rows:
            group, month = tuple([r[c] for c in self._group]), r.month_no
            if month < opening:
                yield self._row("late", *group, month, r.consumption_qty)
            else:
                months = added.setdefault(group, {})
                months[month] = months.get(month, 0) + int((Decimal(repr(r.consumption_qty)) / UNIT).to_integral_value())
        if not added:
            return
        totals = self._held()
        timer = _earliest(totals) if totals else None
        for group, months in added.items():
            held = totals.setdefault(group, {})
            for month, units in months.items():
                held[month] = held.get(month, 0) + units
        self._keep(totals, timer)
        for group, months in added.items():
            for month in months:
                yield self._row("open", *group, month, float(totals[group][month] * UNIT))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        opening = first_open(timerValues.getCurrentWatermarkInMs())
        totals = self._held()
        if not totals or _earliest(totals) >= opening:
            return
        left = {group: still for group, months in totals.items() if (still := {m: u for m, u in months.items() if m >= opening})}
        self._keep(left, None)
        for group, months in totals.items():
            for month, units in months.items():
                if month < opening:
                    yield self._row("final", *group, month, float(units * UNIT))

    def close(self) -> None:
        pass


def closing_month_stream(raw_stream: DataFrame, by: list[str] = (), delay: str = "62 days", buckets: int = BUCKETS) -> DataFrame:
    """Rows ``open`` (running total), ``final`` and ``late`` of a stream of raw movements."""
    by = list(by)
    mv = normalise_movements(raw_stream).withColumn("_time", F.col("document_date").cast("timestamp")).withWatermark("_time", delay)
    rows = mv.select(F.pmod(F.hash(*by, "material_number"), F.lit(buckets)).alias("bucket"), *by, "material_number",
                     (F.col("year") * 12 + F.col("month") - 1).alias("month_no"), "consumption_qty")
    output = f"kind string, {''.join(f'{c} string, ' for c in by)}material_number string, month_no int, qty double"
    return rows.groupBy("bucket").transformWithState(MonthProcessor(by), output, "Update", "eventTime")


def total(emitted: DataFrame, by: list[str] = ()) -> DataFrame:
    """P1 from what the stream has emitted: each month's latest total, and its late rows."""
    key = [*by, "material_number", "month_no"]
    latest = emitted.where("kind <> 'late'").groupBy(*key).agg(F.max_by("qty", F.struct("batch", F.col("kind") == "final")).alias("qty"))
    rows = latest.unionByName(emitted.where("kind = 'late'").select(*key, "qty"))
    return rows.groupBy(*by, "material_number", (F.col("month_no") % 12 + 1).alias("month")).agg(exact_sum(F.col("qty")).alias("qty"))
