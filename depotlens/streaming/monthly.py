"""P1 on a stream: monthly consumption per (group, material, calendar month).

There is no watermark: nothing is too late to count, and the state is one row per result row
(groups x materials x at most 12 months), which does not grow with time.  In ``update`` mode each trigger emits the
rows that changed, so a sink that keeps the latest row per key, or ``complete`` mode, holds the batch P1 table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from depotlens.operators.normalise import normalise_movements
from depotlens.operators.patterns import monthly_consumption


def monthly_consumption_stream(raw_stream: DataFrame, by: list[str] = ("depot_name",)) -> DataFrame:
    return monthly_consumption(normalise_movements(raw_stream), list(by))
