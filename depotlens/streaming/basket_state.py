"""B4 as keyed streaming state (``applyInPandasWithState``).

State per (session, material) is the live line ``(quantity, unit_price,
last_seq)``.  Each trigger sorts the key's new events by ``seq`` and applies
add / set / confirm; events at or below ``last_seq`` (replays, out-of-order
arrivals across triggers) are ignored.  Output (update mode) is the line after
the trigger, with a null quantity for a deleted line.  The Python here is the
per-key fold only; Spark shuffles, groups and checkpoints the state.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT_SCHEMA = "session_id long, material_number string, quantity long, unit_price double, last_seq long"
STATE_SCHEMA = "quantity long, unit_price double, last_seq long"


def _fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    qty, price, last = (None, None, -1)
    if state.exists:
        qty, price, last = state.get
        qty = None if pd.isna(qty) else int(qty)
        price = None if pd.isna(price) else float(price)
    ev = pd.concat(list(batches), ignore_index=True).sort_values("seq")
    for seq, op, q, p in zip(ev["seq"], ev["op"], ev["quantity"], ev["unit_price"]):
        if seq <= last:
            continue
        last = int(seq)
        q = 0 if pd.isna(q) else int(q)
        if op == "add":
            if qty is None:
                qty, price = q, (None if pd.isna(p) else float(p))
            else:
                qty += q
        elif op == "set":
            if qty is not None:
                qty = q if q > 0 else None
                if qty is None:
                    price = None
        elif op == "confirm":
            qty, price = None, None
    state.update((qty, price, last))
    yield pd.DataFrame({"session_id": [key[0]], "material_number": [key[1]],
                        "quantity": pd.array([qty], dtype="Int64"),
                        "unit_price": pd.array([price], dtype="Float64"), "last_seq": [last]})


def basket_state_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "material_number").applyInPandasWithState(
        _fold, OUTPUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)
