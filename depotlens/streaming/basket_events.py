"""B4 as keyed state for events that arrive out of order (``transformWithState``).

State per (session, material): the line after all events whose place in the order is settled, and the later events in a buffer.  An event stays in the buffer until
the watermark on the event time passes it; so events may come in any order within the watermark's delay and still fold by ``seq``.
Each trigger emits the line with the buffer folded in, a null quantity for a deleted one.  A timer settles events when no new ones come, and ends the state of a deleted
line after ``lifetime``.

An event whose ``seq`` is at or below a settled one, or for whose key there is no state and which is older than the watermark by ``lifetime`` (the state may have ended),
comes out as a ``late`` row and changes nothing; a repeated event in the buffer counts once.  The watermark's column is not part of the processor's input, or Spark would drop late rows before they get there.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = Row("kind", "session_id", "material_number", "quantity", "unit_price", "seq")
OUTPUT = "kind string, session_id long, material_number string, quantity long, unit_price double, seq long"


def apply(line: tuple, op: str, quantity: int | None, price: float | None) -> tuple:
    """(quantity, price) of a line after one event; quantity None: no line."""
    held, paid = line
    quantity = quantity or 0
    if op == "add":
        return (quantity, price) if held is None else (held + quantity, paid)
    if op == "set" and held is not None:
        return (quantity, paid) if quantity > 0 else (None, None)
    return (None, None) if op == "confirm" else line


class BasketProcessor(StatefulProcessor):
    def __init__(self, lifetime_ms: int):
        self._lifetime = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._line = handle.getValueState("line", "quantity long, unit_price double, seq long, at long")
        self._buffer = handle.getMapState("buffer", "seq long", "op string, quantity long, unit_price double, at long")

    def _settled(self) -> tuple:
        return tuple(self._line.get()) if self._line.exists() else (None, None, -1, 0)

    def _pending(self) -> list[tuple]:
        return sorted((k[0], *v) for k, v in self._buffer.iterator()) if self._buffer.exists() else []

    def _settle(self, watermark: int) -> tuple[tuple, list[tuple]]:
        """Fold buffered events, in order, up to the first that the watermark has not passed."""
        line, pending = self._settled(), self._pending()
        done = 0
        for seq, op, quantity, price, at in pending:
            if at >= watermark:
                break
            line = (*apply(line[:2], op, quantity, price), seq, max(at, line[3]))
            self._buffer.removeKey((seq,))
            done += 1
        if done:
            self._line.update(line)
        return line, pending[done:]

    def _wake(self, line: tuple, pending: list[tuple]) -> None:
        """One timer: when the last buffered event can be settled, or when a deleted line's state ends."""
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if pending:
            self._handle.registerTimer(max(p[4] for p in pending) + 1)
        elif line[0] is None and line[2] >= 0:
            self._handle.registerTimer(line[3] + self._lifetime)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        settled = self._settled()[2]
        for r in rows:
            if r.seq <= settled or (settled < 0 and r.at < watermark - self._lifetime):
                yield _OUT("late", *key, r.quantity, r.unit_price, r.seq)
            else:
                self._buffer.updateValue((r.seq,), (r.op, r.quantity, r.unit_price, r.at))
        line, pending = self._settle(watermark)
        now, seq = line[:2], line[2]
        for seq, op, quantity, price, _ in pending:
            now = apply(now, op, quantity, price)
        self._wake(line, pending)
        if seq >= 0:
            yield _OUT("line", *key, *now, seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        line, pending = self._settle(watermark)
        if not pending and line[0] is None and line[3] + self._lifetime <= watermark:
            self._line.clear()
            self._buffer.clear()
        else:
            self._wake(line, pending)
        return iter(())

    def close(self) -> None:
        pass


def basket_event_stream(events: DataFrame, delay: str = "1 day", lifetime_ms: int = 7 * 86_400_000, time: str = "ts") -> DataFrame:
    """Rows ``line`` and ``late`` for a stream of (seq, session_id, material_number, op, quantity, unit_price, ts)."""
    rows = events.withWatermark(time, delay).select("session_id", "material_number", "seq", "op", F.col("quantity").cast("long").alias("quantity"), "unit_price",
                                                    F.unix_millis(time).alias("at"))
    return rows.groupBy("session_id", "material_number").transformWithState(BasketProcessor(lifetime_ms), OUTPUT, "Update", "eventTime")


def current_lines(emitted: DataFrame) -> DataFrame:
    """The basket: the last line of each key, where it has a quantity."""
    last = emitted.where("kind = 'line'").groupBy("session_id", "material_number").agg(F.max_by(F.struct("quantity", "unit_price"), "batch").alias("l"))
    return last.select("session_id", "material_number", "l.quantity", "l.unit_price").where("quantity IS NOT NULL")
