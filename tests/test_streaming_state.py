"""Out-of-order baskets and closing months: any arrival within the watermark equals the batch result, late rows come out, and state ends."""
import datetime
import random
import tempfile

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from depotlens.operators import baskets as B
from depotlens.operators import normalise as N
from depotlens.operators import patterns as P
from depotlens.streaming.basket_events import basket_event_stream, current_lines
from depotlens.plans import registry
from depotlens.streaming.closing_months import MonthProcessor, closes_at, closing_month_stream, first_open, total
from depotlens.streaming.runs import run_available
from helpers import RAW_SCHEMA, raw_rows
from test_baskets import SCHEMA, random_events

START = datetime.datetime(2024, 1, 1)
TIMED = SCHEMA + ", ts timestamp"


def files(spark, parts, schema):
    """A folder with one file per part, each a micro-batch, in order."""
    path = tempfile.mkdtemp(prefix="stream-", dir="/tmp") + "/in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def timed(events):
    return [(*e, START + datetime.timedelta(minutes=e[0])) for e in events]


def basket_of(spark, events):
    return {(r.session_id, r.material_number): (r.quantity, r.unit_price) for r in B.basket_current(spark.createDataFrame(events, SCHEMA)).collect()}


def lines(emitted):
    return {(r.session_id, r.material_number): (r.quantity, r.unit_price) for r in current_lines(emitted).collect()}


def test_shuffled_arrival_equals_batch(spark):
    """Events of all times are dealt to three files at random, with repeats; the watermark's delay spans them."""
    events = random_events(240, 11)
    rng = random.Random(2)
    parts = [[], [], []]
    for e in timed(events):
        for k in {rng.randrange(3), rng.randrange(3)} if rng.random() < 0.2 else {rng.randrange(3)}:
            parts[k].append(e)
    out = run_available(basket_event_stream(files(spark, parts, TIMED), "1 day"))
    assert lines(out) == basket_of(spark, events)
    assert out.where("kind = 'late'").count() == 0


def test_events_beyond_the_watermark_come_out_late(spark):
    """Key (1, "1"): an event of minute 1 comes when minute 500 is settled.  Key (2, "1") is deleted, and its state has ended when an old event comes."""
    first = [(1, 1, "1", "add", 2, 5.0), (2, 2, "1", "add", 1, 1.0), (3, 2, "1", "confirm", None, None), (500, 1, "1", "add", 3, 9.0)]
    second = [(2000, 3, "1", "add", 1, 1.0)]
    third = [(400, 1, "1", "set", 50, None), (2, 2, "1", "add", 7, 1.0), (2001, 1, "1", "add", 1, 2.0)]
    settled = [(3000, 3, "1", "add", 1, 1.0)]
    out = run_available(basket_event_stream(files(spark, [timed(p) for p in (first, second, settled, third)], TIMED), "10 minutes", lifetime_ms=60_000 * 60))
    assert {(r.session_id, r.seq) for r in out.where("kind = 'late'").collect()} == {(1, 400), (2, 2)}
    assert lines(out) == {(1, "1"): (6, 5.0), (3, "1"): (2, 1.0)}


def test_closing_months(spark):
    rows = [("A", "05-01-2024", "2", "2"), ("A", "06-02-2024", "3.25", "3"), ("B", "07-03-2024", "0.1", "4", "x", None), ("A", "08-01-2024", "1", "1"), ("B", "09-06-2024", "5", "5"),
            ("A", "01-02-2024", "0.2", "1"), ("A", "09-07-2024", "7", "1"), ("B", "08-03-2024", "0.7", "1", "x", None), ("C", "bad", "1", "1"), ("A", "20-07-2024", "0.3", "1")]
    raw = raw_rows(spark, rows)
    path = tempfile.mkdtemp(prefix="stream-", dir="/tmp") + "/in"
    for i, (low, high) in enumerate(((0, 3), (3, 5), (5, 7), (7, 10))):
        raw.where(F.col("row_key.pos").between(low, high - 1)).coalesce(1).write.parquet(f"{path}/{i}")
    source = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    out = run_available(closing_month_stream(source, ["depot_name"], "10 days"))
    want = P.monthly_consumption(N.normalise_movements(raw), ["depot_name"])
    assert sorted(map(tuple, total(out, ["depot_name"]).collect()), key=repr) == sorted(map(tuple, want.select("depot_name", "material_number", "month", "qty").collect()), key=repr)
    late = {(r.material_number, r.qty) for r in out.where("kind = 'late'").collect()}
    assert late == {("A", 1.0), ("A", 0.2), ("B", 0.7)} or late == {("A", 0.2), ("B", 0.7)}
    assert out.where("kind = 'final'").count() >= 3


def test_month_ends():
    assert closes_at(2024 * 12 + 11) == int(datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC).timestamp()) * 1000
    assert closes_at(1999 * 12 + 1) == int(datetime.datetime(1999, 3, 1, tzinfo=datetime.UTC).timestamp()) * 1000


class CountingState:
    """A value, a map and timers that count the round trips to the state store."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def __getattr__(self, name):
        done = {"get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None),
                "containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k], "updateValue": self.map.__setitem__, "registerTimer": self.timers.add}[name]

        def counted(*args):
            self.calls += 1
            return done(*args)
        return counted


def test_state_is_reached_a_few_times_a_trigger():
    """60 materials of 24 months: a round trip for each month would be what the stream's time goes into."""
    state, processor = CountingState(), MonthProcessor([])
    processor.init(state)
    rows = [Row(bucket=0, material_number=f"M{m}", month_no=2020 * 12 + k, consumption_qty=0.5) for m in range(60) for k in range(24)]
    for trigger in (1, 2):
        state.calls = 0
        out = list(processor.handleInputRows((0,), iter(rows), TimerValues(0, 0)))
        assert state.calls <= 3
        assert {(r.kind, r.qty) for r in out} == {("open", 0.5 * trigger)} and len(out) == len(rows)
    assert state.timers == {closes_at(2020 * 12)}
    closed = closes_at(2020 * 12 + 4)
    final = list(processor.handleExpiredTimer((0,), TimerValues(0, closed), None))
    assert len(final) == 60 * 5 and {(r.kind, r.qty) for r in final} == {("final", 1.0)} and closes_at(2020 * 12 + 5) in state.timers
    late = list(processor.handleInputRows((0,), iter(rows[:6]), TimerValues(0, closed)))
    assert [r.kind for r in late] == ["late"] * 5 + ["open"] and late[-1].qty == 1.5


def test_first_open_month():
    for month in (1970 * 12, 1999 * 12 + 1, 2024 * 12 + 11):
        assert first_open(closes_at(month)) == month + 1 and first_open(closes_at(month) - 1) == month


def test_arrivals_are_dealt_to_many_tasks(spark):
    """Each micro-batch is several files, each written by a task of its own; all rows come, in four batches."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        stream = registry._shuffled_stream(spark.range(3000).withColumn("text", F.col("id").cast("string")), spark)
        out = run_available(stream.withColumn("file", F.col("_metadata.file_path")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out.select("id").distinct().count() == out.count() == 3000
    assert out.select("file").distinct().count() == 12 and out.groupBy("file").count().agg(F.max("count")).first()[0] < 600
    assert sorted(r["n"] for r in out.groupBy("batch").agg(F.countDistinct("file").alias("n")).collect()) == [3, 3, 3, 3]
