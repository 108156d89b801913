"""Stream = batch for the two streaming forms (file source, availableNow)."""
import tempfile

from pyspark.sql import functions as F

from depotlens.operators import baskets as B
from depotlens.operators import normalise as N
from depotlens.operators import patterns as P
from depotlens.streaming.basket_state import basket_state_stream
from depotlens.streaming.monthly import monthly_consumption_stream
from helpers import RAW_SCHEMA, raw_rows
from test_baskets import SCHEMA, random_events


def test_basket_state_stream_equals_batch(spark):
    scratch = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    ev = sorted(random_events(300, 7))
    # three in-order files -> three micro-batches
    for i in range(3):
        spark.createDataFrame(ev[i * 100:(i + 1) * 100], SCHEMA).coalesce(1).write.parquet(f"{scratch}/in/{i}")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in/*")
    q = (basket_state_stream(src).writeStream.format("memory").queryName("basket_state").outputMode("update")
         .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(300)
    out = spark.table("basket_state")
    last = out.groupBy("session_id", "material_number").agg(F.max_by("quantity", "last_seq").alias("q"),
                                                            F.max_by("unit_price", "last_seq").alias("p"))
    got = {(r.session_id, r.material_number): (r.q, r.p) for r in last.collect() if r.q is not None}
    want = {(r.session_id, r.material_number): (r.quantity, r.unit_price)
            for r in B.basket_current(spark.createDataFrame(ev, SCHEMA)).collect()}
    assert got == want


def test_monthly_stream_equals_batch(spark):
    """Late and shuffled rows, null depots, several triggers: the whole table equals the batch."""
    scratch = tempfile.mkdtemp(prefix="stream-", dir="/tmp")
    rows = [("A", "05-01-2024", "2", "2"), ("A", "06-02-2024", "3", "3"), ("B", "07-03-2024", "4.25", "4"),
            ("A", "08-01-2019", "1", "1"), ("B", "09-06-2024", "5", "5"), ("A", "01-02-2001", "0.1", "1"),
            ("C", "01-02-2001", "0.2", "1", "desc", None), ("C", "01-02-2030", "0.7", "1", "desc", None), ("C", "bad", "1", "1")]
    raw = raw_rows(spark, rows)
    for i in range(3):
        raw.where(F.col("row_key.pos") % 3 == 2 - i).coalesce(1).write.parquet(f"{scratch}/in/{i}")
    src = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in/*")
    q = (monthly_consumption_stream(src, by=["depot_name"]).writeStream.format("memory").queryName("monthly").outputMode("complete")
         .option("checkpointLocation", f"{scratch}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination(300)
    batch = P.monthly_consumption(N.normalise_movements(raw), ["depot_name"])
    assert sorted(map(tuple, spark.table("monthly").collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    assert batch.count() == 5
