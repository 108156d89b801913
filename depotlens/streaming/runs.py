"""Running a stream to the end of what its source holds, into a table that can be read as a whole."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from depotlens.functions.stored import shared_folder

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession):
    """``transformWithState`` keeps its state in RocksDB, which the session has to name."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_available(stream: DataFrame, path: str | None = None, mode: str = "update") -> DataFrame:
    """Process what is there (``availableNow``) and return all that was emitted, with the micro-batch it came in (``batch``).

    A batch goes to its own folder, which a retry overwrites, so every row is there once.  ``path`` holds output and checkpoint; a second run on it goes on
    where the first one ended.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark)
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    with _state_on_disk(spark):
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(f"{path}/out")
