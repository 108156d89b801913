"""Tables written once and read by every branch of a query.

A plan with several branches over the same source scans it once per branch wherever column pruning makes the branches differ.
Operators therefore write the one aggregate that all branches need (a row per material or per group, not per movement) into the folder that
the session names in ``spark.checkpoint.dir`` and go on from there.  The copy survives lost executors and ends the lineage.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder; a machine-local one only for a local master where the setting is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="depotlens-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/depotlens-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
