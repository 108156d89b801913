"""Helpers shared by the operators: stored intermediates, document buckets, word hashes.

*Words* are maximal runs of bytes other than space and 0x09-0x0D.  ``bytes.split()``
splits on exactly those six bytes, so UTF-8 text is handled as bytes throughout.

*Buckets.*  Operators that have to look at a text again after a corpus-wide
exchange hash every row to one of ``ceil(bytes / bucket_bytes)`` buckets.  A bucket is a bounded
amount of text, independent of source, language or similarity, so no key in the
data can make one large (beyond the length of a single document).
"""
from __future__ import annotations

import os
import tempfile
import uuid
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words whose hash one Python worker remembers; beyond it the memo starts again.
MEMO_WORDS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names in ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master (tests) where the setting is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="depotlens-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/depotlens-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there.

    Survives lost executors, unlike a local checkpoint, and is computed once.
    """
    path = shared_folder(df.sparkSession)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text) of the whole table: one narrow scan, used only to size partitions."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text)))).first()
    return n, size or 0


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def power_of_two(n: float) -> int:
    """Smallest power of two >= n (at least 1)."""
    p = 1
    while p < n:
        p *= 2
    return p


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered for at most ``MEMO_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One memo per Python worker process; workers are reused between tasks.
WORD_HASH = WordHash()


def binary(column: Any) -> list[bytes | None]:
    """Arrow string column (or chunked) as Python bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def packed(a: np.ndarray) -> bytes:
    """Array -> byte planes -> zstd: small deltas and masks cost little."""
    raw = np.ascontiguousarray(a)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes() if raw.itemsize > 1 else raw.tobytes()
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True) if planes else b""


def unpacked(blob: bytes, n: int, dtype: Any) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not n:
        return np.empty(0, dtype)
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, n * dtype.itemsize), np.uint8)
    if dtype.itemsize == 1:
        return raw.view(dtype)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype)


def bits(mask: np.ndarray) -> bytes:
    return packed(np.packbits(mask))


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpacked(blob, ceil_div(n, 8), np.uint8), count=n).astype(bool)


def others(docs: DataFrame, *names: str) -> Any:
    """The columns besides ``names`` as one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
