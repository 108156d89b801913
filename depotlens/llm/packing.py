"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

``token_pieces`` cuts each document's ids into pieces of at most ``capacity``; only longer documents are cut.
``pack`` places pieces by bounded-space online best-fit: ``open_bins`` sequences are open, a bitset keyed by free space
finds the fullest one that a piece fits, and when none fits and all are open the fullest closes first.
Pieces are range-partitioned by document, about ``pieces_per_task`` to a task.  What is still open when a
task ends is packed once more, whole bins as items, ``merge_tasks`` tasks' worth at a time, so that many small
tasks do not leave many half-empty sequences.  A task holds an Arrow batch and the rows of its open bins, at most ``open_bins * capacity`` tokens;
a closed bin's rows leave with the batch that closed it.

Defined cases: null or empty text is one piece holding the end token alone.  A document of k * capacity tokens
has k full pieces.  Repeated rows are packed each.  Rows with no id sort first.  Empty table: empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.bpe import merged_ids
from depotlens.llm.common import binary, ceil_div, stored
from depotlens.llm.tokens import chunks

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 128
PIECES_PER_TASK = 32_768
MERGE_TASKS = 32


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and the piece's ``ids``) of every document."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([base.schema["id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merged_ids(path)
        for batch in batches:
            texts, ids = binary(batch.column("text")), batch.column("id")
            for part in chunks(texts):
                flat, n = coder.ids(texts[part])
                begins = np.cumsum(n) - n
                flat = np.insert(flat, begins + n, end_id).astype("<u4")
                begins, n = begins + np.arange(len(n)), n + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                at = begins[doc] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                columns = [ids.slice(part.start, len(n)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:  # pieces follow one another in ``flat`` without gaps
                    columns.append(pa.ListArray.from_arrays(np.append(at, len(flat)).astype(np.int32), pa.array(flat.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return base.mapInArrow(run, schema)


class OpenBins:
    """At most ``most`` open bins; ``put`` gives (bin, offset).  Free space 1..capacity keys a bitset and stacks of bins."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.used: list[int] = []  # of every bin so far
        self._free = 0
        self._stacks: dict[int, list[int]] = {}
        self._n = 0

    def put(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a length must be 1 to {self.capacity}")
        fits = self._free >> length
        if fits:
            bin_ = self._take(length + (fits & -fits).bit_length() - 1)
        else:
            if self._n == self.most:
                self._take((self._free & -self._free).bit_length() - 1)  # the fullest closes
            bin_ = len(self.used)
            self.used.append(0)
        offset = self.used[bin_]
        self.used[bin_] += length
        free = self.capacity - self.used[bin_]
        if free:
            self._stacks.setdefault(free, []).append(bin_)
            self._free |= 1 << free
            self._n += 1
        return bin_, offset

    def _take(self, free: int) -> int:
        stack = self._stacks[free]
        bin_ = stack.pop()
        if not stack:
            self._free &= ~(1 << free)
        self._n -= 1
        return bin_

    def open(self) -> set[int]:
        return {b for s in self._stacks.values() for b in s}


def pack(pieces: DataFrame, *, order: tuple[str, ...] = ("id", "piece"), length_col: str = "length", capacity: int = CAPACITY,
         open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK, merge_tasks: int = MERGE_TASKS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; pieces arrive in ``order`` within a task."""
    pieces = stored(pieces)  # so that counting and sampling do not tokenise again
    tasks = max(1, ceil_div(pieces.count(), pieces_per_task))
    ordered = pieces.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = T.StructType(list(pieces.schema.fields))
    first = T.StructType(list(schema.fields)).add("_task", "integer").add("_bin", "long").add("_offset", "long").add("_used", "long")

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bins, held = TaskContext.get().partitionId(), OpenBins(capacity, open_bins), None  # rows of the open bins
        for batch in batches:
            places = [bins.put(n) for n in batch.column(length_col).to_pylist()]
            columns = [pa.array([task] * len(places), pa.int32()), pa.array([b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            rows = pa.RecordBatch.from_arrays([*batch.columns, *columns], first.names[:-1])
            if held is not None:
                rows = pa.concat_batches([held, rows])
            waits = np.isin(rows.column("_bin").to_numpy(), np.fromiter(bins.open(), np.int64))
            held, closed = rows.filter(pa.array(waits)), rows.filter(pa.array(~waits))  # copies: the batch itself is let go
            yield pa.RecordBatch.from_arrays([*closed.columns, pa.nulls(closed.num_rows, pa.int64())], first.names)
        if held is not None:
            used = pa.array([bins.used[b] for b in held.column("_bin").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*held.columns, used], first.names)

    placed = stored(ordered.mapInArrow(online, first))
    own = [F.col(f"`{c}`") for c in schema.names]
    sequence = F.col("_task").cast("long") * F.lit(1 << 32) + F.col("_bin")
    closed = placed.where(F.col("_used").isNull()).select(*own, sequence.alias("sequence_id"), F.col("_offset").alias("offset"))

    final = T.StructType(list(schema.fields)).add("sequence_id", "long").add("offset", "long")

    def again(table: pa.Table) -> pa.Table:
        """Whole open bins of a few tasks as items, longest first, in one more best-fit."""
        keys = list(zip(table["_task"].to_pylist(), table["_bin"].to_pylist()))
        used = dict(zip(keys, table["_used"].to_pylist()))
        bins, place, name = OpenBins(capacity, len(used) + 1), {}, {}
        for key in sorted(used, key=lambda k: (-used[k], k)):
            b, offset = bins.put(used[key])
            name.setdefault(b, key)  # a merged sequence is named after its first bin
            place[key] = (name[b], offset)
        sequence_id = [place[k][0][0] * (1 << 32) + place[k][0][1] for k in keys]
        offset = [place[k][1] + o for k, o in zip(keys, table["_offset"].to_pylist())]
        return table.select(schema.names).append_column("sequence_id", pa.array(sequence_id, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    rest = placed.where(F.col("_used").isNotNull()).withColumn("_group", F.floor(F.col("_task") / F.lit(merge_tasks)))
    merged = rest.groupBy("_group").applyInArrow(lambda t: again(t), final)
    return closed.unionByName(merged)
