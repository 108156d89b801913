"""Line dedup: range-partitioned line hashes, streamed in order, give keep bitmaps per document.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case.  A key of at least
``min_chars`` code points found in at least ``min_docs`` documents loses all its lines
except those in the largest document id that holds it.

1. Each long enough line sends (128-bit hash, document, position): no text.
2. Rows are range-partitioned and sorted by (hash, document descending, position).  The document is part
   of the range key, so a line that a third of all documents share spreads over as many tasks as its rows need.
3. Each task streams its rows.  A run of one hash inside a task is decided there and then; a run
   that touches a task's edge may go on in the next, so each task reports its first and its last run
   (at most two rows a task), and their sums are what edge runs are decided by.  They are broadcast: tasks are of ``task_bytes`` of text or,
   in a larger table, of 1 / ``MAX_TASKS`` of it (rows are streamed, so a larger task holds no more), so there are at most 2 * ``MAX_TASKS`` of them.
4. The lines to drop come back as one compressed bitmap per document, and each document cuts its own lines.

Defined cases: null or empty text is one empty line, which stays.  Every line end is a ``\\n``; a line may be white
space.  Rows that repeat an id count as one document.  Rows with a null id form one document, the smallest.
A repeated line within the document that keeps it stays each time.  Empty table: empty result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.common import binary, ceil_div, others, text_bytes

MIN_CHARS = 40
MIN_DOCS = 5
TASK_BYTES = 64 << 20
#: Tasks that lines are dealt over, at most; two edge rows of each (a hash, a count, an id) are broadcast.
MAX_TASKS = 100_000


def _code_points(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode())


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hash, id, row, pos) of every line whose key has ``min_chars`` code points or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, hashes = [], [], []
            for i, t in enumerate(binary(batch.column("text"))):
                for k, line in enumerate(t.split(b"\n") if t else ()):
                    key = line.strip()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or _code_points(key) >= min_chars):
                        rows.append(i)
                        pos.append(k)
                        hashes.append(xxhash.xxh3_128_digest(key.lower()))  # bytes: only A-Z change
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), *(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "row")),
                                              pa.array(pos, pa.int32())], ["hash", "id", "row", "pos"])

    return docs.mapInArrow(run, T.StructType([T.StructField("hash", T.BinaryType()), docs.schema["id"], docs.schema["row"], T.StructField("pos", T.IntegerType())]))


def _edge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and keeper of a task's first and last run."""
    found: list[list] = []  # [hash, documents, keeper, last id] of the first and the latest run
    for batch in batches:
        for h, i in zip(batch.column("hash").to_pylist(), batch.column("id").to_pylist()):
            if found and found[-1][0] == h:
                if found[-1][3] != i:
                    found[-1][1] += 1
                    found[-1][3] = i
            else:
                found = [*found[:1], [h, 1, i, i]]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()),
                                          pa.array([f[2] for f in found], batch.column("id").type)], ["hash", "n_docs", "keeper"])


def _dropped(min_docs: int):
    """Rows to drop, streamed: a run holds back rows only until it has ``min_docs`` documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_, first, known = None, True, True
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("hash", "id", "row", "pos", "edge", "n_docs", "keeper")]
            for h, i, row, pos, edge, n, k in zip(*columns):
                if h != hash_:
                    if first and hash_ is not None:
                        if not known:
                            raise RuntimeError("a task's first run has no edge count: its partitions changed between passes")
                        first = False
                    hash_, known, held, last = h, edge is not None, [], i
                    docs, keeper, over = (n, k, n >= min_docs) if known else (1, i, False)
                elif not known and i != last:
                    docs, last = docs + 1, i
                    if not over and docs >= min_docs:
                        over = True
                        out += held
                        held = []
                if i != keeper:
                    if over:
                        out.append((i, row, pos))
                    elif not known:
                        held.append((i, row, pos))
            ids, rows, at = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(rows, pa.int64()), pa.array(at, pa.int32())], ["id", "row", "pos"])
        if not known:
            raise RuntimeError("a task's last run has no edge count: its partitions changed between passes")
    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, row, keep) from (id, row, pos) in order: a bit per line up to the last one dropped, compressed."""
    key, held = None, []

    def close(out: list) -> None:
        if held:
            keep = np.ones(8 * ceil_div(held[-1] + 1, 8), np.uint8)
            keep[held] = 0
            out.append((*key, zlib.compress(np.packbits(keep).tobytes(), 1)))

    for batch in batches:
        out: list[tuple] = []
        kind = batch.column("id").type
        for i, row, pos in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "pos"))):
            if (i, row) != key:
                close(out)
                key, held = (i, row), []
            held.append(pos)
        yield _keeps(out, kind)
    if held:
        out = []
        close(out)
        yield _keeps(out, kind)


def _keeps(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ids, keys, maps = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(keys, pa.int64()), pa.array(maps, pa.binary())], ["id", "row", "keep"])


def kept_lines(text: bytes | None, keep: bytes | None) -> tuple[bytes, int, int]:
    """(text left, lines, lines dropped) of one document and its bitmap."""
    lines = (text or b"").split(b"\n")
    if keep is None:
        return text or b"", len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:len(lines)].tolist()
    left = [line for line, k in zip(lines, bits) if k] + lines[len(bits):]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"), others(docs, id_col, text_col).alias("rest"))


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(id, row, keep) of the documents that lose lines; ``row`` is the text's hash, which tells rows of one id apart."""
    _, size = text_bytes(docs, text_col)
    base = _base(docs, id_col, text_col).select("id", "row", "text")
    order = ["hash", F.col("id").desc(), "row", "pos"]
    tasks = min(MAX_TASKS, max(1, ceil_div(size, task_bytes)))
    lines = line_hashes(base, min_chars).repartitionByRange(tasks, "hash", F.col("id").desc())
    id_type = base.schema["id"].dataType
    edge = T.StructType().add("hash", "binary").add("n_docs", "long").add("keeper", id_type)
    edges = (lines.sortWithinPartitions(*order).select("hash", "id").mapInArrow(_edge_runs, edge)  # at most two rows a task
             .groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")).withColumn("edge", F.lit(True)))
    marked = lines.join(F.broadcast(edges), "hash", "left").sortWithinPartitions(*order)  # a sort below the join would be dropped
    marked = marked.select("hash", "id", "row", "pos", "edge", "n_docs", "keeper")
    drop = T.StructType([base.schema["id"]]).add("row", "long").add("pos", "integer")
    dropped = marked.mapInArrow(_dropped(min_docs), drop)
    keep = T.StructType([base.schema["id"]]).add("row", "long").add("keep", "binary")
    return dropped.distinct().repartition("id", "row").sortWithinPartitions("id", "row", "pos").mapInArrow(_bitmaps, keep)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text`` (as it was), ``rest`` (struct of the other columns), ``n_lines``,
    ``n_dropped`` and ``kept`` (lines left, joined by a line end)."""
    base = _base(docs, id_col, text_col)
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs, task_bytes=task_bytes)
    maps = maps.select(F.col("id").alias("_id"), F.col("row").alias("_row"), "keep")
    joined = base.join(maps, F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("id", "text", "rest", "keep")
    schema = T.StructType([f for f in base.schema.fields if f.name != "row"]).add("n_lines", "long").add("n_dropped", "long").add("kept", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_lines(t, k) for t, k in zip(binary(batch.column("text")), batch.column("keep").to_pylist())]
            kept, n, lost = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), batch.column("rest"), pa.array(n, pa.int64()),
                                              pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    return joined.mapInArrow(cut, schema)
