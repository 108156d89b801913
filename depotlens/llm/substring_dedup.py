"""Substring dedup: a Count-min prefilter, then exact grouping of what it estimates repeated.

A window is ``window`` consecutive words of one document.  Every word covered by a
window whose word sequence also starts anywhere else in the input (same document
included) is removed; windows are judged on the input.

1. Each bucket of documents makes a partition sketch: ``depth`` rows of counters
   (saturating at two) addressed by independent 64-bit window hashes.  Its rows hold few
   non-zero cells, so they travel sparse: sorted, delta-coded, compressed, cut by cell range.
2. Sketches are merged by addition, one task per cell range, and each bucket gets
   back one bit per cell of its own: counter >= 2.  Sketch width follows the input
   (``cells_per_window`` cells for each window) and is spread over the cluster; nothing is broadcast.
3. A window is estimated repeated if all its ``depth`` counters are; Count-min never
   underestimates, so no repeated window is lost.  Only those windows send a 96-bit
   fingerprint (per bucket, distinct) to be grouped exactly.
4. Buckets get one bit per fingerprint back and cut the covered words.

A passage that a third of all documents share costs one cell and one fingerprint
per bucket: buckets pre-aggregate before each exchange.

Defined cases: null or empty text, or fewer words than ``window``: nothing removed.  Repeated
rows are documents of their own, so exact copies of long texts lose all words.  Empty table: empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from itertools import compress
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.common import (WORD_HASH, binary, bits, ceil_div, others, packed, power_of_two, text_bytes, unbits,
                                  unpacked)

WINDOW = 35
DEPTH = 2
CELLS_PER_WINDOW = 16
BUCKET_BYTES = 8 << 20
#: Windows whose cells one merging task holds.
SHARD_WINDOWS = 2_000_000
#: Buckets, or cell ranges, that a task works through one after the other; more tasks than the session's shuffle partitions where the input asks for them.
BUCKETS_PER_TASK = 16

_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SEED = (0x0, 0xA0761D6478BD642F)
_BLOB = "part int, bucket long, n long, cells binary, marks binary"
_REPLY = "bucket long, part int, n long, marks binary"


class _Bucket:
    """Windows of one bucket: two independent 64-bit hashes per window start."""

    def __init__(self, texts: list[bytes | None], window: int):
        hashes = [WORD_HASH.of(t.split()) if t else np.empty(0, np.uint64) for t in texts]  # words are not kept: they would outweigh the text
        self.n_words = np.fromiter(map(len, hashes), np.int64, len(hashes))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        del hashes
        n = len(h)
        self.window, self.n = window, n
        ends = np.repeat(np.cumsum(self.n_words), self.n_words)
        self.starts = np.flatnonzero(np.arange(n) + window <= ends)
        self.hashes = [self._rolling(h ^ np.uint64(s), b) for s, b in zip(_SEED, _ODD)]

    def _rolling(self, h: np.ndarray, base: int) -> np.ndarray:
        """sum over j of h[i + j] * base^-j (mod 2^64) at every window start, by prefix sums."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(base)
        sums = np.zeros(self.n + 1, np.uint64)
        h *= _powers(pow(base, -1, 1 << 64), self.n)
        np.cumsum(h, out=sums[1:])
        out = sums[self.starts + self.window] - sums[self.starts]
        out *= _powers(base, self.n)[self.starts]
        return out ^ (out >> np.uint64(31))

    def cells(self, row: int, width_bits: int) -> np.ndarray:
        h = self.hashes[row] * np.uint64(0x9FB21C651E98DF25)
        return h >> np.uint64(64 - width_bits)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def _marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """marks: one per distinct key in order -> one per element of ``keys``."""
    order = np.argsort(keys)
    s = keys[order]
    rank = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]))
    out = np.empty(len(keys), bool)
    out[order] = marks[rank]
    return out


def _distinct(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted array -> (distinct values, whether each occurs twice or more)."""
    first = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.flatnonzero(first)
    return s[at], np.diff(np.append(at, len(s))) > 1


def _ranges(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each value that occurs: work follows the entries, not the number of ranges."""
    begins = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.empty(0, np.int64)
    return list(zip(sorted_[begins].tolist(), begins.tolist(), np.append(begins[1:], len(sorted_)).tolist()))


def _exact_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (a, b) and where a new pair begins; b is compared only where a collides."""
    order = np.argsort(a)
    same = a[order][1:] == a[order][:-1]
    if (same & (b[order][1:] != b[order][:-1])).any():
        order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(a) else np.empty(0, bool)
    return order, new


class _Plan:
    """Sizes of one run; shipped to the tasks."""

    def __init__(self, size: int, window: int, depth: int, bucket_bytes: int, shard_windows: int):
        if not 1 <= depth <= len(_ODD):
            raise ValueError(f"depth must be 1 or {len(_ODD)}")
        windows = max(1, size // 6)  # an estimate: it sets partition sizes, never results
        self.window, self.depth = window, depth
        self.buckets = max(1, ceil_div(size, bucket_bytes))
        self.shards = power_of_two(windows / shard_windows)
        self.width_bits = min(60, max(20, (power_of_two(windows * CELLS_PER_WINDOW) - 1).bit_length()))
        self.cell_bits = self.width_bits - (self.shards - 1).bit_length()
        self.tasks = ceil_div(max(self.buckets, depth * self.shards), BUCKETS_PER_TASK)

    def sketch(self, table: pa.Table) -> pa.Table:
        """Sparse Count-min rows of one bucket, cut by cell range.  part = row * shards + range."""
        bucket = table["bucket"][0].as_py() if len(table) else 0
        windows = _Bucket(binary(table["text"]), self.window)
        out = []
        for row in range(self.depth):
            if not len(windows.starts):
                break
            cells, twice = _distinct(np.sort(windows.cells(row, self.width_bits)))
            low = (cells & np.uint64((1 << self.cell_bits) - 1)).astype(np.uint32 if self.cell_bits <= 32 else np.uint64)
            for k, a, b in _ranges(cells >> np.uint64(self.cell_bits)):
                deltas = np.diff(low[a:b], prepend=low.dtype.type(0))
                out.append((row * self.shards + k, bucket, b - a, packed(deltas), bits(twice[a:b])))
        return _table(out, _BLOB)

    def merge(self, table: pa.Table) -> pa.Table:
        """Add the sketches of one cell range; one bit per bucket and cell: counter >= 2."""
        kind = np.uint32 if self.cell_bits <= 32 else np.uint64
        rows = table.to_pylist()
        cells = [np.cumsum(unpacked(r["cells"], r["n"], kind), dtype=kind) for r in rows]
        twice = [unbits(r["marks"], r["n"]) for r in rows]
        return _replies(rows, np.concatenate(cells), None, np.concatenate(twice))

    def suspects(self, windows: _Bucket, replies: list[dict]) -> np.ndarray:
        """Windows whose counters are all at least two."""
        out = np.ones(len(windows.starts), bool)
        for row in range(self.depth):
            parts = sorted((r for r in replies if r["part"] // self.shards == row), key=lambda r: r["part"])
            marks = np.concatenate([unbits(r["marks"], r["n"]) for r in parts]) if parts else np.empty(0, bool)
            out &= _marked(windows.cells(row, self.width_bits), marks)
        return out

    def fingerprints(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        """Distinct 96-bit fingerprints of a bucket's suspect windows, cut by range."""
        windows = _Bucket(binary(docs["text"]), self.window)
        if not len(windows.starts):
            return _table([], _BLOB)
        bucket = docs["bucket"][0].as_py()
        a, b, _, _, starts, twice = self._suspects(windows, replies.to_pylist())
        a, b = a[starts], b[starts]
        shard = (a >> np.uint64(1)) >> np.uint64(64 - self.shards.bit_length())  # shards is a power of two
        out = [(k, bucket, j - i, a[i:j].tobytes() + b[i:j].tobytes(), bits(twice[i:j])) for k, i, j in _ranges(shard)]
        return _table(out, _BLOB)

    def _suspects(self, windows: _Bucket, replies: list[dict]) -> tuple:
        """Suspects in fingerprint order: hashes, their order, suspect mask, first of each pair, seen twice here."""
        mask = self.suspects(windows, replies)
        a = windows.hashes[0][mask]
        b = (windows.hashes[1][mask] >> np.uint64(32)).astype(np.uint32)
        order, new = _exact_order(a, b)
        starts = np.flatnonzero(new)
        return a[order], b[order], order, mask, starts, np.diff(np.append(starts, len(a))) > 1

    def group(self, table: pa.Table) -> pa.Table:
        """Exact grouping of the fingerprints of one range."""
        rows = table.to_pylist()
        a = np.concatenate([np.frombuffer(r["cells"], np.uint64, r["n"]) for r in rows])
        b = np.concatenate([np.frombuffer(r["cells"], np.uint32, r["n"], r["n"] * 8) for r in rows])
        return _replies(rows, a, b, np.concatenate([unbits(r["marks"], r["n"]) for r in rows]), kind=1 << 30)

    def cut(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        """Words left in each document of a bucket."""
        texts = binary(docs["text"])
        windows = _Bucket(texts, self.window)
        covered = np.zeros(windows.n + 1, np.int64)
        if len(windows.starts):
            rows = replies.to_pylist()
            _, _, order, mask, starts, _ = self._suspects(windows, [r for r in rows if r["part"] < 1 << 30])
            parts = sorted((r for r in rows if r["part"] >= 1 << 30), key=lambda r: r["part"])
            marks = np.concatenate([unbits(r["marks"], r["n"]) for r in parts]) if parts else np.empty(0, bool)
            repeated = np.empty(len(order), bool)
            repeated[order] = np.repeat(marks, np.diff(np.append(starts, len(order))))
            at = windows.starts[mask][repeated]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + self.window, -1)
        keep = np.cumsum(covered)[:-1] == 0
        n_removed, kept, at = [], [], 0
        for t in texts:
            words = t.split() if t else []
            k = keep[at:at + len(words)]
            at += len(words)
            left = int(np.count_nonzero(k))
            n_removed.append(len(words) - left)
            kept.append(b" ".join(words if left == len(words) else compress(words, k.tolist())))
        columns = {c: docs[c] for c in ("id", "text", "rest")}
        return pa.table(columns | {"n_words": pa.array(windows.n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                                   "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns)})


def _replies(rows: list[dict], a: np.ndarray, b: np.ndarray | None, twice: np.ndarray, kind: int = 0) -> pa.Table:
    """Group (a, b) over all buckets' lists; a bit per entry: found twice or more in all."""
    if b is None:
        order = np.argsort(a)
        new = np.concatenate([[True], a[order][1:] != a[order][:-1]])
    else:
        order, new = _exact_order(a, b)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(a)))
    many = (sizes > 1) | (np.add.reduceat(twice[order].astype(np.int64), starts) > 0)
    marks = np.empty(len(a), bool)
    marks[order] = np.repeat(many, sizes)
    out, at = [], 0
    for r in rows:
        out.append((r["bucket"], kind + r["part"], r["n"], bits(marks[at:at + r["n"]])))
        at += r["n"]
    return _table(out, _REPLY)


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text`` (as it was), ``rest`` (struct of the other columns),
    ``n_words``, ``n_removed`` and ``kept`` (words left, joined by one space)."""
    _, size = text_bytes(docs, text_col)
    plan = _Plan(size, window, depth, bucket_bytes, shard_windows)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), others(docs, id_col, text_col).alias("rest"))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(plan.buckets)).cast("long"))
    tasks = max(plan.tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_bucket = base.repartition(tasks, "bucket").groupBy("bucket")
    marks = (by_bucket.applyInArrow(lambda t: plan.sketch(t), _BLOB).repartition(tasks, "part")
             .groupBy("part").applyInArrow(lambda t: plan.merge(t), _REPLY))
    exact = (by_bucket.cogroup(marks.groupBy("bucket")).applyInArrow(lambda t, r: plan.fingerprints(t, r), _BLOB)
             .repartition(tasks, "part").groupBy("part").applyInArrow(lambda t: plan.group(t), _REPLY))
    schema = T.StructType([f for f in base.schema.fields if f.name != "bucket"])
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return by_bucket.cogroup(marks.unionByName(exact).groupBy("bucket")).applyInArrow(lambda t, r: plan.cut(t, r), schema)
