"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. Each text becomes a set of distinct word shingles (A-Z lower-cased).  One hash per shingle; the hash range
   is cut into ``bands * rows`` bins whose minima are the signature (one permutation).  Empty bins borrow
   from a filled bin that a hash of (bin, attempt) names: optimal densification.
2. Equal texts are one node (the smallest id), so copies cost no pairs.
3. Nodes that agree on all rows of a band share a bucket.  A bucket of n nodes gives n - 1 candidate edges, a
   star around its smallest node, not n * (n - 1) / 2 pairs.
4. Edges are confirmed on full shingle sets, and confirmed links give components.
5. A star tests its centre against all.  In a bucket where some member stayed outside the centre's component, members may still be
   similar to each other.  Such *open* buckets are compared in blocks of ``block`` nodes by sketches (the minima of ``SKETCH_BINS``
   bins, no densification): nothing is emitted but pairs of different components whose estimate is within ``DEVIATIONS`` standard deviations of the
   threshold, each in the first band that it shares.  Those are confirmed on full sets like the edges.  No member is left out; by the
   binomial tail over ``SKETCH_BINS`` filled bins, the estimate misses a pair exactly at the threshold with a probability of about 6e-7.

With the default 32 bands of 4 rows, two sets of similarity 0.85 share no bucket with a probability of about 6e-11
(5e-8 at 0.8).  A centre's text is sent once per ``star`` members, so a hub of any size is many small groups.

Defined cases: null or empty text or white space only: an empty set, linked with nothing.  Fewer words than a
shingle: the whole sequence is the one shingle.  Rows that repeat an id are one document.  Rows with no id join
the component of an equal text that has one; else their component is null and they are kept.  Empty table: empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.common import WORD_HASH, binary, mix, stored
from depotlens.llm.graph import components

SHINGLE = 5
PERCENT = 80
BANDS = 32
ROWS = 4
STAR = 256
BLOCK = 1024
SKETCH_BINS = 512
DEVIATIONS = 5.0

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """(lower-cased words joined by a space, sorted distinct shingle hashes) of each text; None without words."""
    powers = [np.uint64(pow(int(_STEP), j, 1 << 64)) for j in range(shingle)]
    for t in texts:
        words = t.lower().split() if t else []  # bytes: only A-Z change
        if not words:
            yield None, np.empty(0, np.uint64)
            continue
        h = WORD_HASH.of(words)
        n = max(1, len(words) - shingle + 1)
        s = np.full(n, len(words) if len(words) < shingle else shingle, np.uint64)
        for j, p in enumerate(powers[:len(words)]):
            s += h[j:j + n] * p
        yield b" ".join(words), np.unique(mix(s))


class Signature:
    """One-permutation MinHash with optimal densification, hashed by bands."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self._salt = mix(np.arange(1, bands + 1).astype(np.uint64) * _STEP)
        self._tries: list[np.ndarray] = []

    def _donors(self, attempt: int) -> np.ndarray:
        while len(self._tries) <= attempt:
            key = np.arange(self.bins).astype(np.uint64) + np.uint64((len(self._tries) + 1) * self.bins)
            self._tries.append((mix(key * _STEP) % np.uint64(self.bins)).astype(np.int64))
        return self._tries[attempt]

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """Minimum of each bin; ``shingles`` is sorted, so it is the first of the bin."""
        bins = ((shingles >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        out, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bins[first]] = shingles[first]
        filled[bins[first]] = True
        empty, attempt = np.flatnonzero(~filled), 0
        while len(empty):
            donors = self._donors(attempt)[empty]
            found = filled[donors]
            out[empty[found]] = out[donors[found]]
            empty, attempt = empty[~found], attempt + 1
        return out

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        h = self._salt.copy()
        for column in self.values(shingles).reshape(self.bands, self.rows).T:
            h = mix((h ^ column) * _STEP)
        return h.view(np.int64)


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, same, bands): ``same`` is a 128-bit hash of the lower-cased words, null without words."""
    signature = Signature(bands, rows)
    schema = T.StructType([docs.schema["id"]]).add("n_shingles", "long").add("same", "binary").add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, hashes = [], [], []
            for words, shingles in shingle_sets(binary(batch.column("text")), shingle):
                n.append(len(shingles))
                same.append(words and xxhash.xxh3_128_digest(words))
                if words:
                    hashes.append(signature.band_hashes(shingles))
            sizes = [0] + [bands if s else 0 for s in same]
            flat = pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), lists], schema.names)

    return docs.mapInArrow(run, schema)


def confirmed(edges: DataFrame, texts: DataFrame, shingle: int, percent: int, star: int = STAR) -> DataFrame:
    """Edges (a, b) whose full shingle sets satisfy 100 * intersection >= percent * union."""
    groups = edges.groupBy("a").count().select("a", F.ceil(F.col("count") / F.lit(star)).cast("int").alias("n"))
    member = edges.join(groups, "a").join(texts.withColumnRenamed("id", "b"), "b")
    member = member.select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("part"), "b", "text")
    centre = groups.join(texts.withColumnRenamed("id", "a"), "a")
    centre = centre.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(None).cast(edges.schema["b"].dataType).alias("b"), "text")
    rows = centre.unionByName(member).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centres = None, []
        for batch in batches:
            out_a, out_b = [], []
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            for x, p, y, (_, shingles) in zip(a, part, b, shingle_sets(binary(batch.column("text")), shingle)):
                if (x, p) != key:
                    key, centres = (x, p), []
                if y is None:  # an id may stand for more than one text
                    centres.append(shingles)
                elif any(similar(c, shingles, percent) for c in centres):
                    out_a.append(x)
                    out_b.append(y)
            kind = batch.column("a").type
            yield pa.RecordBatch.from_arrays([pa.array(out_a, kind), pa.array(out_b, kind)], ["a", "b"])

    return rows.mapInArrow(run, T.StructType([T.StructField(c, edges.schema["a"].dataType) for c in ("a", "b")])).distinct()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct arrays have 100 * intersection >= percent * union."""
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


def sketch(shingles: np.ndarray, bins: int = SKETCH_BINS) -> np.ndarray:
    """Minimum of each bin as 1..65535, 0 where the bin is empty."""
    own = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    out = np.zeros(bins, np.uint16)
    out[own[first]] = 1 + (shingles[first] % np.uint64(65535)).astype(np.uint16)
    return out


def sketches(texts: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, body): size of the set, band hashes and sketch of each text."""
    signature = Signature(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [np.int64(len(s)).tobytes() + signature.band_hashes(s).tobytes() + sketch(s).tobytes() for _, s in shingle_sets(binary(batch.column("text")), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bodies, pa.binary())], ["id", "body"])

    return texts.select("id", "text").mapInArrow(run, T.StructType([texts.schema["id"]]).add("body", "binary"))


def _likely(x: np.ndarray, n: int, y: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which sketches ``y`` (of sets of ``m`` shingles) may be similar to ``x`` (of ``n``).

    The share of agreeing bins among those that either fills estimates the similarity J of two sets with f shingles together; over b filled bins its
    variance is J (1 - J) ((1 / b) (1 + 1 / (f - 1)) - 1 / (f - 1)): small where most shingles have a bin of their own.
    """
    least = percent / 100
    filled = np.maximum(np.count_nonzero((y != 0) | (x != 0), axis=1), 1)
    same = np.count_nonzero((y == x) & (y != 0), axis=1)
    beyond = np.maximum((n + m) / (1 + least) - 1, 1)
    deviation = np.sqrt(least * (1 - least) * np.maximum((1 + 1 / beyond) / filled - 1 / beyond, 0))
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return fits & (same + 1 >= (least - DEVIATIONS * deviation) * filled)


def block_candidates(rows: DataFrame, bands: int, percent: int) -> DataFrame:
    """Pairs (a, b) to confirm out of the block pairs (k, band, i, j); a row holds its node, label, own block and body."""
    key = ("k", "band", "i", "j")
    id_type = rows.schema["node"].dataType
    ordered = rows.repartition(*key).sortWithinPartitions(*key)

    def pairs(k: int, across: bool, group: list[tuple]) -> list[tuple]:
        node, label, block, body = zip(*group)
        numbers = np.stack([np.frombuffer(b, np.int64, 1 + bands) for b in body])
        sizes, hashes = numbers[:, 0], numbers[:, 1:k + 1]
        sketch_ = np.stack([np.frombuffer(b, np.uint16, SKETCH_BINS, 8 + 8 * bands) for b in body])
        names = {x: i for i, x in enumerate(set(label))}
        of, block = np.array([names[x] for x in label]), np.array(block)
        out = []
        for r in range(len(group) - 1):
            other = np.flatnonzero((of[r + 1:] != of[r]) & ((block[r + 1:] != block[r]) if across else True)) + r + 1
            if len(other):
                other = other[_likely(sketch_[r], sizes[r], sketch_[other], sizes[other], percent)]
                other = other[~(hashes[other] == hashes[r]).any(1)]  # an earlier band that both share has the pair
                out += [(min(node[r], node[o]), max(node[r], node[o])) for o in other.tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in key))
            for this, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in ("node", "label", "block", "body")))):
                if this != now:
                    if len(group) > 1:
                        out += pairs(now[0], now[2] != now[3], group)
                    now, group = this, []
                group.append(row)
            yield _pairs(out, batch.column("node").type)
        if len(group) > 1:
            yield _pairs(pairs(now[0], now[2] != now[3], group), batch.column("node").type)

    return ordered.mapInArrow(run, T.StructType([T.StructField(c, id_type) for c in ("a", "b")])).where("a <> b").distinct()


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``, one row per row of ``docs``."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(signatures(base, shingle, bands, rows))
    nodes = stored(signed.where("same is not null and id is not null").groupBy("same")
                   .agg(F.min("id").alias("node"), F.first("bands").alias("bands")))
    members = nodes.select(F.posexplode("bands").alias("k", "band"), "node")
    stars = members.groupBy("k", "band").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    shared = stored(members.join(stars.select("k", "band", "centre"), ["k", "band"]).where("node <> centre").distinct())
    ends = shared.select("node").union(shared.select("centre")).distinct().withColumnRenamed("node", "id")
    texts = stored(base.join(ends, "id", "left_semi").distinct())
    edges = shared.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(confirmed(edges, texts, shingle, percent))
    labels = components(links)

    # Open buckets: three nodes or more, some of them outside the centre's component.
    of = labels.select(F.col("node").alias("centre"), F.col("label").alias("centre_label"))
    labelled = (shared.join(labels, "node", "left").join(of, "centre", "left")
                .select("k", "band", "node", F.coalesce("label", "node").alias("label"), F.coalesce("centre_label", "centre").alias("centre_label")))
    open_ = labelled.groupBy("k", "band").agg(F.count("*").alias("n"), F.max(F.col("label") != F.col("centre_label")).alias("apart")).where("n > 1 and apart")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    inside = stored(labelled.join(open_.select("k", "band", "n"), ["k", "band"]).select("k", "band", "node", "label", blocks.alias("blocks")))
    bodies = stored(sketches(texts.join(inside.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), shingle, bands, rows))
    own = inside.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meet = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("k", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "block")
    found = block_candidates(meet.join(bodies.withColumnRenamed("id", "node"), "node"), bands, percent)
    more = stored(confirmed(stored(found), texts, shingle, percent))
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

    found = signed.join(nodes.select("same", "node"), "same", "left").join(labels, "node", "left")
    component = F.coalesce("label", "node", "id")
    return found.select("id", "n_shingles", component.alias("component_id"),
                        (F.col("id").isNotNull() & (F.col("id") == component) | component.isNull()).alias("kept"))
