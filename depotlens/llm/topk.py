"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

1. Vectors become integers, floor(``scale`` * x).  A rotation from the SVD of a bounded sample puts most of a vector's length into its
   first coordinates; it changes which pairs are looked at in full, never a result.
2. Candidates are range-partitioned by descending length into blocks; queries are cut into blocks of their own.
3. Each query gets a first threshold, its k-th best score among the ``seeds`` longest vectors (a fixed number, broadcast).
4. A query block meets a candidate block only if some |q| * |x| can reach that query's threshold.  Within a pair of blocks
   candidates go by in descending length, a slab at a time: the partial sum over the first rotated coordinates
   plus the product of the two residual lengths bounds the score; what it cannot rule out is bounded again over more
   coordinates, then scored exactly in integers, and the thresholds rise.
5. Each pair of blocks gives at most k rows a query; the best k of them are the result.  Nothing is left out, so recall is 1.

Vectors as long as 2^31 or longer, whose products may leave 64 bits, are scored pair by pair in whole numbers of any size, without the rotated sums.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with no id.  A query with a result that does not fit a
long fails with a message.  Shorter vectors count as filled up with zeros.  Rows equal in id and vector count once;
a query's own rows are all those with its id.  Fewer than k candidates: all of them.  Empty table: empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.common import ceil_div, stored

K = 5
SCALE = 256
BLOCK = 4096
SLAB = 512
SEEDS = 2048
SAMPLE = 20_000
#: Bytes of vectors that the driver gathers for the sample, and for the seeds, at most.
GATHER_BYTES = 64 << 20
#: Length from which on products of vectors are worked out in whole numbers of any size; below it they stay under 2^62.
LONG = float(1 << 31)
#: Allowance for rounding in the rotated sums, relative to |q| * |x|.
_SLACK = 1e-9


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<double> of whole numbers, norm) of the vectors that take part, each distinct (id, vector) once."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))

    def whole(c: Column) -> Column:
        y = c * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0 ** 52, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole already

    v = F.transform(x, whole)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).distinct().withColumn("norm", norm)


class Rotation:
    """An orthogonal basis with the sample's strongest directions first."""

    def __init__(self, sample: np.ndarray):
        self.dim = sample.shape[1]
        basis = np.linalg.svd(sample, full_matrices=True)[2] if len(sample) < self.dim else np.linalg.svd(sample.T @ sample)[0].T
        self.basis = basis.T
        self.stops = sorted({max(1, self.dim // 8), max(1, self.dim // 3), self.dim})

    def apply(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rotated vectors, length left beyond each stop)."""
        r = v @ self.basis
        square = np.cumsum(r[:, ::-1] ** 2, 1)[:, ::-1]
        square = np.concatenate([square, np.zeros((len(r), 1))], 1)
        return r, np.sqrt(square[:, self.stops])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column -> matrix of whole doubles, shorter rows filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy()
    return out


class Best:
    """The k best (score, smaller id first) of each query."""

    def __init__(self, query: np.ndarray, floor: np.ndarray, k: int):
        self.query, self.floor, self.k = query, floor.copy(), k
        self.q = self.id = self.score = np.empty(0, np.int64)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        own = (self.query[q] != ids) & (score >= self.floor[q])
        q, ids, score = (np.concatenate([a, b[own]]) for a, b in ((self.q, q), (self.id, ids), (self.score, score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        self.q, self.id, self.score = q[keep], ids[keep], score[keep]


def whole_scores(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Inner products of whole doubles of any size, exactly, but for pairs of a query and its ``own`` rows.  One below the range of a long counts as its least value."""
    exact = [[[int(c) for c in row] for row in side] for side in (queries, vectors)]
    out = np.full((len(queries), len(vectors)), LEAST, np.int64)
    for i, q in enumerate(exact[0]):
        for j, x in enumerate(exact[1]):
            if own[i, j]:
                continue
            product = sum(a * b for a, b in zip(q, x))
            if product >= 1 << 63:
                raise OverflowError(f"an inner product of {product} does not fit a long")
            out[i, j] = max(product, LEAST)
    return out


#: The score of pairs below the range of a long, of which both signs are longs.
LEAST = 1 - (1 << 63)


def search(best: Best, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: Rotation, slab: int = SLAB) -> None:
    """Feed ``best`` all candidates that may belong; ``vectors`` are in descending length."""
    with np.errstate(over="ignore"):
        norm_q, norm_x = (np.sqrt((m ** 2).sum(1)) for m in (queries, vectors))
    plain_q, plain_x = norm_q < LONG, norm_x < LONG
    rq, left_q = rotation.apply(np.where(plain_q[:, None], queries, 0))
    rx, left_x = rotation.apply(np.where(plain_x[:, None], vectors, 0))
    whole_q, whole_x = (np.where(p[:, None], m, 0).astype(np.int64) for p, m in ((plain_q, queries), (plain_x, vectors)))
    for at in range(0, len(ids), slab):
        x = np.arange(at, min(at + slab, len(ids)))
        with np.errstate(invalid="ignore"):
            live = np.flatnonzero(~(norm_q * norm_x[at] * (1 + _SLACK) < best.floor))  # no later vector is longer
        if not len(live):
            return
        for some, others in ((live, x[~plain_x[x]]), (live[~plain_q[live]], x[plain_x[x]])):
            if len(some) and len(others):
                best.add(np.repeat(some, len(others)), np.tile(ids[others], len(some)),
                         whole_scores(queries[some], vectors[others], best.query[some][:, None] == ids[others]).ravel())
        live, x = live[plain_q[live]], x[plain_x[x]]
        if not len(live) or not len(x):
            continue
        floor = best.floor[live][:, None] - _SLACK * norm_q[live][:, None] * norm_x[x]
        stop = rotation.stops[0]
        part = rq[live, :stop] @ rx[x, :stop].T
        i, j = np.nonzero(part + left_q[live, 0][:, None] * left_x[x, 0] >= floor)
        part, floor = part[i, j], floor[i, j]
        for n, end in enumerate(rotation.stops[1:], 1):
            part = part + np.einsum("ij,ij->i", rq[live[i], stop:end], rx[x[j], stop:end])
            may = part + left_q[live[i], n] * left_x[x[j], n] >= floor
            i, j, part, floor, stop = i[may], j[may], part[may], floor[may], end
        if len(i):
            best.add(live[i], ids[x[j]], np.einsum("ij,ij->i", whole_q[live[i]], whole_x[x[j]]))


def _sides(spec: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in spec.split(", "))])


def _blocks(df: DataFrame, order: list, block: int, dim: int, floors: bool) -> DataFrame:
    """Rows in ``order`` -> blocks of at most ``block`` vectors: (part, seq, ids, floors, body, longest, need)."""
    spec = "part int, seq int, ids binary, floors binary, body binary, longest double, need double"
    schema = _sides(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                v = matrix(rows.column("v"), dim)
                norm = rows.column("norm").to_numpy()
                floor = rows.column("floor").to_numpy() if floors else np.empty(0)
                with np.errstate(divide="ignore", invalid="ignore"):  # the least candidate length that any query here needs
                    need = float(np.where(floor <= 0, -np.inf, floor / norm).min()) if floors else 0.0
                yield pa.RecordBatch.from_pylist([{"part": rows.column("part")[0].as_py(), "seq": seq, "ids": rows.column("id").to_numpy().tobytes(),
                                                   "floors": floor.astype(np.float64).tobytes(), "body": v.astype(np.int32 if norm.max() < LONG else np.float64).tobytes(),
                                                   "longest": float(norm.max()), "need": need}], schema)
                seq += 1

    ordered = df.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, spec)


def vectors_of(body: bytes, n: int, dim: int) -> np.ndarray:
    """A block's vectors: 32-bit where all of them are short, else doubles."""
    return np.frombuffer(body, np.int32 if len(body) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE,
          block: int = BLOCK, seeds: int = SEEDS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query, ties to the smaller id.

    ``is_query`` is a condition on the column ``id``.
    """
    base = stored(integers(vectors, id_col, vector_col, scale))
    count, dim = base.agg(F.count("*"), F.max(F.size("v"))).first()
    spark = vectors.sparkSession
    result = "query_id long, vec_id long, score long"
    dim = max(1, dim or 0)
    if not count:
        return base.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    plain, most = base.where(F.col("norm") < LONG), max(k, GATHER_BYTES // (8 * dim))
    rows = plain.orderBy(F.xxhash64("id"), "id").limit(min(sample, most)).select("v").toArrow()["v"].combine_chunks()
    rotation = spark.sparkContext.broadcast(Rotation(matrix(rows, dim) if len(rows) else np.eye(dim)))
    longest = plain.orderBy(F.desc("norm"), "id").limit(min(seeds, most)).select("id", "v").toArrow()
    seed = spark.sparkContext.broadcast((longest["id"].to_numpy(), matrix(longest["v"].combine_chunks(), dim).astype(np.int64)))

    def first_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = seed.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLAB):
                part = batch.slice(at, SLAB)
                short = part.column("norm").to_numpy() < LONG
                score = (np.where(short[:, None], matrix(part.column("v"), dim), 0).astype(np.int64) @ seen.T).astype(np.float64)
                score[(part.column("id").to_numpy()[:, None] == ids) | ~short[:, None]] = -np.inf
                floor = np.partition(score, -k, 1)[:, -k] if len(ids) >= k else np.full(len(score), -np.inf)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(floor)], ["id", "v", "norm", "floor"])

    queries = base.where(is_query).mapInArrow(first_floors, "id long, v array<double>, norm double, floor double")
    n_blocks = max(1, ceil_div(count, block))
    by_length = base.repartitionByRange(n_blocks, F.desc("norm"), "id")
    cand = stored(_blocks(by_length, [F.desc("norm"), "id"], block, dim, False)
                  .select(F.concat_ws("-", "part", "seq").alias("c"), F.col("ids").alias("c_ids"), F.col("body").alias("c_body"), "longest"))
    asked = stored(_blocks(queries.repartition(max(1, ceil_div(count, 50 * block)), F.xxhash64("id")), ["id"], block, dim, True)
                   .select(F.concat_ws("-", "part", "seq").alias("q"), F.col("ids").alias("q_ids"), F.col("floors").alias("q_floors"),
                           F.col("body").alias("q_body"), "need"))
    # Which blocks meet: names and lengths only, every query block with the candidate blocks long enough for it.
    numbered = asked.select("q", "need", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("part"))
    meet = (numbered.join(cand.select("c", "longest", F.split("c", "-")[0].cast("int").alias("part")), "part")
            .where(F.col("longest") * (1 + _SLACK) >= F.col("need")).select("q", "c"))
    pairs = meet.join(cand.select("c", "c_ids", "c_body"), "c").join(asked.select("q", "q_ids", "q_floors", "q_body"), "q")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("q_ids", "q_floors", "q_body", "c_ids", "c_body")}
                query = np.frombuffer(row["q_ids"], np.int64)
                asked_v, cand_v = (vectors_of(row[f"{c}_body"], len(row[f"{c}_ids"]) // 8, dim) for c in "qc")
                best = Best(query, np.frombuffer(row["q_floors"], np.float64), k)
                search(best, asked_v, np.frombuffer(row["c_ids"], np.int64), cand_v, rotation.value)
                yield pa.RecordBatch.from_arrays([pa.array(query[best.q]), pa.array(best.id), pa.array(best.score)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(compare, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fits = F.when(F.col("score") > LEAST, F.col("score")).otherwise(F.raise_error(F.lit("an inner product does not fit a long")).cast("long"))
    return ranked.select("query_id", "rank", "vec_id", fits.alias("score"))
