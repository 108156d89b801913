"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct hashed words (value: share of the words) and one indicator per statistic for the quantile
bin it falls in, so the model is y = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j.  The pair term is scored in time
linear in the features: half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).  Trained in numpy with Adagrad.

Statistics: words, distinct share, share of the commonest word, repeated neighbours, mean word bytes, shares of capitals, digits,
symbols and exclamation marks, lines, repeated lines, and from the metadata the stated number of characters where the table has it.

Defined cases: null or empty text or white space only: no words, statistics of zero.  Null metadata: 0.  Repeated rows are scored each.
With labels of one class only, that class's score (0 or 1); with no labels, 0.5.  Empty table: empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.common import WORD_HASH, binary, mix, others
from depotlens.llm.labelled import labelled_sample
from depotlens.llm.tokens import chunks

BUCKETS = 1 << 15
RANK = 8
BINS = 16
EPOCHS = 12
RATE = 0.1
DECAY = 1e-5
STATISTICS = 12

#: Class of each byte: 1 capital, 2 other ASCII letter, 3 digit, 4 symbol, 5 exclamation mark, 0 the rest.
_KIND = np.zeros(256, np.uint8)
_KIND[ord("A"):ord("Z") + 1] = 1
_KIND[ord("a"):ord("z") + 1] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[list(b"#*$%&|<>{}[]\\^~_=+@")] = 4
_KIND[ord("!")] = 5


def features(text: bytes | None, n_chars: int | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(hashed distinct words, their shares, statistics) of one text."""
    text = text or b""
    words = text.lower().split()
    n = len(words)
    stats = [0.0] * STATISTICS
    stats[11] = float(np.log1p(max(0, n_chars or 0)))
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.float32), stats
    h = WORD_HASH.of(words)
    distinct, counts = np.unique(h, return_counts=True)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6)
    lines = text.split(b"\n")
    letters = kinds[1] + kinds[2]
    stats[:11] = [float(np.log1p(n)), len(distinct) / n, counts.max() / n, float(np.count_nonzero(h[1:] == h[:-1])) / n, (len(text) - n) / n,
                  kinds[1] / max(1, letters), kinds[3] / len(text), kinds[4] / n, kinds[5] / n, len(lines) / n, 1 - len(set(lines)) / len(lines)]
    return (mix(distinct) % np.uint64(buckets)).astype(np.int64), (counts / n).astype(np.float32), stats


@dataclass
class Model:
    """Bin edges of each statistic; bias, linear weights and factors of words, then of (statistic, bin)."""
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    buckets: int = BUCKETS
    constant: float | None = None

    def rows(self, texts: list[bytes | None], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, value, start of each text's features)."""
        index, value, stats = [], [], []
        for t, c in zip(texts, n_chars):
            i, x, s = features(t, c, self.buckets)
            index.append(i)
            value.append(x)
            stats.append(s)
        own = _bins(np.array(stats, np.float64).reshape(-1, STATISTICS), self.edges) + self.buckets
        index = [np.concatenate([i, b]) for i, b in zip(index, own)]
        one = np.ones(STATISTICS, np.float32)
        value = [np.concatenate([x, one]) for x in value]
        n = np.fromiter(map(len, index), np.int64, len(index))
        if not len(n):
            return np.empty(0, np.int64), np.empty(0, np.float32), n
        return np.concatenate(index), np.concatenate(value), np.cumsum(n) - n

    def scores(self, texts: list[bytes | None], n_chars: list[int | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant if self.constant is not None else 0.0)
        i, x, at = self.rows(texts, n_chars)
        z, _ = _forward(self.bias, self.linear[i], self.factors[i], x, at)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -500, 500)))


def _bins(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of each (statistic, bin) indicator, from 0."""
    width = edges.shape[1] + 1
    return np.stack([np.searchsorted(edges[k], stats[:, k], "right") + k * width for k in range(STATISTICS)], 1)


def _forward(bias: float, linear: np.ndarray, factors: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, sums of v x) by the sum-of-squares identity."""
    vx = factors * x[:, None]
    sums = np.add.reduceat(vx, at)
    squares = np.add.reduceat(vx * vx, at)
    return bias + np.add.reduceat(linear * x, at) + 0.5 * (sums * sums - squares).sum(1), sums


def train(texts: list[bytes], n_chars: list[int | None], labels: list[int], *, buckets: int = BUCKETS, rank: int = RANK, bins: int = BINS,
          epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 11) -> Model:
    if len(set(labels)) < 2:
        return Model(np.zeros((STATISTICS, bins - 1)), 0.0, np.empty(0), np.empty((0, rank)), buckets, float(labels[0]) if labels else 0.5)
    rng = np.random.default_rng(seed)
    stats = np.array([features(t, c, buckets)[2] for t, c in zip(texts, n_chars)])
    edges = np.quantile(stats, np.arange(1, bins) / bins, axis=0).T
    size = buckets + STATISTICS * bins
    model = Model(np.ascontiguousarray(edges), 0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, rank)).astype(np.float32), buckets)
    index, value, at = model.rows(texts, n_chars)
    n = np.diff(np.append(at, len(index)))
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-6, np.float32), np.full((size, rank), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for docs in np.array_split(order, max(1, len(order) // 128)):
            m = n[docs]
            starts = np.cumsum(m) - m
            take = np.arange(int(m.sum())) + np.repeat(at[docs] - starts, m)
            i, x = index[take], value[take]
            v = model.factors[i]
            z, sums = _forward(model.bias, model.linear[i], v, x, starts)
            g = weight[docs] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[docs]) / len(docs)
            gx = np.repeat(g, m) * x
            rows, inverse = np.unique(i, return_inverse=True)
            to_linear = np.bincount(inverse, gx, len(rows)) + decay * model.linear[rows]
            per = gx[:, None] * (np.repeat(sums, m, axis=0) - v * x[:, None])
            to_factors = np.stack([np.bincount(inverse, per[:, f], len(rows)) for f in range(rank)], 1) + decay * model.factors[rows]
            seen_linear[rows] += to_linear ** 2
            seen_factors[rows] += to_factors ** 2
            model.linear[rows] -= rate * to_linear / np.sqrt(seen_linear[rows])
            model.factors[rows] -= rate * to_factors / np.sqrt(seen_factors[rows])
            seen_bias += float(g.sum()) ** 2
            model.bias -= rate * float(g.sum()) / seen_bias ** 0.5
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
        label_col: str = "quality", folds: int = 3, held_out: int = 1, **settings) -> Model:
    """Train on a bounded labelled sample (``labelled.SAMPLE_ROWS``) outside the held-out fold."""
    extra = (chars_col,) if chars_col else ()
    sample = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, extra=extra)
    return train([r[0] for r in sample], [r[2] if extra else None for r in sample], [r[1] for r in sample], **settings)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text``, ``rest`` (struct of the other columns), ``score`` (0 to 1)."""
    chars = F.col(chars_col).cast("long") if chars_col else F.lit(None).cast("long")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), others(docs, id_col, text_col).alias("rest"), chars.alias("chars"))
    schema = T.StructType([f for f in base.schema.fields if f.name != "chars"]).add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (BUCKETS + bins) * (RANK + 1) numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_chars = binary(batch.column("text")), batch.column("chars").to_pylist()
            scores = [shared.value.scores(texts[part], n_chars[part]) for part in chunks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(scores) if scores else np.empty(0))], schema.names)

    return base.mapInArrow(run, schema)
