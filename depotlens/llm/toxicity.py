"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its byte n-grams (with word marks) and of the word itself, all hashed; a bag
is the mean of its words; a softmax over two classes reads it.  Misspelt words that training never saw share n-grams
with those it did.  A few toxic words in a long text would drown in one mean, so a bag is ``span`` consecutive words
and a document scores as its most toxic bag; training takes each document's current worst bag, of either label.

Both layers are linear up to the softmax, so after training each n-gram has one number, a word's share is the mean of its
n-grams' numbers, and a text costs a lookup per word.

Defined cases: null or empty text or white space only: the score of an empty bag (the bias alone).  Fewer words than a span: one bag.
Repeated rows are scored each.  With labels of one class only, or none: every score is 0.  Empty table: empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.common import binary, mix, others
from depotlens.llm.labelled import labelled_sample
from depotlens.llm.tokens import chunks

SPAN = 3
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 14
RATE = 0.5
INIT = 0.01
THRESHOLD = 0.7
MEMO_WORDS = 250_000
#: Words of the sample whose bags training looks at together, about.
PART_WORDS = 1 << 20


def subwords(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all words one after another, how many each word has)."""
    text = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(text))  # bytes from here to the word's end
    base = np.uint64(0x100000001B3)
    out_gram, out_word = [], []
    roll = np.zeros(len(text), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        roll = roll * base
        roll[:len(text) - n + 1] += text[n - 1:]
        if n in GRAMS:
            at = np.flatnonzero(left >= n)
            out_gram.append(mix(roll[at] + np.uint64(n)))
            out_word.append(word[at])
    power = np.cumprod(np.full(int(sizes.max(initial=1)), base, np.uint64))
    whole = np.add.reduceat(text * power[np.arange(len(text)) - np.repeat(starts, sizes)], starts) if len(words) else np.empty(0, np.uint64)
    out_gram.append(mix(whole ^ np.uint64(0xA5A5A5A5)))
    out_word.append(np.arange(len(words)))
    gram, word = np.concatenate(out_gram), np.concatenate(out_word)
    order = np.argsort(word, kind="stable")
    return (gram[order] % np.uint64(buckets)).astype(np.int64), np.bincount(word, minlength=len(words))


def worst_bags(values: np.ndarray, n_words: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best mean, its first word, its words) over each text's bags; ``values`` of all words one after another."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    first = np.cumsum(n_words) - n_words
    size = np.minimum(n_words, span)
    bags = np.maximum(n_words - span, 0) + 1
    at = np.arange(int(bags.sum())) - np.repeat(np.cumsum(bags) - bags - first, bags)
    length = np.repeat(size, bags)
    means = (sums[at + length] - sums[at]) / np.maximum(length, 1)
    if not len(bags):
        return np.empty(0), first, size
    edges = np.cumsum(bags) - bags
    best = np.maximum.reduceat(means, edges)
    hit = np.flatnonzero(means == np.repeat(best, bags))
    which = np.searchsorted(hit, edges)
    return best, at[hit[which]], size


def worst_places(per_word: np.ndarray, doc_words: np.ndarray, n_words: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of each text's worst bag, worked out a few texts at a time."""
    ends = np.cumsum(n_words)
    first, size = np.empty_like(n_words), np.empty_like(n_words)
    for part in np.split(np.arange(len(n_words)), np.flatnonzero(np.diff(ends // PART_WORDS)) + 1):
        start = ends[part[0]] - n_words[part[0]]
        _, at, size[part] = worst_bags(per_word[doc_words[start:ends[part[-1]]]], n_words[part], span)
        first[part] = at + start
    return first, size


@dataclass
class Model:
    """One number for each hashed n-gram, and the bias; ``None`` numbers score 0."""
    grams: np.ndarray | None
    bias: float
    span: int = SPAN

    def words(self, words: list[bytes]) -> np.ndarray:
        gram, n = subwords(words, len(self.grams))
        return np.add.reduceat(self.grams[gram], np.cumsum(n) - n) / n


def train(texts: list[bytes], labels: list[int], *, span: int = SPAN, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = 7) -> Model:
    if len(set(labels)) < 2:
        return Model(None, 0.0, span)
    rng = np.random.default_rng(seed)
    code: dict[bytes, int] = {}
    coded = [np.fromiter((code.setdefault(w, len(code)) for w in t.lower().split()), np.int32) for t in texts]
    n_words = np.fromiter(map(len, coded), np.int64, len(coded))
    doc_words = np.concatenate(coded)
    vocabulary = list(code)
    del coded, code
    parts = [subwords(vocabulary[i:i + 20_000], buckets) for i in range(0, len(vocabulary), 20_000)]  # bounds what hashing holds at once
    gram, n_gram = np.concatenate([g.astype(np.int32) for g, _ in parts]), np.concatenate([n for _, n in parts])
    del parts, vocabulary
    gram_at = np.cumsum(n_gram) - n_gram
    y = np.array(labels)
    table = rng.normal(0, INIT, (buckets, dim)).astype(np.float32)  # n-grams never seen stay near zero
    out = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_table, seen_out, seen_bias = (np.full_like(x, 1e-6) for x in (table, out, bias))
    use = np.flatnonzero(n_words > 0)
    weight = np.where(y == 1, 0.5 / max(1, (y[use] == 1).mean()), 0.5 / max(1e-9, (y[use] == 0).mean()))
    weight = weight / weight[use].mean()
    first_word = np.cumsum(n_words) - n_words
    for epoch in range(epochs):
        # every text's worst bag under the present model; at first all its words, for an idea of the words that matter
        if epoch:
            per_word = np.add.reduceat((table @ (out[:, 1] - out[:, 0]))[gram], gram_at) / n_gram
            first, size = worst_places(per_word, doc_words, n_words, span)
        else:
            first, size = first_word, n_words
        order = rng.permutation(use)
        for docs in np.array_split(order, max(1, len(order) // 128)):
            n = size[docs]
            # distinct words of each bag and their shares, so that a long text costs its distinct words
            place = np.arange(int(n.sum())) + np.repeat(first[docs] - (np.cumsum(n) - n), n)
            cell, times = np.unique(np.repeat(np.arange(len(docs)) * len(n_gram), n) + doc_words[place], return_counts=True)
            bag = cell // len(n_gram)
            share = (times / n[bag]).astype(np.float32)
            words, which = np.unique(cell % len(n_gram), return_inverse=True)
            own = n_gram[words]
            flat = gram[np.arange(int(own.sum())) + np.repeat(gram_at[words] - (np.cumsum(own) - own), own)]
            vectors = np.add.reduceat(table[flat], np.cumsum(own) - own) / own[:, None]
            bags = np.add.reduceat(vectors[which] * share[:, None], np.searchsorted(bag, np.arange(len(docs))))
            z = bags @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), y[docs]] -= 1
            p *= weight[docs, None] / len(docs)
            to_bags = p @ out.T
            for value, seen, g in ((out, seen_out, bags.T @ p), (bias, seen_bias, p.sum(0))):
                seen += g * g
                value -= rate * g / np.sqrt(seen)
            to_words = np.stack([np.bincount(which, to_bags[bag, d] * share, len(words)) for d in range(dim)], 1) / own[:, None]
            rows, inverse = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(inverse, np.repeat(to_words[:, d], own), len(rows)) for d in range(dim)], 1)
            seen_table[rows] += g * g
            table[rows] -= rate * g / np.sqrt(seen_table[rows])
    direction = out[:, 1] - out[:, 0]
    return Model((table @ direction).astype(np.float32), float(bias[1] - bias[0]), span)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        folds: int = 3, held_out: int = 1, **settings) -> Model:
    """Train on a bounded labelled sample (``labelled.SAMPLE_ROWS``) outside the held-out fold."""
    sample = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out)
    return train([t for t, _ in sample], [v for _, v in sample], **settings)


class _Scorer(dict):
    """word -> code; numbers of new words are worked out a batch at a time."""

    def __init__(self, model: Model):
        self.model, self.new, self.values = model, [], np.empty(0, np.float32)

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.model.grams is None:
            return np.zeros(len(texts))
        if len(self) > MEMO_WORDS:
            self.clear()
            self.values = self.values[:0]
        words = [t.lower().split() if t else [] for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.fromiter((c for w in words for c in map(self.__getitem__, w)), np.int64, int(n.sum()))
        if self.new:
            self.values = np.concatenate([self.values, self.model.words(self.new)])
            self.new = []
        best, _, _ = worst_bags(self.values[codes], n, self.model.span)
        return 1 / (1 + np.exp(-np.clip(best + self.model.bias, -500, 500)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text``, ``rest`` (struct of the other columns), ``score`` (0 to 1)."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), others(docs, id_col, text_col).alias("rest"))
    schema = T.StructType(list(base.schema.fields)).add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts = binary(batch.column("text"))
            scores = [scorer.scores(texts[part]) for part in chunks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0))], schema.names)

    return base.mapInArrow(run, schema)
