"""Class-based bigram language model: Brown clustering by exchange, smoothed class transitions and word emissions.

log P(text) = sum over tokens of log P(class | class before) + log P(token | class); each text starts after an end token and ends with one.

1. Texts become codes once: a task cuts its texts into buckets of bounded size, and each bucket is stored as the list of its distinct words, their training counts, and
   its texts as numbers in that list.  All later passes read codes; no text is shuffled.  Word counts cover all training texts: the buckets' counts are added up by word.
2. The exchange algorithm clusters *units* first: the ``frequent`` commonest words, each its own unit, and ``endings``
   groups of all other words by a hash of how they end, so that every word, seen or not, has a unit without a table of all words.
   Bigrams of units are counted over all training texts, a table a task; it has at most (frequent + endings + 1)^2 cells, whatever the input, and is
   clustered on the driver: units move, one at a time, to the class that most raises the class-bigram likelihood.
3. Every other training word then gets its own class: its neighbours' classes are counted over all training texts, added up by word, and
   each word moves from its ending's class to the one that most raises the likelihood of the class table (broadcast; all words move at
   once).  Class bigrams are counted again with the words' own classes.  Should that lower the likelihood, a part of the words moves instead (``SHARES``), with a warning,
   so the likelihood never falls.  Only unseen words keep the class of their ending.
4. Transitions are smoothed towards the class frequencies, emissions by adding ``add`` to each count, with one more place for unseen words.
5. Each bucket gets back the counts and classes of its own words and no others, and keeps its texts as classes with what the emissions add up to; no vocabulary is broadcast.
   The class bigrams and the scores are read off those.

Defined cases: null or empty text or white space only: the end token alone.  Rows with a null id belong to the training texts.
No training texts: all counts are 0 and every class is as likely as any other.  Repeated rows count and score each.  Empty table: empty result.
"""
from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.common import binary, packed, stored, unpacked

log = logging.getLogger(__name__)
FREQUENT = 1024
ENDINGS = 512
CLASSES = 64
ROUNDS = 4
ADD = 1.0
PRIOR = 50.0
BUCKET_BYTES = 12 << 20
#: Rows of contexts whose words move together.
MOVE_ROWS = 8_000
#: The end token; no word holds a line end.
END = b"\n"


def tokens(text: bytes | None) -> list[bytes]:
    words = text.lower().split() if text else []  # bytes: only A-Z change
    words.append(END)
    return words


class Units(dict):
    """word -> unit: its place among the frequent words, or the group of its ending."""

    MEMO = 400_000

    def __init__(self, frequent: list[bytes], endings: int):
        super().__init__({w: i for i, w in enumerate(frequent)})
        self._n, self._endings, self._frequent = len(frequent), endings, frequent

    def __len__(self) -> int:
        return self._n + self._endings

    @property
    def frequent(self) -> list[bytes]:
        return self._frequent

    def __missing__(self, word: bytes) -> int:
        if super().__len__() > self.MEMO:
            self.clear()
            self.update((w, i) for i, w in enumerate(self._frequent))
        unit = self[word] = self._n + xxhash.xxh3_64_intdigest(word[-3:]) % self._endings
        return unit

    def __reduce__(self):
        return Units, (self._frequent, self._endings)


def phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    return float(phi(n).sum() - phi(n.sum(0)).sum() - phi(n.sum(1)).sum())


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit.  Maximises sum N(g,h) log N(g,h) - sum N(g,.) log N(g,.) - sum N(.,h) log N(.,h)."""
    units = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    of = np.empty(units, np.int64)
    of[order] = np.arange(units) % classes
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    to_class, from_class = bigrams @ member, bigrams.T @ member  # unit -> class after it, class before it
    n = member.T @ to_class
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for w in order:
            a, self_ = of[w], bigrams[w, w]
            r, c = to_class[w].copy(), from_class[w].copy()
            if not r.any() and not c.any():
                continue
            n[a] -= r
            n[:, a] -= c
            n[a, a] += self_
            r[a] -= self_
            c[a] -= self_
            out, in_ = n.sum(1), n.sum(0)
            had = phi(n)
            rows, columns = phi(n + r) - had, phi(n + c[:, None]) - had  # row b gains r; column b gains c
            gain = rows.sum(1) - rows[diagonal, diagonal] + columns.sum(0) - columns[diagonal, diagonal]
            gain += phi(n[diagonal, diagonal] + r + c + self_) - had[diagonal, diagonal]
            gain -= phi(out + r.sum() + self_) - phi(out) + phi(in_ + c.sum() + self_) - phi(in_)
            b = a if gain[a] >= gain.max() - 1e-9 else int(gain.argmax())
            n[b] += r
            n[:, b] += c
            n[b, b] += self_
            if b != a:
                of[w] = b
                moved += 1
                to_class[:, a] -= bigrams[:, w]
                to_class[:, b] += bigrams[:, w]
                from_class[:, a] -= bigrams[w]
                from_class[:, b] += bigrams[w]
        if not moved:
            break
    return of


def gains(n: np.ndarray, after: np.ndarray, before: np.ndarray, self_: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(words, classes): what each word, taken out of its class ``own`` in the class table ``n``, adds to the likelihood in each class.

    ``after``, ``before`` (words, classes): neighbours of each class; ``self_``: how often the word follows itself.  As in ``exchange``,
    for many words at once, and at the cost of the classes that they meet.
    """
    m, k = after.shape
    row, diagonal = np.arange(m), np.arange(k)
    to, from_ = after.copy(), before.copy()
    to[row, own] -= self_
    from_[row, own] -= self_
    total = np.zeros((m, k))
    for x, table, mine, other in ((to, n, after, before), (from_, n.T, before, after)):
        w, h = np.nonzero(x)
        if not len(w):
            continue
        a, cell = own[w], np.arange(len(w))
        base = table.T[h]  # table[b, h] of every class b
        base[cell, a] -= mine[w, h]
        at = np.flatnonzero(h == a)
        base[at] -= other[w[at]]
        base[at, a[at]] += self_[w[at]]
        gain = phi(base + x[w, h][:, None]) - phi(base)
        gain[cell, h] = 0  # on the diagonal both sides meet, below
        start = np.flatnonzero(np.diff(w, prepend=-1))
        total[w[start]] += np.add.reduceat(gain, start)
    cells = np.tile(n[diagonal, diagonal], (m, 1))
    cells[row, own] += self_ - after[row, own] - before[row, own]
    total += phi(cells + to + from_ + self_[:, None]) - phi(cells)
    for out, mine in ((n.sum(1), after.sum(1)), (n.sum(0), before.sum(1))):  # the neighbours' own totals stay, wherever the word goes
        left = np.tile(out, (m, 1))
        left[row, own] -= mine
        total -= phi(left + mine[:, None]) - phi(left)
    return total


@dataclass
class Model:
    units: Units
    of: np.ndarray  # class of each unit
    transition: np.ndarray  # log10 P(class | class before)
    places: np.ndarray  # per class: tokens + add * (distinct words + 1)
    add: float
    train_tokens: int
    distinct: int
    table: np.ndarray  # bigrams of classes
    words_of: np.ndarray  # distinct training words of each class
    own: bool = False  # whether training words have classes of their own

    def classes(self, words: list[bytes]) -> np.ndarray:
        """Class of each word's unit."""
        return self.of[np.fromiter(map(self.units.__getitem__, words), np.int64, len(words))]


# --- coded texts ---------------------------------------------------------------------------------

class _Codes(dict):
    """word -> place in the list of a bucket's words, in the order met; the end token is the first."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def coded(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per bucket: (bucket, ids, train, n, codes, words, word_bytes, counts); ``n``: tokens of each text, ``counts``: of each word in training texts."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(True)).alias("train"))
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("ids", T.ArrayType(base.schema["id"].dataType)), T.StructField("train", T.ArrayType(T.BooleanType())),
                           T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()), T.StructField("words", T.BinaryType()),
                           T.StructField("word_bytes", T.LongType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        code, ids, train, own, size = _Codes(), [], [], [], 0
        kind = None

        def close() -> pa.RecordBatch:
            codes, n = np.concatenate(own), np.fromiter(map(len, own), np.int32, len(own))
            joined = b" ".join(list(code)[1:])  # the end token is understood
            counts = np.bincount(codes[np.repeat(np.array(train), n)], minlength=len(code))
            arrays = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([train]), pa.array([n.tolist()], pa.list_(pa.int32())),
                      pa.array([packed(codes)], pa.binary()), pa.array([packed(np.frombuffer(joined, np.uint8))], pa.binary()), pa.array([len(joined)], pa.int64()),
                      pa.array([packed(counts.astype(np.int64))], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            kind = batch.column("id").type
            for i, text, trains in zip(batch.column("id").to_pylist(), binary(batch.column("text")), batch.column("train").to_pylist()):
                words = tokens(text)
                own.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
                ids.append(i)
                train.append(trains)
                size += len(text) if text else 0
                if size >= bucket_bytes:
                    yield close()
                    code, ids, train, own, size = _Codes(), [], [], [], 0
                    number += 1
        if own:
            yield close()

    return base.mapInArrow(run, schema)


class Bucket:
    """One stored bucket."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self._get = lambda c: batch.column(c)[row].as_py()
        self.number = self._get("bucket")

    @property
    def words(self) -> list[bytes]:
        joined = unpacked(self._get("words"), self._get("word_bytes"), np.uint8).tobytes()
        return [END, *joined.split(b" ")] if joined else [END]

    def counts(self, n_words: int) -> np.ndarray:
        return unpacked(self._get("counts"), n_words, np.int64)

    def training(self) -> np.ndarray:
        """Codes of the training texts, one after another; each ends with the end token, 0."""
        n = np.array(self._get("n"), np.int64)
        codes = unpacked(self._get("codes"), int(n.sum()), np.int32)
        return codes[np.repeat(np.array(self._get("train"), bool), n)]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield Bucket(batch, row)


def word_rows(buckets: DataFrame, seed: Broadcast | None = None) -> DataFrame:
    """(bucket, code, word, n, cls): every word of a bucket, how often its training texts have it, and its unit's class in the ``seed`` model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _each(batches):
            words = bucket.words
            n = bucket.counts(len(words))
            for at in range(0, len(words), 100_000):
                part = words[at:at + 100_000]
                cls = seed.value.classes(part) if seed else np.zeros(len(part), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket.number)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part, pa.binary()),
                                                  pa.array(n[at:at + len(part)]), pa.array(cls.astype(np.int32))], ["bucket", "code", "word", "n", "cls"])

    return buckets.select("bucket", "words", "word_bytes", "counts").mapInArrow(run, "bucket long, code int, word binary, n long, cls int")


def _add_cells(df: DataFrame, size: int, cells_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """A size x size table of counts: each task adds its cells up before it sends them on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for cells in cells_of(batches):
            at, n = np.unique(cells, return_counts=True)
            total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    cells = df.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(size, size)


def _follow(now: np.ndarray, end: int, size: int) -> np.ndarray:
    """Cells (token before, token) of texts one after another; a text's first token follows an end."""
    return np.concatenate([[end], now[:-1]]) * size + now if len(now) else now


def unit_bigrams(buckets: DataFrame, units: Units) -> np.ndarray:
    """Bigrams of units over all training texts; the table's size is fixed by the parameters."""
    size = len(units)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for bucket in _each(batches):
            words = bucket.words
            unit = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
            yield _follow(unit[bucket.training()], int(unit[0]), size)

    return _add_cells(buckets, size, cells)


def fit(buckets: DataFrame, totals: DataFrame, *, frequent: int = FREQUENT, endings: int = ENDINGS, classes: int = CLASSES, rounds: int = ROUNDS,
        add: float = ADD, prior: float = PRIOR) -> Model:
    """The model from the counts of all training words (``totals``: word, c) and the bigrams of units."""
    n_tokens, distinct = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    top = [bytes(r["word"]) for r in totals.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).orderBy(F.desc("c"), "word").limit(frequent).collect()]
    units = Units([END, *top], endings)
    bigrams = unit_bigrams(buckets, units)
    of = exchange(bigrams, classes, rounds)

    # Distinct training words of each unit: one each for the frequent ones, counted for the endings.
    def endings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = np.fromiter(map(units.__getitem__, batch.column("word").to_pylist()), np.int64, batch.num_rows)
            found = np.bincount(unit, minlength=len(units))
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at].astype(np.int64))], ["unit", "n"])

    own = totals.where("c > 0").select("word").mapInArrow(endings_of, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")).collect()
    words = np.zeros(len(units))
    for r in own:
        words[r["unit"]] = r["n"]
    member = np.zeros((len(units), classes))
    member[np.arange(len(units)), of] = 1
    return _model(units, of, member.T @ bigrams @ member, member.T @ words, add, prior, int(n_tokens), int(distinct))


def _model(units: Units, of: np.ndarray, n: np.ndarray, words_of: np.ndarray, add: float, prior: float, n_tokens: int, distinct: int, own: bool = False) -> Model:
    tokens_of = n.sum(0)
    share = (tokens_of + 1) / (tokens_of.sum() + len(n))
    transition = np.log10((n + prior * share) / (n.sum(1, keepdims=True) + prior))
    return Model(units, of, transition, tokens_of + add * (words_of + 1), add, n_tokens, distinct, n, words_of, own)


def moved(buckets: DataFrame, seed: Broadcast) -> DataFrame:
    """(word, cls): the class of its own of every training word that is no frequent one.  ``seed``: the model of the units, of a fixed size."""
    k = len(seed.value.table)
    small = np.uint8 if 2 * k < 256 else np.uint16

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, of = seed.value.units, seed.value.of
        for bucket in _each(batches):
            words = bucket.words
            now = bucket.training().astype(np.int32 if len(words) * (2 * k + 1) < 1 << 31 else np.int64)
            if not len(now):
                continue
            before = np.concatenate([now[:1] * 0, now[:-1]])
            unit = np.fromiter(map(units.__getitem__, words), np.int64, len(words))
            cls, rare = of[unit].astype(now.dtype), unit >= len(units.frequent)
            same = now[now == before]
            cell = np.concatenate([before * (2 * k + 1) + cls[now], now * (2 * k + 1) + k + cls[before], same * (2 * k + 1) + 2 * k])
            cell, n = np.unique(cell[rare[cell // (2 * k + 1)]], return_counts=True)
            word, key = cell // (2 * k + 1), (cell % (2 * k + 1)).astype(small)
            start = np.flatnonzero(np.diff(word, prepend=-1))
            places = np.append(start, len(word))
            for at in range(0, len(start), 50_000):
                cut = places[at:at + 50_001]
                low, high = cut[0], cut[-1]
                lists = [pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(((cut - low) * a.itemsize).astype(np.int32).tobytes()), pa.py_buffer(a[low:high].tobytes())])
                         for a in (key, n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in word[cut[:-1]].tolist()], pa.binary()), *lists], ["word", "key", "n"])

    def move(table: pa.Table) -> pa.RecordBatch:
        model = seed.value
        coded = table["word"].combine_chunks().dictionary_encode()
        words, keys = coded.dictionary.to_pylist(), table["key"].to_pylist()
        sizes = np.fromiter(map(len, keys), np.int64, len(keys)) // np.dtype(small).itemsize
        word = np.repeat(coded.indices.to_numpy(), sizes)
        cell = word.astype(np.int64) * (2 * k + 1) + np.frombuffer(b"".join(keys), small)
        n = np.bincount(cell, np.frombuffer(b"".join(table["n"].to_pylist()), np.int32), len(words) * (2 * k + 1)).reshape(-1, 2 * k + 1)
        own = model.classes(words)
        gain = gains(model.table, n[:, :k], n[:, k:2 * k], n[:, 2 * k], own)
        stay = gain[np.arange(len(words)), own] >= gain.max(1) - 1e-9
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.where(stay, own, gain.argmax(1)).astype(np.int32))], ["word", "cls"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:  # sorted by word
            held.append(batch)
            rows += batch.num_rows
            if rows < MOVE_ROWS:
                continue
            table = pa.Table.from_batches(held)
            index = table["word"].combine_chunks().dictionary_encode().indices.to_numpy()
            cut = int(np.searchsorted(index, index[-1]))  # the last word may go on
            if cut:
                yield move(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield move(pa.Table.from_batches(held))

    found = buckets.select("bucket", "train", "n", "codes", "words", "word_bytes").mapInArrow(contexts, "word binary, key binary, n binary")
    return found.repartition("word").sortWithinPartitions("word").mapInArrow(assign, "word binary, cls int")


def in_classes(buckets: DataFrame, replies: DataFrame, base_places: float, k: int, add: float) -> DataFrame:
    """One row per bucket: its texts as classes, and of each text the tokens, known tokens, base score and sum of log10(count + add).

    ``replies``: (bucket, code, c, cls).  A bucket is in one task with the words of its own texts.
    """
    small = np.uint8 if k <= 256 else np.uint16
    schema = T.StructType([buckets.schema["bucket"], buckets.schema["ids"], buckets.schema["train"], buckets.schema["n"]])
    for name, kind in (("known", T.ArrayType(T.LongType())), ("base", T.ArrayType(T.DoubleType())), ("emit", T.ArrayType(T.DoubleType())), ("cls", T.BinaryType())):
        schema = schema.add(name, kind)

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        n = np.array(row["n"], np.int64)
        codes = unpacked(row["codes"], int(n.sum()), np.int32)
        c, cls = np.zeros(len(known)), np.zeros(len(known), small)
        c[known["code"].to_numpy()] = known["c"].to_numpy()
        cls[known["code"].to_numpy()] = known["cls"].to_numpy()
        start = np.cumsum(n) - n
        of_texts = lambda per_word: np.add.reduceat(per_word[codes], start)  # noqa: E731 - every text has its end token
        columns = {"known": of_texts((c > 0).astype(np.int64)), "base": of_texts(np.log10((c + 1) / base_places)), "emit": of_texts(np.log10(c + add))}
        lists = [pa.array([v.tolist()]) for v in columns.values()]
        return pa.Table.from_arrays([*(own[x].combine_chunks() for x in ("bucket", "ids", "train", "n")), *lists, pa.array([packed(cls[codes])], pa.binary())], schema.names)

    parts = max(1, buckets.count() // 2)
    left = buckets.select("bucket", "ids", "train", "n", "codes").repartition(parts, "bucket").groupBy("bucket")
    right = replies.select("bucket", "code", "c", "cls").repartition(parts, "bucket").groupBy("bucket")
    return left.cogroup(right).applyInArrow(lambda a, b: run(a, b), schema)


def class_bigrams(classed: DataFrame, k: int, end: int) -> np.ndarray:
    """Bigrams of classes over all training texts."""
    small = np.uint8 if k <= 256 else np.uint16

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n"], np.int64)
                cls = unpacked(row["cls"], int(n.sum()), small)
                yield _follow(cls[np.repeat(np.array(row["train"], bool), n)].astype(np.int64), end, k)

    return _add_cells(classed.select("train", "n", "cls"), k, cells)


#: Which of the words may take classes of their own, one in so many by a hash, until the likelihood does not fall.
SHARES = (1, 4, 16)


def refine(buckets: DataFrame, totals: DataFrame, own: DataFrame, seed: Broadcast, *, add: float = ADD, prior: float = PRIOR) -> tuple[DataFrame, Model]:
    """(texts as classes, model) with the words' own classes (``own``: word, cls)."""
    model = seed.value
    k, end = len(model.table), int(model.classes([END])[0])
    words = word_rows(buckets, seed).drop("n")
    for share in (*SHARES, None):
        some = own.where(F.lit(False)) if share is None else own.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0)
        known = totals.join(some.withColumnRenamed("cls", "own"), "word", "left")
        replies = words.join(known, "word").select("bucket", "code", "c", F.coalesce("own", "cls").alias("cls"))
        classed = stored(in_classes(buckets, replies, model.train_tokens + model.distinct + 1, k, add))
        n = class_bigrams(classed, k, end)
        if share is None or likelihood(n) >= likelihood(model.table) - 1e-6:
            break
        log.warning("own classes of one word in %d lower the likelihood", share)
    if share is None:
        return classed, model
    words_of = model.words_of.copy()
    for r in some.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect():
        words_of[r["cls"]] += r["n"]
    for r in some.mapInArrow(_seeds(seed), "cls int").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect():
        words_of[r["cls"]] -= r["n"]
    return classed, _model(model.units, model.of, n, words_of, add, prior, model.train_tokens, model.distinct, True)


def _seeds(seed: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The class that each word has in the seed model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(seed.value.classes(batch.column("word").to_pylist()).astype(np.int32))], ["cls"])
    return run


def score(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, **settings) -> DataFrame:
    """``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigram, add one) and ``score`` (the class model), both log10,
    of every row; the model learns from the rows for which ``training`` holds."""
    context = docs.sparkSession.sparkContext
    buckets = stored(coded(docs, training, id_col=id_col, text_col=text_col, bucket_bytes=bucket_bytes))
    totals = stored(word_rows(buckets).groupBy("word").agg(F.sum("n").alias("c")))
    seed = context.broadcast(fit(buckets, totals, **settings))  # frequent words and class tables: a fixed size
    own = stored(moved(buckets, seed))
    classed, model = refine(buckets, totals, own, seed, **{x: v for x, v in settings.items() if x in ("add", "prior")})
    k, end = len(model.table), int(model.classes([END])[0])
    shared = context.broadcast((model.transition, np.log10(model.places), model.train_tokens))
    small = np.uint8 if k <= 256 else np.uint16
    schema = T.StructType([T.StructField("id", classed.schema["ids"].dataType.elementType)])
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, places, train_tokens = shared.value
        for batch in batches:
            kind = batch.column("ids").type.value_type
            for row in batch.to_pylist():
                n = np.array(row["n"], np.int64)
                now = unpacked(row["cls"], int(n.sum()), small).astype(np.int64)
                before = np.concatenate([[end], now[:-1]])  # every text ends with the end token, and begins after one
                steps = np.add.reduceat(transition[before, now] - places[now], np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kind), pa.array(n), pa.array(row["known"], pa.int64()), pa.array(np.full(len(n), train_tokens, np.int64)),
                                                  pa.array(row["base"], pa.float64()), pa.array(steps + np.array(row["emit"]))], schema.names)

    return classed.select("ids", "n", "known", "base", "emit", "cls").mapInArrow(run, schema)


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """One row: perplexity over all tokens of ``scored``."""
    return scored.agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))
