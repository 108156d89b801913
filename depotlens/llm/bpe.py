"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

``compile_lexicon`` turns the corpus's most frequent words and their ids into a
minimal acyclic automaton: shared prefixes and shared suffixes are stored once, and
each arc carries the number of words that sort before those reached through it, so
the outputs along a word's path add up to its rank, which addresses its ids.  The automaton is one flat
file; tasks memory-map it and walk all new words of a batch side by side in numpy.
Words it does not hold are merged exactly, pair by pair in rank order.

The lexicon changes speed only, never ids.  Word counts cover all texts; its
size is a parameter (``lexicon_words``).

Defined cases: null or empty text, or white space only: no ids, decoded text empty.  Special-token strings
in a text become their special ids, as the tokenizers library does.  Repeated rows are encoded each.
"""
from __future__ import annotations

import heapq
import json
import mmap
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.common import binary, others, stored
from depotlens.llm.tokens import WordIds, chunks

LEXICON_WORDS = 1 << 17
#: Bytes of a word in the lexicon, at most; longer ones are merged wherever they are met.
LEXICON_BYTES = 64
#: Pieces of words whose ids one Python worker remembers, and their characters together; beyond either the memo starts again.
MEMO_PIECES = 250_000
MEMO_CHARS = 16 << 20
#: Bytes of a piece from which on it is merged by itself with a heap, in n log n steps; shorter ones are merged side by side.
LONG_PIECE = 512


# --- the automaton ---------------------------------------------------------------------------

def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """word -> ids as one flat block: counts, arcs by (state, byte), outputs, final marks, ids by rank."""
    states: dict[tuple, int] = {}
    reached: list[int] = []  # words accepted from a state
    arcs: list[tuple] = []  # of each state: ((byte, target), ...)
    final: list[bool] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = states.get(key)
        if state is None:
            state = states[key] = len(reached)
            reached.append(node[0] + sum(reached[t] for _, t in node[1]))
            arcs.append(key[1])
            final.append(node[0])
        return state

    words = sorted(entries)
    path: list[list] = [[False, []]]  # open nodes from the root on: [is final, arcs]
    last = b""
    for word in words:
        same = 0
        for a, b in zip(last, word):
            if a != b:
                break
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(node)))
    root = freeze(path[0])

    keys, targets, outputs = [], [], []
    for state, own in enumerate(arcs):
        before = int(final[state])
        for byte, target in own:
            keys.append(state * 256 + byte)
            targets.append(target)
            outputs.append(before)
            before += reached[target]
    counts = np.array([len(entries[w]) for w in words], np.int64)
    ids = np.array([i for w in words for i in entries[w]], np.uint32)
    head = np.array([root, len(keys), len(final), len(words), len(ids)], np.int64)
    blocks = [head, np.array(keys, np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
              np.array(targets, np.int32), np.array(outputs, np.int32), ids, np.array(final, np.uint8)]
    return b"".join(b.tobytes() for b in blocks)


class Lexicon:
    """A compiled lexicon over any buffer, such as a memory-mapped file."""

    def __init__(self, buffer):
        self.root, n_arcs, n_states, n_words, n_ids = (int(x) for x in np.frombuffer(buffer, np.int64, 5))
        at = 40

        def block(kind: type, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(buffer, kind, n, at)
            at += out.nbytes
            return out

        self.keys, self.starts = block(np.int64, n_arcs), block(np.int64, n_words + 1)
        self.targets, self.outputs = block(np.int32, n_arcs), block(np.int32, n_arcs)
        self.ids, self.final = block(np.uint32, n_ids), block(np.uint8, n_states)

    @classmethod
    def open(cls, path: str) -> "Lexicon":
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word among the lexicon's words; -1 where it is not one.  All words walk together."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(words), np.uint8)
        state, rank = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        alive = np.arange(n) if len(self.keys) else np.empty(0, np.int64)
        dead = (sizes > 0) & (len(self.keys) == 0)
        for j in range(int(sizes.max(initial=0))):
            alive = alive[sizes[alive] > j]
            if not len(alive):
                break
            key = state[alive] * 256 + text[starts[alive] + j]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            dead[alive[~hit]] = True
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.targets[arc]
            rank[alive] += self.outputs[arc]
        return np.where(~dead & (self.final[state] == 1), rank, -1)


# --- exact merging -----------------------------------------------------------------------------

def byte_characters() -> list[str]:
    """The character that stands for each byte at byte level: itself where printable, else 256 and up in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class _Pairs:
    """(left id, right id) -> merge rank, as a hash table with linear probing; all lookups of a step at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self._mask = np.int64(4 * len(left)).item().bit_length()
        size = 1 << self._mask
        self._keys, self._ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        todo = np.arange(len(left))
        key = self._key(left, right)
        slot = self._slot(key)
        while len(todo):  # of those that want one free slot the first gets it, the others move on
            free = self._keys[slot[todo]] == -1
            _, winner = np.unique(slot[todo], return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[winner] = True
            wins &= free
            got = todo[wins]
            self._keys[slot[got]], self._ranks[slot[got]] = key[got], got
            todo = todo[~wins]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._mask)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        slot = self._slot(key)
        out = np.full(len(key), NONE, np.int32)
        open_ = np.arange(len(key))
        while len(open_):
            there = self._keys[slot]
            hit = there == key[open_]
            out[open_[hit]] = self._ranks[slot[hit]]
            on = ~hit & (there != -1)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self._mask) - 1)
        return out


#: Rank of a pair that no merge joins.
NONE = np.iinfo(np.int32).max


class _Codes(dict):
    """piece (text, or bytes where the word is odd) -> code; a space has code -1."""

    def __init__(self, first: dict[str, int]):
        super().__init__({s: k for k, s in enumerate(first)})
        self.new: list[str | bytes] = []
        self._next = len(first)
        self[" "] = -1

    def __missing__(self, piece: str | bytes) -> int:
        code = self[piece] = self._next
        self._next += 1
        self.new.append(piece)
        return code


class Merger:
    """Ids of words by the vocabulary's own merges; all new pieces of a batch merge side by side."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self._vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([self._vocab[m[k]] for m in merges]) for k in (0, 1))
        self._pairs = _Pairs(left, right)
        self._merged = np.array([self._vocab[a + b] for a, b in merges])
        self._rank_of: dict[int, int] | None = None  # made when the first long piece comes
        characters = byte_characters()
        self._byte_of = {c: b for b, c in enumerate(characters)}
        self._inner = np.array([self._vocab[c] for c in characters])
        self._last = np.array([self._vocab[c + end] for c in characters])
        library = Tokenizer.from_file(path)
        self._normalise, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._split_plain = regex.compile(f"(?:{pattern})| ").findall
        # printable Latin characters, none of which normalising or lower-casing turns into more than one
        self._plain = regex.compile(r"[\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]*").fullmatch
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in self._special) + ")") if self._special else None
        self._forget()

    def _forget(self) -> None:
        self._pieces = _Codes(self._special)  # special tokens have the first codes
        self._chars = 0
        self._flat = np.array(list(self._special.values()), np.uint32)
        self._counts = np.ones(len(self._special), np.int64)

    def tokens(self) -> list[str]:
        """Token text by id."""
        every = {i: t for t, i in self._vocab.items()} | {i: t for t, i in self._special.items()}
        return [every.get(i, "") for i in range(max(every) + 1)]

    def word(self, word: bytes) -> list[int]:
        return self.ids([word])[1].tolist()

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all words one after another).  Words hold no white space."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        if len(self._pieces) > MEMO_PIECES or self._chars > MEMO_CHARS:
            self._forget()
        text = b" ".join(words).decode()
        n, codes = self._plain_codes(text) if self._is_plain(text) else self._mixed_codes(text)
        if self._pieces.new:
            self._chars += sum(map(len, self._pieces.new))
            counts, flat = self._merge([p.encode() if type(p) is str else p for p in self._pieces.new])
            self._pieces.new = []
            self._counts, self._flat = np.concatenate([self._counts, counts]), np.concatenate([self._flat, flat])
        counts = self._counts[codes]
        starts = np.cumsum(self._counts) - self._counts
        ends = np.cumsum(counts)
        take = np.arange(int(counts.sum())) + np.repeat(starts[codes] - (ends - counts), counts)
        return np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]), self._flat[take]

    def _is_plain(self, text: str) -> bool:
        return bool(self._plain(text)) and not ("<" in text and self._cut and self._cut.search(text))

    def _plain_codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of each word, codes of all pieces) of plain words joined by one space."""
        codes = np.fromiter(map(self._pieces.__getitem__, self._split_plain(text.lower())), np.int64)
        gaps = np.flatnonzero(codes == -1)
        n = np.diff(np.concatenate([[-1], gaps, [len(codes)]])) - 1
        return n, codes[codes != -1]

    def _mixed_codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split(" ")
        parts = [self._plain_codes(w)[1] if self._is_plain(w) else np.array(self._odd(w), np.int64) for w in words]
        return np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)

    def _odd(self, word: str) -> list[int]:
        """Codes of one word with the library's own normalising and splitting; special tokens stand for themselves."""
        out = []
        for part in self._cut.split(word) if self._cut else [word]:
            if part in self._special:
                out.append(self._pieces[part])
            elif part:  # byte-level characters back to bytes
                out += [self._pieces[bytes(self._byte_of[c] for c in p)] for p, _ in self._split(self._normalise(part))]
        return out

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self._inner[text]
        symbols[ends - 1] = self._last[text[ends - 1]]
        counts = np.empty(len(pieces), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # (piece, its symbols) in matrices of like width
        width = 8
        low = 0
        for row in np.flatnonzero(sizes > LONG_PIECE):
            merged = self._merge_long(symbols[ends[row] - sizes[row]:ends[row]])
            counts[row] = len(merged)
            done.append((np.array([row]), merged[None, :]))
        sizes = np.where(sizes > LONG_PIECE, 0, sizes)
        while low < sizes.max(initial=0):
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            for part in np.array_split(rows, max(1, len(rows) * width // 1_000_000)):
                if len(part):
                    done.append((part, self._merge_matrix(symbols, ends[part] - sizes[part], sizes[part], counts, part)))
            low, width = width, width * 2
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.uint32)
        for part, matrix in done:
            inside = np.arange(matrix.shape[1]) < counts[part][:, None]
            flat[(starts[part][:, None] + np.arange(matrix.shape[1]))[inside]] = matrix[inside]
        return counts, flat

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Merge one piece: its symbols are a linked list, its pairs a heap by (rank, place); pairs that are gone are passed over when they come up."""
        if self._rank_of is None:
            self._rank_of = dict(zip((self._pairs.left.astype(np.int64) << 32 | self._pairs.right).tolist(), range(len(self._merged))))
        rank_of, merged = self._rank_of, self._merged.tolist()
        n = len(symbols)
        symbol, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._pairs.ranks(symbols[:-1], symbols[1:])
        at = np.flatnonzero(ranks != NONE)
        heap = ((ranks[at].astype(np.int64) << 32) | at).tolist()
        heapq.heapify(heap)
        while heap:
            key = heapq.heappop(heap)
            rank, place = key >> 32, key & 0xFFFFFFFF
            follower = after[place]
            if symbol[place] < 0 or follower >= n or rank_of.get(symbol[place] << 32 | symbol[follower]) != rank:
                continue
            symbol[place], symbol[follower] = merged[rank], -1
            beyond = after[place] = after[follower]
            if beyond < n:
                before[beyond] = place
                new = rank_of.get(symbol[place] << 32 | symbol[beyond])
                if new is not None:
                    heapq.heappush(heap, new << 32 | place)
            ahead = before[place]
            if ahead >= 0:
                new = rank_of.get(symbol[ahead] << 32 | symbol[place])
                if new is not None:
                    heapq.heappush(heap, new << 32 | ahead)
        return np.array([x for x in symbol if x >= 0], np.int64)

    def _merge_matrix(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Merge pieces of like size, a row each: in every step each row joins its leftmost pair of least rank."""
        width = int(sizes.max())
        column = np.arange(width)
        inside = column < sizes[:, None]
        out = np.full((len(part), width + 1), -1, np.int64)
        out[:, :width][inside] = symbols[(starts[:, None] + column)[inside]]
        counts[part] = sizes
        rows = np.flatnonzero(sizes > 1)
        s, n = out[rows], sizes[rows].copy()
        ranks = np.full((len(rows), width), NONE, np.int32)
        pair = column < (n - 1)[:, None]
        at = np.nonzero(pair)
        ranks[at] = self._pairs.ranks(s[at], s[at[0], at[1] + 1])
        while len(rows):
            best = ranks.argmin(1)
            row = np.arange(len(rows))
            rank = ranks[row, best]
            live = rank != NONE
            if not live.all():
                stop = ~live
                out[rows[stop]], counts[part[rows[stop]]] = s[stop], n[stop]
                rows, s, n, ranks, best, rank = rows[live], s[live], n[live], ranks[live], best[live], rank[live]
                row = np.arange(len(rows))
                if not len(rows):
                    break
            # the pair becomes one symbol; what follows moves one place left
            shift = column + (column > best[:, None])
            s[:, :width] = np.take_along_axis(s, shift, 1)
            s[row, best] = self._merged[rank]
            wide = np.concatenate([ranks, np.full((len(rows), 1), NONE, np.int32)], 1)
            ranks = np.take_along_axis(wide, column + (column >= best[:, None]), 1)
            n -= 1
            for k, has in ((best - 1, best > 0), (best, best < n - 1)):
                r = row[has]
                ranks[r, k[has]] = self._pairs.ranks(s[r, k[has]], s[r, k[has] + 1])
            ended = best >= n - 1
            ranks[row[ended], best[ended]] = NONE
        return out


# --- Spark ---------------------------------------------------------------------------------------

def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n) over all whole texts; each batch is counted before the exchange."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(0))
            for part in chunks(texts, 32 << 20):
                seen: Counter = Counter()
                for t in texts[part]:
                    if t:
                        seen.update(t.split())
                if seen:
                    yield pa.record_batch({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})

    return (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words, at most ``lexicon_words``, and hand the file to all executors; returns its name.

    A table of how many words have each count says down to which count all words find room; of the next count's words a share by a hash fills it up.
    """
    counts = stored(word_counts(docs, text_col).where(F.octet_length("word") <= LEXICON_BYTES))
    chosen, total = F.lit(False), 0
    for n, words in counts.groupBy("n").agg(F.count("*")).orderBy(F.desc("n")).limit(lexicon_words).collect():
        room = lexicon_words - total
        if words > room:
            chosen = chosen | ((F.col("n") == n) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(room / words * (1 << 30))))
            break
        chosen = chosen | (F.col("n") == n) if total == 0 else F.col("n") >= n
        total += words
    top = counts.where(chosen).select("word").limit(lexicon_words).toArrow()
    merger = Merger(path)
    words = top["word"].to_pylist()
    counts, flat = merger.ids(words)
    block = compile_lexicon(dict(zip(words, (x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])))) if words else {})
    name = f"depotlens-lexicon-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(prefix="depotlens-lexicon-"), name)
    with open(local, "wb") as f:
        f.write(block)
    docs.sparkSession.sparkContext.addFile(local)
    return name


_CODERS: dict[tuple[str, str | None], Any] = {}


def merged_ids(path: str) -> WordIds:
    """Ids without a lexicon: every new word is merged.  One memo per worker process."""
    if (path, None) not in _CODERS:
        _CODERS[path, None] = WordIds(Merger(path).ids)
    return _CODERS[path, None]


def _coder(path: str, lexicon: str) -> tuple[WordIds, pa.Array]:
    """The memo of one worker process over the mapped lexicon, and the tokens' texts."""
    if (path, lexicon) not in _CODERS:
        mapped, merger = Lexicon.open(SparkFiles.get(lexicon)), Merger(path)

        def resolve(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ranks = mapped.ranks(words)
            known = ranks >= 0
            counts = np.zeros(len(words), np.int64)
            counts[known] = np.diff(mapped.starts)[ranks[known]]
            counts[~known], merged = merger.ids([w for w, k in zip(words, known.tolist()) if not k])
            flat = np.empty(int(counts.sum()), np.uint32)
            of_known = np.repeat(known, counts)
            ends = np.cumsum(counts[known])
            flat[of_known] = mapped.ids[np.arange(int(counts[known].sum())) + np.repeat(mapped.starts[ranks[known]] - (ends - counts[known]), counts[known])]
            flat[~of_known] = merged
            return counts, flat

        _CODERS[path, lexicon] = WordIds(resolve), pa.array(merger.tokens())
    return _CODERS[path, lexicon]


def decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """Texts of lists of ids: the tokens' texts joined by one space; null decodes to empty text."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), tokens.take(ids.flatten()))
    return pc.binary_join(lists, " ")


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS,
           and_decode: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``rest`` (struct of the other columns), ``ids`` (array of int), and with
    ``and_decode`` also ``decoded``, in the same pass (a second one would hold a second Python worker a task)."""
    lexicon = build_lexicon(docs, path, text_col, lexicon_words)
    base = docs.select(F.col(id_col).alias("id"), others(docs, id_col, text_col).alias("rest"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([f for f in base.schema.fields if f.name != "text"]).add("ids", T.ArrayType(T.IntegerType(), False), False)
    if and_decode:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tokens = _coder(path, lexicon)
        for batch in batches:
            texts = binary(batch.column("text"))
            for part in chunks(texts):
                flat, n = coder.ids(texts[part])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(flat.view(np.int32)))
                rows = batch.slice(part.start, part.stop - part.start)
                columns = [rows.column("id"), rows.column("rest"), lists] + ([decoded(lists, tokens)] if and_decode else [])
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return base.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with a last column ``decoded``: the tokens' texts joined by one space; null ids decode to empty text."""
    schema = T.StructType(list(df.schema.fields)).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(Merger(path).tokens())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*rows.columns, decoded(rows.column(ids_col), tokens)], [*rows.schema.names, "decoded"])

    return df.mapInArrow(run, schema)
