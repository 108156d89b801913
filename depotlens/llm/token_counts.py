"""Token counts: whole texts through the tokenizers library, lengths only.

Texts are cut at safe boundaries into pieces, short and long texts alike.  A worker remembers the lengths of pieces; those it has not met are encoded in
batches of about ``batch_bytes`` of text, so one batch costs the same memory whatever the texts are.  A text's count is the sum over its pieces.  Only counts leave a task.

*Safe boundaries.*  A byte-level vocabulary splits a text by its pattern before any merge.  In that pattern white space only
begins a match or fills a whole one, so a match ends wherever white space follows another character; and a letter never
shares a match with a digit, where pieces longer than ``split_chars`` are cut as well.  A cut there changes no match on either side.  None falls into
a special token, which is checked, as is the kind of vocabulary; with any other kind texts stay whole.  A run without such a place stays whole too, however long.

Defined cases: null text counts as empty: 0 bytes, 0 tokens.  Special strings in a text count as the library counts them by default.
Repeated rows are counted each; null and repeated ids are kept.  Other columns travel in ``rest``.
"""
from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.llm.common import others

#: Text encoded at once, in UTF-8 bytes (the library holds some 100 bytes a token meanwhile), and characters beyond which a piece is cut further.
BATCH_BYTES = 1 << 18
SPLIT_CHARS = 1 << 16
#: Pieces, and their characters together, whose lengths one worker remembers; beyond either it starts again.
MEMO_PIECES = 300_000
MEMO_CHARS = 8 << 20

#: White space of the vocabulary's pattern: Unicode's White_Space.  (``str.isspace`` holds 0x1C-0x1F too.)
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
INNER = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def may_split(spec: dict) -> bool:
    """Whether the boundaries are safe with this vocabulary (its parsed JSON file)."""
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    special = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{SPACE}]", t["content"]) or INNER.search(t["content"])) for t in spec["added_tokens"])
    return bool(plain and special and spec.get("normalizer") is None and spec.get("post_processor") is None)


def split(piece: str, most: int = SPLIT_CHARS) -> list[str]:
    """Parts of ``piece``, each cut at the first place between a letter and a digit at or after ``most`` characters."""
    out, start = [], 0
    while len(piece) - start > most:
        cut = INNER.search(piece, start + most)
        if cut is None:
            break
        out.append(piece[start:cut.start()])
        start = cut.start()
    out.append(piece[start:])
    return out


class _Codes(dict):
    """piece -> code; new pieces are listed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


class Counter:
    """Token counts of texts by one vocabulary file."""

    def __init__(self, path: str, split_chars: int = SPLIT_CHARS, batch_bytes: int = BATCH_BYTES, memo_pieces: int = MEMO_PIECES):
        if not path.endswith(".json"):
            raise ValueError(f"not a vocabulary of the tokenizers library: {path}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        with open(path, encoding="utf-8") as f:
            self._may_split = may_split(json.load(f))
        self._split_chars, self._batch_bytes, self._memo_pieces = split_chars, batch_bytes, memo_pieces
        self._forget()

    def _forget(self) -> None:
        self._codes, self._lengths, self._chars = _Codes(), np.empty(0, np.int64), 0

    def _pieces(self, text: str) -> list[str]:
        if not self._may_split:
            return [text]
        pieces = PIECES.findall(text)
        if len(text) > self._split_chars:
            pieces = [part for piece in pieces for part in (split(piece, self._split_chars) if len(piece) > self._split_chars else (piece,))]
        return pieces

    def _encode(self, pieces: list[str]) -> np.ndarray:
        """Lengths of the pieces, encoded in batches of like size in bytes."""
        out, batch, size = [], [], 0
        for k, piece in enumerate(pieces, 1):
            batch.append(piece)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= self._batch_bytes or k == len(pieces):
                out += map(len, self._library.encode_batch_fast(batch, add_special_tokens=False))
                batch, size = [], 0
        return np.array(out, np.int64)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for start in range(0, len(texts), 64):
            if len(self._codes) > self._memo_pieces or self._chars > MEMO_CHARS:
                self._forget()
            known = self._codes.__getitem__
            codes = [np.fromiter(map(known, pieces), np.int64, len(pieces)) for pieces in (self._pieces(t) if t else [] for t in texts[start:start + 64])]
            new = self._codes.new
            if new:
                self._chars += sum(map(len, new))
                self._lengths = np.concatenate([self._lengths, self._encode(new)])
                new.clear()
            out[start:start + len(codes)] = [self._lengths[c].sum() for c in codes]
        return out


_COUNTERS: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 split_chars: int = SPLIT_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``rest`` (struct of the other columns), ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens)."""
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("id"), others(docs, id_col, text_col).alias("rest"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    schema = T.StructType([f for f in base.schema.fields if f.name != "text"]).add("n_tokens", T.LongType(), False)
    key = (path, split_chars, batch_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(*key)
        for batch in batches:
            counts = _COUNTERS[key].counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "rest", "n_bytes")] + [pa.array(counts)], schema.names)

    return base.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
