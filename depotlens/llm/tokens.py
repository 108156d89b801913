"""Texts to token ids, word by word.

With this vocabulary no token spans a space or 0x09-0x0D and no normalising step reaches across one,
so a text's ids are its words' ids in order.  Special-token strings hold no such byte either.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words whose ids one Python worker remembers; beyond it the memo starts again.
MEMO_WORDS = 300_000
#: Bytes of those words together, at most.
MEMO_BYTES = 32 << 20


class WordIds(dict):
    """word (bytes) -> code; the ids of code c are ``flat[at[c]:at[c + 1]]``.

    Words new in a batch get codes at once and ids together, from ``resolve(words) -> (counts, ids)``.
    """

    def __init__(self, resolve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], memo_words: int = MEMO_WORDS):
        super().__init__()
        self._resolve, self._memo_words = resolve, memo_words
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self._new: list[bytes] = []
        self._bytes = 0
        self._counts = np.empty(0, np.int64)
        self._starts = np.empty(0, np.int64)
        self._flat = np.empty(0, np.uint32)

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self._new.append(word)
        return code

    def ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if len(self) > self._memo_words or self._bytes > MEMO_BYTES:
            self._forget()
        words = [t.split() if t else [] for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.empty(int(n.sum()), np.int64)
        at = 0
        for w in words:
            codes[at:at + len(w)] = np.fromiter(map(self.__getitem__, w), np.int64, len(w))
            at += len(w)
        if self._new:
            self._bytes += sum(map(len, self._new))
            counts, flat = self._resolve(self._new)
            self._new = []
            self._counts = np.concatenate([self._counts, counts])
            self._flat = np.concatenate([self._flat, flat])
            self._starts = np.cumsum(self._counts) - self._counts
        sizes = self._counts[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self._starts[codes] - (ends - sizes), sizes)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        return self._flat[take], np.diff(bounds)


def chunks(texts: list[bytes | None], most: int = 2 << 20) -> list[slice]:
    """Runs of texts of about ``most`` bytes: bounds what is held at once."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            out.append(slice(start, i + 1))
            start, size = i + 1, 0
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out
