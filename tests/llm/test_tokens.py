"""Transducer lexicon, exact merging, and packing against the tokenizers library and plain models."""
import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from depotlens.llm import bpe
from depotlens.llm.bpe import Lexicon, Merger, compile_lexicon, decode, encode
from depotlens.llm.packing import OpenBins, pack, token_pieces
from depotlens.llm.queries import vocabulary
from llm_cases import awkward, awkward_rows, empty

PATH = vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
MERGER = Merger(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAeE'st09 \t\n!<|>_İΣßé́ \x1c\x85\x00"), st.characters(exclude_categories=["Cs"])), max_size=25))
def test_merging_equals_library(text):
    assert MERGER.ids(text.encode().split())[1].tolist() == ids(text)


def test_special_tokens_and_long_words():
    for text in ("<|startoftext|>a<|endoftext|>b", "<|STARTOFTEXT|>", "a" * 5000, "it's I'LL don't", "ab" * 700 + "!" * 99, "é" * 300):
        assert MERGER.ids(text.encode().split())[1].tolist() == ids(text)


def test_a_megabyte_without_a_space():
    rng = random.Random(4)
    for word in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20)), "ab" * 300_000, "é" * 200_000, "aaab" * 50_000 + "c", "x" * 513):
        assert MERGER.ids([word.encode()])[1].tolist() == ids(word)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abelnorstu", min_size=1, max_size=60))
def test_heap_equals_matrix(word):
    symbols = np.array([MERGER._inner[b] for b in word.encode()])
    symbols[-1] = MERGER._last[word.encode()[-1]]
    assert MERGER._merge_long(symbols).tolist() == MERGER.ids([word.encode()])[1].tolist()


def test_lexicon_is_filled_where_all_words_are_equally_common(spark, monkeypatch):
    held = []
    monkeypatch.setattr(bpe, "compile_lexicon", lambda entries: held.append(entries) or compile_lexicon(entries))
    docs = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(1000)) + " " + "y" * 5000)], "doc_id long, text string")
    got = encode(docs, PATH, lexicon_words=100).first()
    assert 60 < len(held[0]) <= 100 and max(map(len, held[0])) <= bpe.LEXICON_BYTES
    assert list(got.ids) == ids(docs.first().text)
    encode(docs.union(spark.createDataFrame([(2, "word1 word1 word2")], docs.schema)), PATH, lexicon_words=50)
    assert {b"word1", b"word2"} <= held[1].keys() and 20 < len(held[1]) <= 50


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.binary(min_size=0, max_size=6), st.lists(st.integers(0, 49_407), min_size=1, max_size=4), max_size=40), st.binary(max_size=7))
def test_transducer_gives_each_word_its_ids(entries, other):
    lexicon = Lexicon(compile_lexicon(entries))
    asked = [*entries, other]
    for word, rank in zip(asked, lexicon.ranks(asked).tolist()):
        if word in entries:
            assert lexicon.ids[lexicon.starts[rank]:lexicon.starts[rank + 1]].tolist() == entries[word]
        else:
            assert rank == -1


def test_transducer_shares_prefixes_and_suffixes():
    entries = {f"{a}{b}ing".encode(): [1] for a in "abcdefgh" for b in "stuvw"}
    lexicon = Lexicon(compile_lexicon(entries))
    assert len(lexicon.final) == 6  # root, one state after each of the two letters, and i, n, g
    assert len(lexicon.keys) == 8 + 5 + 3


@pytest.mark.parametrize("lexicon_words", [0, 7, 1000])
def test_encode_and_decode(spark, lexicon_words):
    got = encode(awkward(spark), PATH, lexicon_words=lexicon_words, and_decode=True).collect()
    want = [(i, ids(t), LIBRARY.decode(ids(t), skip_special_tokens=False)) for i, t in awkward_rows()]
    assert sorted(((r.id, list(r.ids), r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    again = decode(encode(awkward(spark), PATH, lexicon_words=7).select("id", "ids"), PATH).collect()
    assert sorted(((r.id, r.decoded) for r in again), key=repr) == sorted(((i, d) for i, _, d in want), key=repr)


def test_encode_empty(spark):
    assert encode(empty(spark), PATH, and_decode=True).count() == 0


def places_are_gapless(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity,per_task", [(4096, 32768), (64, 5)])
def test_pieces_and_places(spark, capacity, per_task):
    pieces = token_pieces(awkward(spark), PATH, capacity=capacity, with_ids=True)
    got = pack(pieces, capacity=capacity, pieces_per_task=per_task, open_bins=8, merge_tasks=4).collect()
    want = []
    for i, t in awkward_rows():
        own = ids(t) + [1]
        for k, a in enumerate(range(0, len(own), capacity)):
            p = own[a:a + capacity]
            want.append((i, k, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), p))
    assert sorted(((r.id, r.piece, r.start, r.length, r.ids_crc32, list(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    places_are_gapless(got, capacity)


def test_batches_do_not_change_places(spark):
    rows = spark.createDataFrame([(k, 0, 1 + k * 37 % 90) for k in range(700)], "id long, piece int, length long").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    for n in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            found.append(sorted(map(tuple, pack(rows, capacity=100, open_bins=6, pieces_per_task=200, merge_tasks=2).collect())))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1] and len(found[0]) == 700


def test_packing_is_tight(spark):
    random.seed(4)
    lengths = [min(4096, int(random.paretovariate(0.9) * 60)) for _ in range(6000)]
    rows = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "id long, piece int, length long")
    n = places_are_gapless(pack(rows, pieces_per_task=400).collect(), 4096)
    assert n <= 1.01 * -(-sum(lengths) // 4096) + 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.integers(1, 5))
def test_best_fit_model(lengths, most):
    bins, model, used = OpenBins(16, most), [], []
    for n in lengths:
        free = [16 - used[b] for b in model]
        fits = [f for f in free if f >= n]
        b, offset = bins.put(n)
        if fits:
            assert b in model and 16 - used[b] == min(fits)  # the fullest that fits
        else:
            if len(model) == most:
                closing = min(free)
                model.remove(next(x for x in reversed(model) if 16 - used[x] == closing))
            assert b == len(used) and offset == 0
            used.append(0)
            model.append(b)
        assert offset == used[b]
        used[b] += n
        model = [x for x in model if x != b] + ([b] if used[b] < 16 else [])
    assert bins.used == used and len(bins.open()) <= most


def test_pack_empty(spark):
    assert pack(token_pieces(empty(spark), PATH)).count() == 0
