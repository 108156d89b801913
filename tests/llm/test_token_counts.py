"""Token counts against the tokenizers library on whole texts."""
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from depotlens.llm.queries import op13_token_counts, vocabulary
from depotlens.llm.token_counts import PIECES, Counter, may_split, split, token_counts
from llm_cases import awkward, awkward_rows, empty

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SMALL = Counter(PATH, split_chars=3, batch_bytes=20, memo_pieces=50)


def size(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


PARTS = st.one_of(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t ", " ", "　", "'s", "'LL", "a1", "1a", "don't", "_ _", "é", "ß9", "你好", "\U0001f600", "‍", "\x1c", "\x85"]),
                  st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=4))


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=30))
def test_split_texts_count_like_whole_ones(parts):
    text = "".join(parts)
    assert "".join(split(text, 3)) == text and "".join(PIECES.findall(text)) == text
    assert SMALL.counts([text, None, text]).tolist() == [size(text), 0, size(text)]


def test_long_pieces_are_cut():
    pieces = split("abc123" * 5000, 1000)
    assert len(pieces) > 20 and max(map(len, pieces)) < 1010
    assert len(split("x" * 5000, 1000)) == 1
    long = "abc123,你好" * 40_000
    assert Counter(PATH).counts([long, long + " x"]).tolist() == [size(long), size(long + " x")]


def test_other_vocabularies_stay_whole():
    assert may_split(json.load(open(PATH, encoding="utf-8")))
    plain = {"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}, "normalizer": None, "post_processor": None, "added_tokens": []}
    token = {"content": "<a b>", "lstrip": False, "rstrip": False, "single_word": False}
    assert may_split(plain)
    for change in ({"pre_tokenizer": None}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{**token, "content": "a1"}]}, {"added_tokens": [{**token, "content": "<a>", "lstrip": True}]}):
        assert not may_split({**plain, **change})


def test_counts_of_a_table(spark):
    got = token_counts(awkward(spark), PATH, limit=20, split_chars=50, batch_bytes=500).collect()
    want = [(i, len((t or "").encode()), size(t), size(t) > 20) for i, t in awkward_rows()]
    assert sorted(((r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=repr) == sorted(want, key=repr)
    assert token_counts(empty(spark), PATH).count() == 0


def test_query_equals_library(spark, tmp_path):
    rng = random.Random(1)
    rows = awkward_rows() + [(500, " ".join(rng.choice(["the", "token's", "123", "<|endoftext|>", "ärger"]) for _ in range(60_000)))]
    awkward(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_token_counts(spark, str(tmp_path)).collect()
    want = [(i, len((t or "").encode()), size(t), size(t) > 1024) for i, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=repr) == sorted(want, key=repr)
