"""Spelling variants: the composition against all pairs, counts and groups against a plain model."""
import collections
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depotlens.llm import spelling
from llm_cases import awkward, awkward_rows, empty

LOWER = {i: i + 32 for i in range(65, 91)}


def near(x, y):
    """Whether one code point was inserted, deleted or replaced."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = (x, y) if len(x) > len(y) else (y, x)
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1:] == y for i in range(len(x)))


def all_near(words):
    return {(x, y) for x in words for y in words if x < y and near(x, y)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé", max_size=7), max_size=25, unique=True), st.text(alphabet="ab", max_size=3), st.text(alphabet="ab", max_size=3))
def test_composition_gives_every_pair_once(middles, front, back):
    states = spelling.Acceptors()
    words = sorted(front + m + back for m in middles)
    start = states.add(words)
    replaced = [(x, y) for x, y, _ in states.edits(start, start, True)]
    deleted = [(x, y) for x, y, _ in states.edits(start, start, False)]
    assert len(set(replaced + deleted)) == len(replaced + deleted)
    assert {tuple(sorted(p)) for p in replaced + deleted} == all_near(words)


def test_acceptor_is_minimal():
    states = spelling.Acceptors()
    start = states.add(sorted(f"{a}{b}ing" for a in "abcdefgh" for b in "stuvw"))
    assert len(states.arcs) == 6 and len(states.arcs[start]) == 8
    assert states.add(sorted(f"{a}{b}ing" for a in "abcdefgh" for b in "stuvw")) == start  # equal languages are one state


def slipped(doc_id, run):
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run


def model(rows, least=7, count=2, factor=10):
    n = collections.Counter()
    for i, t in rows:
        n.update(w for w in (slipped(i, r) for r in re.findall("[a-zÀ-ÿ]+", (t or "").translate(LOWER))) if len(w) >= least)
    n = {w: k for w, k in n.items() if k >= count}
    partners = collections.defaultdict(list)
    for x, y in all_near(n):
        partners[x].append(y)
        partners[y].append(x)
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= factor * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(partners[w]), n.get(form.get(w))) for w in n), key=repr)


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def variants(seed, n_docs=60):
    """Texts over few stems with slips: ties, chains of forms, words with many near words, long words with common beginnings."""
    rng = random.Random(seed)
    stems = ["ananable", "annanable", "überstand", "überstände", "zzzzzzz", "zzzzzzzz", "interlinked" * 3, "interlinker" * 3, "counted", "Éclairez"]
    out = []
    for k in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[:rng.randint(1, len(stems))])
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aézu") + w[at:], w[:at] + rng.choice("aéz") + w[at + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((k if k % 9 else None, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    return out


@pytest.mark.parametrize("most", [3, 40, 1 << 20])
def test_groups_equal_model(spark, most):
    rows = variants(5)
    got = spelling.spelling_variants(awkward(spark, rows), most=most, words_per_task=50)
    want = model(rows)
    assert any(f and f != r for _, f, r, *_ in want) or any(f for _, f, *_ in want)
    assert rows_of(got) == want


def test_chains_of_forms(spark):
    words = [("counted", 20_000), ("countes", 2000), ("counteses", 3), ("countese", 200), ("countxse", 20), ("kountxse", 2), ("lonely", 9)]
    vocabulary = spark.createDataFrame(words, "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.variant_groups(vocabulary).collect()}
    assert got == {"counted": (None, "counted"), "countes": ("counted", "counted"), "countese": ("countes", "counted"), "countxse": ("countese", "counted"),
                   "counteses": ("countese", "counted"), "kountxse": ("countxse", "counted"), "lonely": (None, "lonely")}


def test_hot_beginning_is_split(spark):
    """Thousands of words that share their first letters: no part holds more than the bound, and no pair is lost."""
    rng = random.Random(8)
    words = list({"common" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 10))) for _ in range(1500)})
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_words(vocabulary, most=64).collect()}
    want = {(w, v) for w in words for i in range(len(w)) for v in (w[:i] + w[i + 1:], w[:i] + ("a" if w[i] == "b" else "b") + w[i + 1:]) if v in set(words) and v != w}
    assert got == want | {(y, x) for x, y in want}


def test_very_long_words(spark):
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(300_000))
    words = [long, long[:150_000] + "z" + long[150_000:], long[:7] + "z" + long[8:], long + "a", "a" * 20_000, "a" * 20_001]
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {(words.index(r.word), words.index(r.other)) for r in spelling.near_words(vocabulary).collect()}
    assert got == {(0, 1), (1, 0), (0, 2), (2, 0), (0, 3), (3, 0), (4, 5), (5, 4)}


def test_awkward_rows_and_empty(spark):
    assert rows_of(spelling.spelling_variants(awkward(spark))) == model(awkward_rows())
    assert spelling.spelling_variants(empty(spark)).count() == 0
