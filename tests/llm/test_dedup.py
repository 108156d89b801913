"""Substring, line and near dedup against plain models."""
import collections

import numpy as np
import pytest

from depotlens.llm.line_dedup import line_dedup
from depotlens.llm.near_dedup import Signature, _likely, near_duplicates, shingle_sets, similar, sketch
from depotlens.llm.substring_dedup import _ranges, substring_dedup
from llm_cases import CLASHES, LOWER, awkward, awkward_rows, components_model, empty, phrase, words

BLANK = " \t\n\x0b\x0c\r"


def substring_model(rows, window):
    count, split = collections.Counter(), [words(t) for _, t in rows]
    for w in split:
        count.update(tuple(w[k:k + window]) for k in range(len(w) - window + 1))
    out = []
    for (i, t), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, t, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("settings", [{}, {"bucket_bytes": 9000, "shard_windows": 900}, {"window": 3, "depth": 1, "bucket_bytes": 20000}])
def test_substrings_equal_model(spark, settings):
    got = [(r.id, r.text, r.n_words, r.n_removed, r.kept) for r in substring_dedup(awkward(spark), **settings).collect()]
    assert sorted(got, key=repr) == substring_model(awkward_rows(), settings.get("window", 35))


def test_substring_rest_and_empty(spark):
    assert substring_dedup(awkward(spark)).select("rest.*").columns == list(CLASHES)
    assert substring_dedup(empty(spark)).count() == 0


def test_ranges_follow_the_entries():
    assert _ranges(np.array([2, 2, 7, 1 << 40], np.uint64)) == [(2, 0, 2), (7, 2, 3), (1 << 40, 3, 4)]
    assert _ranges(np.empty(0, np.uint64)) == []


def line_model(rows, chars=40, least=5, in_order=False):
    def key(line):
        return line.strip(BLANK).translate(LOWER)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    keeper = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items() if len(v) >= least}
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(all_), len(all_) - len(left), "\n".join(left)))
    return out if in_order else sorted(out, key=repr)


@pytest.mark.parametrize("task_bytes", [64 << 20, 4000])
def test_lines_equal_model(spark, task_bytes):
    got = [(r.id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup(awkward(spark), task_bytes=task_bytes).collect()]
    want = line_model(awkward_rows())
    assert sorted(got, key=repr) == want and sum(x[2] for x in want) > 10


def test_one_line_in_most_documents_spans_tasks(spark):
    line = "a line that nearly every document of this table holds, word for word"
    rows = [(k, f"{line}\nown {k}" if k % 10 else f"nothing {k}") for k in range(600)]
    got = [(r.id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup(awkward(spark, rows), task_bytes=1500).collect()]
    assert sorted(got, key=repr) == line_model(rows)


def test_edges_of_at_most_max_tasks(spark, monkeypatch):
    from depotlens.llm import line_dedup as module
    monkeypatch.setattr(module, "MAX_TASKS", 3)
    lines = module.keep_bitmaps(awkward(spark), task_bytes=100)
    got = [(r.id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup(awkward(spark), task_bytes=100).collect()]
    assert sorted(got, key=repr) == line_model(awkward_rows()) and lines.count() > 0


def test_lines_empty(spark):
    assert line_dedup(empty(spark)).count() == 0


def near_rows():
    """A chain whose ends are not similar, families around bases, and look-alikes that no star centre links."""
    rows = awkward_rows()
    for k in range(30):  # a chain: neighbours similar, ends not
        rows.append((1000 + k, " ".join(phrase(20, 300)[k * 6:k * 6 + 120])))
    for f in range(4):  # families of edited copies
        base = phrase(30 + f, 150)
        for k in range(12):
            edited = list(base)
            for j in range(k % 4):
                edited[(13 * j + 31 * k) % 150] = f"edit{f}{k}{j}"
            rows.append((2000 + 100 * f + k, " ".join(edited)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_model(spark, percent):
    rows = near_rows()
    want = components_model(rows, percent)
    got = near_duplicates(awkward(spark, rows), percent=percent, block=4).collect()
    assert len(got) == len(rows)
    by_id = {r.id: r for r in got if r.id is not None}
    assert {i: r.component_id for i, r in by_id.items()} == {i: c for i, c in want.items() if not isinstance(i, tuple)}
    assert all(r.kept == (r.id == r.component_id) for r in by_id.values())
    nameless = sorted((r.n_shingles, r.component_id or -1, r.kept) for r in got if r.id is None)
    assert nameless == [(0, -1, True), (56, 6, False)]  # one equals document 6, one has no text
    assert near_duplicates(empty(spark)).count() == 0


def test_densified_signature_estimates_similarity():
    signature = Signature(32, 4)
    rng = np.random.default_rng(0)
    for size in (3, 20, 400):
        agree = []
        for _ in range(60):
            both = np.sort(rng.integers(0, 2**63, 2 * size).astype(np.uint64))
            pick = rng.permutation(2 * size)
            x, y = np.sort(both[pick[:int(1.6 * size)]]), np.sort(both[pick[int(0.4 * size):]])
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            agree.append(float((signature.values(x) == signature.values(y)).mean()) - true)
        assert abs(np.mean(agree)) < 0.06


def test_sketches_let_similar_pairs_through():
    """Pairs just at the threshold pass the sketch; far ones mostly do not."""
    rng = np.random.default_rng(3)
    for size in (5, 40, 300, 3000):
        passed = {85: 0, 60: 0}
        for percent in passed:
            for _ in range(200):
                union = rng.choice(2**62, size, replace=False).astype(np.uint64) * np.uint64(3)
                common = -(-size * percent // 100)
                rest = union[common:]
                half = rng.random(len(rest)) < 0.5
                x, y = np.sort(np.concatenate([union[:common], rest[half]])), np.sort(np.concatenate([union[:common], rest[~half]]))
                passed[percent] += bool(_likely(sketch(x), len(x), sketch(y)[None], np.array([len(y)]), 85)[0])
        assert passed[85] == 200 and (size < 40 or passed[60] < 10)


def test_similarity_threshold_is_exact():
    a, b = np.arange(100, dtype=np.uint64), np.arange(15, 100, dtype=np.uint64)
    assert similar(a, b, 85) and not similar(a, b[1:], 85) and not similar(a[:0], a[:0], 85)
    assert [len(s) for _, s in shingle_sets([None, b"A b", b"a B c d e f", b"a b c d e a b c d e"])] == [0, 1, 2, 5]
