"""Classifiers by held-out accuracy, the language model against its formulas, top-k and quality rules against brute force."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from depotlens.llm import brown_lm, quality_fm, quality_rules, toxicity
from depotlens.llm.labelled import fold, labelled_sample
from depotlens.llm.topk import top_k
from llm_cases import awkward, awkward_rows, empty, words
from pyspark.sql import functions as F

SYLLABLES = ["ba", "do", "ki", "lu", "me", "no", "ra", "su", "ti", "ve"]


def prose(rng, n):
    return [("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))) for _ in range(n)]


def toxic_corpus(rng, n):
    out = []
    for k in range(n):
        text = prose(rng, rng.randint(3, 300))
        bad = k % 4 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                word = rng.choice(["grumpfling", "snozzwick", "wretchard"]) + rng.choice(["", "s", "ed", "ish", "er"])
                at = rng.randrange(len(word))
                text.insert(rng.randrange(len(text) + 1), word[:at] + rng.choice("xyz") + word[at + 1:] if rng.random() < 0.4 else word)
        out.append((" ".join(text), int(bad)))
    return out


def test_toxicity_finds_misspellings():
    rng = random.Random(3)
    corpus = toxic_corpus(rng, 2400)
    model = toxicity.train([t.encode() for t, _ in corpus[:1800]], [y for _, y in corpus[:1800]], epochs=10)
    scores = toxicity._Scorer(model).scores([t.encode() for t, _ in corpus[1800:]])
    y = np.array([v for _, v in corpus[1800:]])
    assert ((scores >= toxicity.THRESHOLD) == (y == 1)).mean() > 0.97
    assert toxicity._Scorer(model).scores([b"ba do grumpflyng ki"])[0] > 0.7 > toxicity._Scorer(model).scores([b"ba do ki"])[0]


def test_first_epoch_sees_words_late_in_texts():
    rng, late = random.Random(12), [["plovence", "quarthin", "tuffeny", "yazzwope"], ["grumpfling", "snozzwick", "wretchard", "hrumphtag"]]
    corpus = [(" ".join(prose(rng, 250) + late[k % 2] * 5), k % 2) for k in range(400)]
    model = toxicity.train([t.encode() for t, _ in corpus], [y for _, y in corpus], epochs=1)
    clean, bad = (toxicity._Scorer(model).scores([w.encode() for w in words]) for words in late)
    assert bad.min() > clean.max() + 0.05


def test_worst_places_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    n_words = rng.integers(0, 40, 200)
    doc_words, per_word = rng.integers(0, 50, n_words.sum()), rng.normal(size=50)
    _, first, size = toxicity.worst_bags(per_word[doc_words], n_words)
    monkeypatch.setattr(toxicity, "PART_WORDS", 100)
    at, n = toxicity.worst_places(per_word, doc_words, n_words, toxicity.SPAN)
    assert n.tolist() == size.tolist() and at[n > 0].tolist() == first[size > 0].tolist()


def test_subwords_and_bags():
    gram, n = toxicity.subwords([b"ab", b"abcdef", "é".encode()])
    assert n.tolist() == [4, 19, 4] and len(gram) == 27  # <ab>: two 3-grams, one 4-gram and the word itself
    values = np.array([1.0, 5, 3, 0, 0, 9, 9])
    best, first, size = toxicity.worst_bags(values, np.array([3, 0, 4]), 2)
    assert best.tolist() == [4, 0, 9] and first.tolist()[0::2] == [1, 5] and size.tolist() == [2, 0, 2]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_on_awkward_rows(spark):
    labels = labels_of(spark, [(i, k % 2, k % 2) for k, (i, _) in enumerate(awkward_rows())] + [(None, 1, 1), (1, None, None)])
    docs = awkward(spark)
    out = toxicity.score(docs, toxicity.fit(docs, labels, epochs=2)).collect()
    assert len(out) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in out)
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.score == 0 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(empty(spark), none).count() == 0


def test_sample_leaves_the_held_out_fold(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(300)], "doc_id long, text string")
    labels = labels_of(spark, [(k, k % 2, 0) for k in range(300)])
    sample = labelled_sample(docs, labels, "quality", rows=60)
    ids = [int(t.split()[1]) for t, _ in sample]
    assert len(ids) == 60 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert sorted(v for _, v in sample) == [0] * 30 + [1] * 30
    flags = {r.doc_id: r.f for r in docs.select("doc_id", fold("doc_id", 3, 1).alias("f")).collect()}
    assert all(f == (zlib.crc32(str(i).encode()) % 3 == 1) for i, f in flags.items())


def test_sample_holds_whole_texts(spark):
    rows = [(k, f"text {k} " + "x" * 39_990 + f" end {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, [(k, k % 2, 0) for k in range(40)])
    whole = {t.encode() for _, t in rows}
    sample = labelled_sample(docs, labels, "quality")
    assert len(sample) > 20 and all(t in whole for t, _ in sample)
    few = labelled_sample(docs, labels, "quality", total_bytes=200_000)  # fewer rows, not shorter ones
    assert sorted(v for _, v in few) == [0] * 3 + [1] * 3 and all(t in whole for t, _ in few)
    one = labelled_sample(docs, labels, "quality", total_bytes=2)
    assert sorted(v for _, v in one) == [0, 1] and all(t in whole for t, _ in one)


def test_sample_takes_one_text_of_a_repeated_id(spark):
    rows = [(0, f"copy {k % 30}", k % 30) for k in range(300)] + [(k, f"text {k}", k) for k in range(1, 40)] + [(50, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    labels = labels_of(spark, [(k, k % 2, 0) for k in range(40)] + [(50, 0, 0)])
    samples = [labelled_sample(docs.repartition(n), labels, "quality", folds=1, extra=("n_chars",)) for n in (1, 5)]
    assert samples[0] == samples[1] and len(samples[0]) == 41
    assert all(t == b"" and c is None or int(t.split()[1]) == c for t, _, c in samples[0])


def test_quality_machine_learns_structure():
    rng = random.Random(5)
    corpus = []
    for k in range(1500):
        text, bad = prose(rng, rng.randint(30, 200)), k % 3 == 0
        if bad:
            kind = rng.randrange(3)
            text = [w for w in text[:12] for _ in range(9)] if kind == 0 else [w.upper() + "!!" for w in text] if kind == 1 else [x for w in text for x in (w, "|")]
        corpus.append((" ".join(text), int(not bad)))
    model = quality_fm.train([t.encode() for t, _ in corpus[:1000]], [len(t) for t, _ in corpus[:1000]], [y for _, y in corpus[:1000]], epochs=6)
    scores = model.scores([t.encode() for t, _ in corpus[1000:]], [len(t) for t, _ in corpus[1000:]])
    assert ((scores >= 0.5) == np.array([y == 1 for _, y in corpus[1000:]])).mean() > 0.98


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    w, v, x = rng.normal(size=9), rng.normal(size=(9, 4)), rng.normal(size=9)
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(9) for j in range(i))
    y, _ = quality_fm._forward(0.3, w, v, x, np.array([0]))
    assert abs(y[0] - (0.3 + w @ x + pairs)) < 1e-9


def test_quality_on_awkward_rows(spark):
    docs, labels = awkward(spark), labels_of(spark, [(i, k % 2, 0) for k, (i, _) in enumerate(awkward_rows())])
    out = quality_fm.score(docs, quality_fm.fit(docs, labels, epochs=2)).collect()
    assert len(out) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0.5 for r in quality_fm.score(docs, quality_fm.fit(docs, labels.limit(0))).collect())
    assert quality_fm.score(empty(spark), quality_fm.fit(docs, labels.limit(0))).count() == 0


# --- language model

def test_exchange_raises_likelihood_and_finds_classes():
    rng = np.random.default_rng(2)
    true = np.arange(30) % 3  # three languages; a text seldom changes its own
    seq = [0]
    for _ in range(20_000):
        seq.append(int(rng.choice(np.flatnonzero(true == true[seq[-1]]) if rng.random() < 0.95 else np.arange(30))))
    bigrams = np.zeros((30, 30))
    np.add.at(bigrams, (seq[:-1], seq[1:]), 1)

    def likelihood(of):
        member = np.eye(3)[of]
        n = member.T @ bigrams @ member
        return sum(float((x * np.log(np.maximum(x, 1))).sum()) * f for x, f in ((n, 1), (n.sum(0), -1), (n.sum(1), -1)))

    of = brown_lm.exchange(bigrams, 3, rounds=10)
    assert all(len(set(of[true == c])) == 1 for c in range(3)) and len(set(of)) == 3
    steps = [likelihood(brown_lm.exchange(bigrams, 3, rounds=r)) for r in range(4)]
    assert steps == sorted(steps) and steps[-1] > steps[0]
    assert all(likelihood(np.where(np.arange(30) == w, b, of)) <= likelihood(of) + 1e-6 for w in range(30) for b in range(3))


def lm_rows(rng, n):
    rows = list(awkward_rows())
    for k in range(n):
        kind = [["ba", "do", "ki"], ["lu", "me", "no"]][k % 2]
        rows.append((5000 + k, " ".join("".join(rng.choice(kind) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 80)))))
    return rows


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 6000])
def test_language_model(spark, bucket_bytes):
    rows = lm_rows(random.Random(9), 300)
    docs = awkward(spark, rows)
    out = brown_lm.score(docs, ~fold("doc_id", 7, 2), bucket_bytes=bucket_bytes, frequent=30, endings=16, classes=6).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    count = collections.Counter()
    for i, t in rows:
        if not held[i]:
            count.update([*words(t, lower=True), "\n"])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        own = [*words(t, lower=True), "\n"]
        want.append((i, len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), 6)))
    got = [(r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    test = [r for r in out if held[r.id] and r.id >= 5000]
    assert len(test) > 20 and sum(r.score for r in test) > sum(r.base_score for r in test) and all(r.score < 0 for r in out)


def test_model_is_a_distribution(spark):
    rows = lm_rows(random.Random(9), 60)
    buckets = brown_lm.coded(awkward(spark, rows), F.lit(True)).cache()
    totals = brown_lm.word_rows(buckets).groupBy("word").agg(F.sum("n").alias("c")).cache()
    model = brown_lm.fit(buckets, totals, frequent=20, endings=8, classes=5)
    assert np.allclose((10 ** model.transition).sum(1), 1)
    mass = collections.Counter()
    for r in totals.collect():
        cls = model.of[model.units[bytes(r.word)]]
        mass[cls] += (r.c + model.add) / model.places[cls]
    assert all(abs(m + model.add / model.places[c] - 1) < 1e-9 for c, m in mass.items())  # one place for all unseen words


def test_gains_equal_the_likelihood():
    rng = np.random.default_rng(6)
    bigrams, of = rng.poisson(0.6, (25, 25)).astype(float), rng.integers(0, 4, 25)

    def table(classes):
        member = np.eye(4)[classes]
        return member.T @ bigrams @ member

    got = brown_lm.gains(table(of), bigrams @ np.eye(4)[of], bigrams.T @ np.eye(4)[of], bigrams.diagonal().copy(), of)
    for w in range(25):
        want = [brown_lm.likelihood(table(np.where(np.arange(25) == w, b, of))) for b in range(4)]
        assert np.allclose(got[w] - got[w][0], np.array(want) - want[0])


def test_rare_words_get_classes_by_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "MOVE_ROWS", 5)
    rng = random.Random(4)
    rows = []
    for k in range(600):  # words of two kinds take turns; all endings are alike
        rows.append((k, " ".join(f"{'ab'[i % 2]}{rng.randrange(60)}xyz" for i in range(rng.randint(5, 40)))))
    buckets = brown_lm.coded(awkward(spark, rows), F.lit(True), bucket_bytes=20_000).cache()
    assert buckets.count() > 3
    totals = brown_lm.word_rows(buckets).groupBy("word").agg(F.sum("n").alias("c")).cache()
    first = brown_lm.fit(buckets, totals, frequent=20, endings=8, classes=5)
    seed = spark.sparkContext.broadcast(first)
    own = brown_lm.moved(buckets, seed).cache()
    of = {bytes(r.word): r.cls for r in own.collect()}
    assert len(of) == 120 + 1 - len(first.units.frequent)
    kinds = [{c for w, c in of.items() if w[:1] == kind} for kind in (b"a", b"b")]
    assert len({first.of[first.units[w]] for w in of}) == 1 and not kinds[0] & kinds[1]
    _, model = brown_lm.refine(buckets, totals, own, seed)
    assert model.own and brown_lm.likelihood(model.table) > brown_lm.likelihood(first.table) and model.table.sum() == first.table.sum()
    mass = collections.Counter()
    for r in totals.collect():
        cls = of.get(bytes(r.word), model.classes([bytes(r.word)])[0])
        mass[cls] += (r.c + model.add) / model.places[cls]
    assert all(abs(m + model.add / model.places[c] - 1) < 1e-9 for c, m in mass.items())
    # classes that make things worse are taken by a part of the words, or by none
    worse = own.select("word", F.pmod(F.xxhash64("word"), F.lit(5)).cast("int").alias("cls")).cache()
    classed, kept = brown_lm.refine(buckets, totals, worse, seed)
    assert brown_lm.likelihood(kept.table) >= brown_lm.likelihood(first.table) - 1e-6 and kept.table.sum() == first.table.sum() and classed.count() == buckets.count()


def test_language_model_without_training_texts(spark):
    out = brown_lm.score(awkward(spark), F.lit(False)).collect()
    assert len(out) == len(awkward_rows()) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)
    assert brown_lm.score(empty(spark), F.lit(True)).count() == 0


# --- top-k

def vector_rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 12)) * rng.gamma(1.0, 1.0, size=(400, 1)) @ np.diag(np.linspace(1, 0.05, 12))
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(base)]
    rows += [(500 + k, list(rows[7][1])) for k in range(150)]  # a very common vector: ties
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan"), 1.0]), (703, [float("inf")]), (None, [1.0] * 12), (750, [2.0, 1.0]), (751, []), (752, [0.0] * 12)]
    return rows + rows[:3] + [(50, [9.0] * 12)]  # repeated rows, and an id with two vectors


def test_top_k_equals_brute_force(spark):
    rows = vector_rows()
    usable = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, x in usable if j == q for i, y in usable if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, norm int, part string").repartition(4)
    for settings in ({}, {"block": 40, "seeds": 3, "sample": 9}):
        got = top_k(df, F.col("id") % 50 == 0, **settings)
        assert sorted(map(tuple, got.collect())) == want
    assert top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert top_k(df.where("vec_id in (0, 50)"), F.col("id") % 50 == 0).where("query_id = 0").count() == 2


def brute_top(rows):
    usable = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows}
    want = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for j, x in usable if j == q for i, y in usable if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return want


@pytest.mark.parametrize("big", [2.0 ** 22, 2.0 ** 23 - 1, 2.0 ** 23, 2.0 ** 30])
def test_top_k_of_large_components(spark, big):
    """Long vectors take part, as queries and as candidates, and no score wraps: the largest here are just inside a long."""
    rng = random.Random(int(big))
    rows = [(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(300)]
    rows += [(1000, [big] * 8), (1001, [-big] * 8), (1050, [big, -big] + [0.25] * 6), (1002, [0.0] * 7 + [big])]
    if big < 2.0 ** 23:
        rows += [(1003, [big] * 4)]
    safe = [r for r in rows if big < 2.0 ** 22 or r[0] not in (1000, 1001, 1003)] if big >= 2.0 ** 26 else [r for r in rows if r[0] != 1003 or big < 2.0 ** 22]
    df = spark.createDataFrame(safe, "vec_id long, embedding array<double>")
    want = brute_top(safe)
    if all(-2 ** 63 < w[3] < 2 ** 63 for w in want):
        for settings in ({}, {"block": 40, "seeds": 3, "sample": 9}):
            assert sorted(map(tuple, top_k(df, F.col("id") % 50 == 0, **settings).collect())) == want
    else:
        with pytest.raises(Exception, match="fit a long"):
            top_k(df, F.col("id") % 50 == 0).collect()


def test_top_k_that_does_not_fit(spark):
    df = spark.createDataFrame([(0, [2.0 ** 22] * 8), (1, [2.0 ** 22] * 8), (2, [1.0] * 8)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):  # 2^63
        top_k(df, F.col("id") % 50 == 0).collect()
    low = spark.createDataFrame([(0, [1e30] * 2)] + [(k, [-1e30 * k] * 2) for k in range(1, 4)] + [(k, [-float(k), 0.5 / 256]) for k in range(10, 16)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):  # all of the results are below the range
        top_k(low.where("vec_id < 4"), F.col("id") % 50 == 0).collect()
    small = spark.createDataFrame([(0, [1e12] * 2)] + [(k, [-1e14 * k] * 2) for k in range(1, 4)] + [(k, [-float(k) / 256, 0.5]) for k in range(10, 16)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(small, F.col("id") % 50 == 0).collect()))  # the three whose products do not fit are not among the best
    assert got == brute_top([(0, [1e12] * 2)] + [(k, [-float(k) / 256, 0.5]) for k in range(10, 16)])


# --- quality rules

def base_model(t):
    t = t or ""
    w, seen = words(t), collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    cover = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def rule_rows():
    rng = random.Random(6)
    rows = list(awkward_rows())
    for k in range(2600):
        text, kind = prose(rng, rng.randint(25, 90)), k % 10
        rows.append((10_000 + k, " ".join(w + "###" for w in text) if kind == 0 else " ".join(text)))
    rows += [(20_000, " ".join(prose(rng, 30) * 2)), (20_001, "a b c d e f g h a b c d e f g h a"), (20_002, "x y " * 40)]
    return rows


def test_quality_rules(spark):
    rows = rule_rows()
    docs = awkward(spark, rows).withColumn("lang", F.lit("en"))
    labels = labels_of(spark, [(i, int(i % 10 != 0), 0) for i, _ in rows if i is not None and 10_000 <= i < 20_000] + [(None, 1, 0)])
    out = quality_rules.quality_rules(docs, labels).collect()
    want = {(i, *base_model(t)) for i, t in rows}
    assert {(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out} == want and len(out) == len(rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in out)
    made = [r for r in out if r.id is not None and 10_000 <= r.id < 20_000]
    assert all(r.kept == (r.id % 10 != 0) for r in made)  # the junk goes, nothing good does
    assert quality_rules.quality_rules(empty(spark), labels).count() == 0
    few = quality_rules.quality_rules(docs, labels.limit(50)).collect()
    assert all(r.kept == (not r.base_failed) for r in few)  # too few labels certify nothing


def test_copies_are_no_further_evidence(spark):
    """A text a thousand times over is one trial: nothing is certified by it, under one id or many."""
    rng = random.Random(8)
    good = " ".join(prose(rng, 60))
    junk = [(5000 + k, " ".join(w + "###" for w in prose(rng, 60))) for k in range(40)]
    for rows in ([(k, good) for k in range(1000)], [(1, good)] * 1000):
        docs = spark.createDataFrame([(i, t, "en") for i, t in rows + junk], "doc_id long, text string, lang string")
        labels = labels_of(spark, [(i, int(i < 5000), 0) for i in {i for i, _ in rows + junk}])
        assert quality_rules.quality_rules(docs, labels).where("not kept and not base_failed").count() == 0
    rows = [(k, " ".join(prose(rng, 60))) for k in range(1000)]  # as many different texts certify a cutoff
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows + junk], "doc_id long, text string, lang string")
    labels = labels_of(spark, [(i, int(i < 5000), 0) for i, _ in rows + junk])
    assert quality_rules.quality_rules(docs, labels).where("not kept").count() == 40


def test_binomial_tail(spark):
    cases = [(k, n, p) for n, p in ((50, 0.1), (400, 0.01), (20_000, 0.01)) for k in (0, 1, 3, int(n * p))]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_log_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        term = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        want = max(term) + math.log(sum(math.exp(t - max(term)) for t in term))
        assert abs(got - want) < 1e-6 * max(1, abs(want))


def test_cutoffs_respect_the_bound(spark):
    """A rule whose every cutoff rejects too many good texts is never certified."""
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(3000):
        text = prose(rng, 40)
        rows.append((k, " ".join(w + "#" if rng.random() < 0.5 else w for w in text)))
        labels.append((k, int(k % 10 != 0), 0))  # labels have nothing to do with the text
    docs = awkward(spark, rows).withColumn("lang", F.lit("en"))
    out = quality_rules.quality_rules(docs, labels_of(spark, labels)).where("not base_failed").collect()
    good = [r for r in out if r.id % 10]
    assert sum(not r.kept for r in good) <= quality_rules.RISK * len(good)


def test_held_out_rows_of_the_given_tables(spark):
    """Floors on the held-out labelled rows of ``documents``: no clean document in fifty is called toxic, most toxic ones are found, and quality is told apart."""
    from depotlens.llm.queries import op5_toxicity, op6_quality_classifier
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    right = {}
    for query, column in ((op5_toxicity, "toxic"), (op6_quality_classifier, "quality")):
        rows = query(spark, folder).where("held_out").join(labels, "doc_id").select(F.col(column).alias("y"), "predicted", "score").collect()
        assert all(0 <= r.score <= 1 for r in rows)
        for y in (0, 1):
            of = [r.predicted == y for r in rows if r.y == y]
            right[column, y] = sum(of) / len(of)
    assert right["toxic", 0] >= 0.98 and right["toxic", 1] >= 0.6
    assert right["quality", 0] >= 0.85 and right["quality", 1] >= 0.95
