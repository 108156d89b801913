"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base statistics of every whole text come from array functions inside one row; nothing is exploded, so no text meets a shuffle.

Thresholds.  Each rule turns a text into a level 0..``LEVELS`` - 1, higher is worse, and rejects levels at or above a cutoff.  On the labelled
holdout, per stratum (language and length) and rule, a cutoff is certified if the exact binomial test rejects "more than ``risk`` / rules
of good texts are rejected": P(Binomial(n, risk / rules) <= k) <= ``error`` / (rules * strata), k being the good texts rejected out of n.
Cutoffs are tested from the most lenient on and testing stops at the first failure (fixed sequence), which needs no correction
within a sequence; Bonferroni covers rules and strata.  So with probability 1 - ``error``, in every stratum at once, all rules together
reject at most ``risk`` of good texts.  Among certified cutoffs the one that best separates is taken: the share of bad texts rejected less
``weight`` times the share of good ones, the more lenient on ties.  A stratum with too few labels to certify anything rejects nothing.

Defined cases: null or empty text, or white space only: no words, all counts 0, base_failed.  Repeated rows are judged each.  Several labels of
one id: the largest.  Rows with no id have no label but are judged.  No labels: only the base rule decides.  Empty table: empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotlens.llm.common import others, stored

WINDOW = 8
LEVELS = 64
RISK = 0.05
ERROR = 0.05
WEIGHT = 10.0
#: Languages that are strata of their own, and the length in words that divides short texts from long ones.
LANGUAGES = ("en", "de", "fr", "es")
LONG = 300
RULES = ("symbols", "repeated_lines", "repeated_words", "word_length", "few_distinct")
STRATA = 2 * (len(LANGUAGES) + 1)


def bound(value: Column, use) -> Column:
    """``use(v)`` with ``value`` worked out once, however often ``use`` names it (also within lambdas)."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the array, the first included."""
    def covered(at: Column) -> Column:  # sorted starts of repeated windows
        gap = F.transform(at, lambda s, i: F.when(i + 1 < F.size(at), F.least(F.lit(window), F.get(at, i + 1) - s)).otherwise(window))
        return F.aggregate(gap, F.lit(0), lambda total, g: total + g)

    def starts(hashes: Column) -> Column:
        def twins(p: Column) -> Column:  # (hash, start) in order
            same = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(same, lambda x: x["s"]))
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("s"))))
        return bound(bound(placed, twins), covered)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, window)))
        return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(starts(h)))

    return bound(words, lambda w: F.when(F.size(w) <= window, 0).otherwise(of(w)))


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``id``, ``rest``, ``stratum`` and the statistics of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    spaced = F.col("text")
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    base = docs.select(F.col(id_col).alias("id"), others(docs, id_col, text_col).alias("rest"), lang.alias("lang"), text.alias("text"))
    base = base.withColumn("spaced", spaced).withColumn("words", F.array_remove(F.split("spaced", " "), ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \t-\r]"))
    n_words = F.size("words")
    symbols = F.char_length("text") - F.char_length(F.regexp_replace("text", "[#*$%&|<>]", ""))
    return base.select(
        "id", "rest", F.concat_ws("-", F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other"), F.when(n_words < LONG, "short").otherwise("long")).alias("stratum"),
        n_words.cast("long").alias("n_words"), F.char_length(F.replace("spaced", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"), bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"), repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), F.xxhash64("text").alias("text_hash"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def levels() -> Column:
    """Level of each rule, in the order of ``RULES``: whole-number arithmetic, so equal texts have equal levels everywhere."""
    def level(part: Column, whole: Column) -> Column:
        return F.least(F.lit(LEVELS - 1), F.floor(LEVELS * part / F.greatest(whole, F.lit(1)))).cast("int")
    n = F.col("n_words")
    return F.array(level(F.col("n_symbols"), 2 * n), level(F.col("n_dup_lines"), F.col("n_lines")), level(F.col("n_repeat_words"), n),
                   level(F.col("word_chars"), 24 * n), level(n - F.col("n_distinct"), n))


def binomial_log_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Binomial(n, p) <= k), summed term by term in logarithms."""
    import math
    first = n * F.lit(math.log1p(-p))
    odds = F.lit(math.log(p) - math.log1p(-p))

    def step(state: Column, i: Column) -> Column:
        def added(t: Column) -> Column:
            high = F.greatest(t, state["s"])
            return F.struct(t.alias("t"), (high + F.log1p(F.exp(F.least(t, state["s"]) - high))).alias("s"))
        return bound(state["t"] + F.log((n - i + 1) / i) + odds, added)

    start = F.struct(first.alias("t"), first.alias("s"))
    many = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda state: state["s"])
    return F.when(k <= 0, first).otherwise(many)


def cutoffs(judged: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", risk: float = RISK, error: float = ERROR,
            weight: float = WEIGHT) -> DataFrame:
    """(stratum, cuts): for each rule, in the order of ``RULES``, its certified cutoff, or ``LEVELS`` where there is none."""
    import math
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("good"))
    # One trial a text: copies of it, under one id or several, are no further evidence.
    trials = judged.where(~F.col("base_failed")).join(known, "id").select("stratum", "good", "text_hash", "levels").distinct()
    held = trials.select("stratum", "good", F.posexplode("levels").alias("rule", "level"))
    counts = held.groupBy("stratum", "rule", "level").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum(1 - F.col("good").cast("long")).alias("bad"))
    # every level of every (stratum, rule), so that a cutoff may lie where no holdout text does
    grid = counts.select("stratum", "rule").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    full = grid.join(counts, ["stratum", "rule", "level"], "left").fillna(0, ["good", "bad"])
    group = Window.partitionBy("stratum", "rule")
    down = group.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    at = full.select("stratum", "rule", "level", F.sum("good").over(down).alias("k"), F.sum("good").over(group).alias("n"),
                     F.sum("bad").over(down).alias("caught"), F.sum("bad").over(group).alias("n_bad"))
    share = risk / len(RULES)
    may = F.col("k") <= F.col("n") * share  # beyond its mean the tail is no small number
    passed = F.when(may, binomial_log_tail(F.col("k"), F.col("n"), share) <= math.log(error / (len(RULES) * STRATA))).otherwise(False)
    certified = at.withColumn("sure", F.min(passed).over(down)).where("sure and n_bad > 0")
    worth = F.col("caught") / F.col("n_bad") - weight * F.col("k") / F.greatest("n", F.lit(1))
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct(worth.alias("worth"), "level", "caught")).alias("best")).where("best.caught > 0")
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.col("best.level").alias("cut")))).alias("found")).select(
        "stratum", F.array(*[F.coalesce(F.col("found")[i], F.lit(LEVELS)) for i in range(len(RULES))]).alias("cuts"))


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                  label_col: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``rest`` (struct of the other columns), the statistics, ``base_failed``, ``failed`` (names
    of the rules whose cutoff it reaches) and ``kept``."""
    judged = stored(statistics(docs, id_col=id_col, text_col=text_col, lang_col=lang_col).withColumn("base_failed", base_failed()).withColumn("levels", levels()))
    cuts = cutoffs(judged, labels, id_col=id_col, label_col=label_col, risk=risk, error=error)  # at most STRATA rows
    out = judged.join(F.broadcast(cuts), "stratum", "left")
    reached = F.zip_with("levels", F.coalesce("cuts", F.array_repeat(F.lit(LEVELS), len(RULES))), lambda level, cut: level >= cut)
    names = F.array(*[F.lit(r) for r in RULES])
    failed = F.filter(names, lambda _, i: F.get(reached, i))
    return out.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("levels", "cuts", "text_hash")
