"""Spelling variant groups: words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and the acceptor again.

*Composition.*  A minimised acceptor A holds words, and T rewrites one code point (replaced, inserted or deleted).  The accepted paths of A o T o A are
the near pairs.  A path follows equal arcs on both sides in T's first state, makes its edit at the first place where the words differ, and
from then on both sides follow equal arcs to a final state.  So a pair has one path.

*Initial-state partitions.*  The paths are enumerated in parts, one per pair of an initial state and a tail: the edit lies in a window
[a, b) of the word, so the words of a part share what comes before a, which fixes the state of A to start in, and what follows the window.  A word's windows are [0, 3), [3, 6), [6, 12), [12, 24) and so on;
it sends one or two rows for each (as the longer word of a pair its tail starts at b, as the shorter one at b - 1).  A part compiles the middles
of its words, without the prefix and tail that all share.

*Hot parts.*  A part whose middles have more than ``most`` characters is not enumerated: its rows come back with two half windows each and
make another round.  Halving ends at windows of one character, whose part has at most one row per letter.  So no common beginning
makes a part large, and no pair is left out.

Vocabulary counts cover every whole text; what a task has counted so far is sent on whenever it has ``COUNT_WORDS`` words.

Defined cases: null and empty texts have no words; a null id enters the hash as empty text.  Repeated rows count each.  An empty
table gives no rows.  Extra columns are not looked at.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm.common import binary, ceil_div, stored

#: Words shorter than this, in code points, have no part in the grouping.
LEAST_LENGTH = 7
#: A form has at least this many times the occurrences of its variant.
FORM_FACTOR = 10
#: Characters of middles that one part may hold; beyond it its windows are halved.
MOST_CHARS = 1 << 20
#: End of a word's first window; each later window ends at twice that of the one before.
FIRST_END = 3
#: Words a task counts before it sends them on, and words of the vocabulary for each task of the composition.
COUNT_WORDS = 200_000
WORDS_PER_TASK = 50_000
#: Of a run whose hash this divides one code point is left out (the misspellings of the contract).
SLIP = 31


# --- words -----------------------------------------------------------------------------------

def run_pattern(least: int) -> re.Pattern:
    """Maximal runs of at least ``least`` letters of a text whose A-Z are lower-cased already."""
    return re.compile(f"[a-zÀ-ÿ]{{{least},}}")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = LEAST_LENGTH, slip: int | None = SLIP) -> DataFrame:
    """(word, n) of the words of all whole texts, with at least ``least_length`` code points.  ``slip`` None leaves all runs as they are."""
    runs = run_pattern(least_length).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for key, text in zip(binary(batch.column("key")), binary(batch.column("text"))):
                if not text:
                    continue
                start = zlib.crc32((key or b"") + b":")
                for run, n in Counter(runs(text.lower().decode("utf-8", "replace"))).items():
                    if slip:
                        h = zlib.crc32(run.encode(), start)
                        if h % slip == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < least_length:
                                continue
                    seen[run] += n
                if len(seen) >= COUNT_WORDS:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    base = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})


# --- acceptors and their composition -----------------------------------------------------------

class Acceptors:
    """Minimal acyclic acceptors over one table of states: equal sets of endings are one state, also between the acceptors."""

    def __init__(self) -> None:
        self._known: dict[tuple, int] = {}
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []

    def _freeze(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return state

    def add(self, words: list[str]) -> int:
        """Initial state of the minimal acceptor of ``words`` (sorted, distinct)."""
        finals, open_arcs, last = [False], [{}], ""  # the last word's states, not frozen yet

        def close(depth: int) -> None:
            while len(open_arcs) > depth + 1:
                state = self._freeze(finals.pop(), open_arcs.pop())
                open_arcs[-1][last[len(open_arcs) - 1]] = state

        for word in words:
            same = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                same += 1
            close(same)
            for _ in range(len(word) - same):
                finals.append(False)
                open_arcs.append({})
            finals[-1] = True
            last = word
        close(0)
        return self._freeze(finals[0], open_arcs[0])

    def common(self, p: int, q: int) -> Iterator[str]:
        """Endings that both states accept: T has made its edit and copies."""
        path: list[str] = []
        todo = [(p, q, 0, "")]
        while todo:
            p, q, depth, label = todo.pop()
            if depth:
                del path[depth - 1:]
                path.append(label)
            if self.final[p] and self.final[q]:
                yield "".join(path)
            to = self.arcs[q]
            for x, r in self.arcs[p].items():
                if x in to:
                    todo.append((r, to[x], depth + 1, x))

    def edits(self, p: int, q: int, replaced: bool) -> Iterator[tuple[str, str, str]]:
        """Accepted paths of (acceptor at p) o T o (acceptor at q), as (first word, second word, ending after the edit).

        ``replaced``: T's edit replaces a code point, the smaller one being on the first side, so that a pair comes once;
        else it deletes one, at the first place where the words differ.
        """
        arcs = self.arcs
        path: list[str] = []
        todo = [(p, q, 0, "")]
        while todo:
            p, q, depth, label = todo.pop()
            if depth:
                del path[depth - 1:]
                path.append(label)
            to = arcs[q]
            for x, r in arcs[p].items():
                if x in to:  # no edit yet
                    todo.append((r, to[x], depth + 1, x))
                if replaced:
                    for y, s in to.items():
                        if x < y:
                            for end in self.common(r, s):
                                before = "".join(path)
                                yield before + x + end, before + y + end, end
                else:
                    for end in self.common(r, q):
                        if not end.startswith(x):
                            before = "".join(path)
                            yield before + x + end, before + end, end


#: A row's part in a window: as the longer (or equally long) word of a pair, and as the shorter one.
LONGER, SHORTER = 1, 2


def near_pairs(words: list[tuple[str, int, int]], a: int, b: int) -> Iterator[tuple[int, int]]:
    """Index pairs of the words one edit apart, the edit at a place in [a, b).

    ``words``: (word, n, roles) of one part; they share word[:a], and word[b:] (as longer) or word[b - 1:] (as shorter).
    """
    longer = {w[a:b]: k for k, (w, _, roles) in enumerate(words) if roles & LONGER}
    shorter = {w[a:b - 1]: k for k, (w, _, roles) in enumerate(words) if roles & SHORTER}
    if not longer or len(longer.keys() | shorter.keys()) < 2:
        return
    word, _, roles = words[0]
    tail = word[b if roles & LONGER else b - 1:]
    # what all middles share at either end is no part of the acceptors
    low, high = min(*longer, *shorter), max(*longer, *shorter)
    front = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    turned = [m[:front - 1 if front else None:-1] for m in (*longer, *shorter)]
    low, high = min(turned), max(turned)
    back = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    shared = word[a:b if roles & LONGER else b - 1]
    shared = shared[len(shared) - back:]

    def cut(middles: dict[str, int]) -> dict[str, int]:
        return {m[front:len(m) - back]: k for m, k in middles.items()}

    longer, shorter, after = cut(longer), cut(shorter), shared + tail
    states = Acceptors()
    first = states.add(sorted(longer))
    if len(longer) > 1:
        for x, y, _ in states.edits(first, first, True):
            yield longer[x], longer[y]
    if shorter:
        for x, y, end in states.edits(first, states.add(sorted(shorter)), False):
            place = a + front + len(y)
            if not end:  # all of the shorter acceptor's path comes first: the words may agree further on, into a later window
                place += len(after) - len(after.lstrip(x[-1]))
            if end or place < b:
                yield longer[x], shorter[y]


# --- Spark ---------------------------------------------------------------------------------------

def windows(vocabulary: DataFrame) -> DataFrame:
    """(word, n, a, b, roles): the windows of every word, the last of which holds the place after its end."""
    last = F.greatest(F.lit(0), F.floor(F.log2(F.length("word") / FIRST_END)) + 2).cast("int")
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(FIRST_END * F.pow(F.lit(2.0), k - 1)).cast("int")
    every = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(start(k).alias("a"), start(k + 1).alias("b")))
    return (vocabulary.select("word", "n", F.explode(every).alias("w")).select("word", "n", "w.a", "w.b", F.lit(LONGER | SHORTER).alias("roles"))
            .where(F.col("a") <= F.length("word")))


def _keyed(rows: DataFrame) -> DataFrame:
    """One row per role of a word in a window, with the key of its part; one row for both roles where the tails are empty."""
    def part(role: int, b: Column) -> Column:
        key = F.xxhash64("a", "b", F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), b + 1, F.length("word")))
        return F.struct(key.alias("key"), F.lit(role).alias("roles"))

    both = (F.length("word") < F.col("b")) & (F.col("roles") == LONGER | SHORTER)
    parts = F.when(both, F.array(part(LONGER | SHORTER, F.col("b")))).otherwise(
        F.filter(F.array(part(LONGER, F.col("b")), part(SHORTER, F.col("b") - 1)), lambda p: p["roles"].bitwiseAND(F.col("roles")) > 0))
    return rows.select("word", "n", "a", "b", F.explode(parts).alias("part")).select("part.key", "a", "b", "part.roles", "word", "n")


_ROUND = "word string, n long, other string, other_n long, a int, b int, roles int"
_KINDS = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_KINDS)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], ["word", "n", "other", "other_n", "a", "b", "roles"])


def _pairs(group: list[tuple], out: list[tuple]) -> None:
    """Near pairs, both ways round, of the rows of one key.  Equal hashes need not be equal keys."""
    parts: dict[tuple, list] = defaultdict(list)
    for a, b, roles, word, n in group:
        parts[a, b, word[:a], word[b if roles & LONGER else b - 1:]].append((word, n, roles))
    for (a, b, _, _), words in parts.items():
        if len(words) > 1:
            for i, j in near_pairs(words, a, b):
                (x, nx, _), (y, ny, _) = words[i], words[j]
                out += (x, nx, y, ny, None, None, None), (y, ny, x, nx, None, None, None)


def _halve(row: tuple, out: list[tuple]) -> None:
    a, b, roles, word, n = row
    middle = (a + b) // 2
    out.extend((word, n, None, None, *window, roles) for window in ((a, middle), (middle, b)) if window[0] <= len(word))


def _enumerate(keyed: DataFrame, tasks: int, most: int) -> DataFrame:
    """Near pairs (``other`` not null), and the rows of hot parts with half windows (``a`` not null)."""
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[tuple] = []
        at, size, hot = None, 0, False
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "roles", "word", "n"))):
                if key != at:
                    if len(group) > 1:
                        _pairs(group, out)
                    group.clear()
                    at, size, hot = key, 0, False
                a, b, _, word, _ = row
                size += min(len(word), b) - a + 1
                if hot:
                    _halve(row, out)
                else:
                    group.append(row)
                    if size > most and b - a > 1 and len(group) > 1:
                        hot = True
                        for earlier in group:
                            _halve(earlier, out)
                        group.clear()
                if len(out) > 20_000:
                    yield _batch(out)
        if len(group) > 1:
            _pairs(group, out)
        yield _batch(out)

    return keyed.repartition(tasks, "key").sortWithinPartitions("key", "word", "roles").mapInArrow(compose, _ROUND)


def near_words(vocabulary: DataFrame, *, most: int = MOST_CHARS, words_per_task: int = WORDS_PER_TASK) -> DataFrame:
    """(word, n, other, other_n): every pair of words one edit apart, both ways round.  ``vocabulary``: stored, words distinct."""
    tasks = max(1, ceil_div(vocabulary.count(), words_per_task))
    rows, pairs = windows(vocabulary), None
    while True:
        found = stored(_enumerate(_keyed(rows), tasks, most))
        new = found.where("other IS NOT NULL").select("word", "n", "other", "other_n")
        pairs = new if pairs is None else pairs.unionByName(new)
        rows = found.where("a IS NOT NULL").select("word", "n", "a", "b", "roles")
        if rows.isEmpty():
            return pairs


def _roots(forms: DataFrame) -> DataFrame:
    """(variant, root) of a stored (word, form) table: forms of forms by doubling.  A form has ten times the occurrences, so chains are short and end."""
    step = forms.select(F.col("word").alias("variant"), F.col("form").alias("root"))
    while True:
        beyond = step.select(F.col("variant").alias("root"), F.col("root").alias("further"))
        new = stored(step.join(beyond, "root", "left").select("variant", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        step = new.select("variant", "root")
        if new.where("moved").isEmpty():
            return step


def variant_groups(vocabulary: DataFrame, *, factor: int = FORM_FACTOR, most: int = MOST_CHARS, words_per_task: int = WORDS_PER_TASK) -> DataFrame:
    """One row per word of a (word, n) table: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form``: the near word with the most occurrences (ties: the smallest by code points), if it has ``factor`` times the word's own; else null.
    ``root``: where forms of forms end; the word itself if it has none.
    """
    none = vocabulary.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    rank = F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))
    best = (near_words(vocabulary, most=most, words_per_task=words_per_task).unionByName(none).groupBy("word")
            .agg(F.max("n").alias("n"), F.count("other").alias("n_near"), F.min(F.when(F.col("other").isNotNull(), rank)).alias("best")))
    has_form = -F.col("best.less") >= factor * F.col("n")
    words = stored(best.select("word", "n", "n_near", F.when(has_form, F.col("best.other")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n")))
    roots = _roots(words.where("form IS NOT NULL"))
    return (words.join(roots, F.col("word") == F.col("variant"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_count: int = 2, **options) -> DataFrame:
    """``variant_groups`` of the words with at least ``least_count`` occurrences in all texts of ``docs``."""
    vocabulary = stored(word_counts(docs, id_col, text_col).where(F.col("n") >= least_count))
    return variant_groups(vocabulary, **options)
