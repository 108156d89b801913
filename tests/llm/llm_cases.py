"""Small inputs and plain models shared by the llm tests."""
import collections
import hashlib
import re

from pyspark.sql import types as T

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def phrase(seed, n):
    """n words that depend on the seed only."""
    return [f"w{(seed * 7919 + k * 104729) % 9973}x{seed}" for k in range(n)]


def awkward_rows():
    """(doc_id, text): nulls, blanks, ties, repeats, long texts, odd white space, shared passages."""
    shared = phrase(1, 50)
    line = "this line is long enough to count and many documents hold it"
    long_text = " ".join(phrase(2, 9000))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"),
        (6, " ".join(phrase(3, 60))), (7, " ".join(phrase(3, 60))), (7, " ".join(phrase(3, 60))),  # copies and a repeated row
        (8, " ".join(phrase(4, 20) + shared + phrase(5, 20))), (9, "\n".join(phrase(6, 5)) + "\n" + " ".join(shared)),
        (10, long_text), (11, "café naïve ÉCOLE 你好 \U0001f600  x y #*$%&|<>"),
        (12, " ".join(["same"] * 200)), (13, " ".join(phrase(7, 100))), (14, " ".join(phrase(7, 97) + phrase(8, 3))),
        (15, "\n\n\n"), (16, "a\x00b \x1c c\x85d"), (None, " ".join(phrase(3, 60))), (None, None), (2**60, "x " * 3000),
    ]
    for k in range(7):
        rows.append((100 + k, f"{line}\nown {k} " + " ".join(phrase(50 + k, 30)) + f"\n  {line.upper()}\t\nshort\n{line}!"))
    for k in range(6):
        rows.append((200 + k, f"{line}\n{'e' * 39}é {k % 2}\n" + " ".join(phrase(70 + k, 12))))
    return rows


#: Names that an operator might use for itself.
CLASHES = ("id", "rest", "bucket", "part", "row", "n", "word", "score", "hash", "keep", "piece", "start", "length", "node", "label", "band", "kept", "lang", "n_chars")


def awkward(spark, rows=None):
    """The rows with clashing extra columns, nulls among them, over several partitions."""
    rows = awkward_rows() if rows is None else rows
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    for i, c in enumerate(CLASHES):
        schema = schema.add(c, "long" if c == "n_chars" else "string" if i % 2 else "double")
    data = [(i, t, *[None if k % 3 == j % 3 else 5 if c == "n_chars" else f"v{k}" if j % 2 else float(k) for j, c in enumerate(CLASHES)])
            for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], awkward(spark, [(1, "x")]).schema)


def components_model(rows, percent, shingle=5):
    """Brute force: component of every row by id, equal ids being one document."""
    sets = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        w = words(t, lower=True)
        sets[("row", k) if i is None else i].append({tuple(w[j:j + shingle]) for j in range(max(1, len(w) - shingle + 1))} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            for x in sets[keys[a]]:
                for y in sets[keys[b]]:
                    n = len(x & y)
                    if n and 100 * n >= percent * (len(x) + len(y) - n):
                        p, q = root(keys[a]), root(keys[b])
                        if p != q:
                            parent[p] = q
    groups = collections.defaultdict(list)
    for i in keys:
        groups[root(i)].append(i)
    return {i: min((x for x in g if not isinstance(x, tuple)), default=None) for g in groups.values() for i in g}
