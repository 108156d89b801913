"""Bounded labelled samples for the classifiers trained on the driver."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm.common import stored

#: Labelled texts that a classifier is fitted on, at most, and the bytes of all of them together (half of either for each label).
SAMPLE_ROWS = 8_000
TOTAL_BYTES = 64 << 20


def fold(id_col: str, folds: int, part: int) -> Column:
    """Whether crc32(id as text) mod ``folds`` is ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 3,
                    held_out: int = 1, rows: int = SAMPLE_ROWS, total_bytes: int = TOTAL_BYTES, extra: tuple[str, ...] = ()) -> list:
    """Rows (text, label, *extra) of at most ``rows`` labelled documents outside the held-out fold, with their whole texts.

    Ids are taken in the order of a hash, half per label, so the sample does not depend on the tables' order; those of a label end
    with the one that reaches half of ``total_bytes``, so long texts make fewer rows and none is cut or passed over for its length.
    Of an id's rows one is taken, by a hash, so a repeated id weighs as one example.
    Only the ids (a proven bound) are broadcast; ids and sizes of the at most ``rows`` texts are read before the texts themselves.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~fold(id_col, folds, held_out))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")))
    place = F.xxhash64(F.col("id").cast("string"))
    half = [known.where(F.col("label") == v).orderBy(place, "id").limit(rows // 2) for v in (0, 1)]
    chosen = half[0].unionByName(half[1])
    text = F.col(text_col).cast("string").cast("binary")
    found = docs.select(F.col(id_col).alias("id"), F.struct(text.alias("text"), *[F.col(c) for c in extra]).alias("row")).join(F.broadcast(chosen), "id")
    picked = stored(found.groupBy("id", "label").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("id", "label", "row.*"))
    sizes = picked.select(place.alias("place"), "id", "label", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()  # ``rows`` at most
    last, total = {}, dict.fromkeys((0, 1), 0)
    for r in sorted(sizes, key=lambda r: (r["place"], r["id"])):
        if total[r["label"]] < total_bytes // 2:
            last[r["label"]] = r
            total[r["label"]] += r["size"]
    id_type = picked.schema["id"].dataType
    fitting = F.lit(False)
    for label, r in last.items():
        fitting |= (F.col("label") == label) & ((place < r["place"]) | ((place == r["place"]) & (F.col("id") <= F.lit(r["id"]).cast(id_type))))
    out = [(bytes(r["text"] or b""), int(r["label"]), *(r[c] for c in extra), r["id"]) for r in picked.where(fitting).collect()]
    return [r[:-1] for r in sorted(out, key=lambda r: (r[-1], r[0]))]
