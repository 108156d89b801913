from pyspark.sql import functions as F

RAW_SCHEMA = "row_key struct<pos:int>, `Name 1` string, Material string, `Material Description` string, " \
             "`Document Date` string, Quantity string, Amount string"


def raw_rows(spark, rows, depot="D1"):
    """rows: (material, date, qty, amount[, description[, depot]]) -> raw frame."""
    out = []
    for i, r in enumerate(rows):
        m, d, q, a = r[:4]
        desc = r[4] if len(r) > 4 else (f"desc {m}" if m is not None else None)
        dep = r[5] if len(r) > 5 else depot
        out.append(({"pos": i}, dep, m, desc, d, q, a))
    return spark.createDataFrame(out, RAW_SCHEMA)


def by_key(df, key="material_number"):
    return {r[key]: r.asDict() for r in df.collect()}
