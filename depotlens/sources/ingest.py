"""Scan a movement table, resolve its columns to roles, profile it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from depotlens.functions.groups import attach_group

# Accepted source column names per role, highest priority first.
ROLE_NAMES: dict[str, list[str]] = {
    "date": ["Document Date", "Posting Date", "Document_Date", "Posting_Date",
             "document_date", "posting_date", "transaction_date"],
    "quantity": ["Quantity", "Qty", "Qty in unit of entry", "Consumption_Qty",
                 "quantity", "qty", "consumption_qty"],
    "material": ["Material", "Material Number", "Item", "Part", "Product",
                 "material", "material_number", "item", "part"],
    "description": ["Material Description", "Item Description", "Product Description", "Description",
                    "material_description", "item_description", "description"],
    "amount": ["Amount", "Price", "Total Amount", "Total Price",
               "amount", "price", "total_amount", "total_price"],
}
REQUIRED_ROLES = ["date", "quantity", "material", "amount"]
DEPOT_COLUMN = "Name 1"


class MissingColumnsError(ValueError):
    pass


class EmptySourceError(ValueError):
    pass


def scan_movements(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType | None = None, key_columns: list[str] | None = None, **options) -> DataFrame:
    """Read a movement table from any Spark source.

    Parquet and ORC keep their own schema.  CSV (with a header) and JSON are read as
    text columns: by ``schema`` if given, else every column that the files name, all as strings.
    ``key_columns`` name columns that define the order of rows; they become ``row_key``.  Without them rows are keyed by their place:
    in Parquet by file and row index, in other formats by file, the byte at which their split of the file begins, and
    their place in the reading task, which grows within a split.  However a scan is split, the keys sort rows in the order of
    the files; only Parquet's also name the same row in two scans that are split differently.
    """
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}), **options)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "json":
        reader = reader.option("primitivesAsString", "true")
    df = reader.load(path)  # csv without inferSchema: all strings
    if key_columns:
        return df.withColumn("row_key", F.struct(*[F.col(f"`{c}`") for c in key_columns]))
    if "row_key" in df.columns:
        return df
    file = F.col("_metadata.file_path").alias("file")
    if fmt == "parquet":
        return df.withColumn("row_key", F.struct(file, F.col("_metadata.row_index").alias("row")))
    return df.withColumn("row_key", F.struct(file, F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")))


def row_numbers(raw: DataFrame) -> DataFrame:
    """``raw`` of a text format, scanned without ``key_columns``, with its keys as (file, row index in the file), as Parquet has them.

    Rows are counted per split; the counts of a file's earlier splits are what a split starts from.  A second scan, which has to be split like the first:
    both are parts of one plan over the same files.
    """
    key = F.struct(F.col("row_key.file").alias("file"), F.col("row_key.split").alias("split"))
    splits = raw.groupBy(key.alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.min("row_key.row").alias("_first"))
    earlier = Window.partitionBy("_s.file").orderBy("_s.split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_s", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("row_key.row") - F.col("_first")).alias("row")
    numbered = attach_group(raw.withColumn("_s", key), starts, ["_s"])
    return numbered.withColumn("row_key", F.struct("row_key.file", place)).drop("_s", "_first", "_before")


def require_rows(df: DataFrame) -> DataFrame:
    """S1 empty check: fail on a source with no rows (one-row probe job)."""
    if df.isEmpty():
        raise EmptySourceError("no data found in the movement source")
    return df


def resolve_columns(columns: list[str]) -> dict[str, str | None]:
    """Map source columns to roles (driver-side, schema metadata only).

    Every (role, column) pair gets a rank and each role takes its best: an accepted
    name (case ignored) ranks by its place in the list, and of columns that differ in case only the later
    one leads; a column whose name holds the role word ranks after all of those, earlier columns first.
    """
    def rank(role: str, place: int, column: str) -> tuple | None:
        accepted = [n.casefold() for n in ROLE_NAMES[role]]
        name = column.casefold()
        if name in accepted:
            return (0, accepted.index(name), -place)
        return (1, place, 0) if role in name else None

    ranked = {role: [(r, c) for i, c in enumerate(columns) if (r := rank(role, i, c)) is not None] for role in ROLE_NAMES}
    return {role: min(found)[1] if found else None for role, found in ranked.items()}


def require_columns(roles: dict[str, str | None]) -> dict[str, str | None]:
    """S3: error naming the missing mandatory roles."""
    missing = [r for r in REQUIRED_ROLES if not roles.get(r)]
    if missing:
        raise MissingColumnsError("no source column for " + ", ".join(missing))
    return roles


def profile_source(raw: DataFrame, n_rows: int = 5, n_descriptions: int = 10) -> DataFrame:
    """One flat profile table ``(section, item, value)``.

    Row count, column list, resolved roles, rows per depot, the first rows and
    the first descriptions in input order.  Everything is an aggregate or an
    ordered limit (per-partition top-k, then merge): nothing unbounded reaches
    one task.
    """
    spark = raw.sparkSession
    roles = resolve_columns([c for c in raw.columns if c != "row_key"])
    meta = [("column", f"{i:03d}", c) for i, c in enumerate(c for c in raw.columns if c != "row_key")]
    meta += [("role", r, roles[r] if roles[r] else "") for r in ROLE_NAMES]
    meta_df = spark.createDataFrame(meta, "section string, item string, value string")
    parts = [meta_df, raw.agg(F.lit("rows").alias("section"), F.lit("count").alias("item"),
                              F.count(F.lit(1)).cast("string").alias("value"))]
    if DEPOT_COLUMN in raw.columns:
        parts.append(raw.groupBy(F.col(DEPOT_COLUMN).alias("item")).agg(F.count(F.lit(1)).cast("string").alias("value"))
                     .select(F.lit("depot").alias("section"), F.coalesce("item", F.lit("")).alias("item"), "value"))
    desc = roles.get("description")
    cols = [c for c in raw.columns if c != "row_key"]
    # row_number runs after the ordered limit, over at most n_rows rows.
    first = raw.orderBy("row_key").limit(n_rows)
    first = first.withColumn("_rn", F.row_number().over(Window.orderBy("row_key")))
    parts.append(first.select(F.lit("first_row").alias("section"), F.format_string("%03d", "_rn").alias("item"),
                              F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols]).alias("value")))
    if desc:
        fd = raw.orderBy("row_key").limit(n_descriptions)
        fd = fd.withColumn("_rn", F.row_number().over(Window.orderBy("row_key")))
        parts.append(fd.select(F.lit("first_description").alias("section"), F.format_string("%03d", "_rn").alias("item"),
                               F.coalesce(F.col(f"`{desc}`"), F.lit("")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
