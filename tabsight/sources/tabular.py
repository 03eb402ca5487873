"""Tabular sources and sinks.

CSV reading keeps pandas' visible rules: header names de-duplicated as
``a, a_1`` (read from the header line before Spark renames anything), rows
with too many fields skipped, short rows null-filled, the usual NA tokens
read as null, and column types inferred from all values with one aggregate.
"""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.errors import InputError
from tabsight.functions.exprs import col
from tabsight.operators import validate
from tabsight.operators.quality import NUMERIC_TEXT
from tabsight.sources.quoted_csv import parse_records, quoted_breaks, read_records

# pandas' default missing-value tokens.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
DETECT_IMAGE_PATTERN = r"(?i)\.(png|jpe?g)$"
OVERFLOW = "_overflow_"
INT_TEXT = r"^\s*[+-]?\d+\s*$"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, else ISO-8859-1 (which never fails)."""
    lines = spark.read.text(path)
    bad = lines.where(~F.is_valid_utf8(F.col("value"))).limit(1).count()
    return "UTF-8" if bad == 0 else "ISO-8859-1"


def decoded(value: Column, encoding: str) -> Column:
    """Lines of the text source, which hands out a file's bytes as they are, in the given encoding."""
    return value if encoding == "UTF-8" else F.decode(value.cast("binary"), encoding)


def detect_csv(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding, and whether a quoted field holds a line break, in one scan.

    A line with an odd number of quotes begins or ends such a field.
    """
    value = F.col("value")
    row = spark.read.text(path).agg(
        F.count_if(~F.is_valid_utf8(value)).alias("bad"), F.count_if(quoted_breaks(value)).alias("open")
    ).first()
    return "ISO-8859-1" if row["bad"] else "UTF-8", row["open"] > 0


def _header(spark: SparkSession, path: str, encoding: str) -> list[str]:
    lines = spark.read.text(path).select(decoded(F.col("value"), encoding).alias("value")).limit(100).collect()  # a header's lines
    if not lines:
        raise InputError(f"No data in CSV '{path}'.")
    return next(csv.reader(io.StringIO("\n".join(r["value"] for r in lines))))


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns to long / double / boolean when every value parses (one aggregate)."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = col(c)
        # pattern checks first: a failed cast is costly, a regex test is not
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count(F.when(v.rlike(INT_TEXT), v.try_cast("bigint"))).alias(f"l{i}"),
            F.count(F.when(v.rlike(NUMERIC_TEXT), v.try_cast("double"))).alias(f"d{i}"),
            F.count(F.when(v.isin(TRUE_TOKENS + FALSE_TOKENS), 1)).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        v = col(c)
        if n > 0 and row[f"l{i}"] == n:
            out.append(v.try_cast("bigint").alias(c))
        elif n > 0 and row[f"d{i}"] == n:
            out.append(v.try_cast("double").alias(c))
        elif n > 0 and row[f"b{i}"] == n:
            out.append(v.isin(TRUE_TOKENS).alias(c))
        else:
            out.append(v)
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with pandas-like header, NA and bad-line handling.

    Files are split over tasks whether or not quoted fields hold line breaks;
    where some do, ``quoted_csv`` finds the records first.
    """
    encoding, multi_line = detect_csv(spark, path)
    names = validate.dedupe_names(_header(spark, path, encoding))
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))] +
                          [T.StructField(OVERFLOW, T.StringType())])
    options = {"mode": "PERMISSIVE", "escape": '"'}
    if multi_line:
        records = read_records(spark, path, lambda value: decoded(value, encoding))
        raw = parse_records(records, schema.toDDL(), options)
    else:
        raw = spark.read.options(**options).option("header", True).option("encoding", encoding).schema(schema).csv(path)
    # a filled overflow field means the row had too many fields: skip it
    kept = raw.where(F.col(OVERFLOW).isNull()).drop(OVERFLOW)
    na = F.array(*[F.lit(x) for x in NA_TOKENS])
    cleaned = kept.select(
        *[F.when(F.array_contains(na, F.col(f"_c{i}")) | F.col(f"_c{i}").isNull(), F.lit(None)).otherwise(F.col(f"_c{i}")).alias(n)
          for i, n in enumerate(names)]
    )
    return infer_types(cleaned) if infer else cleaned


def clean_tabular(df: DataFrame) -> DataFrame:
    """Drop ``Unnamed…`` columns and all-null rows."""
    keep = [c for c in df.columns if not c.startswith("Unnamed")]
    out = df.select(*[col(c) for c in keep])
    return out.dropna(how="all")


def read_tabular(spark: SparkSession, path: str, require_target: bool = True) -> DataFrame:
    """Read CSV or Parquet, clean it and check its shape."""
    validate.require_source(spark, path)
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        df = read_csv(spark, path)
    elif low.endswith(".parquet") or "." not in low.rsplit("/", 1)[-1]:
        df = spark.read.parquet(path)
    elif low.endswith(".xlsx"):
        raise InputError("XLSX has no Spark reader; convert it to CSV or Parquet.")
    else:
        raise InputError(f"'{path}' is neither .csv nor .parquet.")
    df = clean_tabular(df)
    validate.require_shape(
        df,
        min_rows=validate.MIN_TRAIN_ROWS if require_target else 1,
        min_columns=2 if require_target else 1,
        purpose="training" if require_target else "prediction",
    )
    return df


def text_like_schema(df: DataFrame) -> bool:
    """Exactly two columns, both non-numeric (the 'two text columns' rule)."""
    from tabsight.functions.exprs import is_numeric_type

    fields = df.schema.fields
    return len(fields) == 2 and all(not is_numeric_type(f.dataType) for f in fields)


def image_share(paths: DataFrame, path_col: str = "path") -> Column:
    """Share of entries with an image extension (an aggregate expression)."""
    return F.avg(F.when(F.col(path_col).rlike(DETECT_IMAGE_PATTERN), 1.0).otherwise(0.0))


def listing_type(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``n_files, image_share, dataset_type`` of a listing of files: one row.

    ``image`` from half the entries on; else, and for an empty listing, ``unknown``.
    """
    row = paths.agg(F.count(F.lit(1)).alias("n_files"), image_share(paths, path_col).alias("image_share"))
    return row.select("n_files", "image_share", F.when(F.col("image_share") >= 0.5, "image").otherwise("unknown").alias("dataset_type"))


def detect_dataset_type(spark: SparkSession, path: str) -> str:
    """``tabular | text | image | unknown``."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv") or low.endswith(".parquet"):
        try:
            df = read_csv(spark, path, infer=True) if low.endswith(".csv") else spark.read.parquet(path)
            return "text" if text_like_schema(df) else "tabular"
        except Exception:
            return "tabular"
    if low.endswith(".txt"):
        return "text"
    if "." not in low.rsplit("/", 1)[-1]:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
        return listing_type(listing).first()["dataset_type"]
    return "unknown"


def preview(df: DataFrame, order_cols: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in key order (S12): a TakeOrdered."""
    return df.orderBy(*order_cols).limit(n)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write predictions (S13); CSV gets a header like ``index,predicted_class,label``."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
