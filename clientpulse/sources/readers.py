"""Table scans, format detection and the raw-directory inventory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientpulse.config import SEED
from clientpulse.functions import require_columns

# File-name patterns, first match wins.
FORMAT_PATTERNS = (
    (r"\.(tar\.gz|tgz)$", "tar.gz archive"),
    (r"\.csv\.gz$", "csv.gz"),
    (r"\.(json|jsonl|ndjson)\.gz$", "json.gz"),
    (r"\.parquet\.gz$", "parquet.gz"),
    (r"\.parquet(\.|$)", "parquet"),
    (r"\.csv(\.|$)", "csv"),
    (r"\.(json|jsonl|ndjson)(\.|$)", "json"),
    (r"\.gz$", "gzip compressed file"),
)
READERS = {"csv": "csv", "csv.gz": "csv", "json": "json", "json.gz": "json", "parquet": "parquet"}

SCHEMA_ROWS = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
    ]
)
INVENTORY_ROWS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("inferred_format", T.StringType()),
        T.StructField("readable_by_spark", T.BooleanType()),
        T.StructField("schema", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("row_count_status", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    return require_columns(spark.read.parquet(path), required)


def read_any(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV with a header, or JSON lines; gzip is read by extension.
    Pass ``schema`` for large text inputs: inference costs an extra full read."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if fmt == "json":
        return reader.json(path)
    raise ValueError(f"unsupported format {fmt!r}")


def read_events(spark: SparkSession, base: str, *event_types: str) -> DataFrame:
    """The clean event table; naming types prunes the scan to their partitions."""
    events = spark.read.parquet(base)
    return events.where(F.col("event_type").isin(*event_types)) if event_types else events


def sample_rows(df: DataFrame, fraction: float | None, seed: int = SEED) -> DataFrame:
    """Bernoulli row sample without replacement."""
    if fraction is None or fraction == 1.0:
        return df
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must be greater than 0 and at most 1")
    return df.sample(False, fraction, seed)


def infer_format(name: Column) -> Column:
    """Format label from a file name; an unknown extension is returned as it is."""
    name = F.lower(name)
    expr = F.when(name.rlike(FORMAT_PATTERNS[0][0]), F.lit(FORMAT_PATTERNS[0][1]))
    for pattern, label in FORMAT_PATTERNS[1:]:
        expr = expr.when(name.rlike(pattern), F.lit(label))
    extension = F.regexp_extract(name, r"\.([^./]+)$", 1)
    return expr.otherwise(F.when(extension == "", F.lit("unknown")).otherwise(extension))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and format of every file below ``root``; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size_bytes"), infer_format(F.col("path")).alias("inferred_format"))


def schema_rows(df: DataFrame, table_name: str) -> DataFrame:
    rows = [(table_name, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, SCHEMA_ROWS)


def row_count(df: DataFrame, size_bytes: int, limit: int | None = None) -> tuple[int | None, str]:
    """Count, unless the caller set a ``limit`` and the input is larger."""
    return (df.count(), "counted") if limit is None or size_bytes <= limit else (None, "deferred")


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Files grouped to datasets: the part files of a directory written by Spark,
    partitioned or not, are one dataset, any other file is its own."""
    dataset = F.regexp_replace("path", r"(/[^/=]+=[^/]+)*/part-[^/]+$", "")
    return (
        list_files(spark, root)
        .groupBy(dataset.alias("path"), "inferred_format")
        .agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"))
    )


def inventory(spark: SparkSession, root: str, max_count_bytes: int | None = None) -> DataFrame:
    """One row per dataset: can Spark read it, with which schema, how many rows. Counts
    are deferred only beyond a ``max_count_bytes`` that the caller sets. A broken one is reported in its own row and does not stop the others."""
    rows = []
    for item in list_datasets(spark, root).orderBy("path").toLocalIterator():
        fmt = READERS.get(item.inferred_format)
        schema, count, status, note = None, None, "not_available", None
        if fmt is None:
            note = f"no direct Spark reader for {item.inferred_format}"
        else:
            try:
                df = read_any(spark, item.path, fmt)
                schema = df.schema.json()
                count, status = row_count(df, item.size_bytes, max_count_bytes)
                if count is None:
                    note = f"larger than {max_count_bytes} bytes"
            except Exception as error:  # noqa: BLE001 - any reader failure belongs to this dataset alone
                kind = error.getCondition() if isinstance(error, PySparkException) else None
                schema, note = None, f"unreadable ({kind or type(error).__name__})"
        rows.append(
            (item.path, item.file_count, item.size_bytes, item.inferred_format, schema is not None, schema, count, status, note)
        )
    return spark.createDataFrame(rows, INVENTORY_ROWS)
