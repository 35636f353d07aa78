"""Parquet tables, small reports and stored models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientpulse.session import small_tasks

SCORE_BUCKETS = 256
ROW_GROUP_BYTES = 4 << 20


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    with small_tasks(df.sparkSession):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """One directory per event type, so that readers prune to the types they need."""
    write_table(events, path, "event_type")


def round_floats(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *(
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name)
            for f in df.schema.fields
        )
    )


def write_report(df: DataFrame, path: str, fmt: str = "csv", digits: int = 6) -> None:
    """A report of a few rows as one file. Not for row-level tables."""
    out = round_floats(df, digits).coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        out.option("header", True).csv(path)
    elif fmt == "json":
        out.json(path)
    else:
        raise ValueError(f"unsupported report format {fmt!r}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def client_bucket(client_id: Column, buckets: int = SCORE_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(client_id.cast("string")), F.lit(buckets)).cast("int")


def write_scores(
    scores: DataFrame, path: str, buckets: int = SCORE_BUCKETS, row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Scores in hash buckets of the client, so that a lookup opens only the buckets of the
    clients it asks for. Buckets are sorted by client and cut into small row groups with
    Bloom filters on the id, so of those it reads only the groups that may hold one."""
    table = scores.withColumn("client_bucket", client_bucket(F.col("client_id"), buckets))
    sorted_rows = table.repartition("client_bucket").sortWithinPartitions("client_bucket", "client_id")
    (
        sorted_rows.write.mode("overwrite")
        .partitionBy("client_bucket")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.bloom.filter.enabled#client_id", "true")
        # ids hardly repeat; without a dictionary the filter is always written
        .option("parquet.enable.dictionary#client_id", "false")
        .parquet(path)
    )


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
