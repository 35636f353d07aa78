"""Time and validity predicates as plain comparisons that Parquet can push down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day(value: str) -> Column:
    return F.lit(value).cast("date")


def midnight(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def with_event_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Parse the event time; unreadable text gives null, also under ANSI mode."""
    return df.withColumn("event_ts", F.try_to_timestamp(F.col(column).cast("string"))).withColumn(
        "event_date", F.to_date("event_ts")
    )


def in_history(cutoff: str, days: int | None = None, grain: str = "date") -> Column:
    """Before the cutoff; with ``days``, only the ``days`` days that end there."""
    if grain == "date":
        column, edge = F.col("event_date"), day(cutoff)
        start = F.date_sub(edge, days) if days is not None else None
    elif grain == "ts":
        column, edge = F.col("event_ts"), midnight(cutoff)
        start = F.date_sub(day(cutoff), days).cast("timestamp") if days is not None else None
    else:
        raise ValueError(f"grain must be 'date' or 'ts', not {grain!r}")
    return column < edge if start is None else (column < edge) & (column >= start)


def in_target(cutoff: str, target_end: str) -> Column:
    """From the cutoff to the end of the ``target_end`` day."""
    return (F.col("event_ts") >= midnight(cutoff)) & (
        F.col("event_ts") < F.date_add(day(target_end), 1).cast("timestamp")
    )


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null, not an error, where the denominator is zero or missing."""
    return F.when(denominator > 0, numerator / denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(safe_ratio(numerator, denominator), F.lit(0.0))
