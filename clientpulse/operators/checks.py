"""Check tables: named pass/fail rows computed in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.functions import require_columns


class Check(NamedTuple):
    name: str
    passed: Column
    observed: Column
    expected: Column | str | int
    notes: str


def check_table(summary: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Turn a one-row ``summary`` into one row per check."""

    def row(check: Check) -> Column:
        expected = check.expected if isinstance(check.expected, Column) else F.lit(check.expected)
        return F.struct(
            F.lit(check.name).alias("check_name"),
            F.when(check.passed, F.lit("pass")).otherwise(F.lit("fail")).alias("status"),
            check.observed.cast("string").alias("observed_value"),
            expected.cast("string").alias("expected_value"),
            F.lit(check.notes).alias("notes"),
        )

    return summary.select(F.inline(F.array(*(row(c) for c in checks))))


def none_of(name: str, count: str, notes: str) -> Check:
    """A check that a counter of the summary is zero."""
    return Check(name, F.col(count) == 0, F.col(count), 0, notes)


def per_client(df: DataFrame, *aggregates: Column, key: str = "client_id") -> DataFrame:
    """Group to the key first, so that row counts, duplicates and value checks
    of a keyed table need one shuffle of reduced rows and one pass."""
    return df.groupBy(key).agg(F.count("*").alias("rows"), *aggregates)


def modeling_summary(df: DataFrame) -> DataFrame:
    """Row, class, null, invalid and duplicate-client counters of a labelled table."""
    require_columns(df, ("client_id", "label"))
    label = F.col("label")
    clients = per_client(
        df,
        F.count_if(label == 1).alias("positives"),
        F.count_if(label.isNull()).alias("nulls"),
        F.count_if(label.isNull() | ~label.isin(0, 1)).alias("invalid"),
    )
    return clients.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positive_count"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("label_null_count"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_label_count"),
        F.count_if(F.col("rows") > 1).alias("duplicate_client_id_count"),
    ).select(
        "row_count",
        "positive_count",
        (F.col("row_count") - F.col("positive_count")).alias("negative_count"),
        F.when(F.col("row_count") > 0, F.col("positive_count") / F.col("row_count")).otherwise(0.0).alias("positive_rate"),
        "label_null_count",
        "invalid_label_count",
        "duplicate_client_id_count",
    )


def validate_modeling(df: DataFrame, name: str = "modelling") -> dict[str, float]:
    """The counters of :func:`modeling_summary`, or an error for unusable data."""
    summary = modeling_summary(df).first().asDict()
    if not (summary["positive_count"] and summary["negative_count"]):
        raise ValueError(f"{name} data must contain positive and negative rows")
    bad = [c for c in ("label_null_count", "invalid_label_count", "duplicate_client_id_count") if summary[c]]
    if bad:
        raise ValueError(f"{name} data failed: " + ", ".join(f"{c}={summary[c]}" for c in bad))
    return summary
