"""Target labels, training sets and their checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.config import BUY, CART, ELIGIBLE, Snapshot
from clientpulse.functions import forbidden_columns, in_history, in_target, label_like
from clientpulse.operators.checks import Check, check_table, none_of, per_client

# The rule as the check reports it, and below the names of the checks.
BOUNDARY_RULE = "event_ts >= cutoff_date and event_ts < date_add(target_end, 1)"


def guard_features(features: DataFrame) -> DataFrame:
    """Refuse a feature table that already carries label-like columns."""
    flagged = label_like(c for c in features.columns if c != "client_id")
    if flagged:
        raise ValueError("feature table contains label-like columns: " + ", ".join(flagged))
    return features


def eligible(features: DataFrame) -> DataFrame:
    return features.where(F.col(ELIGIBLE) == 1)


def label_columns(snapshot: Snapshot) -> list[Column]:
    count = F.coalesce("target_event_count", F.lit(0)).cast("bigint")
    return [
        F.col("client_id"),
        F.when(count > 0, 1).otherwise(0).alias("label"),
        F.lit(snapshot.cutoff).alias("target_window_start"),
        F.lit(snapshot.target_end).alias("target_window_end"),
        count.alias("target_event_count"),
    ]


def build_labels(features: DataFrame, events: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Label of each eligible client of a feature table: 1 with at least one
    purchase in the target window."""
    purchases = (
        events.where((F.col("event_type") == BUY) & in_target(snapshot.cutoff, snapshot.target_end))
        .groupBy("client_id")
        .agg(F.count("*").alias("target_event_count"))
    )
    cohort = eligible(guard_features(features)).select("client_id")
    return cohort.join(purchases, "client_id", "left").select(*label_columns(snapshot))


def labels_from_events(events: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The same labels straight from events: eligibility and target purchases
    are two counters of one aggregation, so no feature table and no join."""
    kind = F.col("event_type")
    history = kind.isin(CART, BUY) & in_history(snapshot.cutoff)
    target = (kind == BUY) & in_target(snapshot.cutoff, snapshot.target_end)
    return (
        events.where(kind.isin(CART, BUY) & (history | target) & F.col("client_id").isNotNull())
        .groupBy("client_id")
        .agg(F.max(history).alias("in_cohort"), F.count_if(target).alias("target_event_count"))
        .where("in_cohort")
        .select(*label_columns(snapshot))
    )


def labels_of_snapshots(events: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """Client, label and snapshot of the eligible clients of each snapshot, from one pass."""
    kind = F.col("event_type")
    aggregates, used = [], F.lit(False)
    for i, s in enumerate(snapshots):
        history, target = in_history(s.cutoff), (kind == BUY) & in_target(s.cutoff, s.target_end)
        used = used | history | target
        count = F.count_if(target)
        aggregates.append(
            F.struct(
                F.max(history).alias("in_cohort"), F.when(count > 0, 1).otherwise(0).alias("label"), F.lit(s.name).alias("snapshot")
            ).alias(f"of_{i}")
        )
    found = events.where(kind.isin(CART, BUY) & used & F.col("client_id").isNotNull()).groupBy("client_id").agg(*aggregates)
    rows = F.array(*(F.col(f"of_{i}") for i in range(len(snapshots))))
    return found.select("client_id", F.inline(rows)).where("in_cohort").drop("in_cohort")


def buyers_of_snapshots(events: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """Client and snapshot of everyone with a purchase in the target window of a snapshot.
    Reads nothing outside the windows: who is eligible is known from the features."""
    within = [in_target(s.cutoff, s.target_end) for s in snapshots]
    bought = events.where((F.col("event_type") == BUY) & reduce(or_, within) & F.col("client_id").isNotNull())
    found = bought.groupBy("client_id").agg(*(F.max(hit).alias(f"in_{i}") for i, hit in enumerate(within)))
    names = F.array_compact(F.array(*(F.when(F.col(f"in_{i}"), F.lit(s.name)) for i, s in enumerate(snapshots))))
    return found.select("client_id", F.explode(names).alias("snapshot"))


def training_rows(features: DataFrame, buyers: DataFrame) -> DataFrame:
    """``training_set`` from the features and the clients who bought in the target window."""
    cohort, bought = eligible(guard_features(features)), buyers.select("client_id", F.lit(1).alias("label"))
    return cohort.join(bought, "client_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of the eligible clients with their label as last column."""
    return eligible(features).join(labels.select("client_id", "label"), "client_id")


def label_checks(
    features: DataFrame,
    labels: DataFrame,
    training: DataFrame,
    expected_eligible: int | None = None,
    expected_positive: int | None = None,
) -> DataFrame:
    """Six label and five training checks. The three tables are reduced to one
    row per client, counted together and checked in a single aggregation."""
    label = F.col("label")
    tables = {
        "features": eligible(features).select("client_id", F.lit(None).cast("int").alias("label")),
        "labels": labels.select("client_id", "label"),
        "training": training.select("client_id", "label"),
    }
    parts = None
    for name, df in tables.items():
        part = per_client(
            df,
            F.count_if(label == 1).alias("positives"),
            F.count_if(label.isNull()).alias("nulls"),
            F.count_if(label.isNull() | ~label.isin(0, 1)).alias("invalid"),
        ).withColumn("source", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)

    def total(source: str, column: str, alias: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("source") == source, F.col(column))), F.lit(0)).alias(alias)

    def repeated(source: str, alias: str) -> Column:
        return F.count_if((F.col("source") == source) & (F.col("rows") > 1)).alias(alias)

    summary = parts.agg(
        total("features", "rows", "eligible_rows"),
        total("labels", "rows", "label_rows"),
        total("labels", "positives", "positives"),
        total("labels", "nulls", "label_nulls"),
        total("labels", "invalid", "label_invalid"),
        repeated("labels", "label_duplicates"),
        total("training", "rows", "training_rows"),
        total("training", "nulls", "training_nulls"),
        repeated("training", "training_duplicates"),
    )

    def matches(column: str, expected: int | None) -> Column:
        return F.lit(True) if expected is None else F.col(column) == expected

    def text(value: int | None) -> str:
        return "" if value is None else str(value)

    positives_match = (
        F.lit(True) if expected_positive is None else F.abs(F.col("positives") - expected_positive) <= 1
    )
    leaks = forbidden_columns(training, "training")
    n_features = len([c for c in features.columns if c != "client_id"])
    return check_table(
        summary,
        [
            Check(
                "label_row_count_equals_eligible_cohort_count",
                (F.col("label_rows") == F.col("eligible_rows")) & matches("eligible_rows", expected_eligible),
                F.col("label_rows"),
                text(expected_eligible),
                "Only eligible clients have labels.",
            ),
            Check(
                "positive_count_matches_expected",
                positives_match,
                F.col("positives"),
                text(expected_positive),
                "Positive clients buy in the target window.",
            ),
            none_of("label_values_only_0_or_1", "label_invalid", "Labels are binary."),
            none_of("no_null_labels", "label_nulls", "Every eligible client has a label."),
            none_of("no_duplicate_client_id_in_label_table", "label_duplicates", "One label per client."),
            Check(
                "target_window_boundary_rule_documented",
                F.lit(True),
                F.lit(BOUNDARY_RULE),
                BOUNDARY_RULE,
                "Half-open window that contains the whole last day.",
            ),
            Check(
                "training_row_count_equals_label_row_count",
                F.col("training_rows") == F.col("label_rows"),
                F.col("training_rows"),
                F.col("label_rows"),
                "Every label meets exactly one feature row.",
            ),
            Check("feature_count_used", F.lit(True), F.lit(n_features), n_features, "Columns other than client_id."),
            none_of("no_duplicate_client_id_in_training_dataset", "training_duplicates", "One row per client."),
            none_of("no_null_labels_in_training_dataset", "training_nulls", "Every training row is labelled."),
            Check(
                "no_prediction_or_model_columns",
                F.lit(not leaks),
                F.lit(",".join(leaks)),
                "",
                "Training data carries no model output.",
            ),
        ],
    )
