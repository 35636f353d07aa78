"""Batch scores, their checks, the serving export and lookups."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from clientpulse.config import SCORE_THRESHOLD, SEED
from clientpulse.functions import forbidden_columns, require_columns
from clientpulse.operators.checks import Check, check_table, none_of, per_client
from clientpulse.operators.distribution import smallest_key_cutoff
from clientpulse.operators.labels import eligible
from clientpulse.operators.model import score
from clientpulse.sources.readers import sample_rows
from clientpulse.sources.sinks import SCORE_BUCKETS, client_bucket

# Columns of the score table.
SCORE_COLUMNS = ("client_id", "prediction_score", "prediction_label", "model_version", "scored_at")

INTEGER_BITS = {"byte": 8, "short": 16, "integer": 32, "long": 64}


def as_scores(scored: DataFrame, version: str, scored_at: str, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    return scored.select(
        "client_id",
        "prediction_score",
        (F.col("prediction_score") >= float(threshold)).cast("int").alias("prediction_label"),
        F.lit(version).alias("model_version"),
        F.lit(scored_at).alias("scored_at"),
    )


def batch_score(
    model: PipelineModel, features: DataFrame, version: str, scored_at: str, threshold: float = SCORE_THRESHOLD
) -> DataFrame:
    """Scores of all eligible clients, with version and time of scoring."""
    return as_scores(score(model, eligible(features)), version, scored_at, threshold)


def score_checks(scores: DataFrame, eligible_rows: DataFrame, loaded: bool = True, written: bool = True) -> DataFrame:
    """Eleven checks of a score table against its eligible input, one pass over each."""
    value = F.col("prediction_score")
    label = F.col("prediction_label")
    clients = per_client(
        scores,
        F.count_if(value.isNull()).alias("null_scores"),
        F.count_if((value < 0) | (value > 1)).alias("out_of_range"),
        F.count_if(label.isNull() | ~label.isin(0, 1)).alias("bad_labels"),
        F.count_if(F.col("model_version").isNull()).alias("null_versions"),
        F.count_if(F.col("scored_at").isNull()).alias("null_times"),
    )
    sums = ("rows", "null_scores", "out_of_range", "bad_labels", "null_versions", "null_times")
    summary = clients.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.count_if(F.col("rows") > 1).alias("duplicates")
    ).withColumn("eligible", eligible_rows.agg(F.count("*")).scalar())
    leaks = forbidden_columns(scores, "scores")
    # fixed values: the names of the checks
    return check_table(
        summary,
        [
            Check(
                "output_row_count_equals_eligible_input_row_count",
                F.col("rows") == F.col("eligible"),
                F.col("rows"),
                F.col("eligible"),
                "One score per eligible client.",
            ),
            none_of("no_null_prediction_score", "null_scores", "Every row has a score."),
            none_of("prediction_score_in_0_1", "out_of_range", "Scores are probabilities."),
            none_of("prediction_label_values_only_0_or_1", "bad_labels", "Labels are the thresholded score."),
            none_of("no_duplicate_client_id", "duplicates", "One row per client."),
            none_of("model_version_non_null", "null_versions", "Every row names its model."),
            none_of("scored_at_non_null", "null_times", "Every row names its time."),
            Check(
                "no_label_column_in_score_output",
                F.lit("label" not in scores.columns),
                F.lit("label" in scores.columns),
                "false",
                "Labels are not served.",
            ),
            Check(
                "no_target_window_metadata_in_score_output",
                F.lit(not leaks),
                F.lit(",".join(leaks)),
                "",
                "Target-window columns are not served.",
            ),
            Check("model_loaded_successfully", F.lit(loaded), F.lit(loaded), "true", "The model was read."),
            Check("score_table_written_successfully", F.lit(written), F.lit(written), "true", "The table was written."),
        ],
    )


def serving_export(
    scores: DataFrame,
    limit: int | None = None,
    fraction: float | None = None,
    seed: int = SEED,
    key: str = "client_id",
) -> DataFrame:
    """The rows to serve, keyed by client as text; null or repeated keys are refused.

    ``limit`` keeps the clients with the smallest ids. The last id to keep is
    found from counts, so that no task has to sort or hold ``limit`` rows."""
    rows = sample_rows(require_columns(scores, SCORE_COLUMNS), fraction, seed).select(*SCORE_COLUMNS)
    if limit is not None:
        if limit <= 0:
            raise ValueError("limit must be positive")
        # rows without a key stay in, for the null check below to refuse
        rows = rows.where(F.col(key).isNull() | (F.col(key) <= F.lit(smallest_key_cutoff(rows, key, limit))))
    any_null = F.greatest(*(F.col(c).isNull().cast("int") for c in SCORE_COLUMNS)) == 1
    problems = (
        per_client(rows, F.count_if(any_null).alias("nulls"))
        .agg(F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"), F.count_if(F.col("rows") > 1).alias("duplicates"))
        .first()
    )
    if problems.nulls:
        raise ValueError(f"{problems.nulls} rows have nulls in served columns")
    if problems.duplicates:
        raise ValueError(f"{problems.duplicates} clients have more than one row")
    return rows.withColumn("client_id", F.col("client_id").cast("string"))


def lookup(scores: DataFrame, ids: Sequence[str | int] | DataFrame, buckets: int = SCORE_BUCKETS) -> DataFrame:
    """Score rows of the given clients; unknown clients give no row.

    A list becomes a pushed-down filter, also on the bucket column of a table
    written with ``write_scores``; a DataFrame of ids becomes a semi join."""
    kind = scores.schema["client_id"].dataType
    bucketed = "client_bucket" in scores.columns
    if isinstance(ids, DataFrame):
        text = F.col("client_id").cast("string")
        wanted = ids.select(text.try_cast(kind).alias("__id"), client_bucket(text, buckets).alias("__bucket")).distinct()
        same = F.col("client_id") == F.col("__id")
        if bucketed:
            same = same & (F.col("client_bucket") == F.col("__bucket"))
        return scores.join(wanted, same, "left_semi").select(*SCORE_COLUMNS)
    values = [str(i) for i in ids]
    if not values:
        return scores.limit(0).select(*SCORE_COLUMNS)
    if isinstance(kind, IntegralType):
        # text that is no number of this type is nobody's id
        most = 2 ** (INTEGER_BITS[kind.typeName()] - 1)
        parts = (re.fullmatch(r"(-?)0*([0-9]{1,19})", v) for v in values)
        typed = [n for p in parts if p and -most <= (n := int(p[1] + p[2])) < most]
    else:
        typed = values
    found = scores.where(F.col("client_id").isin(*typed)) if typed else scores.limit(0)
    if bucketed:
        # hashes of literals: the optimiser folds them, and the scan is pruned by partition
        found = found.where(F.col("client_bucket").isin(*(client_bucket(F.lit(v), buckets) for v in dict.fromkeys(values))))
    return found.select(*SCORE_COLUMNS)
