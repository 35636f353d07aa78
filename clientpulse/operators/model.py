"""Logistic regression on client features: split, fit, score, model card."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clientpulse.config import MAX_ITER, SCORE_THRESHOLD, SEED
from clientpulse.functions import feature_columns

WEIGHT = "class_weight"


def with_class_weight(df: DataFrame) -> DataFrame:
    """Weight both classes equally: n / (2 * rows of the class)."""
    positive = F.col("label") == 1
    counts = df.agg(
        (F.count("*") / (2 * F.count_if(positive))).alias("pos"),
        (F.count("*") / (2 * F.count_if(~positive))).alias("neg"),
    )
    weights = counts.select(F.struct("pos", "neg")).scalar()
    return (
        df.withColumn("__w", weights)
        .withColumn(WEIGHT, F.when(positive, F.col("__w.pos")).otherwise(F.col("__w.neg")))
        .drop("__w")
    )


def split(df: DataFrame, train_percent: int = 80, seed: int = SEED, key: str = "client_id") -> tuple[DataFrame, DataFrame]:
    """Random split by a hash of the client: a client's side does not depend on
    partitioning, order or retries."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    return df.where(draw < train_percent), df.where(draw >= train_percent)


def temporal_split(train: DataFrame, validation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two snapshots as train and validation; both need the same feature columns."""
    if feature_columns(train) != feature_columns(validation):
        raise ValueError("train and validation feature columns differ")
    return train, validation


def as_doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Integer columns would be truncated by an imputed fraction."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def fit(train: DataFrame, columns: Sequence[str], max_iter: int = MAX_ITER, weighted: bool = True) -> PipelineModel:
    """Median imputation, assembly and a standardised logistic regression."""
    prepared = as_doubles(with_class_weight(train) if weighted else train, columns)
    filled = [f"{c}__imputed" for c in columns]
    regression = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, standardization=True)
    if weighted:
        regression = regression.setWeightCol(WEIGHT)
    stages = [
        Imputer(inputCols=list(columns), outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="features"),
        regression,
    ]
    return Pipeline(stages=stages).fit(prepared)


def model_columns(model: PipelineModel) -> list[str]:
    return list(model.stages[0].getInputCols())


def score(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    """``client_id``, the probability of class 1, and the columns to ``keep``."""
    kept = keep or tuple(c for c in ("label",) if c in df.columns)
    # Kept columns go in under their own type; the model sees double copies.
    inputs = df.select("client_id", F.struct(*kept).alias("__kept") if kept else F.lit(None).alias("__kept"), *model_columns(model))
    scored = model.transform(as_doubles(inputs, model_columns(model)))
    return scored.select(
        "client_id", *(F.col(f"__kept.{c}").alias(c) for c in kept), vector_to_array("probability")[1].alias("prediction_score")
    )


def coefficient_table(model: PipelineModel, only: Sequence[str] | None = None) -> DataFrame:
    """Coefficient of each feature and its rank by absolute value."""
    rows = list(zip(model_columns(model), (float(c) for c in model.stages[-1].coefficients)))
    table = model.stages[0].surrogateDF.sparkSession.createDataFrame(rows, "feature_name string, coefficient double")
    rank = F.row_number().over(Window.orderBy(F.col("abs_coefficient").desc(), "feature_name"))
    ranked = table.withColumn("abs_coefficient", F.abs("coefficient")).withColumn("rank_among_all_features", rank)
    return ranked if only is None else ranked.where(F.col("feature_name").isin(*only))


def model_card(model: PipelineModel, version: str = "baseline_lr_v1", threshold: float = SCORE_THRESHOLD) -> dict[str, Any]:
    """All that is needed to score without the pipeline."""
    columns, regression = model_columns(model), model.stages[-1]
    medians = model.stages[0].surrogateDF.first().asDict()
    return {
        "model_version": version,
        "feature_order": columns,
        "coefficients": [float(c) for c in regression.coefficients],
        "intercept": float(regression.intercept),
        "threshold": threshold,
        "imputation_values": {c: float(medians[c]) for c in columns},
    }


def card_rows(df: DataFrame, card: Mapping[str, Any]) -> DataFrame:
    """A model card as a small table, intercept and threshold included."""
    rows = [
        (i, name, float(c), float(card["imputation_values"][name]))
        for i, (name, c) in enumerate(zip(card["feature_order"], card["coefficients"]))
    ]
    return (
        df.sparkSession.createDataFrame(rows, "position int, feature_name string, coefficient double, imputation_value double")
        .withColumn("intercept", F.lit(float(card["intercept"])))
        .withColumn("threshold", F.lit(float(card["threshold"])))
        .withColumn("model_version", F.lit(card["model_version"]))
    )


def check_card(card: Mapping[str, Any]) -> None:
    missing = [k for k in ("model_version", "feature_order", "coefficients", "intercept", "imputation_values") if k not in card]
    if missing:
        raise ValueError("model card is missing " + ", ".join(missing))
    if len(card["feature_order"]) != len(card["coefficients"]):
        raise ValueError("a model card needs one coefficient for each feature")
    unknown = [f for f in card["feature_order"] if f not in card["imputation_values"]]
    if unknown:
        raise ValueError("no imputation value for " + ", ".join(unknown))


def sigmoid(z: Column) -> Column:
    """The form whose exponential cannot overflow, for either sign."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def score_with_card(df: DataFrame, card: Mapping[str, Any]) -> DataFrame:
    """Score every row with a model card, as one column expression.

    Missing values and missing columns take the card's medians and are listed;
    a value that is not a finite number makes the row invalid: it gets no score
    and its bad features are listed instead."""
    check_card(card)
    present = set(df.columns)
    total = F.lit(float(card["intercept"]))
    filled, invalid = [], []
    for name, coefficient in zip(card["feature_order"], card["coefficients"]):
        default = F.lit(float(card["imputation_values"][name]))
        if name not in present:
            value = default
            filled.append(F.lit(name))
        else:
            raw = F.col(name)
            number = raw.try_cast(T.DoubleType())
            value = F.when(raw.isNull(), default).otherwise(number)
            filled.append(F.when(raw.isNull(), F.lit(name)))
            finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
            invalid.append(F.when(raw.isNotNull() & ~finite, F.lit(name)))
        total = total + value * F.lit(float(coefficient))
    none = F.array().cast("array<string>")
    bad = F.array_compact(F.array(*invalid)) if invalid else none
    threshold = float(card.get("threshold", SCORE_THRESHOLD))
    scored = (
        df.withColumn("missing_features_filled", F.array_compact(F.array(*filled)) if filled else none)
        .withColumn("invalid_features", bad)
        .withColumn("prediction_score", F.when(F.size("invalid_features") == 0, sigmoid(total)))
        .withColumn("prediction_label", (F.col("prediction_score") >= threshold).cast("int"))
    )
    return scored.withColumn(
        "decision",
        F.when(F.col("prediction_label") == 1, "likely_to_buy").when(
            F.col("prediction_label") == 0, "not_likely_to_buy"
        ),
    ).withColumn("model_version", F.lit(card["model_version"]))
