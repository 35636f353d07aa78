"""The stages of a scoring run. Stages hand over stored tables, so each can be
rerun on its own and none rebuilds the plan of another."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientpulse.config import EVENT_SPECS, FEATURE_SETS, MAX_ITER, SCORE_THRESHOLD, SEARCH, FeatureSet, Snapshot
from clientpulse.functions import feature_columns
from clientpulse.operators.checks import validate_modeling
from clientpulse.operators.experiments import evaluate
from clientpulse.operators.features import (
    add_recent_flag,
    add_transition_features,
    build_features,
    recency_thresholds,
    search_buckets,
    velocity_features,
)
from clientpulse.operators.labels import build_labels, label_checks, training_set
from clientpulse.operators.model import fit, score, split, temporal_split
from clientpulse.operators.prepare import duplicate_summary, observed_report, prepare_events, prepare_observed, prepare_products
from clientpulse.operators.serving import batch_score, score_checks, serving_export
from clientpulse.session import side_session
from clientpulse.sources import load_model, read_events, read_table, save_model, write_events, write_report, write_scores, write_table


def prepare(spark: SparkSession, raw: Mapping[str, str], products: str, out: str, include: Iterable[str] = (SEARCH,)) -> None:
    """Raw event and product tables to clean ones under ``out``, with reports of what was
    valid and what occurs twice. A raw table that is taken in is read once: its counters
    are observed while the clean rows are written, and duplicates are looked for in those."""
    side = side_session(spark)
    frames = {t: read_table(side, path, EVENT_SPECS[t].required) for t, path in raw.items()}
    clean, seen = prepare_observed(frames, include)
    write_events(clean, f"{out}/events")
    validation = observed_report(spark, seen)
    events = read_events(spark, f"{out}/events")
    duplicates = [
        duplicate_summary(events.where(F.col("event_type") == t), EVENT_SPECS[t].duplicate_key).select(F.lit(t).alias("event_type"), "*")
        for t in seen
    ]
    for t in sorted(set(frames) - set(seen)):
        # left out of the clean table: only its reports are wanted
        part = prepare_events(read_table(spark, raw[t], EVENT_SPECS[t].required), EVENT_SPECS[t])
        validation = validation.unionByName(part.report, True)
        duplicates.append(part.duplicates)
    write_report(validation, f"{out}/reports/validation")
    write_report(reduce(lambda a, b: a.unionByName(b, True), duplicates), f"{out}/reports/duplicates")
    clean, report = prepare_products(read_table(spark, products))
    write_table(clean, f"{out}/products")
    write_report(report, f"{out}/reports/products")


def snapshot(spark: SparkSession, base: str, snap: Snapshot) -> DataFrame:
    """Features, labels, training set and their checks of one snapshot."""
    events = read_events(spark, f"{base}/events")
    products = read_table(spark, f"{base}/products")
    root = f"{base}/snapshots/{snap.name}"
    write_table(build_features(events, products, snap, active_windows=(30,)), f"{root}/features_with_helpers")
    helpers = read_table(spark, f"{root}/features_with_helpers")
    features = helpers.drop("active_days_count_30d")
    labels = build_labels(features, events, snap)
    write_table(labels, f"{root}/labels")
    labels = read_table(spark, f"{root}/labels")
    write_table(training_set(features, labels), f"{root}/training")
    training = read_table(spark, f"{root}/training")
    write_report(label_checks(features, labels, training), f"{root}/checks")
    return training


def engineer(
    training: DataFrame, helpers: DataFrame, events: DataFrame, snap: Snapshot, fs: FeatureSet, thresholds=None
) -> DataFrame:
    """Add the engineered columns of a feature set to a training table."""
    df, wanted = training, set(fs.engineered)
    if "search_count_bucket" in wanted:
        df = search_buckets(df, thresholds or recency_thresholds(training))
    if "search_before_cart_count" in wanted:
        df = add_transition_features(df, events, snap.cutoff)
    elif "recent_search_then_cart_flag" in wanted:
        df = add_recent_flag(df, events, snap.cutoff)
    if any("velocity" in c for c in wanted):
        df = velocity_features(df.join(helpers.select("client_id", "active_days_count_30d"), "client_id"))
    return df


def train(
    training: DataFrame,
    validation: DataFrame | None = None,
    fs: FeatureSet = FEATURE_SETS["baseline"],
    max_iter: int = MAX_ITER,
) -> tuple[PipelineModel, dict]:
    """Fit and evaluate on a later snapshot, or on a random fifth of the clients."""
    validate_modeling(training, "training")
    if validation is None:
        fitted, held_out = split(training)
    else:
        validate_modeling(validation, "validation")
        fitted, held_out = temporal_split(training, validation)
    columns = fs.columns(feature_columns(training))
    model = fit(fitted, columns, max_iter)
    return model, evaluate(score(model, held_out))


def serve(
    spark: SparkSession,
    model_path: str,
    features: DataFrame,
    out: str,
    version: str,
    scored_at: str,
    threshold: float = SCORE_THRESHOLD,
    limit: int | None = None,
) -> DataFrame:
    """Score, check what was written, and export it bucketed for lookups."""
    write_table(batch_score(load_model(model_path), features, version, scored_at, threshold), f"{out}/scores")
    scores = read_table(spark, f"{out}/scores")
    checks = score_checks(scores, features.where("is_eligible_purchase_propensity = 1"))
    write_report(checks, f"{out}/checks")
    write_scores(serving_export(scores, limit), f"{out}/served")
    return checks


__all__ = ["engineer", "prepare", "save_model", "serve", "snapshot", "train"]
