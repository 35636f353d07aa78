"""Every operator as a named query over the driver's tables.

A query takes (spark, sf_dir) and returns a DataFrame whose integers are
bigint and whose floats are rounded to six places, as its SQL counterpart in
``oracles.py`` has them. Queries that need the training table share one stored
copy per session, the way the stages of a run do."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientpulse.config import (
    BUY,
    CART,
    COMBINED_ABLATIONS,
    EVENT_SPECS,
    FEATURE_SETS,
    REMOVE,
    SEARCH,
    VELOCITY_GROUPS,
    VISIT,
    Snapshot,
    feature_families,
    feature_names,
)
from clientpulse.functions import feature_columns
from clientpulse.operators import audit, checks, cohorts, experiments, features, labels, metrics, model, paths, prepare
from clientpulse.operators import profile, serving, sketches, targets
from clientpulse.operators.distribution import long_form
from clientpulse.operators.score_index import ScoreIndex, build_index
from clientpulse.session import pin_time_zone, shared_dir, side_session, stable
from clientpulse.sources import fixtures as fx
from clientpulse.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
T_ = TypeVar("T_")
_stored: dict[tuple, Any] = {}

# A fixed card, so that scores do not depend on a fit.
CARD = {
    "model_version": "fixed_card_v1",
    "feature_order": ["product_buy_count", "days_since_last_product_buy", "add_to_cart_count_90d", "search_to_cart_ratio"],
    "coefficients": [0.03, -0.01, 0.2, -0.5],
    "intercept": -1.0,
    "threshold": 0.5,
    "imputation_values": {
        "product_buy_count": 0.0,
        "days_since_last_product_buy": 90.0,
        "add_to_cart_count_90d": 0.0,
        "search_to_cart_ratio": 0.25,
    },
}
SCORED_AT = "2024-01-01T00:00:00+00:00"
LOOKUP_IDS = (3, 7, 42, -1)
EXPORT_LIMIT = 100
PAIR = (fx.ORDERS_TRAIN, fx.ORDERS_SNAPSHOT)
SEARCH_LIMITS = (30, 90, 180)
BUCKETED = ("add_to_cart_count", "days_since_last_product_buy", "buy_to_cart_ratio", "active_days_count", "search_query_count")
TRANSITION_DAYS = 1
DECISION_RULES = ("not_worse", "gain", "review", "any_gain", "both_gain")
TRANSITION_RECENT = 3


def normalize(df: DataFrame) -> DataFrame:
    """Bigint integers and six-digit doubles; adding zero turns -0.0 into 0.0."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pin_time_zone(spark)
        return normalize(function(spark, sf_dir))

    QUERIES[function.__name__] = run
    return function


def stored_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], T_]) -> T_:
    """What ``build`` stores, once per session and state of the tables."""
    key = (spark.sparkContext.applicationId, sf_dir, table_stamp(spark, sf_dir), name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    return stored_once(spark, sf_dir, name, lambda: stable(build()))


def table_stamp(spark: SparkSession, sf_dir: str) -> int:
    """Changes when a table in the folder is written anew."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return max((e.getModificationTime() for e in entries), default=0)


def by_snapshot(
    spark: SparkSession, sf_dir: str, name: str, snaps: tuple[Snapshot, ...], build: Callable[[list[Snapshot]], DataFrame]
) -> list[DataFrame]:
    """The stored tables ``name`` of ``snaps``; those that are not stored yet come from one
    table with their names as its last column ``snapshot``."""
    keys = {s: (spark.sparkContext.applicationId, sf_dir, table_stamp(spark, sf_dir), f"{name}_{s.name}") for s in snaps}
    missing = [s for s in snaps if keys[s] not in _stored]
    if missing:
        table = stable(build(missing), "snapshot")
        for s in missing:
            _stored[keys[s]] = table.where(F.col("snapshot") == s.name).drop("snapshot")
    return [_stored[keys[s]] for s in snaps]


def feature_frames(spark: SparkSession, sf_dir: str, *snaps: Snapshot) -> list[DataFrame]:
    def build(missing: list[Snapshot]) -> DataFrame:
        return features.features_of_snapshots(
            fx.order_events(spark, sf_dir, timed=False), fx.products(spark, sf_dir), missing, active_windows=(30,)
        )

    return by_snapshot(spark, sf_dir, "features", snaps, build)


def feature_frame(spark: SparkSession, sf_dir: str, snap=fx.ORDERS_SNAPSHOT) -> DataFrame:
    return feature_frames(spark, sf_dir, snap)[0]


def training_frames(spark: SparkSession, sf_dir: str, *snaps: Snapshot) -> list[DataFrame]:
    def build(missing: list[Snapshot]) -> DataFrame:
        buyers = stable(labels.buyers_of_snapshots(fx.order_events(spark, sf_dir, BUY), missing))
        out = None
        for s, table in zip(missing, feature_frames(spark, sf_dir, *missing)):
            part = labels.training_rows(table.drop("active_days_count_30d"), buyers.where(F.col("snapshot") == s.name))
            part = part.withColumn("snapshot", F.lit(s.name))
            out = part if out is None else out.unionByName(part)
        return out

    return by_snapshot(spark, sf_dir, "training", snaps, build)


def training_frame(spark: SparkSession, sf_dir: str, snap=fx.ORDERS_SNAPSHOT) -> DataFrame:
    return training_frames(spark, sf_dir, snap)[0]


def carded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table scored with the fixed card, to six digits."""
    scored = model.score_with_card(training_frame(spark, sf_dir), CARD)
    return scored.withColumn("prediction_score", F.round("prediction_score", 6))


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.as_scores(fx.scored_orders(spark, sf_dir), "fixed_v1", SCORED_AT)


# --- profiles and preparation -------------------------------------------------


@query
def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(fx.raw_events(spark, sf_dir, CART), CART, exact=True)


@query
def profile_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of every raw event table; columns that a table has not are null."""
    out = None
    for t in EVENT_SPECS:
        part = profile.profile(fx.raw_events(spark, sf_dir, t), t, exact=True)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


@query
def table_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_overview({t: fx.raw_events(spark, sf_dir, t) for t in EVENT_SPECS})


@query
def event_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.event_overview(fx.stream_events(spark, sf_dir))


@query
def event_overview_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview from stored sketches of days: exact counts, and whether the estimates
    of distinct clients and entities are within the stated bound of the exact ones."""
    days = stored(spark, sf_dir, "daily_sketches", lambda: sketches.daily_sketches(fx.stream_events(spark, sf_dir)))
    exact = profile.event_overview(fx.stream_events(spark, sf_dir)).select(
        "event_type", *(F.col(c).alias(f"exact_{c}") for c in ("distinct_client_id_count", "distinct_entity_count"))
    )

    def near(column: str) -> Column:
        n = F.col(f"exact_{column}")
        return F.abs(F.col(column) - n) <= F.greatest(n * sketches.HLL_ERROR, F.lit(1.0))

    return sketches.overview_of_days(days).join(exact, "event_type").select(
        "event_type",
        "row_count",
        "null_client_id_count",
        "null_entity_count",
        F.date_format("ts_min", "yyyy-MM-dd HH:mm:ss").alias("timestamp_min"),
        F.date_format("ts_max", "yyyy-MM-dd HH:mm:ss").alias("timestamp_max"),
        near("distinct_client_id_count").alias("clients_in_bound"),
        near("distinct_entity_count").alias("entities_in_bound"),
    )


@query
def product_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.product_overview(fx.raw_products(spark, sf_dir))


@query
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quantiles(fx.repeated_products(spark, sf_dir), ["price", "category"], profile.PRICE_QUANTILES)


@query
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in EVENT_SPECS:
        part = prepare.validation_counts(fx.raw_events(spark, sf_dir, t), EVENT_SPECS[t])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


@query
def validation_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of ``validation_counts``, collected while the clean table is written."""
    side = side_session(spark)
    raw = {t: fx.raw_events(side, sf_dir, t) for t in EVENT_SPECS}
    clean, seen = prepare.prepare_observed(raw, include=(SEARCH, VISIT))
    stable(clean)
    return prepare.observed_report(spark, seen)


@query
def validation_of_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids delivered as text, some of them missing or no numbers, with the rows that the
    clean table keeps."""
    out = None
    for t in (CART, REMOVE, BUY):
        raw = fx.raw_text_events(spark, sf_dir, t)
        kept = prepare.standardize_events(raw, EVENT_SPECS[t]).agg(
            F.struct(F.count("*").alias("clean_rows"), F.sum("client_id").alias("client_id_sum"), F.sum("sku").alias("sku_sum"))
        )
        part = prepare.validation_counts(raw, EVENT_SPECS[t]).withColumn("kept", kept.scalar()).select("*", "kept.*").drop("kept")
        out = part if out is None else out.unionByName(part)
    return out


@query
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by (client, day, type): the driver's events repeat no moment."""
    return prepare.duplicate_summary(fx.stream_events(spark, sf_dir), ["client_id", "event_date", "event_type"])


@query
def duplicate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in EVENT_SPECS:
        part = prepare.prepare_events(fx.raw_events(spark, sf_dir, t), EVENT_SPECS[t]).duplicates
        out = part if out is None else out.unionByName(part)
    return out


@query
def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = {t: fx.raw_events(spark, sf_dir, t) for t in EVENT_SPECS}
    return prepare.prepare_all(raw, include=(SEARCH, VISIT))


@query
def clean_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.dedup_products(fx.repeated_products(spark, sf_dir))


@query
def product_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.product_validation(fx.repeated_products(spark, sf_dir))


@query
def metadata_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.metadata_profile(fx.repeated_products(spark, sf_dir), "raw")


@query
def metadata_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.repeated_products(spark, sf_dir)
    return prepare.metadata_consistency(raw, prepare.dedup_products(raw))


@query
def purchase_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.purchase_frequency(fx.order_events(spark, sf_dir, BUY))


# --- targets and cohorts ------------------------------------------------------


@query
def target_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.target_windows(fx.order_events(spark, sf_dir, BUY))


@query
def churn_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.churn_balance(fx.order_events(spark, sf_dir, CART, BUY))


@query
def target_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.target_comparison(fx.order_events(spark, sf_dir, CART, BUY))


@query
def recommend_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.recommend_target(targets.target_comparison(fx.order_events(spark, sf_dir, CART, BUY)))


@query
def recommend_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.recommend_window(targets.churn_balance(fx.order_events(spark, sf_dir, CART, BUY)))


@query
def active_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.active_cohorts(fx.order_events(spark, sf_dir, CART, BUY))


@query
def active_cohorts_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.active_cohorts(fx.stream_events(spark, sf_dir), days=(3, 7, 14), broad=True)


@query
def cohort_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohort_flags(fx.stream_events(spark, sf_dir), fx.EVENTS_LAST_DAY)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohort_flags(fx.order_events(spark, sf_dir, CART, BUY, SEARCH), fx.ORDERS_SNAPSHOT)


@query
def cohort_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cohort_overlap(_flags(spark, sf_dir))


@query
def candidate_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.candidate_cohorts(_flags(spark, sf_dir))


@query
def overlap_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.overlap_matrix(_flags(spark, sf_dir))


def _cohort_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return sketches.cohort_sketches(fx.order_events(spark, sf_dir, CART, BUY, SEARCH), fx.ORDERS_SNAPSHOT)

    return stored(spark, sf_dir, "cohort_sketches", build)


@query
def overlap_matrix_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap matrix from theta sketches of slices of the clients."""
    return sketches.sketched_overlaps(_cohort_sketches(spark, sf_dir))


@query
def candidate_cohorts_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.sketched_cohorts(_cohort_sketches(spark, sf_dir))


# --- paths --------------------------------------------------------------------


@query
def purchase_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.purchase_path(fx.order_events(spark, sf_dir, CART, BUY), fx.ORDERS_SNAPSHOT)


@query
def cart_delay_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.cart_delay_quantiles(fx.order_events(spark, sf_dir, CART, BUY), fx.ORDERS_SNAPSHOT)


def _sided(spark: SparkSession, sf_dir: str, event_type: str, name: str) -> DataFrame:
    events = fx.stream_events(spark, sf_dir, event_type)
    return events.select("client_id", "sku", F.col("event_ts").alias(name))


@query
def latest_prior_cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every purchase the latest earlier cart of the same client and SKU."""
    left, right = _sided(spark, sf_dir, BUY, "purchase_ts"), _sided(spark, sf_dir, CART, "cart_ts")
    return paths.latest_prior(left, right, ["client_id", "sku"], "purchase_ts", "cart_ts")


@query
def carts_after_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carts with a search of the same client in the day before."""
    left, right = _sided(spark, sf_dir, CART, "cart_ts"), _sided(spark, sf_dir, SEARCH, "search_ts")
    return paths.preceded_within(left, right.drop("sku"), ["client_id"], "cart_ts", "search_ts", TRANSITION_DAYS)


@query
def transition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.stream_events(spark, sf_dir, CART, SEARCH)
    return features.transition_features(events, fx.EVENTS_SNAPSHOT.cutoff, TRANSITION_DAYS, TRANSITION_RECENT)


@query
def recent_search_then_cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.stream_events(spark, sf_dir, CART, SEARCH)
    return paths.recent_then(events, fx.EVENTS_SNAPSHOT.cutoff, TRANSITION_RECENT)


# --- features and labels ------------------------------------------------------


@query
def activity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.activity_features(fx.stream_events(spark, sf_dir), fx.EVENTS_SNAPSHOT.cutoff, fx.EVENTS_WINDOWS)


@query
def product_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.order_events(spark, sf_dir, CART, BUY)
    return features.product_features(events, fx.products(spark, sf_dir), fx.ORDERS_SNAPSHOT.cutoff)


@query
def active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.active_days(fx.stream_events(spark, sf_dir), fx.EVENTS_SNAPSHOT.cutoff)


@query
def active_days_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.active_days(fx.stream_events(spark, sf_dir), fx.EVENTS_SNAPSHOT.cutoff, 7)


@query
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.order_events(spark, sf_dir)
    return features.build_features(events, fx.products(spark, sf_dir), fx.ORDERS_SNAPSHOT)


@query
def features_of_two_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature tables of both snapshots of a temporal pair from one stored daily table."""
    days = stored(spark, sf_dir, "daily_activity", lambda: features.daily_activity(fx.order_events(spark, sf_dir)))
    return features.features_of_snapshots(days, fx.products(spark, sf_dir), PAIR)


@query
def ratio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.order_events(spark, sf_dir)
    counts = features.activity_features(events, fx.ORDERS_SNAPSHOT.cutoff, ())
    return features.ratio_features(counts).select("client_id", *(c for c in feature_names() if "ratio" in c or "minus" in c))


@query
def feature_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = feature_frame(spark, sf_dir)
    return features.feature_validation(table, feature_names())


@query
def feature_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_catalog(feature_frame(spark, sf_dir))


@query
def search_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.search_buckets(feature_frame(spark, sf_dir), SEARCH_LIMITS)
    return table.select("client_id", "search_count_bucket", "search_recency_bucket", "recent_search_flag")


@query
def velocity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = features.velocity_features(feature_frame(spark, sf_dir))
    return table.select("client_id", *FEATURE_SETS["e6"].engineered)


@query
def labels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labels_from_events(fx.order_events(spark, sf_dir, CART, BUY), fx.ORDERS_SNAPSHOT)


@query
def labels_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same labels by joining a feature table with the target purchases."""
    events = fx.order_events(spark, sf_dir, BUY)
    return labels.build_labels(feature_frame(spark, sf_dir), events, fx.ORDERS_SNAPSHOT)


@query
def positive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.labels_from_events(fx.order_events(spark, sf_dir, CART, BUY), fx.ORDERS_SNAPSHOT)
    return metrics.dataset_summary(found)


@query
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_frame(spark, sf_dir)


@query
def label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = feature_frame(spark, sf_dir).drop("active_days_count_30d")
    found = labels.labels_from_events(fx.order_events(spark, sf_dir, CART, BUY), fx.ORDERS_SNAPSHOT)
    return labels.label_checks(table, found, training_frame(spark, sf_dir)).drop("notes")


@query
def modeling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.modeling_summary(training_frame(spark, sf_dir))


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.with_class_weight(training_frame(spark, sf_dir)).select("client_id", "label", "class_weight")


@query
def bucket_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bucket_lift(training_frame(spark, sf_dir), BUCKETED)


@query
def search_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.search_segments(training_frame(spark, sf_dir))


@query
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.feature_stats(training_frame(spark, sf_dir), feature_names())


@query
def feature_stats_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature statistics from stored sketches, kept by label and merged: exact moments,
    and whether distinct counts and quantiles are within the stated bounds."""
    table, q = training_frame(spark, sf_dir), profile.FEATURE_QUANTILES
    names = feature_columns(table)
    kept = stored(spark, sf_dir, "value_sketches", lambda: sketches.value_sketches(table, names, "label"))
    found = stored(spark, sf_dir, "sketched_stats", lambda: sketches.stats_of_values(kept, q))
    value = F.col("value")
    rows = long_form(table, names).where(value.isNotNull()).withColumnRenamed("column_name", "feature_name")
    # one row per feature
    shares = rows.join(found.select("feature_name", *q), "feature_name").groupBy("feature_name").agg(
        F.bool_and(F.lit(True)).alias("known"),
        F.count_distinct("value").alias("distinct"),
        *(F.avg((value < F.col(n)).cast("double")).alias(f"below_{n}") for n in q),
        *(F.avg((value <= F.col(n)).cast("double")).alias(f"upto_{n}") for n in q),
    )
    inside = F.lit(True)
    for n, share in q.items():
        inside = inside & (F.col(f"below_{n}") <= share + sketches.KLL_ERROR) & (F.col(f"upto_{n}") >= share - sketches.KLL_ERROR)
    near = F.abs(F.col("distinct_count") - F.col("distinct")) <= F.greatest(F.col("distinct") * sketches.HLL_ERROR, F.lit(1.0))
    return found.join(shares, "feature_name", "left").select(
        "feature_name", "row_count", "non_null_count", "mean", "variance", "min", "max", "zero_count",
        F.coalesce(inside, F.lit(True)).alias("quantiles_in_bound"), F.coalesce(near, F.lit(True)).alias("distinct_in_bound"),
    )


@query
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(training_frame(spark, sf_dir), feature_names())


# --- evaluation ---------------------------------------------------------------


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(fx.scored_orders(spark, sf_dir), 0.5)


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(fx.scored_orders(spark, sf_dir))


@query
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.operating_points(metrics.threshold_sweep(fx.scored_orders(spark, sf_dir)))


@query
def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored_orders(spark, sf_dir)
    points = metrics.operating_points(metrics.threshold_sweep(scored))
    return metrics.policy_table(points, metrics.topk_metrics(scored))


@query
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(fx.scored_orders(spark, sf_dir))


@query
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_summary(metrics.calibration(fx.scored_orders(spark, sf_dir)))


@query
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_distribution(fx.scored_orders(spark, sf_dir))


@query
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prediction_summary(fx.scored_orders(spark, sf_dir))


def _index(spark: SparkSession, sf_dir: str, score: str = metrics.SCORE, by: tuple[str, ...] = ()) -> ScoreIndex:
    """The score index of the scored orders, stored once per session."""
    return stored_once(
        spark, sf_dir, f"index_{score}_{'_'.join(by)}", lambda: build_index(fx.scored_orders(spark, sf_dir), score, by)
    )


@query
def topk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.topk_table(_index(spark, sf_dir).cutoffs())


@query
def topk_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.topk_table(_index(spark, sf_dir, by=("segment",)).cutoffs(), ["segment"])


@query
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("prediction_score", "other_score")
    indexes = {name: _index(spark, sf_dir, name) for name in names}
    return metrics.topk_overlap(fx.scored_orders(spark, sf_dir), *names, indexes=indexes)


@query
def auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return metrics.auc_exact(index.ranks, ranks=index.ranks)


@query
def auc_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of each segment from the index that its top-K metrics read."""
    index = _index(spark, sf_dir, by=("segment",))
    return metrics.auc_exact(index.ranks, by=["segment"], ranks=index.ranks)


@query
def score_index_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidecar of the index of each segment, summed: what its ranges hold is what the
    scored rows are, each range starts where those before it end, and no range is empty."""
    ranges = _index(spark, sf_dir, by=("segment",)).ranges
    before = F.sum("n").over(Window.partitionBy("segment").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    checked = ranges.withColumn("joins", F.coalesce(before, F.lit(0)) == F.col("n_before"))
    return checked.groupBy("segment").agg(
        F.sum("n").alias("row_count"),
        F.sum("pos").alias("positive_count"),
        F.bool_and(F.col("joins") & (F.col("n") > 0) & (F.col("n_total") >= F.col("n_before") + F.col("n"))).alias("is_whole"),
    )


@query
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.score_stats(fx.scored_orders(spark, sf_dir), ["prediction_score", "other_score"])


@query
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fx.scored_orders(spark, sf_dir).select("client_id", "label", "prediction_score")
    second = fx.scored_orders(spark, sf_dir).select("client_id", F.col("other_score").alias("prediction_score"))
    joined = experiments.join_scores(first, second, "first", "second")
    return profile.score_stats(metrics.score_delta(joined, "first", "second"), ["score_delta"])


@query
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.with_segments(training_frame(spark, sf_dir))
    return table.select("client_id", "activity_segment", "lifecycle_segment")


@query
def segment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> ScoreIndex:
        rows = metrics.by_segment(metrics.with_segments(carded(spark, sf_dir)))
        return build_index(rows, by=("segment_type", "segment_name"))

    return metrics.segment_metrics(None, index=stored_once(spark, sf_dir, "index_of_segments", build))


# --- audits -------------------------------------------------------------------


@query
def variance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.variance_audit(training_frame(spark, sf_dir), feature_families())


@query
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.correlation_matrix(training_frame(spark, sf_dir), feature_families())


@query
def correlation_matrix_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.correlation_matrix(feature_frame(spark, sf_dir), feature_families(), nulls="skip")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.correlation_matrix(training_frame(spark, sf_dir), feature_families())


@query
def family_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.family_correlation(_matrix(spark, sf_dir))


@query
def redundancy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = feature_families()
    return audit.redundancy_audit(audit.variance_audit(training_frame(spark, sf_dir), families), _matrix(spark, sf_dir))


@query
def window_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.window_review(training_frame(spark, sf_dir))


# --- scoring and serving ------------------------------------------------------


@query
def score_with_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = model.score_with_card(feature_frame(spark, sf_dir), CARD)
    return scored.select(
        "client_id",
        "prediction_score",
        "prediction_label",
        "decision",
        F.concat_ws(",", "missing_features_filled").alias("missing_features_filled"),
        "model_version",
    )


@query
def score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.score_checks(score_table(spark, sf_dir), fx.scored_orders(spark, sf_dir)).drop("notes")


@query
def serving_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of 100 clients: the row limit is the operator's own option."""
    return serving.serving_export(score_table(spark, sf_dir), limit=EXPORT_LIMIT)


@query
def serving_export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.serving_export(score_table(spark, sf_dir))


@query
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup of four clients, one of them unknown: the ids are its argument."""
    return serving.lookup(score_table(spark, sf_dir), LOOKUP_IDS)


@query
def lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup of all customers in the score table."""
    ids = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"))
    return serving.lookup(score_table(spark, sf_dir), ids)


# --- models: rows only --------------------------------------------------------


def _temporal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return model.temporal_split(*training_frames(spark, sf_dir, *PAIR))


def _baseline(spark: SparkSession, sf_dir: str):
    train, _ = _temporal(spark, sf_dir)
    return model.fit(train, feature_columns(train))


@query
def fit_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.score(_baseline(spark, sf_dir), training_frame(spark, sf_dir))


def batch_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _baseline(spark, sf_dir)  # stores the tables of both snapshots
    return serving.batch_score(fitted, feature_frame(spark, sf_dir), "baseline_lr_v1", SCORED_AT)


@query
def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_score_table(spark, sf_dir)


@query
def coefficient_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.coefficient_table(_baseline(spark, sf_dir))


@query
def model_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = model.model_card(_baseline(spark, sf_dir))
    return model.card_rows(training_frame(spark, sf_dir), card)


# --- null groups, text ids, odd scores -----------------------------------------


def _text_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("client_id", F.concat(F.lit("c"), F.col("client_id").cast("string")))


@query
def topk_null_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored_orders(spark, sf_dir)
    return metrics.topk_metrics(scored.withColumn("segment", F.nullif("segment", F.lit("F"))), by=["segment"])


@query
def topk_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.topk_metrics(_text_ids(fx.scored_orders(spark, sf_dir)))


@query
def serving_export_text_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of the 100 clients with the smallest text ids, by the operator's option."""
    return serving.serving_export(_text_ids(score_table(spark, sf_dir)), limit=EXPORT_LIMIT)


@query
def topk_overlap_null_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = fx.scored_orders(spark, sf_dir)
    part = scored.withColumn("other_score", F.when(F.col("segment") == "P", F.col("other_score")))
    return metrics.topk_overlap(part, "prediction_score", "other_score")


@query
def calibration_outside_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of which some are no probabilities."""
    scored = fx.scored_orders(spark, sf_dir)
    return metrics.calibration(scored.withColumn("prediction_score", F.col("prediction_score") * 2.0 - 0.25))


# --- fills, thresholds and rules --------------------------------------------------


@query
def filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every customer, with or without history, filled with 0."""
    wanted = [c for c in feature_names() if c.endswith("_count") or c.startswith("days_since")]
    customers = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"))
    table = feature_frame(spark, sf_dir).select("client_id", *wanted)
    return features.fill_counts(customers.join(table, "client_id", "left"))


@query
def recency_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = features.recency_thresholds(training_frame(spark, sf_dir))
    return spark.createDataFrame([tuple(limits)], "low bigint, middle bigint, high bigint")


@query
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a split, as counts and checks."""
    table = training_frame(spark, sf_dir)
    fitted, held_out = model.split(table)
    both = fitted.select("client_id", F.lit(1).alias("fit")).unionByName(held_out.select("client_id", F.lit(0).alias("fit")))
    share = F.avg("fit")
    return both.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("client_id").alias("client_count"),
        (F.abs(share - 0.8) < 4 * F.sqrt(0.16 / F.count("*"))).alias("share_near_80_percent"),
    )


def _brand_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored metric table whose numbers come from the parts of each brand."""
    parts = fx.table(spark, sf_dir, "part")
    return parts.groupBy(F.col("p_brand").alias("variant")).agg(
        F.round(F.avg("p_retailprice") / 3000.0, 4).alias("pr_auc"),
        F.round(F.avg(F.col("p_size").cast("double")) / 10.0, 4).alias("lift_at_5pct"),
        F.count("*").alias("added_feature_count"),
    )


@query
def pruning_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _brand_metrics(spark, sf_dir)
    first = table.agg(F.min("variant")).first()[0]
    return experiments.minimal_variants(table, first)


@query
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule on the metrics of every brand against those of all parts."""
    base = fx.table(spark, sf_dir, "part").agg(
        F.round(F.avg("p_retailprice") / 3000.0, 4).alias("pr_auc"),
        F.round(F.avg(F.col("p_size").cast("double")) / 10.0, 4).alias("lift_at_5pct"),
    )
    rows = _brand_metrics(spark, sf_dir).withColumn("base", base.select(F.struct("*")).scalar())
    metrics_of = {m: F.col(m) for m in experiments.CORE}
    base_of = {m: F.col(f"base.{m}") for m in experiments.CORE}
    drops = [-experiments.change(metrics_of[m], base_of[m]) for m in experiments.CORE]
    return rows.select(
        "variant",
        *(experiments.decision(metrics_of, base_of, rule).alias(rule) for rule in DECISION_RULES),
        experiments.drop_class(*drops).alias("ablation"),
    )


# --- models: what does not depend on the optimiser ---------------------------------


@query
def fit_and_score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each client's label, and whether the score is a probability that the model card
    gives, too."""
    fitted, table = _baseline(spark, sf_dir), training_frame(spark, sf_dir)
    scored = model.score(fitted, table)
    card = model.score_with_card(table, model.model_card(fitted)).select(
        "client_id", F.col("prediction_score").alias("card_score")
    )
    value = F.col("prediction_score")
    return scored.join(card, "client_id").select(
        "client_id",
        "label",
        ((value >= 0) & (value <= 1)).alias("is_probability"),
        (F.abs(value - F.col("card_score")) < 1e-9).alias("card_agrees"),
    )


@query
def batch_score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = batch_score_table(spark, sf_dir)
    follows = F.col("prediction_label") == (F.col("prediction_score") >= 0.5).cast("int")
    return scores.select("client_id", "model_version", "scored_at", follows.alias("label_follows_threshold"))


@query
def coefficient_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature once, its coefficient finite and the card's, its rank by size."""
    fitted = _baseline(spark, sf_dir)
    table = model.coefficient_table(fitted)
    card = model.card_rows(table, model.model_card(fitted)).select("feature_name", F.col("coefficient").alias("of_card"))
    larger = table.select(F.col("abs_coefficient").alias("other"), F.col("rank_among_all_features").alias("other_rank"))
    above = table.join(larger, F.col("other") > F.col("abs_coefficient")).groupBy("feature_name").agg(
        F.max("other_rank").alias("last_above")
    )
    return table.join(card, "feature_name").join(above, "feature_name", "left").select(
        "feature_name",
        (F.col("coefficient") == F.col("of_card")).alias("card_agrees"),
        F.coalesce(F.col("last_above") < F.col("rank_among_all_features"), F.lit(True)).alias("ranked_by_size"),
    )


@query
def model_card_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each imputation value split the training values in halves, to the imputer's
    0.1 % of ranks?"""
    train, _ = _temporal(spark, sf_dir)
    card = model.card_rows(train, model.model_card(_baseline(spark, sf_dir))).select("feature_name", "position", "imputation_value")
    names = feature_columns(train)
    values = train.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("value")) for c in names))))
    n, m = F.count("value"), F.col("imputation_value")
    slack = F.lit(2.0) + n * 0.001
    halves = values.join(card, "feature_name").groupBy("feature_name", "position").agg(
        ((F.count_if(F.col("value") < m) <= n / 2 + slack) & (F.count_if(F.col("value") <= m) >= n / 2 - slack)).alias("is_median")
    )
    return halves


@query
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        train, validation = _temporal(spark, sf_dir)
        return experiments.ablate_families(train, validation, feature_columns(train), feature_families())

    return stored(spark, sf_dir, "ablation", build)


@query
def combined_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation = _temporal(spark, sf_dir)
    return experiments.ablate_families(
        train, validation, feature_columns(train), feature_families(), combined=COMBINED_ABLATIONS
    )


def _engineered(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The training tables of the temporal pair with every engineered feature; recency
    limits come from the train snapshot for both snapshots."""

    def build(missing: list[Snapshot]) -> DataFrame:
        tables = dict(zip(PAIR, training_frames(spark, sf_dir, *PAIR)))
        helpers = dict(zip(PAIR, feature_frames(spark, sf_dir, *PAIR)))
        limits = features.recency_thresholds(tables[fx.ORDERS_TRAIN])
        last = max(s.cutoff for s in missing)
        moments = stable(paths.cart_search_moments(fx.order_events(spark, sf_dir, CART, SEARCH), last))
        found = stable(features.transitions_of_moments(moments, missing))
        out = None
        for s in missing:
            helper = helpers[s].select("client_id", "active_days_count_30d")
            table = features.search_buckets(features.velocity_features(tables[s].join(helper, "client_id")), limits)
            extra = found.where(F.col("snapshot") == s.name).drop("snapshot")
            part = features.add_features(table, extra, features.TRANSITION_FILLS).withColumn("snapshot", F.lit(s.name))
            out = part if out is None else out.unionByName(part)
        return out

    return by_snapshot(spark, sf_dir, "engineered", PAIR, build)


@query
def pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation = _engineered(spark, sf_dir)
    base = FEATURE_SETS["v2_2"].columns(feature_names())
    return experiments.prune(train, validation, base)


@query
def velocity_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each velocity group removed from the set that has all of them: the structure of the
    fitted runs, without the metrics that depend on the optimiser."""
    train, validation = _engineered(spark, sf_dir)
    columns = FEATURE_SETS["e6"].columns(feature_names())
    table = experiments.ablate(train, validation, columns, VELOCITY_GROUPS)
    drops = F.greatest("pr_auc_drop_relative", "lift_5pct_drop_relative")
    expected = F.when(drops > experiments.KEEP_DROP, "KEEP").when(drops >= experiments.LOWER_DROP, "KEEP_LOWER_PRIORITY").otherwise("REMOVE_CANDIDATE")
    return table.select(
        "scenario",
        "removed_features",
        (F.lit(len(columns)) - F.col("feature_count")).cast("bigint").alias("removed_count"),
        F.col("pr_auc").between(0, 1).alias("is_share"),
        (F.col("recommendation") == expected).alias("rule_holds"),
    )


def _benchmark(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def build() -> dict[str, DataFrame]:
        train, validation = _engineered(spark, sf_dir)
        return experiments.benchmark_sets(train, validation, *(FEATURE_SETS[n].columns(feature_names()) for n in ("v2_2", "v2_4")))

    return stored_once(spark, sf_dir, "benchmark", build)


@query
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap, score distributions and verdict of the benchmark, as one long table."""
    report = _benchmark(spark, sf_dir)
    parts = [
        report[name].select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("row"))
        for name in ("overlap", "distribution", "verdict")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def feature_set_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, validation = _engineered(spark, sf_dir)
    sets = {name: fs.columns(feature_names()) for name, fs in FEATURE_SETS.items()}
    rules = {"v2_1": "not_worse", "v2_2": "not_worse", "e6": "review", "v2_4": "any_gain"}
    bases = {name: "v2_2" for name in ("v2_3a", "v2_3b", "v2_3c", "e6", "v2_4")}
    return experiments.compare_feature_sets(train, validation, sets, rules, bases)


@query
def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _benchmark(spark, sf_dir)
    overall = report["overall"].withColumns({"segment_type": F.lit("all"), "segment_name": F.lit("all")})
    return overall.unionByName(report["segments"])


@query
def family_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _temporal(spark, sf_dir)
    families = feature_families()
    drops = ablation(spark, sf_dir).select(
        F.col("scenario").alias("feature_family"), "pr_auc_drop_relative", "lift_5pct_drop_relative"
    )
    matrix = audit.correlation_matrix(train, families)
    return audit.family_decisions(audit.variance_audit(train, families), matrix, drops)


@query
def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written in each format that the readers know and read back, as sums."""
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = f"{shared_dir(spark).rstrip('/')}/clientpulse/{uuid.uuid4().hex}"
        writer = rows.write.option("header", True)
        writer.format(fmt).save(path)
        part = readers.read_any(spark, path, fmt).agg(
            F.lit(fmt).alias("format"),
            F.count("*").alias("row_count"),
            F.sum("c_custkey").alias("key_sum"),
            F.count_distinct("c_name").alias("name_count"),
            F.sum("c_nationkey").alias("nation_sum"),
            F.round(F.sum(F.col("c_acctbal").cast("decimal(20,2)")), 2).cast("double").alias("balance"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.inventory(spark, sf_dir)
    name = F.regexp_extract("path", r"([^/]+)\.parquet$", 1)
    fields = F.size(F.from_json("schema", "fields array<struct<name: string>>")["fields"])
    return found.select(
        name.alias("dataset"), "inferred_format", "readable_by_spark", "row_count", "row_count_status", fields.alias("column_count")
    )


@query
def schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in EVENT_SPECS:
        part = readers.schema_rows(fx.raw_events(spark, sf_dir, t), t)
        out = part if out is None else out.unionByName(part)
    return out


# The driver's tables include one called ``labels``; the query keeps the plain name.
QUERIES["labels"] = QUERIES.pop("labels_table")
