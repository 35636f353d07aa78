"""Evaluation of scored rows: (client_id, label, prediction_score [, segment]).

Every report is computed from a table that is small by construction: counts
per threshold bucket, per calibration bin or per distinct score."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clientpulse.config import BUY, TOPK_PERCENTS
from clientpulse.functions import feature_bucket, safe_ratio, score_bucket, score_bucket_labels
from clientpulse.functions.buckets import OUTSIDE_RANGE
from clientpulse.functions.buckets import SEARCH_SEGMENTS, bucketize
from clientpulse.functions.predicates import ratio_or_zero
from clientpulse.operators.checks import modeling_summary
from clientpulse.operators.distribution import in_top, null_safe, quantile, score_ranks, topk_cutoffs
from clientpulse.operators.score_index import ScoreIndex, build_index, wanted

SCORE = "prediction_score"

# Calibration limits.
GAP_LIMIT = 0.05
ECE_LIMIT = 0.10
OVERCONFIDENCE_LIMIT = 0.10
OVERCONFIDENT_BUCKETS = ("0.8-0.9", "0.9-1.0")

# Operating points.
PRECISION_TARGETS = (20, 30, 40)
RECALL_TARGETS = (50, 70)
POPULATION_TARGETS = (1, 5, 10, 20)


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 next to tp, fp, tn, fn; 0 where undefined."""
    tp = F.col("tp")
    return (
        df.withColumn("precision", ratio_or_zero(tp, tp + F.col("fp")))
        .withColumn("recall", ratio_or_zero(tp, tp + F.col("fn")))
        .withColumn(
            "f1",
            ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def confusion(scored: DataFrame, threshold: float = 0.5, score: str = SCORE) -> DataFrame:
    hit, positive = F.col(score) >= threshold, F.col("label") == 1
    counts = scored.agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"),
        F.count_if(~hit & positive).alias("fn"),
    )
    return rates(counts.select(F.lit(float(threshold)).alias("threshold"), "*"))


def thresholds_met(score: Column, steps: int = 100) -> Column:
    """How many of the thresholds 1/steps .. (steps-1)/steps the score reaches.
    The rounded product is corrected by comparing with the thresholds themselves,
    since for example floor(0.29 * 100) is 28."""
    guess = F.floor(score * steps)
    exact = guess + F.when(score >= (guess + 1) / steps, 1).when(score < guess / steps, -1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(steps - 1), exact)).cast("int")


def threshold_sweep(scored: DataFrame, score: str = SCORE, steps: int = 100) -> DataFrame:
    """Confusion, rates, targeted share and lift at every threshold 0.01 .. 0.99,
    from one pass that counts rows per threshold bucket."""
    spark = scored.sparkSession
    buckets = (
        scored.where(F.col(score).isNotNull())
        .groupBy(thresholds_met(F.col(score), steps).alias("bucket"))
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    )
    # At most `steps` rows from here on.
    at_least = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    filled = spark.range(0, steps, 1, 1).select(F.col("id").cast("int").alias("bucket")).join(buckets, "bucket", "left")
    filled = filled.select("bucket", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pos", "neg")))
    counted = filled.select(
        "bucket",
        F.sum("pos").over(at_least).alias("tp"),
        F.sum("neg").over(at_least).alias("fp"),
        F.sum("pos").over(everything).alias("positives"),
        F.sum("neg").over(everything).alias("negatives"),
    ).where(F.col("bucket") > 0)
    swept = rates(
        counted.select(
            (F.col("bucket") / steps).alias("threshold"),
            "tp",
            "fp",
            (F.col("negatives") - F.col("fp")).alias("tn"),
            (F.col("positives") - F.col("tp")).alias("fn"),
        )
    )
    rows = F.expr("tp + fp + tn + fn")
    base = ratio_or_zero(F.expr("tp + fn"), rows)
    return swept.withColumn("positive_prediction_rate", ratio_or_zero(F.expr("tp + fp"), rows)).withColumn(
        "lift", ratio_or_zero(F.col("precision"), base)
    )


POINT_FIELDS = ("threshold", "tp", "fp", "precision", "recall", "f1", "positive_prediction_rate", "lift")


def operating_points(sweep: DataFrame) -> DataFrame:
    """Named thresholds of a sweep: best F1, precision and recall targets, and
    the nearest targeted shares. Points that no threshold reaches are left out."""
    t, row = F.col("threshold"), F.struct(*POINT_FIELDS)
    share = F.col("positive_prediction_rate")

    def lowest(condition: Column) -> Column:
        return F.min_by(F.when(condition, row), F.when(condition, t))

    best = F.struct(F.col("f1").alias("a"), F.col("precision").alias("b"), (-share).alias("c"), (-t).alias("d"))
    points = {"max_f1": F.max_by(row, best)}
    for p in PRECISION_TARGETS:
        points[f"precision_ge_{p}_lowest_threshold"] = lowest(F.col("precision") >= p / 100)
    for r in RECALL_TARGETS:
        reached = F.col("recall") >= r / 100
        points[f"recall_ge_{r}_highest_threshold"] = F.max_by(F.when(reached, row), F.when(reached, t))
    for p in POPULATION_TARGETS:
        distance = F.struct(F.abs(share - p / 100).alias("a"), t.alias("b"))
        points[f"population_closest_{p}pct"] = F.min_by(row, distance)
    wide = sweep.agg(*(expr.alias(name) for name, expr in points.items()))
    rows = (F.struct(F.lit(name).alias("operating_point"), F.col(name).alias("p")) for name in points)
    return wide.select(F.inline(F.array(*rows))).where(F.col("p").isNotNull()).select("operating_point", "p.*")


def topk_metrics(
    scored: DataFrame,
    score: str = SCORE,
    percents: Iterable[int] = TOPK_PERCENTS,
    by: Sequence[str] = (),
    tie_break: str = "client_id",
    ranks: DataFrame | None = None,
) -> DataFrame:
    """Positives, precision, recall and lift in the top K% of each group."""
    return topk_table(topk_cutoffs(scored, score, percents, by, tie_break, ranks), by)


def topk_table(cutoffs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The metrics of top-K cutoffs, from ``topk_cutoffs`` or a score index."""
    hits, positives = F.col("positives_in_top"), F.col("positive_count")
    precision = ratio_or_zero(hits, F.col("top_k_count"))
    return cutoffs.select(
        *by,
        "top_percent",
        "top_k_count",
        hits.alias("positive_count"),
        precision.alias("precision_at_k"),
        ratio_or_zero(hits, positives).alias("recall_at_k"),
        ratio_or_zero(precision, ratio_or_zero(positives, F.col("row_count"))).alias("lift_at_k"),
    )


def topk_overlap(
    joined: DataFrame,
    first: str,
    second: str,
    percents: Iterable[int] = TOPK_PERCENTS,
    tie_break: str = "client_id",
    indexes: Mapping[str, ScoreIndex] | None = None,
) -> DataFrame:
    """How many clients are in the top K% of both scores. K is a share of all rows; a
    score that fewer rows have fills less than K, and each side reports its own rest.

    The cutoffs of a score, read from its index if there is one, are a map of one row
    that the count over the joined rows looks up; nothing runs before it."""
    percents = sorted(set(percents))
    everyone = joined.agg(F.count("*")).scalar()
    ends = {}
    for score in (first, second):
        if indexes and score in indexes:
            cutoffs = indexes[score].cutoffs(percents, everyone)
        else:
            cutoffs = topk_cutoffs(joined, score, percents, (), tie_break, population=everyone)
        entry = F.struct("top_percent", F.struct("cutoff_score", "cutoff_id"))
        ends[score] = cutoffs.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    sizes = joined.agg(F.count("*").alias("n")).where("n > 0").select(F.inline(wanted(F.col("n"), percents)))

    def inside(score: str, name: str, percent: int) -> Column:
        # a score that no row has puts nobody at the top
        end = F.col(name)[F.lit(percent)]
        return F.coalesce(in_top(F.col(score), F.col(tie_break), end["cutoff_score"], end["cutoff_id"]), F.lit(False))

    flagged = joined.select(first, second, tie_break).withColumns({"__first": ends[first], "__second": ends[second]})
    one = {p: inside(first, "__first", p) for p in percents}
    two = {p: inside(second, "__second", p) for p in percents}
    counts = flagged.agg(
        F.array(
            *(
                F.struct(
                    F.lit(p).alias("top_percent"),
                    F.count_if(one[p] & two[p]).alias("overlap_count"),
                    F.count_if(one[p]).alias("first_count"),
                    F.count_if(two[p]).alias("second_count"),
                )
                for p in percents
            )
        ).alias("rows")
    ).select(F.inline("rows"))
    # one row per percent
    return counts.join(sizes.withColumnRenamed("k", "top_k_count"), "top_percent").select(
        "top_percent",
        "top_k_count",
        "overlap_count",
        (F.col("overlap_count") / F.col("top_k_count")).alias("overlap_rate"),
        (F.col("first_count") - F.col("overlap_count")).alias("first_only_count"),
        (F.col("second_count") - F.col("overlap_count")).alias("second_only_count"),
    )


def policy_table(points: DataFrame, topk: DataFrame) -> DataFrame:
    """Threshold policies next to top-K policies."""
    # The labels of the policies.
    names = {
        "max_f1": "Best-F1 threshold",
        "precision_ge_20_lowest_threshold": "Precision >= 20% threshold",
        "precision_ge_30_lowest_threshold": "Precision >= 30% threshold",
    }
    label = F.create_map(*(F.lit(text) for pair in names.items() for text in pair))[F.col("operating_point")]
    by_threshold = points.where(F.col("operating_point").isin(*names)).select(
        label.alias("policy"),
        "threshold",
        F.col("positive_prediction_rate").alias("population_targeted"),
        "precision",
        "recall",
        "lift",
        F.col("tp").alias("positive_count_captured"),
    )
    by_rank = topk.select(
        F.concat(F.lit("Top "), F.col("top_percent").cast("string"), F.lit("%")).alias("policy"),
        F.lit(None).cast("double").alias("threshold"),
        (F.col("top_percent") / 100).alias("population_targeted"),
        F.col("precision_at_k").alias("precision"),
        F.col("recall_at_k").alias("recall"),
        F.col("lift_at_k").alias("lift"),
        F.col("positive_count").alias("positive_count_captured"),
    )
    return by_threshold.unionByName(by_rank)


def auc_exact(
    scored: DataFrame, score: str = SCORE, by: Sequence[str] = (), ranks: DataFrame | None = None
) -> DataFrame:
    """Exact ROC-AUC and PR-AUC per group; null when a class is missing.

    Each distinct score is one step of both curves, and the area under a step
    needs only the totals before it, which come from running totals."""
    if ranks is None:
        ranks = score_ranks(scored, score, by)
    pos, tp0, tps = F.col("pos").cast("double"), F.col("pos_before").cast("double"), F.col("pos_total").cast("double")
    neg = (F.col("n") - F.col("pos")).cast("double")
    seen0 = F.col("n_before").cast("double")
    negs = (F.col("n_total") - F.col("pos_total")).cast("double")
    roc_step = neg * (tp0 + pos / 2.0)
    precision = (tp0 + pos) / (seen0 + F.col("n"))
    # The curve starts flat: before the first step the precision is the first one.
    previous = F.when(seen0 > 0, tp0 / seen0).otherwise(precision)
    pr_step = pos * (precision + previous) / 2.0
    positives, negatives = F.max(tps), F.max(negs)
    both = (positives > 0) & (negatives > 0)
    return ranks.groupBy(*by).agg(
        F.sum("n").alias("row_count"),
        F.sum("pos").alias("positive_count"),
        F.when(both, F.sum(roc_step) / (positives * negatives)).alias("roc_auc"),
        F.when(both, F.sum(pr_step) / positives).alias("pr_auc"),
    )


def auc_binned(scored: DataFrame, score: str = SCORE) -> dict[str, float | None]:
    """ROC-AUC and PR-AUC of Spark's evaluator; None for one-class input."""
    summary = scored.agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("pos")).first()
    if not summary.n or not summary.pos or summary.pos == summary.n:
        return {"roc_auc": None, "pr_auc": None}
    pairs = scored.select(F.col("label").cast("double").alias("label"), score)
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol=score)
    return {
        name: evaluator.evaluate(pairs, {evaluator.metricName: metric})
        for name, metric in (("roc_auc", "areaUnderROC"), ("pr_auc", "areaUnderPR"))
    }


def calibration(scored: DataFrame, bins: int = 10, score: str = SCORE) -> DataFrame:
    """Mean score against positive rate in equal-width score bins, empty ones too.
    Scores outside [0, 1] are counted in a row ``outside_range``, if there are any."""
    value = F.col(score)
    index = F.when((value < 0) | (value > 1) | F.isnan(value), bins).otherwise(
        F.least(F.floor(value * bins).cast("int"), F.lit(bins - 1))
    )
    filled = (
        scored.where(F.col(score).isNotNull())
        .groupBy(index.alias("bucket"))
        .agg(
            F.count("*").alias("n"),
            F.avg(score).alias("predicted"),
            F.avg(F.col("label").cast("double")).alias("actual"),
        )
    )
    labels = F.array(*(F.lit(label) for label in (*score_bucket_labels(bins), OUTSIDE_RANGE)))
    zero = F.lit(0.0)
    return (
        scored.sparkSession.range(0, bins + 1, 1, 1)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(filled, "bucket", "left")
        .where((F.col("bucket") < bins) | (F.col("n") > 0))
        .select(
            labels[F.col("bucket")].alias("score_bucket"),
            F.coalesce("n", F.lit(0)).alias("sample_count"),
            F.coalesce("predicted", zero).alias("predicted_probability_avg"),
            F.coalesce("actual", zero).alias("actual_positive_rate"),
            F.coalesce(F.abs(F.col("predicted") - F.col("actual")), zero).alias("absolute_gap"),
        )
    )


def calibration_summary(curve: DataFrame) -> DataFrame:
    """Calibration error, gaps, monotonicity and verdict of a calibration curve; scores
    that are no probabilities are left out."""
    n, gap = F.col("sample_count"), F.col("absolute_gap")
    # The curve has one row per bin, so the window is over a handful of rows.
    previous = F.lag("actual_positive_rate").over(Window.orderBy("score_bucket"))
    used = curve.where((n > 0) & (F.col("score_bucket") != OUTSIDE_RANGE)).withColumn("falls", previous > F.col("actual_positive_rate"))
    over = F.col("predicted_probability_avg") - F.col("actual_positive_rate") > OVERCONFIDENCE_LIMIT
    totals = used.agg(
        F.count("*").alias("non_empty_bucket_count"),
        F.coalesce(F.sum(n * gap) / F.sum(n), F.lit(0.0)).alias("expected_calibration_error"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("maximum_calibration_gap"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("average_calibration_gap"),
        F.count_if(gap < GAP_LIMIT).alias("bucket_gaps_under_0_05"),
        F.count_if(F.col("score_bucket").isin(*OVERCONFIDENT_BUCKETS) & over).alias(
            "high_score_overconfidence_bucket_count"
        ),
        (F.count_if("falls") == 0).alias("monotonic_actual_positive_rate"),
    )
    ece = F.col("expected_calibration_error")
    most = F.col("bucket_gaps_under_0_05") > F.col("non_empty_bucket_count") / 2
    overconfident = F.col("high_score_overconfidence_bucket_count") > 0
    return totals.select(
        "*",
        most.alias("most_bucket_gaps_under_0_05"),
        overconfident.alias("high_score_overconfident"),
        F.when((ece < GAP_LIMIT) & most, "PASS")
        .when((ece <= ECE_LIMIT) & ~overconfident, "PARTIAL PASS")
        .otherwise("FAIL")
        .alias("calibration_quality"),
    )


def score_distribution(scores: DataFrame, score: str = SCORE) -> DataFrame:
    """Rows and score range per tenth; rows outside [0, 1] only if there are any."""
    counted = scores.groupBy(score_bucket(F.col(score)).alias("bucket")).agg(
        F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.count("*").alias("row_count")
    )
    labels = scores.sparkSession.createDataFrame([(b,) for b in score_bucket_labels()], "bucket string")
    total = F.sum("row_count").over(Window.partitionBy())
    joined = labels.join(counted, "bucket", "full").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    return joined.select(
        "bucket",
        "min_score",
        "max_score",
        "row_count",
        ratio_or_zero(F.col("row_count"), total).alias("row_rate"),
    )


def prediction_summary(scored: DataFrame, score: str = SCORE) -> DataFrame:
    summary = scored.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("positive_count"),
        F.count_if(F.col(score).isNull()).alias("null_score_count"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("avg_score"),
    )
    return summary.withColumn("negative_count", F.col("row_count") - F.col("positive_count")).withColumn(
        "positive_rate", ratio_or_zero(F.col("positive_count"), F.col("row_count"))
    )


def score_delta(joined: DataFrame, first: str, second: str) -> DataFrame:
    """Both scores and their difference, second minus first, ready for statistics."""
    return joined.select("*", (F.col(second) - F.col(first)).alias("score_delta"))


def ranking_metrics(index: ScoreIndex) -> DataFrame:
    """Exact AUCs and, as one column per metric and percent, top-K metrics of each group."""
    keys = list(index.by)
    tops = topk_table(index.cutoffs(), keys)
    wide = tops.groupBy(*keys).agg(
        *(
            F.max(F.when(F.col("top_percent") == p, F.col(f"{m}_at_k"))).alias(f"{m}_at_{p}pct")
            for p in TOPK_PERCENTS
            for m in ("precision", "recall", "lift")
        )
    )
    areas = auc_exact(index.ranks, by=keys, ranks=index.ranks)
    side = wide.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in wide.columns if c not in keys))
    return areas.join(side, null_safe(keys, "__{}"), "left").drop(*(f"__{k}" for k in keys))


SEGMENTS = ("activity_segment", "lifecycle_segment")


def with_segments(df: DataFrame) -> DataFrame:
    """Activity segment against the median of active days; lifecycle segment by
    whether the client has bought before."""
    median = quantile(df, "active_days_count", 0.5)
    high = F.col("active_days_count") > F.col("__median")
    return (
        df.withColumn("__median", median)
        .withColumn("activity_segment", F.when(high, "high_activity").otherwise("low_activity"))
        .withColumn("lifecycle_segment", F.when(F.col(f"{BUY}_count") > 0, "returning_users").otherwise("new_users"))
        .drop("__median")
    )


def by_segment(scored: DataFrame, segments: Sequence[str] = SEGMENTS, score: str = SCORE, keep: Sequence[str] = ()) -> DataFrame:
    """Each row once per segment type, with the name of its segment."""
    pairs = F.array(*(F.struct(F.lit(s).alias("segment_type"), F.col(s).alias("segment_name")) for s in segments))
    return scored.select("client_id", "label", score, *keep, F.inline(pairs))


def segment_metrics(
    scored: DataFrame | None, segments: Sequence[str] = SEGMENTS, score: str = SCORE, index: ScoreIndex | None = None
) -> DataFrame:
    """AUC and top-K metrics within every segment, all segments at once; from an index of
    ``by_segment`` rows where there is one."""
    if index is None:
        index = build_index(by_segment(scored, segments, score), score, ["segment_type", "segment_name"])
    found = ranking_metrics(index)
    first = (*index.by, "row_count", "positive_count")
    return found.select(
        *first,
        (F.col("row_count") - F.col("positive_count")).alias("negative_count"),
        ratio_or_zero(F.col("positive_count"), F.col("row_count")).alias("positive_rate"),
        *(c for c in found.columns if c not in first),
    )


def lift_direction(rate: Column, base: Column) -> Column:
    return (
        F.when(rate.isNull() | base.isNull(), "no rate available")
        .when(rate > base * 1.2, "higher than baseline")
        .when(rate < base * 0.8, "lower than baseline")
        .otherwise("near baseline")
    )


def bucket_lift(training: DataFrame, features: Sequence[str]) -> DataFrame:
    """Positive rate and lift of every bucket of every feature, in one pass."""
    label = F.col("label").cast("long")
    buckets = F.array(
        *(F.struct(F.lit(f).alias("feature_name"), feature_bucket(f).alias("bucket")) for f in features)
    )
    counted = (
        training.select(label.alias("label"), F.inline(buckets))
        .groupBy("feature_name", "bucket")
        .agg(F.count("*").alias("row_count"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive_count"))
    )
    # Each feature's buckets add up to the whole table.
    whole = Window.partitionBy("feature_name")
    base = safe_ratio(F.sum("positive_count").over(whole), F.sum("row_count").over(whole))
    rate = F.col("positive_rate")
    return (
        counted.withColumn("positive_rate", F.col("positive_count") / F.col("row_count"))
        .withColumn("baseline_positive_rate", base)
        .withColumn("lift_vs_baseline", safe_ratio(rate, F.col("baseline_positive_rate")))
        .withColumn("direction", lift_direction(rate, F.col("baseline_positive_rate")))
    )


def search_segments(training: DataFrame) -> DataFrame:
    """Positive rate and lift by search volume."""
    segment = bucketize(F.coalesce("search_query_count", F.lit(0)), SEARCH_SEGMENTS)
    counted = training.groupBy(segment.alias("segment")).agg(
        F.count("*").alias("client_count"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("positive_count")
    )
    # Four rows at most.
    whole = Window.partitionBy()
    base = safe_ratio(F.sum("positive_count").over(whole), F.sum("client_count").over(whole))
    rate = F.col("positive_rate")
    return (
        counted.withColumn("positive_rate", F.col("positive_count") / F.col("client_count"))
        .withColumn("__base", base)
        .withColumn("lift_vs_baseline", safe_ratio(rate, F.col("__base")))
        .withColumn("direction", lift_direction(rate, F.col("__base")))
        .drop("__base")
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    return modeling_summary(df).select("row_count", "positive_count", "negative_count", "positive_rate")
