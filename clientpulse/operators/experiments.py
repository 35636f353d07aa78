"""Model experiments: evaluation, ablation, pruning, comparison and verdicts.

All variants of an experiment share one imputation and assembly, one long score table
and one score index (``variants.py``); only metric rows reach the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientpulse.config import BUY, MAX_ITER, PRUNING_VARIANTS, TOPK_PERCENTS, VELOCITY_GROUPS
from clientpulse.operators.metrics import (
    SEGMENTS,
    by_segment,
    ranking_metrics,
    score_delta,
    segment_metrics,
    topk_overlap,
    with_segments,
)
from clientpulse.operators.model import fit, score
from clientpulse.operators.profile import score_stats
from clientpulse.operators.score_index import build_index
from clientpulse.operators.variants import fit_variants, run_variants, score_side_by_side, vectors
from clientpulse.session import stable

METRICS = ("roc_auc", "pr_auc", *(f"{m}_at_{p}pct" for p in TOPK_PERCENTS for m in ("precision", "recall", "lift")))
CORE = ("pr_auc", "lift_at_5pct")

# Relative limits of the decision rules.
KEEP_DROP = 0.03
LOWER_DROP = 0.01
SMALL_CHANGE = 0.005
CLEAR_LOSS = 0.01
PRUNING_TOLERANCE = 0.002


@contextmanager
def held(*frames: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Keep frames on executor storage for a loop; lost blocks are rebuilt."""
    kept = tuple(df.persist(StorageLevel.MEMORY_AND_DISK) for df in frames)
    try:
        yield kept
    finally:
        for df in kept:
            df.unpersist()


def evaluate(scored: DataFrame) -> dict[str, Any]:
    """Rows, classes, exact AUCs and top-K metrics of scored rows."""
    with held(scored.select("client_id", "label", "prediction_score")) as (rows,):
        return ranking_metrics(build_index(rows)).first().asDict()


def fit_and_evaluate(
    train: DataFrame, validation: DataFrame, columns: Sequence[str], max_iter: int = MAX_ITER, weighted: bool = True
) -> tuple[PipelineModel, dict[str, Any]]:
    model = fit(train, columns, max_iter, weighted)
    return model, evaluate(score(model, validation))


def relative_change(value: float | None, base: float | None) -> float:
    return (value - base) / base if value is not None and base else 0.0


def classify_drop(pr_auc_drop: float, lift_drop: float) -> str:
    worst = max(pr_auc_drop, lift_drop)
    if worst > KEEP_DROP:
        return "KEEP"
    return "KEEP_LOWER_PRIORITY" if worst >= LOWER_DROP else "REMOVE_CANDIDATE"


def change(value: Column, base: Column) -> Column:
    """``relative_change`` of columns."""
    return F.when(value.isNull() | base.isNull() | (base == 0), 0.0).otherwise((value - base) / base)


def drop_class(*drops: Column) -> Column:
    """``classify_drop`` of columns."""
    worst = F.greatest(*drops)
    return F.when(worst > KEEP_DROP, "KEEP").when(worst >= LOWER_DROP, "KEEP_LOWER_PRIORITY").otherwise("REMOVE_CANDIDATE")


def decision(metrics: Mapping[str, Column], base: Mapping[str, Column], rule: str = "gain") -> Column:
    """``decide`` of columns: every variant of a metric table judged where it lies."""
    changes = [change(metrics[m], base[m]) for m in CORE]
    least, most = F.least(*changes), F.greatest(*changes)
    better = [F.coalesce(metrics[m] > base[m], F.lit(False)) for m in CORE]
    if rule == "not_worse":
        return F.when(least >= -SMALL_CHANGE, "ADOPT").when(least < -CLEAR_LOSS, "KEEP").otherwise("INVESTIGATE")
    if rule == "gain":
        return F.when(most >= SMALL_CHANGE, "ADOPT").when(least < -SMALL_CHANGE, "KEEP").otherwise("INVESTIGATE")
    if rule == "review":
        return F.when(most >= SMALL_CHANGE, "ADOPT_FOR_REVIEW").otherwise("INVESTIGATE")
    if rule == "any_gain":
        return F.when(reduce(or_, better), "CANDIDATE").otherwise("KEEP")
    if rule == "both_gain":
        return F.when(reduce(and_, better), "PROMOTE").otherwise("KEEP")
    raise ValueError(f"unknown rule {rule!r}")


def metric_table(spark, rows: Iterable[Mapping[str, Any]], texts: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Driver-side metric rows as a DataFrame with a fixed schema."""
    schema = ", ".join([f"{t} string" for t in texts] + [f"{n} double" for n in numbers])
    values = [
        tuple(r.get(t) for t in texts) + tuple(None if r.get(n) is None else float(r[n]) for n in numbers) for r in rows
    ]
    return spark.createDataFrame(values, schema)


def ablate(
    train: DataFrame,
    validation: DataFrame,
    columns: Sequence[str],
    removals: Mapping[str, Sequence[str]],
    max_iter: int = MAX_ITER,
) -> DataFrame:
    """Refit without each named group of features; relative drops against the
    full model tell which groups matter."""
    # None names the full model, as no group can
    left = {None: list(columns)} | {name: [c for c in columns if c not in set(gone)] for name, gone in removals.items()}
    found = run_variants(train, validation, {str(i): listed for i, listed in enumerate(left.values())}, max_iter)
    base, *judged = (found[str(i)] for i in range(len(left)))
    rows = []
    for (name, removed), metrics in zip(removals.items(), judged):
        drops = {m: -relative_change(metrics[m], base[m]) for m in ("roc_auc", *CORE)}
        rows.append(
            {
                "scenario": name,
                "removed_features": ",".join(c for c in columns if c in set(removed)),
                "recommendation": classify_drop(drops["pr_auc"], drops["lift_at_5pct"]),
                "feature_count": len(left[name]),
                **{m: metrics[m] for m in METRICS},
                "roc_auc_drop_relative": drops["roc_auc"],
                "pr_auc_drop_relative": drops["pr_auc"],
                "lift_5pct_drop_relative": drops["lift_at_5pct"],
            }
        )
    numbers = ("feature_count", *METRICS, "roc_auc_drop_relative", "pr_auc_drop_relative", "lift_5pct_drop_relative")
    return metric_table(train.sparkSession, rows, ("scenario", "removed_features", "recommendation"), numbers)


def ablate_families(
    train: DataFrame,
    validation: DataFrame,
    columns: Sequence[str],
    families: Mapping[str, Sequence[str]],
    combined: Mapping[str, Sequence[str]] | None = None,
    max_iter: int = MAX_ITER,
) -> DataFrame:
    """Remove each family on its own or, with ``combined``, named sets of families."""
    if combined is None:
        removals = dict(families)
    else:
        removals = {name: [f for family in group for f in families[family]] for name, group in combined.items()}
    return ablate(train, validation, columns, removals, max_iter)


def minimal_variants(table: DataFrame, reference: str) -> DataFrame:
    """``decision`` and ``recommended`` of each variant in a metric table.

    A variant is a candidate if it loses next to nothing against the reference in PR-AUC
    and against the best lift at 5%, or if its lift reaches the reference's. The
    candidates are ranked by lift, then PR-AUC, then fewest added features."""
    every = Window.partitionBy()  # one row per variant
    lift, pr_auc = F.col("lift_at_5pct"), F.col("pr_auc")
    of_reference = F.col("variant") == reference

    known = table.select(
        "*",
        F.max(F.when(of_reference, pr_auc)).over(every).alias("__pr_auc"),
        F.max(F.when(of_reference, lift)).over(every).alias("__lift"),
        F.max(lift).over(every).alias("__best"),
    )
    close = (change(F.col("__pr_auc"), pr_auc) <= PRUNING_TOLERANCE) & (change(lift, F.col("__best")) >= -PRUNING_TOLERANCE)
    decision = F.when(of_reference, "REFERENCE").otherwise(
        F.when(close | (lift >= F.col("__lift")), "KEEP_AS_CANDIDATE").otherwise("DROP_FROM_MINIMAL_SET")
    )
    dropped = F.col("decision") == "DROP_FROM_MINIMAL_SET"
    best_first = Window.orderBy(dropped, lift.desc(), pr_auc.desc(), "added_feature_count", "variant")
    return (
        known.withColumn("decision", decision)
        .withColumn("recommended", F.when(F.row_number().over(best_first) == 1, "yes").otherwise("no"))
        .select(*table.columns, "decision", "recommended")
    )


def prune(
    train: DataFrame,
    validation: DataFrame,
    base_columns: Sequence[str],
    groups: Mapping[str, Sequence[str]] = VELOCITY_GROUPS,
    variants: Mapping[str, Sequence[str]] = PRUNING_VARIANTS,
    max_iter: int = MAX_ITER,
) -> DataFrame:
    """Fit every variant of added feature groups and choose a minimal set. The
    first variant is the reference that has all groups."""
    added = {name: [f for g in kept for f in groups[g]] for name, kept in variants.items()}
    found = run_variants(train, validation, {n: [*base_columns, *more] for n, more in added.items()}, max_iter)
    rows: list[dict[str, Any]] = [
        {
            "variant": name,
            "included_features": ",".join(more),
            "added_feature_count": len(more),
            "total_feature_count": len(base_columns) + len(more),
            **found[name],
        }
        for name, more in added.items()
    ]
    for r in rows:
        r["pr_auc_vs_full"] = relative_change(r["pr_auc"], rows[0]["pr_auc"])
        r["lift5_vs_full"] = relative_change(r["lift_at_5pct"], rows[0]["lift_at_5pct"])
    numbers = ("added_feature_count", "total_feature_count", *METRICS, "pr_auc_vs_full", "lift5_vs_full")
    table = metric_table(train.sparkSession, rows, ("variant", "included_features"), numbers)
    judged = minimal_variants(table, next(iter(variants)))
    return judged.select("variant", "included_features", "decision", "recommended", *numbers)


def decide(metrics: Mapping[str, float], base: Mapping[str, float], rule: str = "gain") -> str:
    """Adopt, keep or investigate, from PR-AUC and lift at 5% against a base.

    ``not_worse``  adopt unless a metric falls by 0.5%, keep the base beyond 1%
    ``gain``       adopt on a gain of 0.5%, keep the base on a loss of 0.5%
    ``review``     adopt for review on a gain of 0.5%
    ``any_gain``   candidate on any gain
    ``both_gain``  promote when both metrics gain"""
    changes = [relative_change(metrics[m], base[m]) for m in CORE]
    if rule == "not_worse":
        if min(changes) >= -SMALL_CHANGE:
            return "ADOPT"
        return "KEEP" if min(changes) < -CLEAR_LOSS else "INVESTIGATE"
    if rule == "gain":
        if max(changes) >= SMALL_CHANGE:
            return "ADOPT"
        return "KEEP" if min(changes) < -SMALL_CHANGE else "INVESTIGATE"
    if rule == "review":
        return "ADOPT_FOR_REVIEW" if max(changes) >= SMALL_CHANGE else "INVESTIGATE"
    better = [metrics[m] > base[m] for m in CORE]
    if rule == "any_gain":
        return "CANDIDATE" if any(better) else "KEEP"
    if rule == "both_gain":
        return "PROMOTE" if all(better) else "KEEP"
    raise ValueError(f"unknown rule {rule!r}")


def compare_feature_sets(
    train: DataFrame,
    validation: DataFrame,
    sets: Mapping[str, Sequence[str]],
    rules: Mapping[str, str] | None = None,
    bases: Mapping[str, str] | None = None,
    max_iter: int = MAX_ITER,
) -> DataFrame:
    """Fit each named list of columns and judge it, by its rule, against its base:
    an earlier set named in ``bases``, or else the one before it."""
    found = run_variants(train, validation, sets, max_iter)
    rows: list[dict[str, Any]] = []
    for name, columns in sets.items():
        metrics, named = found[name], (bases or {}).get(name)
        base = next((r for r in reversed(rows) if named in (None, r["feature_set"])), metrics)
        rows.append(
            {
                "feature_set": name,
                "compared_with": base.get("feature_set"),
                "decision": decide(metrics, base, (rules or {}).get(name, "gain")) if rows else "BASE",
                "feature_count": len(columns),
                **metrics,
                **{f"{m}_change": relative_change(metrics[m], base[m]) for m in CORE},
            }
        )
    numbers = ("feature_count", *METRICS, *(f"{m}_change" for m in CORE))
    return metric_table(train.sparkSession, rows, ("feature_set", "compared_with", "decision"), numbers)


def join_scores(first: DataFrame, second: DataFrame, first_name: str, second_name: str) -> DataFrame:
    """Scores of two models side by side, with the columns of the first."""
    other = second.select("client_id", F.col("prediction_score").alias(second_name))
    return first.withColumnRenamed("prediction_score", first_name).join(other, "client_id")


def compare_scores(joined: DataFrame, first: str = "first", second: str = "second") -> dict[str, DataFrame]:
    """Two scores of the same clients: ``joined`` has client_id, label, both scores and the
    segments. Both models' rows, whole and by segment, are groups of one score index;
    overlaps read one index per score. The verdict is on the second score."""
    spark = joined.sparkSession
    # everybody is a segment, too
    every = joined.withColumn("all", F.lit("all"))
    sides = F.array(*(F.struct(F.lit(n).alias("model"), F.col(n).alias("prediction_score")) for n in (first, second)))
    long = every.select("client_id", "label", "all", *SEGMENTS, F.inline(sides))
    keys = ["model", "segment_type", "segment_name"]
    with held(by_segment(long, ("all", *SEGMENTS), keep=["model"])) as (rows,):
        found = segment_metrics(None, index=build_index(rows, by=keys)).collect()
    indexes = {name: build_index(joined, name) for name in (first, second)}
    overall = {r.model: r.asDict() for r in found if r.segment_type == "all"}
    parts = [r.asDict() for r in found if r.segment_type != "all"]
    of = {(r["model"], r["segment_name"]): r for r in parts}
    regressions = sorted(
        s
        for (m, s), r in of.items()
        if m == second and (b := of.get((first, s))) and None not in (r["pr_auc"], b["pr_auc"]) and r["lift_at_5pct"] < b["lift_at_5pct"]
    )
    verdict = decide(overall[second], overall[first], "both_gain")
    numbers = ("row_count", "positive_count", *METRICS)
    return {
        "overall": metric_table(spark, (overall[n] for n in (first, second)), ("model",), numbers),
        "segments": metric_table(spark, parts, ("model", "segment_type", "segment_name"), numbers),
        "overlap": topk_overlap(joined, first, second, indexes=indexes),
        "distribution": score_stats(score_delta(joined, first, second), [first, second, "score_delta"]),
        "verdict": spark.createDataFrame([(verdict, ",".join(regressions))], "verdict string, segment_regressions string"),
    }


def benchmark(first: PipelineModel, second: PipelineModel, validation: DataFrame) -> dict[str, DataFrame]:
    """Two models on one validation set: overall and segment metrics, top-K
    overlap, score distributions and the verdict on the second model."""
    context = ("label", "active_days_count", f"{BUY}_count")
    a = score(first, validation, *context)
    b = score(second, validation, "label")
    # the reports read this table several times, and later
    return compare_scores(stable(with_segments(join_scores(a, b, "first", "second"))))


def benchmark_sets(
    train: DataFrame, validation: DataFrame, first: Sequence[str], second: Sequence[str], max_iter: int = MAX_ITER
) -> dict[str, DataFrame]:
    """``benchmark`` of the models of two lists of columns, fitted from shared vectors."""
    sets = {"first": list(first), "second": list(second)}
    columns = list(dict.fromkeys([*first, *second]))
    context = ("active_days_count", f"{BUY}_count")
    with vectors(train, validation, columns, context) as of:
        scored = score_side_by_side(of, sets, fit_variants(of, sets, max_iter), context)
        return compare_scores(stable(with_segments(scored)))
