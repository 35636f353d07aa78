"""A stored index of scores: built once, read by every ranking metric.

Scores fold to one row per group and distinct score, best first. That table is
partitioned by ranges of (group, score), and a sidecar keeps the prefix sums of the
ranges, one row per range and group; with it each row knows the rows and positives
before it without a window over a whole group. Scores that several rows share have
those rows in a second table, ranked by id in the same way, so a cutoff inside ties is
a lookup. Readers scan the stored table: a top-K cutoff opens only the ranges in which
the sidecar says it lies.

Frames of equal scores, null groups and ids of any ordered type are allowed; rows
without a score are left out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientpulse.config import TOPK_PERCENTS
from clientpulse.operators.distribution import null_safe, score_counts
from clientpulse.session import stable

PART = "part"


def ranged_totals(counts: DataFrame, key: str, sums: Sequence[str], by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``counts`` (one row per group and key) stored in ranges, with ``<sum>_before`` and
    ``<sum>_total`` of each row and its range's number; and the sidecar: for each group
    and range the sums in it, before it and in all."""
    groups = list(by)
    placed = stable(counts.repartitionByRange(*groups, key).withColumn(PART, F.spark_partition_id()))
    before = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    ranges = stable(
        placed.groupBy(*groups, PART)
        .agg(*(F.sum(s).alias(s) for s in sums))
        .select(
            *groups,
            PART,
            *sums,
            *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums),
            *(F.sum(s).over(whole).alias(f"{s}_total") for s in sums),
        )
    )
    inside = Window.partitionBy(*groups, PART).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.select("*", *(F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__{s}") for s in sums))
    side = ranges.select(
        *(F.col(g).alias(f"__{g}") for g in groups),
        F.col(PART).alias("__part"),
        *(F.col(f"{s}_before").alias(f"__{s}_offset") for s in sums),
        *(f"{s}_total" for s in sums),
    )
    ranked = counted.join(side, (F.col(PART) == F.col("__part")) & null_safe(groups, "__{}")).select(
        *groups,
        *(c for c in counts.columns if c not in groups),
        *((F.col(f"__{s}") + F.col(f"__{s}_offset")).alias(f"{s}_before") for s in sums),
        *(f"{s}_total" for s in sums),
        PART,
    )
    return stable(ranked, PART), ranges


@dataclass(frozen=True)
class ScoreIndex:
    """``ranks``: groups, score, n, pos and their sums before and in all. ``ranges``: the
    sidecar. ``ties``: groups, score, id, m rows and h positives, and their sums before."""

    by: tuple[str, ...]
    ranks: DataFrame
    ranges: DataFrame
    ties: DataFrame

    def cutoffs(self, percents: Iterable[int] = TOPK_PERCENTS, population: Column | None = None) -> DataFrame:
        """Where the top K% of each group ends and what it holds, as ``topk_cutoffs``."""
        keys = [*self.by, "top_percent"]
        last = F.least(F.col("k"), F.col("n_total"))
        sized = self.ranges.select(
            *(F.col(g).alias(f"__{g}") for g in self.by),
            F.col(PART).alias("__part"),
            "n_total",
            F.col("n_before").alias("__first"),
            F.col("n").alias("__rows"),
            F.inline(wanted(F.col("n_total") if population is None else population, percents)),
        )
        # the range of each cutoff, which lets the scan open only those
        sought = sized.where((F.col("__first") < last) & (last <= F.col("__first") + F.col("__rows"))).drop("n_total")
        met = self.ranks.join(sought, (F.col(PART) == F.col("__part")) & null_safe(self.by, "__{}"))
        ends = met.where((F.col("n_before") < last) & (last <= F.col("n_before") + F.col("n"))).select(
            *keys,
            "k",
            F.col("score").alias("cutoff_score"),
            (last - F.col("n_before")).alias("take"),
            *(c for c in ("n", "n_before", "pos", "pos_before", "n_total", "pos_total")),
        )
        tied = self.ties.select(
            *(F.col(g).alias(f"__{g}") for g in self.by),
            F.col("score").alias("__score"),
            F.col("id").alias("__id"),
            "m_before",
            (F.col("m_before") + F.col("m")).alias("taken"),
            (F.col("h_before") + F.col("h")).alias("hits"),
        )
        inside = F.col("take") < F.col("n")
        same = (F.col("cutoff_score") == F.col("__score")) & null_safe(self.by, "__{}")
        here = inside & (F.col("m_before") < F.col("take")) & (F.col("take") <= F.col("taken"))
        return ends.join(tied, same & here, "left").select(
            *keys,
            "k",
            "cutoff_score",
            F.when(inside, F.col("__id")).alias("cutoff_id"),
            (F.col("n_before") + F.when(inside, F.col("taken")).otherwise(F.col("n"))).alias("top_k_count"),
            (F.col("pos_before") + F.when(inside, F.col("hits")).otherwise(F.col("pos"))).alias("positives_in_top"),
            F.col("n_total").alias("row_count"),
            F.col("pos_total").alias("positive_count"),
        )


def wanted(rows: Column, percents: Iterable[int]) -> Column:
    """(top_percent, k) structs; ceil by whole numbers, as n * percent / 100 is not exact."""
    return F.array(
        *(
            F.struct(
                F.lit(p).alias("top_percent"),
                F.greatest(F.lit(1), F.floor((rows * p + 99) / 100)).cast("long").alias("k"),
            )
            for p in sorted(set(percents))
        )
    )


def build_index(
    scored: DataFrame, score: str = "prediction_score", by: Sequence[str] = (), tie_break: str = "client_id"
) -> ScoreIndex:
    """Store the index of ``score`` within the groups ``by``, and of the rows of equal score."""
    groups = list(by)
    ranks, ranges = ranged_totals(score_counts(scored, score, groups), "key", ["n", "pos"], groups)
    shared = ranks.where("n > 1").select(*(F.col(g).alias(f"__{g}") for g in groups), F.col("score").alias("__score"))
    rows = scored.select(*groups, F.col(score).alias("score"), F.col(tie_break).alias("id"), F.col("label").cast("long").alias("label"))
    tied = rows.join(shared, (F.col("score") == F.col("__score")) & null_safe(groups, "__{}"))
    counted = tied.groupBy(*groups, "score", "id").agg(F.count("*").alias("m"), F.sum("label").alias("h"))
    ties, _ = ranged_totals(counted, "id", ["m", "h"], [*groups, "score"])
    return ScoreIndex(tuple(groups), ranks, ranges, ties)
