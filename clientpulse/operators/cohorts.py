"""Client cohorts as flags: set sizes, overlaps and framings without joins.

Each client is reduced to a few boolean flags. Clients then fall on at most
sixteen flag patterns, and every set size, intersection, union and difference
is a sum over that pattern table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.config import BUY, CART, SEARCH, Snapshot
from clientpulse.functions import in_history, in_target, safe_ratio

FLAGS = ("in_cart", "in_buy", "in_search", "bought_in_target")


def cohort_flags(events: DataFrame, snapshot: Snapshot) -> DataFrame:
    """One row per client seen in a cohort or buying in the target window."""
    history = in_history(snapshot.cutoff, grain="ts")
    target = in_target(snapshot.cutoff, snapshot.target_end)
    kind = F.col("event_type")
    relevant = kind.isin(CART, BUY, SEARCH) & (history | (target & (kind == BUY)))
    return (
        events.where(relevant)
        .groupBy("client_id")
        .agg(
            F.max((kind == CART) & history).alias("in_cart"),
            F.max((kind == BUY) & history).alias("in_buy"),
            F.max((kind == SEARCH) & history).alias("in_search"),
            F.max((kind == BUY) & target).alias("bought_in_target"),
        )
    )


def flag_patterns(flags: DataFrame) -> DataFrame:
    return flags.groupBy(*FLAGS).agg(F.count("*").alias("n"))


def framings() -> dict[str, Column]:
    """Candidate cohort names and their definitions."""
    cart, buy, search = F.col("in_cart"), F.col("in_buy"), F.col("in_search")
    return {
        "current_prior_cart_or_purchase": cart | buy,
        "cart_only": cart,
        "search_cart_buy": search | cart | buy,
        "buy_only": buy,
        "search_only": search & ~(cart | buy),
    }


def size(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")


def cohort_overlap(flags: DataFrame) -> DataFrame:
    """Sizes and overlap rates of the history cohorts, as eleven rows."""
    cart, buy, search = F.col("in_cart"), F.col("in_buy"), F.col("in_search")
    sizes = flag_patterns(flags).agg(
        size(cart).alias("cart"),
        size(buy).alias("buy"),
        size(search).alias("search"),
        size(cart | buy).alias("current"),
        size(buy & ~cart).alias("buy_no_cart"),
        size(search & ~(cart | buy)).alias("search_only"),
        size(cart & buy).alias("cart_and_buy"),
    )
    current = F.col("current")
    extra = current - F.col("cart")
    metrics = {
        "add_to_cart_before_cutoff": F.col("cart"),
        "product_buy_before_cutoff": F.col("buy"),
        "search_query_before_cutoff": F.col("search"),
        "current_add_to_cart_or_product_buy_before_cutoff": current,
        "cart_conversion_cohort": F.col("cart"),
        "buyers_without_cart_before_cutoff": F.col("buy_no_cart"),
        "search_only_before_cutoff": F.col("search_only"),
        "add_to_cart_product_buy_jaccard_overlap": safe_ratio(F.col("cart_and_buy"), current),
        "buyers_without_cart_rate": safe_ratio(F.col("buy_no_cart"), current),
        "current_vs_cart_cohort_extra_clients": extra,
        "current_vs_cart_cohort_extra_rate": safe_ratio(extra, current),
    }
    rows = (F.struct(F.lit(k).alias("cohort_name"), v.cast("double").alias("value")) for k, v in metrics.items())
    return sizes.select(F.inline(F.array(*rows)))


def candidate_cohorts(flags: DataFrame) -> DataFrame:
    """Size, overlap with the current cohort and class balance of each framing."""
    defined = framings()
    current, cart = defined["current_prior_cart_or_purchase"], defined["cart_only"]
    rows = []
    aggregates = []
    for name, cohort in defined.items():
        aggregates.append(
            F.struct(
                F.lit(name).alias("candidate"),
                size(cohort).alias("cohort_client_count"),
                size(cohort & current).alias("overlap_with_current_count"),
                size(cohort & ~current).alias("extra_clients_vs_current"),
                size(cohort & ~cart).alias("extra_clients_vs_cart_only"),
                size(cohort & F.col("bought_in_target")).alias("positive_client_count"),
            ).alias(name)
        )
        rows.append(F.col(name))
    total, positive = F.col("cohort_client_count"), F.col("positive_client_count")
    rate = safe_ratio(positive, total)
    return (
        flag_patterns(flags)
        .agg(*aggregates)
        .select(F.inline(F.array(*rows)))
        .select(
            "candidate",
            "cohort_client_count",
            "overlap_with_current_count",
            safe_ratio(F.col("overlap_with_current_count"), total).alias("overlap_with_current_rate"),
            "extra_clients_vs_current",
            "extra_clients_vs_cart_only",
            "positive_client_count",
            (total - positive).alias("negative_client_count"),
            rate.alias("positive_rate"),
            F.when(rate < 0.05, "high").otherwise("moderate").alias("class_imbalance_risk"),
        )
    )


def overlap_matrix(flags: DataFrame) -> DataFrame:
    """Intersection, share of the left cohort and Jaccard index of every pair."""

    def members(side: str) -> Column:
        named = (
            F.struct(F.lit(name).alias(f"{side}_candidate"), cohort.alias(f"in_{side}")) for name, cohort in framings().items()
        )
        return F.inline(F.array(*named))

    # 25 pairs of cohorts for each of at most 16 patterns
    pairs = flag_patterns(flags).select("*", members("left")).select("*", members("right"))
    left, right, inter = F.col("in_left"), F.col("in_right"), F.col("intersection_count")
    return (
        pairs.groupBy("left_candidate", "right_candidate")
        .agg(
            size(left).alias("left_count"),
            size(right).alias("right_count"),
            size(left & right).alias("intersection_count"),
            size(left | right).alias("union_count"),
        )
        .select(
            "left_candidate",
            "right_candidate",
            "left_count",
            "right_count",
            "intersection_count",
            safe_ratio(inter, F.col("left_count")).alias("intersection_over_left_rate"),
            safe_ratio(inter, F.col("union_count")).alias("jaccard_rate"),
        )
    )
