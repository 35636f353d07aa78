"""Which target and which window to predict: candidates, balance, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clientpulse.config import BUY, CART, TARGET_WINDOWS
from clientpulse.functions import safe_ratio

# Candidate targets with their complexity and business-value ranks.
TARGETS = (
    # name, cohort, positive means a purchase, complexity, rank, business value, rank
    ("purchase_propensity", "active", True, "medium", 3, "high", 1),
    ("cart_conversion", "cart", True, "low_to_medium", 2, "high", 1),
    ("purchase_based_churn", "buy", False, "low", 1, "medium", 2),
)
WINDOW_COLUMNS = ("history_start", "cutoff_date", "target_end", "history_days")
BALANCE_CENTER = 0.25
MIN_NON_CHURN_RATE = 0.03


def client_dates(events: DataFrame, broad: bool = False) -> DataFrame:
    """First and last purchase, first cart and, with ``broad``, first event of each client:
    all that cohorts and buyers of any window follow from."""
    kind, date = F.col("event_type"), F.col("event_date")
    rows = events if broad else events.where(kind.isin(CART, BUY))
    return rows.groupBy("client_id").agg(
        F.min(F.when(kind == BUY, date)).alias("first_buy"),
        F.max(F.when(kind == BUY, date)).alias("last_buy"),
        F.min(F.when(kind == CART, date)).alias("first_cart"),
        F.min(date).alias("first_any"),
    )


def with_windows(bounds: DataFrame, days: Sequence[int]) -> DataFrame:
    """(target_days, history_start, cutoff_date, target_end, history_days) of each length:
    a window ends on the last purchase date."""
    cutoff = F.date_sub(F.col("target_end"), F.col("target_days") - 1)
    return bounds.select("*", F.explode(F.array(*(F.lit(d) for d in days))).alias("target_days")).withColumns(
        {"cutoff_date": cutoff, "history_days": F.datediff(cutoff, "history_start")}
    )


def target_windows(events: DataFrame, days: Sequence[int] = TARGET_WINDOWS) -> DataFrame:
    """One row per window length."""
    bounds = events.where(F.col("event_type") == BUY).agg(
        F.min("event_date").alias("history_start"), F.max("event_date").alias("target_end")
    )
    return with_windows(bounds, days).select("target_days", *WINDOW_COLUMNS)


def window_counts(events: DataFrame, days: Sequence[int] = TARGET_WINDOWS, broad: bool = False) -> DataFrame:
    """Window, cohort size and buyers for all windows, from one aggregation by client.

    ``active`` is cart or purchase history and ``any`` (only with ``broad``) any event
    in history. The bounds are taken from the clients' dates, so events are read once."""
    clients = client_dates(events, broad)
    bounds = clients.agg(
        F.struct(F.min("first_buy").alias("history_start"), F.max("last_buy").alias("target_end")).alias("b")
    ).scalar()
    dated = clients.withColumn("b", bounds)
    names = ("buy", "cart", "active", *(("any",) if broad else ()))
    cells = []
    for d in days:
        cutoff = F.date_sub(F.col("b.target_end"), d - 1)
        buys, carts = F.col("first_buy") < cutoff, F.col("first_cart") < cutoff
        members = {
            "buy": buys,
            "cart": carts,
            "active": F.coalesce(buys, F.lit(False)) | F.coalesce(carts, F.lit(False)),
            "any": F.col("first_any") < cutoff,
        }
        for name in names:
            cells.append(
                F.struct(
                    F.lit(d).alias("days"),
                    F.lit(name).alias("cohort"),
                    F.count_if(members[name]).alias("eligible_clients"),
                    F.count_if(members[name] & (F.col("last_buy") >= cutoff)).alias("buyers"),
                )
            )
    counted = dated.agg(F.array(*cells).alias("cells"), F.max("b.history_start").alias("history_start"), F.max("b.target_end").alias("target_end"))
    rows = with_windows(counted, days).select("target_days", *WINDOW_COLUMNS, F.inline("cells"))
    return rows.where(F.col("days") == F.col("target_days")).drop("days")


def rate6(part: Column, whole: Column) -> Column:
    return F.round(safe_ratio(part, whole), 6)


def churn_balance(events: DataFrame, days: Sequence[int] = TARGET_WINDOWS) -> DataFrame:
    """Of the clients who bought in history, how many do not buy in the window."""
    eligible, stayed = F.col("eligible_clients"), F.col("buyers")
    counts = window_counts(events, days).where(F.col("cohort") == "buy")
    return counts.select(
        "target_days",
        *WINDOW_COLUMNS,
        "eligible_clients",
        (eligible - stayed).alias("churn_clients"),
        stayed.alias("non_churn_clients"),
        rate6(eligible - stayed, eligible).alias("churn_rate"),
        rate6(stayed, eligible).alias("non_churn_rate"),
    )


def imbalance_note(rate: Column) -> Column:
    return (
        F.when(rate.isNull(), "not_available")
        .when(rate < 0.10, "positive_class_low")
        .when(rate > 0.40, "positive_class_high")
        .otherwise("moderate_for_baseline")
    )


def target_comparison(events: DataFrame, days: Sequence[int] = TARGET_WINDOWS) -> DataFrame:
    """Every candidate target in every window, ranked; the best has the smallest
    sum of ranks, and of equals the first by window and target order."""
    targets = F.array(
        *(
            F.struct(
                F.lit(i).alias("target_order"),
                F.lit(name).alias("target_name"),
                F.lit(cohort).alias("target_cohort"),
                F.lit(buys).alias("positive_buys"),
                F.lit(complexity).alias("implementation_complexity"),
                F.lit(c_rank).alias("complexity_rank"),
                F.lit(value).alias("business_value"),
                F.lit(v_rank).alias("business_value_rank"),
            )
            for i, (name, cohort, buys, complexity, c_rank, value, v_rank) in enumerate(TARGETS)
        )
    )
    eligible = F.col("eligible_clients")
    positive = F.when(F.col("positive_buys"), F.col("buyers")).otherwise(eligible - F.col("buyers"))
    rows = (
        window_counts(events, days)
        .select("*", F.inline(F.filter(targets, lambda t: t["target_cohort"] == F.col("cohort"))))
        .withColumn("positive_clients", positive)
        .withColumn("negative_clients", eligible - F.col("positive_clients"))
        .withColumn("positive_rate", rate6(F.col("positive_clients"), eligible))
        .withColumn("negative_rate", rate6(F.col("negative_clients"), eligible))
    )
    # Nine rows, so a window over all of them is one small task.
    distance = F.abs(F.col("positive_rate") - BALANCE_CENTER)
    ranked = (
        rows.withColumn("coverage_rank", F.dense_rank().over(Window.orderBy(F.col("eligible_clients").desc())))
        .withColumn(
            "balance_rank",
            F.when(distance.isNull(), 99).otherwise(F.dense_rank().over(Window.orderBy(distance.asc_nulls_last()))),
        )
        .withColumn(
            "overall_recommendation_score",
            F.expr("coverage_rank + balance_rank + complexity_rank + business_value_rank"),
        )
        .withColumn(
            "overall_recommendation_rank", F.dense_rank().over(Window.orderBy("overall_recommendation_score"))
        )
        .withColumn(
            "recommended",
            F.row_number().over(Window.orderBy("overall_recommendation_score", "target_days", "target_order")) == 1,
        )
    )
    return ranked.select(
        "target_name",
        "target_days",
        "history_start",
        "cutoff_date",
        "target_end",
        "eligible_clients",
        "positive_clients",
        "negative_clients",
        "positive_rate",
        "negative_rate",
        imbalance_note(F.col("positive_rate")).alias("label_imbalance_note"),
        "implementation_complexity",
        "business_value",
        "coverage_rank",
        "balance_rank",
        "complexity_rank",
        "business_value_rank",
        "overall_recommendation_score",
        "overall_recommendation_rank",
        "recommended",
    )


def recommend_target(comparison: DataFrame) -> DataFrame:
    return comparison.where("recommended").select(
        "target_name", "target_days", "eligible_clients", "positive_rate", "overall_recommendation_score"
    )


def recommend_window(balance: DataFrame, preferred: int = 30) -> DataFrame:
    """The preferred window if enough buyers return in it, else the one where most do."""
    good = (F.col("target_days") == preferred) & (F.col("non_churn_rate") >= MIN_NON_CHURN_RATE)
    order = F.struct(
        (~F.coalesce(good, F.lit(False))).alias("a"),
        (-F.coalesce("non_churn_rate", F.lit(0.0))).alias("b"),
        F.col("target_days").alias("c"),
    )
    fields = ("target_days", "cutoff_date", "target_end", "eligible_clients", "churn_rate", "non_churn_rate")
    return balance.agg(F.min_by(F.struct(*fields), order).alias("best")).select("best.*")


def active_cohorts(events: DataFrame, days: Sequence[int] = TARGET_WINDOWS, broad: bool = False) -> DataFrame:
    """Cohort options per window: A purchase history, B purchase or cart, C any
    event. C needs the large page-visit table, so it is skipped unless ``broad``."""
    option = F.when(F.col("cohort") == "buy", "A").when(F.col("cohort") == "active", "B").otherwise("C")
    eligible, buyers = F.col("eligible_clients"), F.col("buyers")
    computed = F.struct(
        option.alias("cohort_option"),
        eligible.alias("eligible_clients"),
        buyers.alias("clients_with_purchase_in_target"),
        rate6(buyers, eligible).alias("target_positive_rate"),
        F.lit("computed").alias("status"),
    )
    skipped = F.struct(
        F.lit("C").alias("cohort_option"),
        F.lit(None).cast("bigint").alias("eligible_clients"),
        F.lit(None).cast("bigint").alias("clients_with_purchase_in_target"),
        F.lit(None).cast("double").alias("target_positive_rate"),
        F.lit("skipped").alias("status"),
    )
    options = F.array(computed) if broad else F.when(F.col("cohort") == "buy", F.array(computed, skipped)).otherwise(F.array(computed))
    counts = window_counts(events, days, broad).where(F.col("cohort") != "cart")
    return counts.select("target_days", "cutoff_date", "target_end", F.inline(options))
