"""Cart-to-purchase and search-to-cart paths.

The general case is an as-of lookup: the latest right-hand time at or before a
left-hand time. It is done over distinct moments, cut into time slices, so one
very active client is spread over many tasks; only the last moment of each
slice travels between slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clientpulse.config import BUY, CART, RECENT_SEARCH_DAYS, SEARCH, TRANSITION_DAYS, Snapshot
from clientpulse.functions import in_history, in_target, safe_ratio
from clientpulse.functions.predicates import day
from clientpulse.operators.distribution import quantiles_of_counts

SLICE_SECONDS = 3600
MICROS = 1_000_000
DELAY_QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9}


def latest_marked(
    moments: DataFrame, by: Sequence[str], on: str, marked: str, inclusive: bool = True, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """Add ``latest``: the last marked moment not after (or before) each moment.

    ``moments`` holds one row per (``by``, ``on``), and ``marked`` equals ``on``
    where the moment counts and is null elsewhere. A window covers one slice of
    one key; the second window sees one row per slice."""
    keys = list(by)
    sliced = moments.withColumn("__slice", F.floor(F.unix_micros(F.col(on)) / (slice_seconds * MICROS)))
    earlier_slices = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.max(marked).alias("__last"))
        .select(*keys, "__slice", F.max("__last").over(earlier_slices).alias("__carried"))
    )
    end = Window.currentRow if inclusive else -1
    in_slice = Window.partitionBy(*keys, "__slice").orderBy(on).rowsBetween(Window.unboundedPreceding, end)
    return (
        sliced.withColumn("__inside", F.max(marked).over(in_slice))
        .join(carried, [*keys, "__slice"])
        .withColumn("latest", F.coalesce("__inside", "__carried"))
        .drop("__slice", "__inside", "__carried")
    )


def asof_latest(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, inclusive: bool = True
) -> DataFrame:
    """Left rows with ``latest_<right_on>``: the latest right time of the same
    key at or before (``inclusive=False``: strictly before) the left time."""
    keys = list(by)

    def times(df: DataFrame, on: str, is_left: bool) -> DataFrame:
        return df.select(*keys, F.col(on).alias("__ts"), F.lit(is_left).alias("__left"))

    both = times(left, left_on, True).unionByName(times(right, right_on, False)).where(F.col("__ts").isNotNull())
    moments = both.groupBy(*keys, "__ts").agg(
        F.max("__left").alias("__left"), F.max(F.when(~F.col("__left"), F.col("__ts"))).alias("__marked")
    )
    found = (
        latest_marked(moments, keys, "__ts", "__marked", inclusive)
        .where("__left")
        .select(*keys, F.col("__ts").alias(left_on), F.col("latest").alias(f"latest_{right_on}"))
    )
    return left.join(found, [*keys, left_on], "left")


def latest_prior(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str) -> DataFrame:
    """Latest strictly earlier right-hand time of the same key for each left row."""
    return asof_latest(left, right, keys, left_ts, right_ts, inclusive=False)


def preceded_within(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, days: int
) -> DataFrame:
    """Left rows with a right-hand time in the ``days`` days before, both ends included."""
    latest = f"latest_{right_on}"
    near = F.col(latest) >= F.col(left_on) - F.make_dt_interval(days=F.lit(days))
    return asof_latest(left, right, by, left_on, right_on).where(near).drop(latest)


def sku_paths(events: DataFrame, snapshot: Snapshot) -> DataFrame:
    """One row per (client, SKU): last cart in history, purchases in the window.

    All history lies before all of the window, so the latest earlier cart of any
    purchase is the last cart of all, and no join is needed."""
    carted = (F.col("event_type") == CART) & in_history(snapshot.cutoff, grain="ts")
    bought = (F.col("event_type") == BUY) & in_target(snapshot.cutoff, snapshot.target_end)
    return (
        events.where(F.col("event_type").isin(CART, BUY) & (carted | bought))
        .groupBy("client_id", "sku")
        .agg(
            F.max(F.when(carted, F.col("event_ts"))).alias("last_cart_ts"),
            F.min(F.when(bought, F.col("event_ts"))).alias("first_purchase_ts"),
            F.count_if(bought).alias("purchases"),
        )
    )


def purchase_path(events: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Target buyers and purchases with and without an earlier cart: six counters
    with their denominators and rates."""
    carted = F.col("last_cart_ts").isNotNull()
    bought = F.col("purchases") > 0
    clients = (
        sku_paths(events, snapshot)
        .groupBy("client_id")
        .agg(
            F.max(carted).alias("has_cart"),
            F.max(bought).alias("is_buyer"),
            F.max(carted & bought & F.col("sku").isNotNull()).alias("has_sku_path"),
            F.sum("purchases").alias("purchases"),
            F.sum(F.when(carted & F.col("sku").isNotNull(), F.col("purchases")).otherwise(0)).alias("path_purchases"),
        )
        .where("is_buyer")
    )
    totals = clients.agg(
        F.count("*").alias("buyers"),
        F.count_if("has_cart").alias("with_cart"),
        F.count_if("has_sku_path").alias("with_sku_path"),
        F.coalesce(F.sum("purchases"), F.lit(0)).alias("purchases"),
        F.coalesce(F.sum("path_purchases"), F.lit(0)).alias("path_purchases"),
    )
    buyers, purchases = F.col("buyers"), F.col("purchases")
    metrics = (
        ("target_window_buyers", buyers, buyers),
        ("target_window_buyers_with_add_to_cart_before_cutoff", F.col("with_cart"), buyers),
        ("target_window_buyers_without_add_to_cart_before_cutoff", buyers - F.col("with_cart"), buyers),
        ("target_window_buyers_with_prior_same_sku_cart_before_first_purchase", F.col("with_sku_path"), buyers),
        ("target_purchase_events", purchases, purchases),
        ("target_purchase_events_with_prior_same_sku_add_to_cart", F.col("path_purchases"), purchases),
    )
    rows = (
        F.struct(
            F.lit(name).alias("metric"),
            value.alias("value"),
            whole.alias("denominator"),
            safe_ratio(value, whole).alias("rate"),
        )
        for name, value, whole in metrics
    )
    return totals.select(F.inline(F.array(*rows)))


def cart_delays(events: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Days from the last cart to the first window purchase of each (client, SKU)."""
    return (
        sku_paths(events, snapshot)
        .where(F.col("sku").isNotNull() & F.col("last_cart_ts").isNotNull() & (F.col("purchases") > 0))
        .select(
            "client_id",
            "sku",
            F.datediff(F.to_date("first_purchase_ts"), F.to_date("last_cart_ts")).alias("delay_days"),
        )
    )


def cart_delay_quantiles(events: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Count, ends and quantiles of the delays, all from the table of distinct delays."""
    value = F.col("delay_days").cast("double").alias("value")
    counts = cart_delays(events, snapshot).groupBy(value).agg(F.count("*").alias("n"))
    ends = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("path_count"),
        F.min("value").cast("bigint").alias("min_delay_days"),
        F.max("value").cast("bigint").alias("max_delay_days"),
    ]
    return quantiles_of_counts(counts, DELAY_QUANTILES, extra=ends).select(
        "path_count", "min_delay_days", *(F.col(q).alias(f"{q}_delay_days") for q in DELAY_QUANTILES), "max_delay_days"
    )


def transition_counts(
    events: DataFrame, cutoff: str, days: int = TRANSITION_DAYS, recent_days: int = RECENT_SEARCH_DAYS
) -> DataFrame:
    """Per client: carts, carts with a search in the ``days`` before, and whether
    a cart follows a search of the last ``recent_days`` days of history."""
    return transition_counts_of(events, {"": cutoff}, days, recent_days).drop("snapshot")


def transition_counts_of(
    events: DataFrame, cutoffs: Mapping[str, str], days: int = TRANSITION_DAYS, recent_days: int = RECENT_SEARCH_DAYS
) -> DataFrame:
    """``transition_counts`` of each named cutoff, with its name in ``snapshot``. The search
    before a cart does not depend on the cutoff, so all cutoffs share it."""
    return transition_counts_of_moments(cart_search_moments(events, max(cutoffs.values())), cutoffs, days, recent_days)


def cart_search_moments(events: DataFrame, cutoff: str) -> DataFrame:
    """(client, time) rows before the cutoff with their carts, and the time again where it has
    a search. ``transition_counts_of_moments`` reads them twice, so they are worth storing."""
    kind, ts = F.col("event_type"), F.col("event_ts")
    history = events.where(
        in_history(cutoff) & kind.isin(CART, SEARCH) & ts.isNotNull() & F.col("client_id").isNotNull()
    )
    return history.groupBy("client_id", "event_ts").agg(
        F.count_if(kind == CART).alias("carts"), F.max(F.when(kind == SEARCH, ts)).alias("search_ts")
    )


def transition_counts_of_moments(
    moments: DataFrame, cutoffs: Mapping[str, str], days: int = TRANSITION_DAYS, recent_days: int = RECENT_SEARCH_DAYS
) -> DataFrame:
    """``transition_counts_of`` from ``cart_search_moments`` up to the last cutoff."""
    ts = F.col("event_ts")
    near = F.col("latest") >= ts - F.make_dt_interval(days=F.lit(days))
    aggregates = []
    for i, (name, cutoff) in enumerate(cutoffs.items()):
        past = F.to_date(ts) < day(cutoff)
        recent = past & (F.to_date("search_ts") >= F.date_sub(day(cutoff), recent_days))
        aggregates.append(
            F.struct(
                F.lit(name).alias("snapshot"),
                F.coalesce(F.sum(F.when(past, F.col("carts"))), F.lit(0)).alias("carts"),
                F.coalesce(F.sum(F.when(past & near, F.col("carts"))), F.lit(0)).alias("assisted"),
                F.max(F.when(past & (F.col("carts") > 0), ts)).alias("last_cart"),
                F.min(F.when(recent, F.col("search_ts"))).alias("first_recent_search"),
            ).alias(f"of_{i}")
        )
    wide = latest_marked(moments, ["client_id"], "event_ts", "search_ts").groupBy("client_id").agg(*aggregates)
    rows = F.array(*(F.col(f"of_{i}") for i in range(len(cutoffs))))
    return wide.select("client_id", F.inline(rows)).where(F.col("carts") > 0)


def recent_then(events: DataFrame, cutoff: str, recent_days: int = RECENT_SEARCH_DAYS) -> DataFrame:
    """Clients with a cart at or after a recent search. Some pair exists exactly
    when the last cart is not before the first recent search, so two extremes
    per client replace the row-level inequality join."""
    kind, ts = F.col("event_type"), F.col("event_ts")
    recent = (kind == SEARCH) & (F.col("event_date") >= F.date_sub(day(cutoff), recent_days))
    return (
        events.where(in_history(cutoff) & kind.isin(CART, SEARCH) & (recent | (kind == CART)))
        .where(F.col("client_id").isNotNull())
        .groupBy("client_id")
        .agg(F.max(F.when(kind == CART, ts)).alias("last_cart"), F.min(F.when(recent, ts)).alias("first_search"))
        .where(F.col("last_cart") >= F.col("first_search"))
        .select("client_id", F.lit(1).alias("recent_search_then_cart_flag"))
    )
