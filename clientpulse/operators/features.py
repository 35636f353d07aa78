"""The client feature table and the engineered feature families.

All windows, event types and cutoffs come out of one aggregation tree of narrow rows:

    (client, SKU)      counts of the three SKU types
      + product by SKU joined after the reduction, not to raw events
    (client, category) SKUs and categories become countable rows
    (client, date)     counts of all types: windows, recency, searches, active days
    (client)           one row for each snapshot

A client's cart, removal and purchase of one SKU share a row, so the event type is never a
shuffle key. The (client, SKU) and (client, date) levels combine on the map side, so a client
with a third of all events is spread out. After them the rows themselves are moved once, by
client, not the wide buffers of the next levels: a client has one row for each of its SKUs and
one for each of its days, however many events it has. Categories are made where a client's
rows are, without a shuffle of their own. Searches have no SKU and never reach the product
join, where they would all meet in one partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.config import (
    BUY,
    CART,
    ELIGIBLE,
    ELIGIBLE_TYPES,
    FEATURE_TYPES,
    FEATURE_WINDOWS,
    RECENT_SEARCH_DAYS,
    REMOVE,
    SEARCH,
    SKU_TYPES,
    TRANSITION_DAYS,
    Snapshot,
    feature_names,
    feature_registry,
)
from clientpulse.functions import in_history, safe_ratio
from clientpulse.functions.predicates import day
from clientpulse.operators.distribution import long_form, quantiles
from clientpulse.operators.paths import recent_then, transition_counts, transition_counts_of, transition_counts_of_moments

#: The column of a daily table that says how many events a row stands for.
EVENT_COUNT = "event_count"
PRODUCT_PREFIX = {"cart": CART, "bought": BUY}


def history_of(events: DataFrame, cutoff: str, types: Sequence[str] = FEATURE_TYPES) -> DataFrame:
    return events.where(in_history(cutoff) & F.col("event_type").isin(*types) & F.col("client_id").isNotNull())


def daily_activity(events: DataFrame, types: Sequence[str] = FEATURE_TYPES) -> DataFrame:
    """(client, type, SKU, day) rows with the number of events in ``EVENT_COUNT``. All that
    features and labels know of an event is in them, so a stored daily table serves any
    number of cutoffs, each by sums over a range of days, and new days are appended."""
    known = events.where(F.col("event_type").isin(*types) & F.col("client_id").isNotNull())
    return known.groupBy("client_id", "event_type", "sku", "event_date").agg(F.count("*").alias(EVENT_COUNT))


def counted(events: DataFrame, hit: Column) -> Column:
    """The number of events that ``hit``: rows, or in a daily table the sum of their counts."""
    if EVENT_COUNT in events.columns:
        return F.coalesce(F.sum(F.when(hit, F.col(EVENT_COUNT))), F.lit(0))
    return F.count_if(hit)


def before(cutoff: str) -> Column:
    return F.col("event_date") < day(cutoff)


def sku_level(history: DataFrame, cutoffs: Sequence[str], types: Sequence[str] = SKU_TYPES) -> DataFrame:
    """(client, SKU) rows; ``<type>_n_<i>`` is the number of events before the i-th cutoff."""
    counts = [
        counted(history, (F.col("event_type") == t) & before(cutoff)).alias(f"{t}_n_{i}")
        for i, cutoff in enumerate(cutoffs)
        for t in types
    ]
    return history.where(F.col("event_type").isin(*types)).groupBy("client_id", "sku").agg(*counts)


def with_products(df: DataFrame, products: DataFrame) -> DataFrame:
    """Category and price by SKU; ``products`` must be unique on SKU. The join
    strategy is left to Spark, which knows the size of the product table."""
    return df.join(products.select("sku", "category", "price"), "sku", "left")


def category_aggregates(cutoffs: Sequence[str], types: Sequence[str] = SKU_TYPES, of: str = "") -> list[Column]:
    """What ``product_aggregates`` and ``sku_aggregates`` read, by client and category.
    ``of`` is the prefix of the columns of ``with_products``."""
    price = F.col(f"{of}price")
    out = []
    for i in range(len(cutoffs)):
        for t in types:
            n = F.col(f"{of}{t}_n_{i}")
            out.append(F.count_if((n > 0) & F.col(f"{of}sku").isNotNull()).alias(f"{t}_skus_{i}"))
            if t in ELIGIBLE_TYPES:
                out += [
                    F.sum(F.when(price.isNotNull(), n)).alias(f"{t}_priced_{i}"),
                    F.sum(price.cast("double") * n).alias(f"{t}_price_sum_{i}"),
                    F.max(F.when(n > 0, price)).alias(f"{t}_max_price_{i}"),
                ]
    return out


def moved(skus: DataFrame) -> DataFrame:
    """Rows of ``with_products`` as they are moved: of the SKU only whether there is one."""
    return skus.withColumn("sku", F.when(F.col("sku").isNotNull(), True))


def day_level(history: DataFrame) -> DataFrame:
    """(client, date) rows with ``<type>_n``, the events of each type on that day."""
    return history.groupBy("client_id", "event_date").agg(
        *(counted(history, F.col("event_type") == t).alias(f"{t}_n") for t in FEATURE_TYPES)
    )


def client_tree(parts: DataFrame, days: DataFrame) -> DataFrame:
    """The rows of both levels by client, each with the struct ``of`` or ``on`` of its columns.
    The rows are moved as they are, as the buffers of all features are many times as wide."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("client_id", F.struct(*(c for c in df.columns if c != "client_id")).alias(name))

    return packed(parts, "of").unionByName(packed(days, "on"), allowMissingColumns=True).repartition("client_id")


def active_days(events: DataFrame, cutoff: str, days: int | None = None) -> DataFrame:
    """Distinct days with any included event, per client."""
    name = "active_days_count" if days is None else f"active_days_count_{days}d"
    history = history_of(events, cutoff)
    if days is not None:
        history = history.where(in_history(cutoff, days))
    return history.select("client_id", "event_date").distinct().groupBy("client_id").agg(F.count("*").alias(name))


def total(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def sku_aggregates(i: int) -> list[Column]:
    return [total(f"{t}_skus_{i}").alias(f"distinct_{t}_sku_count_{i}") for t in SKU_TYPES]


def day_parts(i: int, cutoff: str, windows: Sequence[int], active_windows: Sequence[int] = ()) -> list[Column]:
    """Of some of a client's days, what ``day_aggregates`` puts together."""
    date = F.col("on.event_date")
    past = date < day(cutoff)

    def within(w: int) -> Column:
        return past & (date >= F.date_sub(day(cutoff), w))

    out = []
    for t in FEATURE_TYPES:
        n = F.col(f"on.{t}_n")
        out += [
            total(F.when(past, n)).alias(f"{t}_count_{i}"),
            F.max(F.when(past & (n > 0), date)).alias(f"last_{t}_{i}"),
            *(total(F.when(within(w), n)).alias(f"{t}_count_{w}d_{i}") for w in windows),
        ]
    return [
        *out,
        F.count_if(past & (F.col(f"on.{SEARCH}_n") > 0)).alias(f"distinct_search_days_{i}"),
        F.count_if(past).alias(f"active_days_count_{i}"),
        *(F.count_if(within(w)).alias(f"active_days_count_{w}d_{i}") for w in active_windows),
    ]


def day_aggregates(i: int, cutoff: str, windows: Sequence[int], active_windows: Sequence[int] = ()) -> list[Column]:
    """From the columns of ``day_parts``."""
    out = []
    for t in FEATURE_TYPES:
        out += [
            total(f"{t}_count_{i}").alias(f"{t}_count_{i}"),
            F.datediff(day(cutoff), F.max(f"last_{t}_{i}")).alias(f"days_since_last_{t}_{i}"),
            *(total(f"{t}_count_{w}d_{i}").alias(f"{t}_count_{w}d_{i}") for w in windows),
        ]
    counts = ["distinct_search_days", "active_days_count", *(f"active_days_count_{w}d" for w in active_windows)]
    return [*out, *(total(f"{c}_{i}").alias(f"{c}_{i}") for c in counts)]


def product_aggregates(i: int) -> list[Column]:
    out = []
    for prefix, t in PRODUCT_PREFIX.items():
        # a row with a category has a SKU
        known = F.col("category").isNotNull() & (F.col(f"{t}_skus_{i}") > 0)
        out += [
            F.count_if(known).alias(f"distinct_{prefix}_category_count_{i}"),
            safe_ratio(F.sum(f"{t}_price_sum_{i}"), F.sum(f"{t}_priced_{i}")).alias(f"avg_{prefix}_price_{i}"),
            F.max(f"{t}_max_price_{i}").alias(f"max_{prefix}_price_{i}"),
        ]
    return out


def one_snapshot(wide: DataFrame, i: int = 0) -> DataFrame:
    """The client and the columns of the i-th snapshot, under their own names."""
    end = f"_{i}"
    return wide.select("client_id", *(F.col(c).alias(c.removesuffix(end)) for c in wide.columns if c.endswith(end)))


def activity_features(events: DataFrame, cutoff: str, windows: Sequence[int] = FEATURE_WINDOWS) -> DataFrame:
    """Counts, distinct SKUs, recency and window counts per event type."""
    history = history_of(events, cutoff)
    one = F.col("sku").isNotNull()
    skus = sku_level(history, [cutoff]).select(
        "client_id", *((one & (F.col(f"{t}_n_0") > 0)).cast("long").alias(f"{t}_skus_0") for t in SKU_TYPES)
    )
    parts = [*(F.sum(f"of.{t}_skus_0").alias(f"{t}_skus_0") for t in SKU_TYPES), *day_parts(0, cutoff, windows)]
    wanted = [*sku_aggregates(0), *day_aggregates(0, cutoff, windows)]
    found = client_tree(skus, day_level(history)).groupBy("client_id").agg(*parts).groupBy("client_id").agg(*wanted)
    order = []
    for t in FEATURE_TYPES:
        order += [f"{t}_count", *([f"distinct_{t}_sku_count"] if t in SKU_TYPES else []), f"days_since_last_{t}"]
        order += [f"{t}_count_{w}d" for w in windows]
    return one_snapshot(found).select("client_id", *order)


def product_features(events: DataFrame, products: DataFrame, cutoff: str) -> DataFrame:
    """Categories and prices of carted and bought SKUs, per client."""
    skus = sku_level(history_of(events, cutoff, ELIGIBLE_TYPES), [cutoff], ELIGIBLE_TYPES)
    rows = moved(with_products(skus, products)).repartition("client_id")
    categories = rows.groupBy("client_id", "category").agg(*category_aggregates([cutoff], ELIGIBLE_TYPES))
    return one_snapshot(categories.groupBy("client_id").agg(*product_aggregates(0)))


def ratio_features(df: DataFrame) -> DataFrame:
    carts = F.col(f"{CART}_count")
    return df.withColumns(
        {
            "buy_to_cart_ratio": safe_ratio(F.col(f"{BUY}_count"), carts),
            "remove_to_cart_ratio": safe_ratio(F.col(f"{REMOVE}_count"), carts),
            "cart_minus_remove_count": carts - F.col(f"{REMOVE}_count"),
            "search_to_cart_ratio": safe_ratio(F.col(f"{SEARCH}_count"), carts),
        }
    )


def fill_counts(df: DataFrame, windows: Sequence[int] = FEATURE_WINDOWS) -> DataFrame:
    """Null counts, and the difference of two, to 0; recency, prices and ratios keep their nulls."""
    counts = {f.name for f in feature_registry(tuple(windows)) if f.group == "activity_count"}
    counts |= {"distinct_cart_category_count", "distinct_bought_category_count", "cart_minus_remove_count"}
    return df.fillna({c: 0 for c in df.columns if c in counts})


def features_of_snapshots(
    events: DataFrame,
    products: DataFrame,
    snapshots: Sequence[Snapshot],
    windows: Sequence[int] = FEATURE_WINDOWS,
    active_windows: Sequence[int] = (),
) -> DataFrame:
    """The rows of ``build_features`` of each snapshot, with its name in ``snapshot``, from one
    pass: the levels below the client are shared by all cutoffs."""
    cutoffs = [s.cutoff for s in snapshots]
    history = history_of(events, max(cutoffs))
    skus = moved(with_products(sku_level(history, cutoffs), products))
    parts, aggregates = category_aggregates(cutoffs, of="of."), []
    for i, cutoff in enumerate(cutoffs):
        parts += day_parts(i, cutoff, windows, active_windows)
        aggregates += [*sku_aggregates(i), *product_aggregates(i), *day_aggregates(i, cutoff, windows, active_windows)]
    # days are with the SKUs that have no category
    categories = client_tree(skus, day_level(history)).groupBy("client_id", F.col("of.category").alias("category")).agg(*parts)
    wide = categories.groupBy("client_id").agg(*aggregates)
    names = [c.removesuffix("_0") for c in wide.columns if c.endswith("_0")]
    rows = F.array(
        *(F.struct(*(F.col(f"{c}_{i}").alias(c) for c in names), F.lit(s.name).alias("snapshot")) for i, s in enumerate(snapshots))
    )
    # a client without history before a cutoff has no day there
    found = wide.select("client_id", F.inline(rows)).where(F.col("active_days_count") > 0)
    in_cohort = F.col(f"{CART}_count") + F.col(f"{BUY}_count") > 0
    found = ratio_features(found.withColumn(ELIGIBLE, in_cohort.cast("int")))
    extra = [f"active_days_count_{w}d" for w in active_windows]
    return found.select("client_id", *feature_names(tuple(windows)), *extra, "snapshot")


def build_features(
    events: DataFrame,
    products: DataFrame,
    snapshot: Snapshot,
    windows: Sequence[int] = FEATURE_WINDOWS,
    active_windows: Sequence[int] = (),
) -> DataFrame:
    """One row per client with history, from events before the cutoff only.
    ``active_windows`` adds ``active_days_count_<w>d`` helper columns."""
    return features_of_snapshots(events, products, [snapshot], windows, active_windows).drop("snapshot")


def feature_catalog(df: DataFrame, windows: Sequence[int] = FEATURE_WINDOWS) -> DataFrame:
    """Name, type, group and description of each feature column of ``df``."""
    known = {f.name: f for f in feature_registry(tuple(windows))}
    rows = [
        (f.name, f.dataType.simpleString(), known[f.name].group, known[f.name].description)
        for f in df.schema.fields
        if f.name in known
    ]
    return df.sparkSession.createDataFrame(
        rows, "feature_name string, data_type string, feature_group string, description string"
    )


def feature_validation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, range and mean per feature, in one pass over the table."""
    rows = F.col("total_rows")
    return (
        long_form(df, columns)
        .groupBy(F.col("column_name").alias("feature_name"))
        .agg(
            F.count("*").alias("total_rows"),
            F.count_if(F.col("value").isNull()).alias("null_count"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.avg("value").alias("avg_value"),
        )
        .withColumn("null_rate", F.when(rows > 0, F.round(F.col("null_count") / rows, 6)))
    )


def add_features(base: DataFrame, extra: DataFrame, fills: Mapping[str, tuple[float, str]]) -> DataFrame:
    """Left join on the client; ``fills`` gives each new column's fill value and type."""
    joined = base.join(extra, "client_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)).cast(t) for c, (v, t) in fills.items()})


# Search count limits of buckets 1 to 3; 0 means none, 4 more.
SEARCH_COUNT_LIMITS = (1, 5, 20)
DEFAULT_RECENCY_LIMITS = (7, 30, 60)


def recency_thresholds(train: DataFrame, exact: bool = True) -> tuple[int, int, int]:
    """Quartiles of search recency in the training data, as three distinct whole
    days of at least 1; the default limits where there are not three."""
    names = {"q1": 0.25, "q2": 0.50, "q3": 0.75}
    row = quantiles(train, [f"days_since_last_{SEARCH}"], names, exact, 0.001).select(*names).first()
    limits = sorted({max(1, round(v)) for v in row}) if row is not None else []
    return tuple(limits) if len(limits) == 3 else DEFAULT_RECENCY_LIMITS


def step_bucket(value: Column, limits: Sequence[int]) -> Column:
    expr = F.when(value <= limits[0], 1)
    for i, limit in enumerate(limits[1:], start=2):
        expr = expr.when(value <= limit, i)
    return expr.otherwise(len(limits) + 1)


def search_buckets(df: DataFrame, thresholds: Sequence[int], recent_days: int = RECENT_SEARCH_DAYS) -> DataFrame:
    count = F.coalesce(F.col(f"{SEARCH}_count"), F.lit(0))
    recency = F.col(f"days_since_last_{SEARCH}")
    none = (count <= 0) | recency.isNull()
    return df.withColumns(
        {
            "search_count_bucket": F.when(count <= 0, 0).otherwise(step_bucket(count, SEARCH_COUNT_LIMITS)),
            "search_recency_bucket": F.when(none, 0).otherwise(step_bucket(recency, thresholds)),
            "recent_search_flag": F.when(~none & (recency <= recent_days), 1).otherwise(0),
        }
    )


TRANSITION_FILLS = {
    "search_before_cart_count": (0, "bigint"),
    "search_to_cart_rate": (0.0, "double"),
    "recent_search_then_cart_flag": (0, "int"),
}


def transition_features(
    events: DataFrame, cutoff: str, days: int = TRANSITION_DAYS, recent_days: int = RECENT_SEARCH_DAYS
) -> DataFrame:
    """Search-to-cart transitions of every client with a cart. The rate is
    smoothed, so it is 1 / (carts + 2) and not 0 where no cart had a search."""
    return transition_columns(transition_counts(events, cutoff, days, recent_days))


def transition_columns(counts: DataFrame, *keep: str) -> DataFrame:
    return counts.select(
        "client_id",
        F.col("assisted").alias("search_before_cart_count"),
        ((F.col("assisted") + 1.0) / (F.col("carts") + 2.0)).alias("search_to_cart_rate"),
        F.when(F.col("last_cart") >= F.col("first_recent_search"), 1).otherwise(0).alias("recent_search_then_cart_flag"),
        *keep,
    )


def transitions_of_snapshots(events: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """``transition_features`` of each snapshot, with its name in ``snapshot``, from one pass."""
    return transition_columns(transition_counts_of(events, {s.name: s.cutoff for s in snapshots}), "snapshot")


def transitions_of_moments(moments: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """``transitions_of_snapshots`` from stored ``paths.cart_search_moments``."""
    return transition_columns(transition_counts_of_moments(moments, {s.name: s.cutoff for s in snapshots}), "snapshot")


def add_transition_features(base: DataFrame, events: DataFrame, cutoff: str) -> DataFrame:
    return add_features(base, transition_features(events, cutoff), TRANSITION_FILLS)


def add_recent_flag(base: DataFrame, events: DataFrame, cutoff: str) -> DataFrame:
    name = "recent_search_then_cart_flag"
    return add_features(base, recent_then(events, cutoff), {name: TRANSITION_FILLS[name]})


def velocity_features(df: DataFrame, active_recent: str = "active_days_count_30d") -> DataFrame:
    """Recent against longer activity, from the 30 and 90 day counts and the
    ``active_recent`` helper column, which is dropped."""

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def velocity(short: str, long: str) -> Column:
        return (number(short) + 1.0) / (number(long) + 1.0)

    out = {}
    for prefix, t in (("cart", CART), ("buy", BUY)):
        short, long = f"{t}_count_30d", f"{t}_count_90d"
        out[f"{prefix}_velocity_30d_vs_90d"] = velocity(short, long)
        out[f"{prefix}_delta_30d_90d"] = number(short) - number(long) / 3.0
    out["search_velocity_30d_vs_90d"] = velocity(f"{SEARCH}_count_30d", f"{SEARCH}_count_90d")
    out["activity_intensity_ratio"] = velocity(active_recent, "active_days_count")
    return df.withColumns(out).drop(active_recent)
