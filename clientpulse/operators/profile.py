"""Table profiles: each table is read once, whatever the number of metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientpulse.config import BUY, CART, REMOVE, SEARCH, VISIT
from clientpulse.operators.distribution import long_form, quantiles, quantiles_of_counts, value_counts

# Tracked columns, in report order.
TRACKED = ("client_id", "sku", "url", "query", "name", "timestamp", "category", "price")
KEYS = ("client_id", "sku", "url", "category")
ENTITY_OF = {CART: "sku", REMOVE: "sku", BUY: "sku", SEARCH: "query", VISIT: "url"}
PRICE_QUANTILES = {"price_q25": 0.25, "price_median": 0.5, "price_q75": 0.75}


def distinct_count(column: str, exact: bool) -> Column:
    return F.count_distinct(column) if exact else F.approx_count_distinct(column)


def profile(df: DataFrame, table_name: str, exact: bool = False) -> DataFrame:
    """One row: row count, nulls, distinct keys, time range and parsing, prices."""
    present = set(df.columns)
    aggregates = [F.count("*").alias("row_count")]
    aggregates += [F.count_if(F.col(c).isNull()).alias(f"{c}_null_count") for c in TRACKED if c in present]
    aggregates += [distinct_count(c, exact).alias(f"{c}_distinct_count") for c in KEYS if c in present]
    if "timestamp" in present:
        parsed = F.try_to_timestamp(F.col("timestamp").cast("string"))
        given = F.col("timestamp").isNotNull()
        aggregates += [
            F.min(parsed).cast("string").alias("timestamp_min"),
            F.max(parsed).cast("string").alias("timestamp_max"),
            F.count_if(given & parsed.isNotNull()).alias("timestamp_parse_success_count"),
            F.count_if(given & parsed.isNull()).alias("timestamp_parse_failure_count"),
        ]
    if "price" in present:
        aggregates += [
            F.min("price").alias("price_min"),
            F.max("price").alias("price_max"),
            F.avg("price").alias("price_avg"),
        ]
    result = df.agg(*aggregates)
    return result.select(F.lit(table_name).alias("table_name"), *result.columns)


def table_overview(
    tables: Mapping[str, DataFrame],
    sizes: Mapping[str, int] | None = None,
    full: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """One row per table: row count, time range, and which columns it has. A caller that
    passes ``limit`` and not ``full`` defers the count of tables above so many bytes."""
    out = None
    for name, df in tables.items():
        columns = set(df.columns)
        counted = full or limit is None or (sizes or {}).get(name, 0) <= limit
        if "timestamp" in columns:
            parsed = F.try_to_timestamp(F.col("timestamp").cast("string"))
        else:
            parsed = F.lit(None).cast("timestamp")
        count = F.count("*") if counted else F.max(F.lit(None).cast("bigint"))
        row = df.agg(
            count.alias("row_count"),
            F.min(parsed).cast("string").alias("timestamp_min"),
            F.max(parsed).cast("string").alias("timestamp_max"),
        ).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit("counted" if counted else "deferred").alias("row_count_status"),
            F.lit(len(df.columns)).cast("bigint").alias("column_count"),
            "timestamp_min",
            "timestamp_max",
            *(
                F.lit(c in columns).alias(f"has_{c}")
                for c in ("client_id", "timestamp", "sku", "url", "query", "category", "price")
            ),
        )
        out = row if out is None else out.unionByName(row)
    return out


def event_overview(events: DataFrame, exact: bool = True) -> DataFrame:
    """Volume, clients, time range and entity of each event type.

    Distinct counts are taken over rows grouped by (type, client) and
    (type, entity) first, so one hot type is spread over many tasks."""
    entity = F.coalesce("sku", "url") if "url" in events.columns else F.col("sku")
    rows = events.select("event_type", "client_id", "event_ts", entity.alias("entity"))
    return (
        rows.groupBy("event_type")
        .agg(
            F.count("*").alias("row_count"),
            distinct_count("client_id", exact).alias("distinct_client_id_count"),
            F.count_if(F.col("client_id").isNull()).alias("null_client_id_count"),
            F.min("event_ts").alias("ts_min"),
            F.max("event_ts").alias("ts_max"),
            F.count_if(F.col("event_ts").isNull()).alias("null_timestamp_count"),
            distinct_count("entity", exact).alias("distinct_entity_count"),
            F.count_if(F.col("entity").isNull()).alias("null_entity_count"),
        )
        .select(
            "event_type",
            "row_count",
            "distinct_client_id_count",
            "null_client_id_count",
            F.date_format("ts_min", "yyyy-MM-dd HH:mm:ss").alias("timestamp_min"),
            F.date_format("ts_max", "yyyy-MM-dd HH:mm:ss").alias("timestamp_max"),
            "null_timestamp_count",
            _lookup(ENTITY_OF, F.col("event_type")).alias("entity_column"),
            "distinct_entity_count",
            "null_entity_count",
        )
    )


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    pairs = [F.lit(text) for pair in mapping.items() for text in pair]
    return F.create_map(*pairs)[key]


def product_overview(products: DataFrame, exact: bool = True) -> DataFrame:
    """One row about the product table, price quartiles included."""
    base = products.agg(
        F.count("*").alias("row_count"),
        distinct_count("sku", exact).alias("distinct_sku_count"),
        F.count_if(F.col("sku").isNull()).alias("null_sku_count"),
        distinct_count("category", exact).alias("distinct_category_count"),
        F.count_if(F.col("category").isNull()).alias("null_category_count"),
        F.count_if(F.col("price").isNull()).alias("null_price_count"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        F.avg("price").alias("price_avg"),
        F.count_if(F.col("name").isNull()).alias("null_name_count"),
    )
    quartiles = quantiles(products, ["price"], PRICE_QUANTILES, exact).select(F.struct(*PRICE_QUANTILES)).scalar()
    return base.withColumn("__q", quartiles).select(*base.columns, "__q.*")


def purchase_frequency(events: DataFrame) -> DataFrame:
    """How often buying clients buy: one row over all purchases."""
    clients = events.where(F.col("event_type") == BUY).groupBy("client_id").agg(F.count("*").alias("purchases"))
    # Clients fall on few distinct purchase counts, so everything else is cheap.
    counts = clients.groupBy(F.col("purchases").cast("double").alias("value")).agg(F.count("*").alias("n"))
    value, n = F.col("value"), F.col("n")
    sums = {
        "total_purchasing_clients": F.sum(n),
        "total_purchase_events": F.sum(n * value).cast("bigint"),
        "clients_with_exactly_1_purchase": F.sum(F.when(value == 1, n)),
        **{f"clients_with_{k}_plus_purchases": F.sum(F.when(value >= k, n)) for k in (2, 3, 5)},
    }
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
    wanted = {f"purchase_count_{name}": q for name, q in names.items()}
    totals = [F.coalesce(expr, F.lit(0)).alias(name) for name, expr in sums.items()]
    total = F.col("total_purchasing_clients")
    return quantiles_of_counts(counts, wanted, extra=totals).select(
        *sums,
        F.when(total > 0, F.col("total_purchase_events") / total).alias("average_purchases_per_purchasing_client"),
        *(
            F.round(F.when(total > 0, F.col(c) / total * 100), 4).alias(f"{c}_pct")
            for c in sums
            if c.startswith("clients_with")
        ),
        *wanted,
    )


FEATURE_QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
SCORE_QUANTILES = {
    "p01": 0.01,
    "p05": 0.05,
    "p10": 0.10,
    "p25": 0.25,
    "p50": 0.50,
    "p75": 0.75,
    "p90": 0.90,
    "p95": 0.95,
    "p99": 0.99,
}


def feature_stats(
    df: DataFrame, columns: list[str], probabilities: Mapping[str, float] = FEATURE_QUANTILES, exact: bool = True
) -> DataFrame:
    """Distribution of every column: one row per column, two aggregations in all.
    Several passes over ``df``: give a stored table, not a long plan."""
    value = F.col("value")
    moments = (
        long_form(df, columns)
        .groupBy("column_name")
        .agg(
            F.count("*").alias("row_count"),
            F.count("value").alias("non_null_count"),
            F.avg("value").alias("mean"),
            F.stddev("value").alias("stddev"),
            F.variance("value").alias("variance"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.count_if(value == 0).alias("zero_count"),
        )
    )
    ranks = quantiles(df, columns, probabilities, exact)
    rows = F.col("row_count")
    return moments.join(ranks, "column_name", "left").select(
        F.col("column_name").alias("feature_name"),
        "row_count",
        "non_null_count",
        (rows - F.col("non_null_count")).alias("missing_count"),
        F.when(rows > 0, (rows - F.col("non_null_count")) / rows).otherwise(0.0).alias("missing_rate"),
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        "mean",
        "stddev",
        "variance",
        "min",
        *probabilities,
        "max",
        "zero_count",
        F.when(rows > 0, F.col("zero_count") / rows).otherwise(0.0).alias("zero_rate"),
    )


def score_stats(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Moments and nine quantiles of score columns, one row per column."""
    return feature_stats(df, columns, SCORE_QUANTILES, exact).select(
        F.col("feature_name").alias("score_name"),
        F.col("non_null_count").alias("count"),
        "mean",
        "variance",
        "stddev",
        "min",
        *SCORE_QUANTILES,
        "max",
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null or NaN cells per column, and the imputation they will get."""
    missing = F.col("value").isNull() | F.isnan("value")
    return (
        long_form(df, columns)
        .groupBy(F.col("column_name").alias("feature_name"))
        .agg(F.count_if(missing).alias("null_count_before_imputation"))
        .withColumn("imputation_strategy", F.lit("median"))
    )


__all__ = [
    "event_overview",
    "feature_stats",
    "null_counts",
    "product_overview",
    "profile",
    "purchase_frequency",
    "quantiles",
    "score_stats",
    "table_overview",
    "value_counts",
]
