"""Views of the driver's tables in the shape of the canonical event model.

Two behaviour sources: ``events`` (true sub-second times, dense clients) and
``orders`` with ``lineitem`` (more clients and SKU-level paths). One scored
source for metric operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientpulse.config import BUY, CART, FEATURE_TYPES, REMOVE, SEARCH, VISIT, Snapshot

# How the driver's event types stand for the canonical ones.
EVENT_TYPE_OF = {"click": CART, "error": REMOVE, "purchase": BUY, "view": SEARCH, "signup": VISIT}
SOURCE_OF = {canonical: source for source, canonical in EVENT_TYPE_OF.items()}

EVENTS_SNAPSHOT = Snapshot("2024-01-21", "2024-01-30", "events")
EVENTS_LAST_DAY = Snapshot("2024-01-30", "2024-01-30", "events_last_day")
EVENTS_WINDOWS = (3, 7, 14)
ORDERS_TRAIN = Snapshot("2001-06-01", "2001-06-30", "orders_train")
ORDERS_SNAPSHOT = Snapshot("2001-07-02", "2001-07-31", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """One raw event table with text timestamps, as delivered before cleaning."""
    source = table(spark, sf_dir, "events").where(F.col("event_type") == SOURCE_OF[event_type])
    columns = [F.col("user_id").alias("client_id"), F.col("ts").cast("string").alias("timestamp")]
    if event_type == VISIT:
        columns.append(_props_key().alias("url"))
    elif event_type == SEARCH:
        columns.append(F.col("props").alias("query"))
    else:
        columns.append(_props_key().alias("sku"))
    return source.select(*columns)


def raw_text_events(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Raw events whose ids are text: clients that end in 5 are no numbers, SKUs that end
    in 7 are missing, those that end in 3 no numbers."""
    raw = raw_events(spark, sf_dir, event_type)
    client, sku = F.col("client_id").cast("string"), F.col("sku").cast("string")
    return raw.select(
        F.when(client.endswith("5"), F.concat(F.lit("c"), client)).otherwise(client).alias("client_id"),
        "timestamp",
        F.when(sku.endswith("7"), None).when(sku.endswith("3"), F.lit("abc")).otherwise(sku).alias("sku"),
    )


def _props_key() -> Column:
    return F.get_json_object("props", "$.k").try_cast("bigint")


def stream_events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """The driver's ``events`` as clean events."""
    types = types or tuple(SOURCE_OF)
    source = table(spark, sf_dir, "events").where(F.col("event_type").isin(*(SOURCE_OF[t] for t in types)))
    canonical = F.when(F.col("event_type") == SOURCE_OF[types[0]], F.lit(types[0]))
    for t in types[1:]:
        canonical = canonical.when(F.col("event_type") == SOURCE_OF[t], F.lit(t))
    ts = F.col("ts").cast("timestamp")
    return source.select(
        F.col("user_id").alias("client_id"),
        ts.alias("event_ts"),
        F.to_date(ts).alias("event_date"),
        canonical.alias("event_type"),
        F.when(F.col("event_type").isin("click", "error", "purchase"), _props_key()).alias("sku"),
        F.when(F.col("event_type") == "signup", _props_key()).alias("url"),
    )


def order_events(spark: SparkSession, sf_dir: str, *types: str, timed: bool = True) -> DataFrame:
    """Line items as cart, purchase and removal events, orders as searches.
    Every line-item type comes from the same single join with ``orders``. Whole events
    leave it, so branches that read different columns of them share its shuffles. ``timed=False``
    leaves ``event_ts`` out: times become dates before the join, whose rows are narrower."""
    types = types or FEATURE_TYPES

    def source(name: str, time: str, *others: str | Column) -> DataFrame:
        at = F.col(time).cast("timestamp")
        return table(spark, sf_dir, name).select(*others, (at if timed else F.to_date(at)).alias(time))

    orders = source("orders", "o_orderdate", "o_orderkey", "o_custkey")
    at = F.col("at")
    times = (at.alias("event_ts"), F.to_date(at).alias("event_date")) if timed else (at.alias("event_date"),)
    columns = ("client_id", *times, "event_type", "sku")
    parts = []
    if set(types) & {CART, BUY, REMOVE}:
        removed = (F.col("l_returnflag") == "R").alias("l_removed")
        lines = source("lineitem", "l_shipdate", "l_orderkey", "l_partkey", removed)
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

        def made(event_type: str, at: str) -> Column:
            return F.struct(F.lit(event_type).alias("event_type"), F.col("l_partkey").alias("sku"), F.col(at).alias("at"))

        made_of = {
            CART: made(CART, "o_orderdate"),
            BUY: made(BUY, "l_shipdate"),
            REMOVE: F.when(F.col("l_removed"), made(REMOVE, "l_shipdate")),
        }
        rows = [made_of[t] for t in types if t in made_of]
        client = F.col("o_custkey").alias("client_id")
        if len(rows) == 1:  # without a generator, filters by date reach the scan
            found = lines.select(client, rows[0].alias("event")).select("client_id", "event.*")
        else:
            found = lines.select(client, F.inline(F.array(*rows)))
        parts.append(found.where(F.col("event_type").isNotNull()).select(*columns))
    if SEARCH in types:
        parts.append(
            orders.select(
                F.col("o_custkey").alias("client_id"),
                F.lit(None).cast("bigint").alias("sku"),
                F.lit(SEARCH).alias("event_type"),
                F.col("o_orderdate").alias("at"),
            ).select(*columns)
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product rows with one row per SKU; prices are whole tenths."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sku"),
        F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("bigint").alias("category"),
        F.round(F.col("p_retailprice") * 10).cast("bigint").alias("price"),
        F.col("p_name").alias("name"),
    )


def repeated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product rows with several conflicting rows per SKU, one per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("sku"),
        F.when(F.col("l_linenumber") <= 6, F.col("l_linenumber").cast("bigint")).alias("category"),
        F.col("l_quantity").cast("bigint").alias("price"),
        F.col("l_returnflag").alias("name"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_products(spark, sf_dir).select("sku", "category", "price")


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored rows: two models' scores in thousandths, so with many ties."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("client_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("label"),
        (F.floor(F.col("o_totalprice") / 500.0) / 1000.0).alias("prediction_score"),
        (F.floor((F.col("o_totalprice") + 20000.0 * (F.col("o_custkey") % 5)) / 600.0) / 1000.0).alias("other_score"),
        F.col("o_orderstatus").alias("segment"),
    )
