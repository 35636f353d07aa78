"""The same results from the plans one writes first: a join per window, row-level
interval joins, a global sort per cutoff, one pass per correlation. Spark SQL, for
measuring what the package's plans save; ``bench.py`` runs it on request."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from clientpulse.config import FEATURE_TYPES, FEATURE_WINDOWS, SKU_TYPES, feature_families
from clientpulse.plans import catalog
from clientpulse.sources import fixtures as fx


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.order_events(spark, sf_dir).createOrReplaceTempView("bp_events")
    fx.products(spark, sf_dir).createOrReplaceTempView("bp_products")
    cut = f"DATE '{fx.ORDERS_SNAPSHOT.cutoff}'"
    parts = []
    for t in FEATURE_TYPES:
        where = f"event_type = '{t}' AND event_date < {cut}"
        distinct = f", count(DISTINCT sku) AS distinct_{t}_sku_count" if t in SKU_TYPES else ""
        parts.append(
            f"(SELECT client_id, count(*) AS {t}_count, datediff({cut}, max(event_date)) AS days_since_last_{t}{distinct} "
            f"FROM bp_events WHERE {where} GROUP BY client_id)"
        )
        parts += [
            f"(SELECT client_id, count(*) AS {t}_count_{w}d FROM bp_events WHERE {where} "
            f"AND event_date >= date_sub({cut}, {w}) GROUP BY client_id)"
            for w in FEATURE_WINDOWS
        ]
    for prefix, t in (("cart", "add_to_cart"), ("bought", "product_buy")):
        parts.append(
            f"(SELECT client_id, count(DISTINCT category) AS distinct_{prefix}_category_count, avg(price) AS avg_{prefix}_price, "
            f"max(price) AS max_{prefix}_price FROM bp_events LEFT JOIN bp_products USING (sku) "
            f"WHERE event_type = '{t}' AND event_date < {cut} GROUP BY client_id)"
        )
    parts.append(
        f"(SELECT client_id, count(DISTINCT event_date) AS active_days_count FROM bp_events WHERE event_date < {cut} GROUP BY client_id)"
    )
    spine = f"(SELECT DISTINCT client_id FROM bp_events WHERE event_date < {cut})"
    return spark.sql(f"SELECT * FROM {spine} " + " ".join(f"LEFT JOIN {p} USING (client_id)" for p in parts))


def transition_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.stream_events(spark, sf_dir).createOrReplaceTempView("bp_stream")
    cut = f"DATE '{fx.EVENTS_SNAPSHOT.cutoff}'"
    side = f"FROM bp_stream WHERE event_date < {cut} AND event_type ="
    days, recent = catalog.TRANSITION_DAYS, catalog.TRANSITION_RECENT
    return spark.sql(
        f"""WITH c AS (SELECT client_id, event_ts {side} 'add_to_cart'),
        s AS (SELECT DISTINCT client_id, event_ts {side} 'search_query'),
        a AS (SELECT c.client_id, count(*) AS n FROM c LEFT SEMI JOIN s ON c.client_id = s.client_id
              AND s.event_ts BETWEEN c.event_ts - INTERVAL {days} DAYS AND c.event_ts GROUP BY c.client_id),
        r AS (SELECT DISTINCT c.client_id, 1 AS flag FROM c LEFT SEMI JOIN s ON c.client_id = s.client_id
              AND s.event_ts <= c.event_ts AND to_date(s.event_ts) >= date_sub({cut}, {recent})),
        n AS (SELECT client_id, count(*) AS carts FROM c GROUP BY client_id)
        SELECT client_id, coalesce(n, 0) AS search_before_cart_count, (coalesce(n, 0) + 1D) / (carts + 2D) AS search_to_cart_rate,
               coalesce(flag, 0) AS recent_search_then_cart_flag
        FROM n LEFT JOIN a USING (client_id) LEFT JOIN r USING (client_id)"""
    )


def topk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.scored_orders(spark, sf_dir).createOrReplaceTempView("bp_scored")
    n = spark.table("bp_scored").count()
    rows = [
        f"SELECT {p} AS top_percent, count(*) AS top_k_count, sum(label) AS positive_count FROM (SELECT label FROM bp_scored "
        f"ORDER BY prediction_score DESC, client_id LIMIT {max(1, -(-n * p // 100))})"
        for p in (1, 5, 10)
    ]
    return spark.sql(" UNION ALL ".join(rows))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx.scored_orders(spark, sf_dir).createOrReplaceTempView("bp_scored")
    counters = [
        f"count_if(prediction_score {op} {i / 100}D AND label = {y}) AS {name}_{i}"
        for i in range(1, 100)
        for name, op, y in (("tp", ">=", 1), ("fp", ">=", 0), ("tn", "<", 0), ("fn", "<", 1))
    ]
    return spark.sql("SELECT " + ", ".join(counters) + " FROM bp_scored")


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each of the 630 pairs."""
    catalog.training_frame(spark, sf_dir).createOrReplaceTempView("bp_training")
    columns = [f for fs in feature_families().values() for f in fs if f != "is_eligible_purchase_propensity"]
    rows = []
    for a, b in combinations(columns, 2):
        pair = f"SELECT coalesce(CAST({a} AS DOUBLE), 0D) AS a, coalesce(CAST({b} AS DOUBLE), 0D) AS b FROM bp_training"
        rows.append((a, b, spark.sql(f"SELECT corr(a, b) FROM ({pair}) HAVING var_pop(a) > 0 AND var_pop(b) > 0").collect()[0][0]))
    return spark.createDataFrame(rows, "a string, b string, r double")


PLANS = {f.__name__: f for f in (feature_table, transition_features, topk_metrics, threshold_sweep, correlation_matrix)}


def compare(spark: SparkSession, sf_dir: str, queries, seconds) -> dict[str, dict[str, float]]:
    out = {}
    for name, plan in PLANS.items():
        if name != "correlation_matrix":  # 630 jobs are their own warm-up
            seconds(lambda: plan(spark, sf_dir))
        out[name] = {"first_plan": seconds(lambda: plan(spark, sf_dir)), "package": seconds(lambda: queries[name](spark, sf_dir))}
    return out
