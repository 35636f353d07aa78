"""Small hand-made inputs with the edge cases every operator must survive."""

from __future__ import annotations

from clientpulse import BUY, CART, REMOVE, SEARCH, Snapshot

#: The smallest of the driver's table sets.
SF = "/root/testdata/sf0.001"
SNAP = Snapshot("2024-03-01", "2024-03-10", "test")
EVENT_SCHEMA = "client_id long, ts string, event_type string, sku long"

# client 1: carts and purchases around every boundary
# client 2: searches only            client 3: removals only
# client 4: purchases without carts  client 5: buys in the window only
EVENTS = [
    (1, "2024-02-29 23:59:59", CART, 10),
    (1, "2024-03-01 00:00:00", CART, 11),
    (1, "2024-02-20 12:00:00", CART, 10),
    (1, "2024-02-20 12:00:00", CART, 10),
    (1, "2024-01-31 00:00:00", CART, 12),
    (1, "2024-01-30 23:59:59", CART, 13),
    (1, "2024-02-10 08:00:00", REMOVE, 10),
    (1, "2024-02-25 10:00:00", BUY, 10),
    (1, "2024-03-01 00:00:00", BUY, 10),
    (1, "2024-03-10 23:59:59", BUY, 12),
    (1, "2024-03-11 00:00:00", BUY, 13),
    (2, "2024-02-01 00:00:00", SEARCH, None),
    (2, "2024-02-01 05:00:00", SEARCH, None),
    (2, "2024-02-28 00:00:00", SEARCH, None),
    (3, "2024-02-02 00:00:00", REMOVE, 10),
    (4, "2024-02-03 00:00:00", BUY, 11),
    (4, "2024-03-05 00:00:00", BUY, 11),
    (5, "2024-03-05 00:00:00", BUY, 12),
]
PRODUCTS = [(10, 1, 100), (11, 1, 300), (12, 2, None), (13, None, 500)]


def events(spark, rows=None):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EVENTS if rows is None else rows, EVENT_SCHEMA)
    ts = F.to_timestamp("ts")
    return df.select("client_id", ts.alias("event_ts"), F.to_date(ts).alias("event_date"), "event_type", "sku")


def products(spark):
    return spark.createDataFrame(PRODUCTS, "sku long, category long, price long")


def by(df, *keys):
    """Rows as dictionaries under their key."""
    rows = [r.asDict() for r in df.collect()]
    out = {(tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]): r for r in rows}
    assert len(out) == len(rows)
    return out
