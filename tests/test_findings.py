"""What a review of larger tables found: one small test per finding."""

from __future__ import annotations

import re
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from clientpulse import BUY, CART, SEARCH, Snapshot, session
from clientpulse.operators import cohorts, distribution, features, labels, paths, sketches
from clientpulse.session import ADVISORY_CONF, INITIAL_CONF, small_tasks, stable
from clientpulse.sources import fixtures as fx
from data import SF, SNAP, by, events, products


def test_sketched_cohorts_are_exact_beyond_one_sketch(spark):
    """60,000 clients, several times what one theta sketch keeps exactly."""
    day = F.date_sub(F.lit(SNAP.cutoff).cast("date"), 1)
    of = {
        CART: (F.col("id") % 2 == 0, day),
        BUY: (F.col("id") % 3 == 0, F.when(F.col("id") % 9 == 0, F.date_add(day, 3)).otherwise(day)),
        SEARCH: (F.col("id") % 5 < 4, day),
    }
    made = F.array(*(F.when(hit, F.struct(F.lit(t).alias("event_type"), d.alias("event_date"))) for t, (hit, d) in of.items()))
    ev = spark.range(60_000).select(F.col("id").alias("client_id"), F.inline(F.array_compact(made)))
    ev = ev.withColumn("event_ts", F.col("event_date").cast("timestamp"))
    flags = cohorts.cohort_flags(ev, SNAP)
    kept = sketches.cohort_sketches(ev, SNAP)
    pair = ("left_candidate", "right_candidate")
    assert by(sketches.sketched_overlaps(kept), *pair) == by(cohorts.overlap_matrix(flags), *pair)
    got = sketches.sketched_cohorts(kept)
    assert by(got, "candidate") == by(cohorts.candidate_cohorts(flags).select(*got.columns), "candidate")


def test_sketched_cohorts_of_no_events(spark):
    ev = spark.createDataFrame([], "client_id long, event_ts timestamp, event_date date, event_type string")
    kept = sketches.cohort_sketches(ev, SNAP)
    assert {r.cohort_client_count for r in sketches.sketched_cohorts(kept).collect()} == {0}
    assert sketches.sketched_overlaps(kept).count() == 25


def test_counts_of_a_client_without_history_are_filled(spark):
    """the difference of two counts is filled like the counts."""
    df = spark.createDataFrame(
        [(1, None, None, None, None)],
        "client_id long, add_to_cart_count long, cart_minus_remove_count long, days_since_last_product_buy int, buy_to_cart_ratio double",
    )
    row = features.fill_counts(df).first()
    assert (row.add_to_cart_count, row.cart_minus_remove_count) == (0, 0)
    assert row.days_since_last_product_buy is None and row.buy_to_cart_ratio is None


def test_snapshots_share_one_pass(spark):
    """Two cutoffs have the rows of two builds, from one tree."""
    earlier = Snapshot("2024-02-20", "2024-02-28", "earlier")
    ev, items = events(spark), products(spark)
    both = features.features_of_snapshots(ev, items, [earlier, SNAP], active_windows=(30,))
    moved = features.transitions_of_snapshots(ev, [earlier, SNAP])
    marked = labels.labels_of_snapshots(ev, [earlier, SNAP])
    for snap in (earlier, SNAP):
        of = F.col("snapshot") == snap.name
        one = features.build_features(ev, items, snap, active_windows=(30,))
        assert by(both.where(of).drop("snapshot"), "client_id") == by(one, "client_id")
        assert by(moved.where(of).drop("snapshot"), "client_id") == by(features.transition_features(ev, snap.cutoff), "client_id")
        alone = labels.labels_from_events(ev, snap).select("client_id", "label")
        assert by(marked.where(of).drop("snapshot"), "client_id") == by(alone, "client_id")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(client_id") == 4


def test_feature_rows_stay_narrow_until_the_client(spark):
    """No buffer of features is moved, only rows of counts."""
    plan = features.build_features(events(spark), products(spark), SNAP)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(client_id" in line]
    # below the last two exchanges rows are not aggregated for the level above
    assert len(moved) == 4 and sum("REPARTITION_BY_COL" in line for line in moved) == 2
    skus = [line for line in plan.split("\n") if "HashAggregate(keys=[client_id" in line and "sku#" in line.split("]")[0]]
    assert skus and all("max(" not in line for line in skus)


def test_branches_of_line_item_events_read_the_same_columns(spark):
    """The levels of the feature tree share the shuffles of one join."""
    table = features.build_features(fx.order_events(spark, SF), fx.products(spark, SF), fx.ORDERS_SNAPSHOT)
    plan = table._jdf.queryExecution().executedPlan().toString()
    scans = [re.sub(r"#\d+L?", "", line.split("[", 1)[1].split("]")[0]) for line in plan.split("\n") if "FileScan" in line]
    lines = [s for s in scans if "l_orderkey" in s]
    assert len(lines) == 2 and len(set(lines)) == 1
    joined = [s for s in scans if "o_orderkey" in s]
    assert len(joined) == 2 and len(set(joined)) == 1


def test_buyers_of_the_windows_make_the_training_set(spark):
    """Labels from the purchases in the windows alone, filtered in the scan."""
    earlier = Snapshot("2024-02-20", "2024-02-28", "earlier")
    ev, items = events(spark), products(spark)
    buyers = labels.buyers_of_snapshots(ev, [earlier, SNAP])
    for snap in (earlier, SNAP):
        table = features.build_features(ev, items, snap)
        made = labels.training_rows(table, buyers.where(F.col("snapshot") == snap.name))
        expected = labels.training_set(table, labels.labels_from_events(ev, snap))
        assert made.schema["label"].dataType == expected.schema["label"].dataType and made.columns == expected.columns
        assert by(made, "client_id") == by(expected, "client_id")
    bought = labels.buyers_of_snapshots(fx.order_events(spark, SF, BUY), [fx.ORDERS_TRAIN])
    plan = bought._jdf.queryExecution().executedPlan().toString()
    assert any("FileScan" in line and "l_shipdate" in line.split("DataFilters", 1)[1] for line in plan.split("\n") if "l_orderkey" in line and "DataFilters" in line)


def test_transitions_of_stored_moments(spark):
    """Moments are stored once and hold all that transitions need."""
    earlier = Snapshot("2024-02-20", "2024-02-28", "earlier")
    ev = events(spark)
    moments = stable(paths.cart_search_moments(ev, SNAP.cutoff))
    got, whole = (by(df, "client_id", "snapshot") for df in (
        features.transitions_of_moments(moments, [earlier, SNAP]), features.transitions_of_snapshots(ev, [earlier, SNAP])
    ))
    assert got == whole and got


def test_stored_tables_are_made_by_small_tasks(spark, monkeypatch):
    """32 MB of a shuffle, which the session's four partitions put into four tasks."""
    monkeypatch.setattr(session, "TASK_BYTES", 2 << 20)
    wide = spark.range(1_000_000).select("id", *(F.xxhash64("id", F.lit(i)).alias(f"h{i}") for i in range(4)))
    kept = stable(wide.repartition("id"))
    assert kept.select(F.count("*"), F.sum("id")).first()[:] == (1_000_000, 499_999_500_000)
    assert len(kept.inputFiles()) >= 16


def test_settings_come_back_after_small_tasks(spark):
    """Smaller tasks and more partitions that the session asks for stay."""
    keys = (ADVISORY_CONF, INITIAL_CONF)
    before = [spark.conf.get(k, None) for k in keys]
    for asked, used in (((None, None), (16 << 20, 200)), (("64MB", "12"), (16 << 20, 200)), (("4m", "500"), (4 << 20, 500))):
        for key, value in zip(keys, asked):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        with small_tasks(spark):
            assert (session.in_bytes(spark.conf.get(ADVISORY_CONF)), int(spark.conf.get(INITIAL_CONF))) == used
        assert tuple(spark.conf.get(k, None) for k in keys) == asked
    for key, value in zip(keys, before):
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_rows_of_a_client_are_moved_once(spark):
    """Categories are made where the client's rows are: no shuffle by (client, category)."""
    events = fx.order_events(spark, SF, timed=False)
    plan = features.build_features(events, fx.products(spark, SF), fx.ORDERS_SNAPSHOT)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(client_id#\d+L, (\w+)", plan)
    assert sorted("client" if k.isdigit() else k for k in keys) == ["client", "event_date", "sku"]


def test_untimed_events_are_the_dates_of_the_timed(spark):
    """F7 to F10."""
    timed, days = fx.order_events(spark, SF), fx.order_events(spark, SF, timed=False)
    assert days.columns == [c for c in timed.columns if c != "event_ts"]
    assert days.exceptAll(timed.drop("event_ts")).count() == 0 and timed.drop("event_ts").exceptAll(days).count() == 0
    # times become dates below the join
    below = days._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "cast(l_shipdate" in below and "cast(o_orderdate" in below and "AS l_removed" in below


def test_days_of_clients_without_skus_and_skus_without_category(spark):
    rows = [(1, None, "2024-01-02", SEARCH), (2, None, "2024-01-03", CART), (2, 9, "2024-01-03", BUY), (2, 5, "2024-01-04", CART)]
    ev = spark.createDataFrame(rows, "client_id long, sku long, event_date string, event_type string")
    ev = ev.withColumn("event_date", F.to_date("event_date"))
    goods = spark.createDataFrame([(5, 1, 10)], "sku long, category long, price long")
    got = {r.client_id: r for r in features.build_features(ev, goods, Snapshot("2024-01-10", "2024-01-20", "s")).collect()}
    assert (got[1].search_query_count, got[1].add_to_cart_count, got[1].distinct_cart_category_count) == (1, 0, 0)
    assert (got[2].add_to_cart_count, got[2].product_buy_count, got[2].days_since_last_add_to_cart) == (2, 1, 6)
    assert (got[2].distinct_cart_category_count, got[2].avg_cart_price, got[2].active_days_count) == (1, 10.0, 2)


def rows_moved(spark, run):
    """What ``run`` returns, and the rows that its jobs wrote to shuffles."""
    context, jsc = spark.sparkContext, spark.sparkContext._jsc.sc()
    context.setJobGroup("moved", "rows moved")
    try:
        result = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jsc.listenerBus().waitUntilEmpty()
    tracker, moved = context.statusTracker(), 0
    for stage in {s for j in tracker.getJobIdsForGroup("moved") for s in tracker.getJobInfo(j).stageIds}:
        if tracker.getStageInfo(stage) is not None:  # not of stages that were skipped
            moved += jsc.statusStore().lastStageAttempt(stage).shuffleWriteRecords()
    return result, moved


def test_export_limit_moves_the_last_range_only(spark, monkeypatch):
    """r04 F1: before, every key was grouped, moved and sorted, whatever the limit."""
    monkeypatch.setattr(distribution, "ROWS_PER_RANGE", 500)
    ids = spark.range(50_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("k"))
    in_order = sorted(f"c{i}" for i in range(50_000))
    for k in (100, 25_000):
        cutoff, moved = rows_moved(spark, lambda k=k: distribution.smallest_key_cutoff(ids, "k", k))
        assert cutoff == in_order[k - 1] and 0 < moved < 10_000


@pytest.mark.parametrize("rows_per_range", [1, 7, 50_000])
def test_export_limit_among_tied_and_missing_keys(spark, monkeypatch, rows_per_range):
    """r04 F1: a third of the rows have one key, some none; also more asked for than there are."""
    monkeypatch.setattr(distribution, "ROWS_PER_RANGE", rows_per_range)
    keys = [20 if i % 3 == 0 else None if i % 7 == 0 else i % 41 for i in range(90)]
    df = spark.createDataFrame([(None if x is None else f"id{x:03d}",) for x in keys], "k string").repartition(5)
    known = sorted(f"id{x:03d}" for x in keys if x is not None)
    for k in (1, 30, 45, len(known), 500):
        assert distribution.smallest_key_cutoff(df, "k", k) == known[min(k, len(known)) - 1]
    assert distribution.smallest_key_cutoff(df.where("k is null"), "k", 3) is None


def test_ranges_are_found_by_halving(spark):
    """r04 F1: before, a row was compared with each of about 1,024 edges."""
    for n in (0, 1, 2, 1023, 1024, 4095):
        edges = [f"e{i * 7:06d}" for i in range(n)]
        keys = [None, "", "e", "z", *(f"e{i:06d}" for i in range(0, 30_000, 29)), *edges[:3], *edges[-3:]]
        side = spark.createDataFrame([(edges,)], "edges array<string>")
        df = spark.createDataFrame([(k,) for k in keys], "k string").crossJoin(side)
        for r in df.select("k", distribution.edges_below(F.col("edges"), "k").alias("below")).collect():
            assert r.below == (0 if r.k is None else bisect_left(edges, r.k))
    rows = spark.range(100).select("id", F.lit(1).alias("n"))
    plan = distribution.running_totals(rows, "id", ["n"], rows_per_range=1)._jdf.queryExecution().optimizedPlan().toString()
    assert "reduce(" in plan and not re.search(r"(?<!array_)filter\(", plan)
