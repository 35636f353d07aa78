from __future__ import annotations

import gzip
import json

import pytest
from data import SNAP, by, events, products

from pyspark.sql import functions as F

from clientpulse import BUY, CART
from clientpulse.functions import feature_columns, forbidden_columns, label_like
from clientpulse.operators import serving
from clientpulse.plans import jobs
from clientpulse.session import shared_dir, stable
from clientpulse import sources

SCHEMA = "client_id long, prediction_score double, prediction_label int, model_version string, scored_at string"


def scores(spark, n=50):
    return spark.createDataFrame([(i, i / n, int(i / n >= 0.5), "v1", "2024-01-01") for i in range(n)], SCHEMA)


def test_export_limit_and_keys(spark):
    rows = serving.serving_export(scores(spark), limit=7).collect()
    assert sorted(r.client_id for r in rows) == sorted(str(i) for i in range(7))
    assert serving.serving_export(scores(spark), limit=500).count() == 50
    with pytest.raises(ValueError, match="positive"):
        serving.serving_export(scores(spark), limit=0)


def test_export_refuses_bad_rows(spark):
    with pytest.raises(ValueError, match="more than one row"):
        serving.serving_export(scores(spark).union(scores(spark)))
    with pytest.raises(ValueError, match="nulls"):
        serving.serving_export(scores(spark).withColumn("scored_at", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="nulls"):
        serving.serving_export(scores(spark).withColumn("client_id", F.nullif(F.col("client_id"), F.lit(30))), limit=3)
    with pytest.raises(ValueError, match="model_version"):
        serving.serving_export(scores(spark).drop("model_version"))


def test_score_checks(spark):
    good = by(serving.score_checks(scores(spark), scores(spark)), "check_name")
    assert len(good) == 11 and {r["status"] for r in good.values()} == {"pass"}
    bad = scores(spark).withColumn("prediction_score", F.col("prediction_score") * 2 - 0.5).withColumn("label", F.lit(1))
    found = by(serving.score_checks(bad.union(bad), scores(spark), written=False), "check_name")
    assert {n for n, r in found.items() if r["status"] == "fail"} == {
        "output_row_count_equals_eligible_input_row_count",
        "prediction_score_in_0_1",
        "no_duplicate_client_id",
        "no_label_column_in_score_output",
        "no_target_window_metadata_in_score_output",
        "score_table_written_successfully",
    }


def test_lookup_opens_only_the_buckets_it_needs(spark, tmp_path):
    path = str(tmp_path / "scores")
    sources.write_scores(serving.serving_export(scores(spark)), path)
    table = sources.read_scores(spark, path)
    found = serving.lookup(table, ["3", 17, "nobody"])
    assert sorted(r.client_id for r in found.collect()) == ["17", "3"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "client_bucket" in partition_filters and "PushedFilters: [In(client_id" in plan
    assert serving.lookup(table, []).count() == 0
    ids = spark.createDataFrame([(3,), (3,), (999,)], "client_id long")
    assert [r.client_id for r in serving.lookup(table, ids).collect()] == ["3"]


def test_lookup_reaches_the_ends_of_integer_types(spark):
    least, most = -(2**63), 2**63 - 1
    table = spark.createDataFrame([(i, 0.5, 1, "v1", "2024-01-01") for i in (least, 10**18, most, 7)], SCHEMA)
    ids = [str(least), 10**18, 9223372036854775807, most + 1, least - 1, "7x", "00000000000000000007"]
    found = [r.client_id for r in serving.lookup(table, ids).collect()]
    assert sorted(found) == [least, 7, 10**18, most]
    small = scores(spark).withColumn("client_id", F.col("client_id").cast("int"))
    assert [r.client_id for r in serving.lookup(small, [7, 2**31, 10**18]).collect()] == [7]


def test_formats(spark):
    names = {
        "a.parquet": "parquet",
        "b.CSV": "csv",
        "b.csv.gz": "csv.gz",
        "c.jsonl": "json",
        "c.ndjson.gz": "json.gz",
        "d.parquet.gz": "parquet.gz",
        "e.tar.gz": "tar.gz archive",
        "e.tgz": "tar.gz archive",
        "f.gz": "gzip compressed file",
        "g.txt": "txt",
        "h": "unknown",
    }
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r[0]: r[1] for r in df.select("name", sources.infer_format(F.col("name"))).collect()} == names


def test_readers_and_inventory(spark, tmp_path):
    root = tmp_path / "raw"
    root.mkdir()
    (root / "a.csv").write_text("x,y\n1,p\n2,q\n")
    with gzip.open(root / "b.csv.gz", "wt") as f:
        f.write("x\n1\n")
    (root / "c.jsonl").write_text("\n".join(json.dumps({"k": i}) for i in range(3)))
    (root / "broken.parquet").write_text("this is no parquet file")
    (root / "notes.txt").write_text("hello")
    sources.write_table(scores(spark), str(root / "scores.parquet"))
    sources.write_events(events(spark), str(root / "events.parquet"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in sources.inventory(spark, str(root)).collect() if not r.path.endswith("_SUCCESS")}
    counts = {name: r.row_count for name, r in rows.items()}
    assert counts == {"a.csv": 2, "b.csv.gz": 1, "c.jsonl": 3, "broken.parquet": None, "notes.txt": None, "scores.parquet": 50, "events.parquet": 18}
    assert not rows["broken.parquet"].readable_by_spark and "unreadable" in rows["broken.parquet"].note
    assert rows["notes.txt"].row_count_status == "not_available"
    small = {r.path.rsplit("/", 1)[1]: r.row_count_status for r in sources.inventory(spark, str(root), max_count_bytes=5).collect()}
    assert small["a.csv"] == "deferred"
    assert sources.read_any(spark, str(root / "a.csv"), "csv").dtypes == [("x", "int"), ("y", "string")]
    with pytest.raises(ValueError):
        sources.read_any(spark, str(root), "avro")


def test_event_types_are_pruned(spark, tmp_path):
    path = str(tmp_path / "events")
    sources.write_events(events(spark), path)
    df = sources.read_events(spark, path, CART, BUY)
    assert df.count() == 13
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [event_type" in plan


def test_sample(spark):
    df = spark.range(1000)
    assert 300 < sources.sample_rows(df, 0.4).count() < 500
    assert sources.sample_rows(df, 0.4).collect() == sources.sample_rows(df, 0.4).collect()
    assert sources.sample_rows(df, None) is df
    with pytest.raises(ValueError):
        sources.sample_rows(df, 0.0)


def test_schema_rules(spark):
    df = spark.createDataFrame([(1, 1, 1.0, "t", 1, 0.1)], "client_id long, label int, a double, name string, target_x int, score_b double")
    assert label_like(df.columns) == ["label", "target_x"]
    assert feature_columns(df) == ["a", "score_b"] and feature_columns(df, ["a"]) == ["score_b"]
    assert forbidden_columns(df, "training") == ["score_b"] and forbidden_columns(df, "scores") == ["label"]
    assert [r.column_name for r in sources.schema_rows(df, "t").collect()] == df.columns


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1 / 3)], "k string, v double")
    for fmt in ("csv", "json"):
        sources.write_report(df, str(tmp_path / fmt), fmt)
        assert sources.read_any(spark, str(tmp_path / fmt), fmt).first().v == 0.333333
    with pytest.raises(ValueError):
        sources.write_report(df, str(tmp_path / "x"), "xml")


def test_stable_keeps_rows_and_schema(spark):
    df = scores(spark)
    again = stable(df)
    assert again.schema.simpleString() == df.schema.simpleString() and sorted(again.collect()) == sorted(df.collect())
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_jobs_end_to_end(spark, tmp_path):
    base, raw = str(tmp_path / "base"), {}
    rows = [(c, t, k, s) for c, t, k, s in _many()]
    frame = spark.createDataFrame(rows, "client_id long, timestamp string, event_type string, sku long")
    for kind in (CART, BUY, "remove_from_cart", "search_query"):
        raw[kind] = str(tmp_path / kind)
        frame.where(F.col("event_type") == kind).drop("event_type").write.parquet(raw[kind])
    goods = str(tmp_path / "goods")
    products(spark).withColumn("name", F.lit("n")).write.parquet(goods)
    jobs.prepare(spark, raw, goods, base)
    training = jobs.snapshot(spark, base, SNAP)
    assert training.count() == 40 and training.columns[-1] == "label"
    model, metrics = jobs.train(training, training, max_iter=3)
    assert 0 <= metrics["roc_auc"] <= 1
    path = str(tmp_path / "model")
    sources.save_model(model, path)
    features = sources.read_table(spark, f"{base}/snapshots/test/features_with_helpers")
    checks = jobs.serve(spark, path, features, str(tmp_path / "out"), "v1", "2024-03-01T00:00:00")
    assert {r.status for r in checks.collect()} == {"pass"}
    served = sources.read_scores(spark, str(tmp_path / "out" / "served"))
    assert serving.lookup(served, [7]).count() == 1


def _many():
    for c in range(40):
        for d in range(1, 4 + c % 5):
            yield c, f"2024-02-{d:02d} 10:00:00", CART, 10 + d % 4
            yield c, f"2024-02-{d:02d} 09:00:00", "search_query", None
        yield c, "2024-02-20 10:00:00", BUY, 10 + c % 4
        yield c, "2024-02-21 10:00:00", "remove_from_cart", 10
        if c % 3 == 0:
            yield c, "2024-03-02 10:00:00", BUY, 11
