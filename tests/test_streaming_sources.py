import json

from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import ingest, late, stateful


def test_ingest_is_idempotent_and_keeps_dead_letters(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [[("k", "0", p, f"v{p}") for p in (0, 1, 1, 2)], [("k", "0", 2, "late"), ("k", "0", 3, "v3"), ("k", "1", 0, "w"), ("k", None, None, "bad")]]
    schema = "source string, part string, position bigint, value string"
    store = ingest.Store(spark, str(tmp_path / "store"))
    for i, batch in enumerate(rows):
        (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(["source", "part", "position", "value"], r))) for r in batch))
        ingest.run(spark.readStream.schema(schema).json(str(src)), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["part"], r["position"]) for r in store.records().collect()) == [("0", 0), ("0", 1), ("0", 2), ("0", 3), ("1", 0)]
    assert sorted(r["reason"] for r in store.dead().collect()) == ["committed", "duplicate", "missing_position"]
    before = store.records().count()
    store.apply(spark.createDataFrame(rows[1], schema), 1)  # a replayed batch
    assert store.records().count() == before
    heads = spark.createDataFrame([("k", "0", 10), ("k", "2", 4)], "source string, part string, head bigint")
    assert ingest.lag(store.ledger(), heads).first()["lag"] == 7


def test_backpressure(spark):
    b = spark.createDataFrame([("s", "0", p) for p in (1, 5, 50)], "source string, part string, position bigint")
    out = ingest.validate(b, spark.createDataFrame([("s", "0", 0)], ingest.LEDGER), 10)
    assert {r["position"]: r["reason"] for r in out.collect()} == {1: None, 5: None, 50: "backpressure"}


def test_late_stream_equals_one_batch(spark, tmp_path):
    src = tmp_path / "in"
    schema = "delivery_id bigint, tenant bigint, ts_ms bigint, hook_observed_at_ms bigint, created_at_ms bigint, ingestion_time_ms bigint, importance float"
    h = 1_700_000_000_000 // 3_600_000 * 3_600_000
    rows = [(i, i % 2, h - (i % 5) * 3_600_000, None, None, h + 3_600_000 * (i % 9), float(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.filter(F.col("delivery_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(src))
        late.run(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    from tidemark.operators import late_events

    whole = late_events.with_period(df)
    assert sorted(map(tuple, late.state(spark, str(tmp_path / "state")).collect())) == sorted(map(tuple, late_events.multiset(whole.filter("not set_aside")).collect()))
    assert spark.read.parquet(str(tmp_path / "state" / "aside")).count() == whole.filter("set_aside").count() > 0


def test_accepted_cap_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, schema = tmp_path / "in", "key string, ts_ms bigint, seq bigint"
    got = []
    for k in range(2):
        spark.createDataFrame([("a", i, i) for i in range(k * 2, k * 2 + 2)] + [("b", k, k)], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = stateful.accepted_cap(spark.readStream.schema(schema).parquet(str(src)), 3)
        stream.writeStream.foreachBatch(lambda b, i: got.extend(map(tuple, b.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [("a", 0, True), ("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 0, True), ("b", 1, True)]


def test_files_and_series_layout(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_text("<html><style>x{}</style><p>One &amp; two</p><!-- no --></html>")
    (tmp_path / "d" / "b.md").write_text("# T\nbody")
    got = {r["kind"]: r["text"] for r in files.documents(spark, str(tmp_path / "d")).collect()}
    assert got == {"html": "One & two", "md": "# T\nbody"}
    day = 86_400_000
    s = spark.range(100).select((F.col("id") % 3).cast("string").alias("key"), (F.col("id") * (day // 10)).cast("bigint").alias("ts_ms"), F.col("id").alias("value"))
    files.write_series(s, str(tmp_path / "s"), files=2)
    out = files.read_series(spark, str(tmp_path / "s"), 2 * day, 3 * day - 1)
    assert out.count() == s.filter(F.col("ts_ms").between(2 * day, 3 * day - 1)).count() == 10
    assert "PartitionFilters: [isnotnull(day" in out._jdf.queryExecution().executedPlan().toString()
    log = spark.createDataFrame([("{\"a\": 1}",), ("{",)], "payload string")
    assert [r[0] is None for r in files.records(log).select(F.col("body").isNull()).collect()] == [False, False]
