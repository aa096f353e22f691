from pyspark.sql import functions as F

from hostmill.operators import store
from hostmill.sources import json_points as J


def test_json_names_that_repeat_or_differ_in_case(spark):
    """The last of repeated names counts; fields of value objects are found whatever their case."""
    cases = {
        '{"key":"x","data":{"v":1,"v":2}}': [("x", "v", 2.0, False)],
        '{"key":"x","data":{"v":{"value":1,"value":2}}}': [("x", "v", 2.0, False)],
        '{"key":"x","data":{"v":{"Value":3}}}': [("x", "v", 3.0, False)],
        '\xa0{"key":" x ","data":{"v":4}}': [("x", "v", 4.0, False)],
        '{"key":"x","data":{" v":1,"v":2}}': [("x", "v", 2.0, False)],
        '{"key":"x","data":{"v":"bad","v":5}}': [("x", "v", 5.0, False)],
        '{"key":"x","data":{"v":5,"v":"bad"}}': None,
        '{"key":"a","key":"b","data":{"v":{"LAST":6,"Kind":"percent"}}}': [("b", "v", 6.0, True)],
        '{"key":"x","data":{"v":{"value":null,"last":3}}}': None,
        '{"key":"x","data":{"v":{}}}': None,
        '{"Key":"x","data":{"v":1}}': None,
    }
    d = spark.createDataFrame(list(enumerate(cases)), "i int, payload string")
    got = {}
    for r in J.points_from_json(d, "payload").collect():
        got.setdefault(r.i, []).append((r.key, r["var"], r.raw, r.is_percent))
    bad = {r.i for r in J.json_rejects(d, "payload").collect()}
    for i, want in enumerate(cases.values()):
        assert (i in bad, got.get(i)) == (want is None, want), list(cases)[i]


def test_events_are_read_entry_by_entry(spark, tmp_path):
    lines = [
        '{"dt":1,"dts":2,"metric":"m","key":"k","data":{"a":5,"b":{"last":3,"p50":4}}}',
        '{"dt":1,"dts":2,"key":"k","data":{"b":{"last":"7","p50":"x","p90":3.7,"q":" 7","big":"99999999999999999999"}}}',
        '{"dt":1,"dts":2,"key":"k","data":{"b":{"t":true,"n":null,"l":[1],"w":-1e40,"m":9223372036854775807}}}',
        '{"dt":1,"key":"k"}', '{"dt":1,"data":[1]}', '{"dt":', "", '"text"', '{"dt":"late","data":{}}',
    ]
    (tmp_path / "log.json").write_text("\n".join(lines))
    rows = store.flatten_events(store.read_events(spark, str(tmp_path)))
    got = {(r["var"], r["agg"]): r.value for r in rows.collect()}
    assert got == {
        ("b", "last"): got["b", "last"], ("b", "p50"): got["b", "p50"], ("b", "p90"): 3, ("b", "q"): 0, ("b", "big"): 0,
        ("b", "t"): 1, ("b", "n"): 0, ("b", "l"): 0, ("b", "w"): -(1 << 63), ("b", "m"): (1 << 63) - 1,
    }
    assert sorted(r.value for r in rows.filter("agg IN ('last', 'p50')").collect()) == [0, 3, 4, 7]
    assert sorted(r.line for r in store.event_rejects(spark, str(tmp_path)).collect()) == sorted(['{"dt":', '"text"', '{"dt":"late","data":{}}'])


def rows_of(spark, n, metric="m", day="2024-01-01"):
    at = F.lit(f"{day} 10:00:00").cast("timestamp")
    d = spark.range(n).select(F.lit(1704103200000).alias("dt"), F.lit(1704103201).alias("dts"), F.lit(metric).alias("metric"), F.concat(F.lit("h"), F.col("id") % 5).alias("host"),
                              F.lit("k").alias("key"), F.lit("v").alias("var"), F.lit("last").alias("agg"), F.col("id").alias("value"))
    return store.stamp(d, at).withColumns({"dt": at, "day": F.to_date(at)})


def test_two_streams_into_one_root_keep_all_rows(spark, tmp_path):
    """Batch 0 of one stream doesn't replace batch 0 of another; a repeated batch replaces itself."""
    for k, n in ((1, 30), (2, 50)):
        rows_of(spark, n).write.parquet(f"{tmp_path}/in{k}")
        stream = spark.readStream.schema(rows_of(spark, 1).schema).parquet(f"{tmp_path}/in{k}")
        sinks = [store.metric_sink(f"{tmp_path}/rows"), store.table_sink(f"{tmp_path}/table")]
        q = stream.writeStream.foreachBatch(lambda d, b, sinks=sinks: store.fan_out(d, sinks, b)).option("checkpointLocation", f"{tmp_path}/cp{k}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert store.read_metric(spark, f"{tmp_path}/rows").count() == 80
    assert spark.read.parquet(f"{tmp_path}/table").count() == 80
    for _ in range(2):
        store.metric_sink(f"{tmp_path}/rows")(rows_of(spark, 7), 0)
    assert store.read_metric(spark, f"{tmp_path}/rows").count() == 87


def test_a_finished_day_is_compacted_into_few_files(spark, tmp_path):
    root = f"{tmp_path}/rows"
    for b in range(3):
        store.metric_sink(root)(rows_of(spark, 40), b)
    store.metric_sink(root)(rows_of(spark, 5, day="2024-01-02"), 0)
    assert store.compact_day(spark, root, "m", "2024-01-01", files=2) == 120
    files = list((tmp_path / "rows/metric=m/day=2024-01-01").rglob("*.parquet"))
    assert 1 <= len(files) <= 2
    assert store.read_metric(spark, root, "m", "2024-01-01", "2024-01-01").count() == 120
    assert store.read_metric(spark, root).count() == 125
    store.metric_sink(root)(rows_of(spark, 9), 7)  # late rows of that day
    assert store.compact_day(spark, root, "m", "2024-01-01", files=2) == 129
    assert store.compact_day(spark, root, "m", "2024-01-01", files=2) == 129
    assert store.compact_day(spark, root, "m", "2030-01-01") == 0


def test_expired_days_go_and_younger_ones_stay(spark, tmp_path):
    root, as_of = f"{tmp_path}/rows", F.lit("2024-06-15 12:00:00").cast("timestamp")
    for day in ("2024-02-14", "2024-02-15", "2024-06-01"):
        store.write_metric_rows(rows_of(spark, 4, day=day), root)
    assert store.remove_expired(spark, root, as_of) == [("m", "2024-02-14")]
    assert store.read_metric(spark, root).count() == 8
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    try:
        store.create_metric_tables(spark, "kept", ["cpu"])
        for day in ("2024-02-14", "2024-06-01"):
            spark.sql(f"ALTER TABLE kept.cpu ADD PARTITION (day = DATE '{day}')")
        assert store.drop_expired_partitions(spark, "kept.cpu", as_of) == ["2024-02-14"]
        assert [r[0] for r in spark.sql("SHOW PARTITIONS kept.cpu").collect()] == ["day=2024-06-01"]
    finally:
        spark.sql("DROP DATABASE kept CASCADE")
