from tarnwell.operators import metrics
from tarnwell.streaming import live

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
D = "/root/testdata/sf0.001"


def run(df, name, mode, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_of_rates_matches_batch(spark, tmp_path):
    stream = live.table_stream(spark, D, "events", EVENTS)
    got = run(live.rates(stream), "rates_out", "complete", spark, tmp_path)
    want = metrics.rates(spark.read.parquet(f"{D}/events.parquet"))
    key = lambda rows: sorted((r.window_start, r.event_type, r.events) for r in rows)
    assert key(got.collect()) == key(want.collect())


def test_breaches_and_first_seen(spark, tmp_path):
    stream = live.table_stream(spark, D, "events", EVENTS)
    assert run(live.breaches(stream, "error", 0.2), "breach_out", "complete", spark, tmp_path).where("share <= 0.2").count() == 0
    once = run(live.first_seen(live.table_stream(spark, D, "events", EVENTS), "user_id", ttl="1000 days"), "once_out", "append", spark, tmp_path)
    assert once.count() == spark.read.parquet(f"{D}/events.parquet").select("user_id").distinct().count()


def test_recent_turns_state(spark, tmp_path):
    schema = "id long, session_id string, content string"
    src = tmp_path / "in"
    spark.createDataFrame([(i, "s", f"m{i}") for i in range(5)] + [(9, "t", None)], schema).coalesce(1).write.parquet(str(src))
    out = run(live.recent(spark.readStream.schema(schema).parquet(str(src)), n=3), "turns_out", "update", spark, tmp_path)
    assert {r.session_id: list(r.turns) for r in out.collect()} == {"s": ["m2", "m3", "m4"], "t": [""]}
