from opinara.operators import panel
from opinara.sources import adapters
from opinara.streaming import incremental


def test_incremental_sums_equal_the_batch_panel(spark, sf_dir, tmp_path):
    posts = adapters.opinions(spark, sf_dir)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in range(3):
        posts.where(f"post_id % 3 = {k}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = incremental.sink_sums(stream, out, check).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.user_id, r.topic, r.year): (r.cnt, round(r.mean, 9)) for r in incremental.read_sums(spark, out).collect()}
    want = {(r.user_id, r.topic, r.year): (r.cnt, round(r["mean"], 9)) for r in panel.user_panel(posts).collect()}
    assert got == want


def test_windows_close_behind_the_watermark(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("ts", "event_type topic", "value opinion")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = incremental.windowed_opinions(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg({"cnt": "sum"}).first()[0] == events.count()
