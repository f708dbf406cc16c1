"""The streaming front end on files that arrive one by one."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quotewright.streaming import stream

EVENTS = "user_id long, ts timestamp, event_type string, value double"


def _events():
    at = datetime(2024, 1, 1)
    return [(i % 3, at + timedelta(seconds=37 * i * (1 + i % 3)), "view" if i % 2 else "buy", float(i)) for i in range(60)]


def test_batches_are_verified_once_each(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    mark = lambda b: b.withColumn("checked", F.upper("text"))
    for rows in ([], [(3, "c")]):
        if rows:
            spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/in")
        stream.verify_stream(read(), mark, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert sorted((r.doc_id, r.checked) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_streamed_rate_limit_equals_the_window(spark, tmp_path):
    events = spark.createDataFrame(_events(), EVENTS)
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = stream.rate_limit_stream(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"), 3)
    q = out.writeStream.format("memory").queryName("limits").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = stream.rate_limit(events, 3).select("user_id", F.unix_micros("ts").alias("us"), "recent", "refused")
    assert sorted(tuple(r) for r in spark.table("limits").collect()) == sorted(tuple(r) for r in batch.collect())
    assert batch.where("refused").count() > 0
