"""Streaming front end (an extension): verification per micro-batch, windows, rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def verify_stream(texts: DataFrame, verify: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through the batch plan; a batch's folder is rewritten when it is repeated."""

    def one(batch: DataFrame, epoch: int) -> None:
        verify(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return texts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limit(events: DataFrame, limit: int, seconds: int = 600, key: str = "user_id") -> DataFrame:
    """Requests of the key in the time before each, itself included, and whether it is refused."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("refused", F.col("recent") > limit)


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", key: str = "user_id", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limit_stream(events: DataFrame, limit: int, seconds: int = 600, key: str = "user_id") -> DataFrame:
    """The exact sliding limit on a stream; state holds a key's times of the last window only."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("us")
        out = []
        for us in rows["us"]:
            times = [t for t in times if us - t < seconds * 1_000_000] + [int(us)]
            out.append((k[0], int(us), len(times), len(times) > limit))
        state.update((times,))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield pd.DataFrame(out, columns=[key, "us", "recent", "refused"])

    timed = events.select(F.col(key).cast("long").alias(key), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} long, us long, recent int, refused boolean", "times array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
