"""Traffic roll-ups over event streams: event time, watermarks, bounded state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import cascade, fields


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over what is there now and returns its rows. Complete results go to a memory table (they
    are aggregates); appended rows go to Parquet beside the checkpoint, in the shared folder where one is set."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    place = f"{shared}/stream-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="spark-")
    name = f"drained_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{place}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/rows")
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def rollup(events: DataFrame, minutes: int = 120) -> DataFrame:
    """Tumbling buckets: requests, errors, mean value. Late rows beyond the watermark are left out of appended buckets."""
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", f"{minutes} minutes"))
    return w.agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("window.start").alias("bucket"), "requests", "errors", "mean_value")


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    s = events.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap))
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("began"), "n")


def scanner_stream(events: DataFrame, seconds: int = 172_800, probe: str = "error", target: str = "signup") -> DataFrame:
    """(event_id, score) for every event: a client's sliding window kept as state, events of a batch taken in event time.

    State holds the window's events only, (time, kind, value) of each, and goes when the watermark has passed the window.
    Events that come later than the watermark allows are dropped by Spark before they get here.
    """
    points = lambda kinds, values: 2 * (len(set(values)) >= 8 and len(kinds) >= 8) + (len(kinds) >= 25) + (4 if kinds.count(probe) >= 2 else kinds.count(probe)) + (3 if kinds.count(target) >= 2 else kinds.count(target))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, kinds, values = map(list, state.get) if state.exists else ([], [], [])
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        ids, scores = [], []
        for e in rows.itertuples():
            now = e.ts.value // 1000
            gone = next((i for i, t in enumerate(at) if t >= now - seconds * 1_000_000), len(at))
            at, kinds, values = at[gone:] + [now], kinds[gone:] + [e.event_type], values[gone:] + [e.value]
            ids.append(e.event_id)
            scores.append(int(points(kinds, values)))
        state.update((at, kinds, values))
        state.setTimeoutTimestamp(max(at[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": ids, "score": scores})

    rows = events.select("event_id", "user_id", "ts", "event_type", "value").withWatermark("ts", "1 hour")
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id long, score int", "at array<long>, kinds array<string>, vals array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/pages.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/pages.parquet*")


def detection_stream(pages: DataFrame) -> DataFrame:
    """Requests to fields to verdicts, row by row; the sink is the detection log."""
    return cascade.detect_fields(fields.explode_urls(pages, "page_id", "url"))
