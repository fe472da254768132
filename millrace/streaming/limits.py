"""Operators over ordered events: rate limits, percentiles, breaches; the same as streams."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(events: DataFrame, requests: int, window_s: float) -> DataFrame:
    """Sliding-window limiter for each key: an event passes if fewer than `requests` passed in the window before it.

    Denied events do not count, so each decision rests on those before: rows are dealt out by key, sorted, and
    streamed with at most `requests` times in memory. Columns key, ts, event_id; adds allowed, remaining.
    """
    width = int(window_s * 1_000_000)
    own = events.select("key", "event_id", F.unix_micros("ts").alias("us")).repartition("key").sortWithinPartitions("key", "us", "event_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hits = object(), []
        for part in parts:
            allowed, remaining = [], []
            for k, us in zip(part["key"], part["us"], strict=True):
                if k != key:
                    key, hits = k, []
                while hits and us - hits[0] >= width:
                    hits.pop(0)
                ok = len(hits) < requests
                if ok:
                    hits.append(us)
                allowed.append(ok)
                remaining.append(requests - len(hits) if ok else 0)
            yield part.assign(allowed=allowed, remaining=remaining)

    return own.mapInPandas(run, f"{own.schema.simpleString()[7:-1]}, allowed: boolean, remaining: int").drop("us")


def nearest_rank(value: str, p: float, by: list[str], rows: DataFrame) -> DataFrame:
    """Nearest-rank percentile of each group."""
    return rows.groupBy(*by).agg(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p:g}"))


def breaches(samples: DataFrame, threshold: float, count: int, window_s: float) -> DataFrame:
    """Runs of consecutive samples over the threshold, for each key: how many, from when to when, whether the alarm fires."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    over = F.coalesce(F.col("value") > threshold, F.lit(False))
    island = F.sum(F.when(over, 0).otherwise(1)).over(order)
    runs = samples.withColumn("island", island).where(over).groupBy("key", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    span = (F.unix_micros("last") - F.unix_micros("first")) / 1e6
    return runs.withColumn("fires", (F.col("n") >= count) & (span >= window_s)).drop("island")


def tumbling(events: DataFrame, width: str, late: str = "10 minutes", value: Column | None = None) -> DataFrame:
    """Counts and sums by type and window; works on a stream too, where what comes later than `late` is left out."""
    value = F.col("value") if value is None else value
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
