"""Streams replayed over the driver's tables; what they end with equals the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.plans.registry import query
from lorekeep.streaming import tail

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def replay(spark, d):
    return tail.replayed(spark, d, "events", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_type, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id, event_type")
def stream_heartbeats(spark, d):
    beats = tail.heartbeats(replay(spark, d), ["user_id", "event_type"])
    done = tail.to_table(beats, ["user_id", "event_type"], tail.folder_for(spark, "beats"), tail.folder_for(spark, "beats-state"))
    return done.select("user_id", "event_type", "n", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("SELECT event_type, (epoch_us(ts) // 180000000) * 180000000 AS start_us, count(*) AS n FROM events GROUP BY ALL")
def stream_buckets(spark, d):
    counted = tail.windows(replay(spark, d), ["event_type"], delay="3650 days")
    done = tail.to_table(counted, ["event_type", "start"], tail.folder_for(spark, "windows"), tail.folder_for(spark, "windows-state"))
    return done.select("event_type", F.unix_micros("start").alias("start_us"), "n")
