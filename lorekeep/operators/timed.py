"""Time-ordered operators: buckets, sessions, as-of joins, look-back counts, last-wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def buckets(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows per key and bucket; buckets count from the key's first row, floored to the grid."""
    grid = F.lit(seconds * 1_000_000)
    us = df.select(key, micros(ts).alias("us"))
    origin = us.groupBy(key).agg(F.min("us").alias("low"))
    floored = lambda c: F.expr(f"{c} div {seconds * 1_000_000}")
    joined = us.join(origin, key).withColumn("from", floored("low") * grid)
    return joined.groupBy(key, F.expr(f"(us - `from`) div {seconds * 1_000_000}").alias("bucket")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """Each left row with the latest right row of its key that is no later: one sort of the union, no range join."""
    both = left.select(key, ts, row_id, F.lit(1).alias("side")).unionByName(right.select(key, ts, row_id, F.lit(0).alias("side")))
    w = Window.partitionBy(key).orderBy(ts, "side", row_id).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("side") == 0, F.col(row_id)), ignorenulls=True).over(w)
    return both.withColumn("match_id", found).where("side = 1").drop("side")


def count_within(df: DataFrame, key: str, ts: str, test: Column, seconds: int) -> DataFrame:
    """`hits`: rows of the key that meet the test in the seconds up to each row, by a range frame."""
    w = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("hits", F.count(F.when(test, 1)).over(w))


def sessions(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """`session`: counts from 1, a new one after each gap longer than given."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    gap = micros(ts) - F.lag(micros(ts)).over(w)
    opened = df.withColumn("opens", F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0))
    return opened.withColumn("session", F.sum("opens").over(w)).drop("opens")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by map-side max_by rather than a window."""
    row = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("row")).select(*keys, "row.*")


def conversation_windows(events: DataFrame, seconds: int = 180, least_users: int = 2, least_chars: int = 5) -> DataFrame:
    """session_id, bucket, n: windows of conversation that can be scored.

    Windows count from a session's first conversational event, floored to the grid. Users' noise is dropped before;
    sessions with fewer user turns, and windows without a user's text of some length or without an assistant, go.
    """
    from lorekeep.functions import markers

    user = F.col("kind") == "user"
    said = events.where(F.col("kind").isin("user", "assistant") & ~(user & (markers.is_noise(F.col("text")) | markers.is_interrupt(F.col("text")))))
    us = said.select("session_id", F.unix_micros("ts").alias("us"), user.alias("user"), (user & (F.char_length(markers.strip(F.col("text"))) >= least_chars)).alias("real"))
    size = seconds * 1_000_000
    own = Window.partitionBy("session_id")
    told = us.withColumn("origin", F.expr(f"min(us) OVER (PARTITION BY session_id) div {size} * {size}")).withColumn("users", F.sum(F.col("user").cast("int")).over(own)).where(F.col("users") >= least_users)
    each = told.groupBy("session_id", F.expr(f"(us - origin) div {size}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("real").alias("real"), F.max(~F.col("user")).alias("answered"))
    return each.where("real and answered").select("session_id", "bucket", "n")
