"""Order-sensitive operators: segments, nearest rows and neighbourhoods within a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, key: str, order: str, opens: Column) -> DataFrame:
    """`segment`: how many rows up to this one open a segment."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("segment", F.sum(F.when(opens, 1).otherwise(0)).over(w))


def previous_where(df: DataFrame, key: str, order: str, test: Column, name: str) -> DataFrame:
    """The order value of the nearest earlier row that meets the test."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.max(F.when(test, F.col(order))).over(w))


def next_where(df: DataFrame, key: str, order: str, test: Column, name: str) -> DataFrame:
    """The order value of the nearest later row that meets the test; a running minimum from the end."""
    w = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.min(F.when(test, F.col(order))).over(w))


def around(log: DataFrame, hits: DataFrame, key: str, order: str, before: int, after: int) -> DataFrame:
    """Each hit with the rows near it: an equality join on the exploded neighbouring positions, not a range join."""
    wanted = hits.select(key, order, F.explode(F.sequence(F.col(order) - before, F.col(order) + after)).alias(f"near_{order}"))
    return wanted.where(F.col(order) != F.col(f"near_{order}")).join(log.select(key, F.col(order).alias(f"near_{order}")), [key, f"near_{order}"])
