"""Connected components of an edge table: forests of bounded parts, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.store import discard, written

#: Edges that one task joins into a forest, about.
EDGES = 100_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the least node that these edges lead to."""
    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if schema is not None:
        pairs = [(v, find(v)) for v in list(root)]
        pairs = [p for p in pairs if p[0] != p[1]]
        for k in range(0, len(pairs), 50_000):
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*pairs[k : k + 50_000]), schema)], schema=schema)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large) or the other (small) neighbours of each node on the least of its neighbourhood."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else near.groupBy("a").agg(F.min("b").alias("m"))
    joined = near.join(least, "a")
    hung = joined.where("b > a" if large else "b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        hung = hung.unionByName(least.select("a", F.col("m").alias("b")))
    return hung.where("a != b").distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its component's least node) of every node of edges (a, b) but the least ones.

    Parts of about EDGES edges become forests of stars first, which shortens all paths; with one part that is the
    result. Each round is a written table, so lineage stays short. Loops, repeated edges and either direction are fine.
    """
    once = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    parts = once.count() // EDGES + 1
    now = written(once.coalesce(parts).mapInArrow(_forest, once.schema), "edges")
    discard(once)
    done = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if parts == 1:
        return done
    mark = None
    for _ in range(rounds):
        before, now = now, written(_stars(_stars(now, True), False), "edges")
        discard(before)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(found)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
