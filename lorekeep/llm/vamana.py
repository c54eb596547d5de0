"""Nearest neighbours by inner product with robust-pruned directed graphs, one per shard.

Shards are bands of the vectors' lengths, so a shard's vectors are about equally long. One more coordinate
makes them exactly so, and the largest inner product is then the least distance. Vectors are inserted in growing
batches: a greedy beam search proposes neighbours and relaxed distance pruning keeps diverse edges in both
directions. Each graph is written once; a task searches one shard for one block of queries, and the best of all
shards remain. Equal vectors are one node; their ids are put back afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.store import prepare, written
from lorekeep.llm.vectors import stacked, usable

#: The longest vector of a band over the shortest.
BAND = 1.25
#: Distinct vectors of a shard about; edges of a node; beam widths; relaxation of the pruning.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 4000, 32, 48, 96, 1.2
#: Queries that a task searches in its shard, and those of them that are searched at once.
QUERIES, QUERY_BLOCK = 20_000, 500
#: Shards with at most this many vectors are all wanted: a query's 20 and itself.
SMALL = 21


def even(x: np.ndarray, longest: float) -> np.ndarray:
    """The rows with one more coordinate that makes all as long as `longest`, scaled so that this is 1."""
    x = x / longest if longest else x
    return np.hstack([x, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))[:, None]])


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow of the squares."""
    top = np.abs(x).max(1)
    return top * np.sqrt(((x / np.where(top > 0, top, 1)[:, None]) ** 2).sum(1))


class Graph:
    """`x` has one row for each node; `edges` the nodes that it leads to (-1: none); `starts` where searches begin."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.longest = float(lengths(x).max(initial=0))
        self.x = even(x, self.longest)
        n = len(x)
        if edges is not None:
            self.edges, self.starts = edges, starts
            return
        self.edges = np.full((n, DEGREE), -1, np.int32)
        first = int(np.argmin(((self.x - self.x.mean(0)) ** 2).sum(1)))
        self.starts = np.array([first], np.int32)
        if n <= SMALL:
            return
        order = np.random.default_rng(3).permutation(n)
        order = np.append(first, order[order != first])
        at, size = 1, 1
        while at < n:
            batch = order[at : at + size]
            found, _ = self.search(self.x[batch], BUILD_BEAM)
            back: dict[int, list[int]] = {}
            for p, near in zip(batch.tolist(), found):
                chosen = self.prune(p, near[near >= 0])
                self.edges[p, : len(chosen)] = chosen
                for q in chosen.tolist():
                    back.setdefault(q, []).append(p)
            for q, more in back.items():
                have = self.edges[q][self.edges[q] >= 0]
                every = np.union1d(have, more)
                if len(every) > DEGREE:
                    every = self.prune(q, every)
                self.edges[q] = -1
                self.edges[q, : len(every)] = every
            at, size = at + len(batch), min(max(1, at), max(64, n // 16))
        self._reach()

    def _reach(self) -> None:
        """Begin searches also at one node of each part that pruning has cut off."""
        seen = np.zeros(len(self.x), bool)
        front = self.starts
        while True:
            while len(front):
                seen[front] = True
                after = np.unique(self.edges[front])
                front = after[(after >= 0) & ~seen[np.maximum(after, 0)]]
            if seen.all():
                return
            front = np.flatnonzero(~seen)[:1].astype(np.int32)
            self.starts = np.append(self.starts, front)

    def prune(self, p: int, near: np.ndarray) -> np.ndarray:
        near = near[near != p]
        gap = ((self.x[near] - self.x[p]) ** 2).sum(1)
        order = np.argsort(gap, kind="stable")
        near, gap = near[order], gap[order]
        y = self.x[near]
        sq = (y * y).sum(1)
        between = ALPHA**2 * (sq[:, None] + sq[None, :] - 2 * y @ y.T)
        alive, kept = np.ones(len(near), bool), []
        while len(kept) < DEGREE and alive.any():
            k = int(np.argmax(alive))
            kept.append(k)
            alive[k] = False
            alive &= between[k] > gap
        return near[kept]

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's nodes (-1: none) and squared distances, nearest first, of each query."""
        m, n, s = len(q), len(self.x), min(len(self.starts), beam)
        ids, far, seen = np.full((m, beam), -1, np.int32), np.full((m, beam), np.inf), np.zeros((m, beam), bool)
        met = np.zeros((m, n), bool)  # nodes whose distance a query knows
        gap = ((self.x[self.starts][None] - q[:, None, :]) ** 2).sum(2)
        order = np.argsort(gap, axis=1, kind="stable")[:, :s]
        ids[:, :s], far[:, :s] = self.starts[order], np.take_along_axis(gap, order, 1)
        met[:, self.starts] = True
        sq, live = (self.x * self.x).sum(1), np.arange(m)
        while len(live):
            open_ = ~seen[live] & (ids[live] >= 0)
            some = open_.any(1)
            live, open_ = live[some], open_[some]
            if not len(live):
                break
            spot = np.argmax(open_, axis=1)  # the beam is sorted
            seen[live, spot] = True
            new = self.edges[ids[live, spot]]
            fresh = (new >= 0) & ~met[live[:, None], new]
            met[live[:, None], np.where(new >= 0, new, 0)] |= new >= 0
            r, c = np.nonzero(fresh)
            gap = np.full(new.shape, np.inf)
            x = new[r, c]
            own = q[live[r]]
            gap[r, c] = np.maximum(sq[x] + np.einsum("ij,ij->i", own, own) - 2 * np.einsum("ij,ij->i", self.x[x], own), 0)
            every_id, every_far = np.hstack([ids[live], np.where(fresh, new, -1)]), np.hstack([far[live], gap])
            every_seen = np.hstack([seen[live], np.zeros(new.shape, bool)])
            order = np.argsort(every_far, axis=1, kind="stable")[:, :beam]
            ids[live], far[live], seen[live] = (np.take_along_axis(v, order, 1) for v in (every_id, every_far, every_seen))
        return np.where(np.isfinite(far), ids, -1), far

    def nearest(self, q: np.ndarray, k: int) -> np.ndarray:
        """The k nodes (-1: none) with the largest inner products that were found, for rows q of the original space."""
        own = lengths(q)
        q = q / np.where(own > 0, own, 1)[:, None]
        if len(self.x) > SMALL:
            return self.search(np.hstack([q, np.zeros((len(q), 1))]), max(BEAM, 2 * k))[0][:, :k]
        order = np.argsort(-(q @ self.x[:, :-1].T), axis=1, kind="stable")[:, :k]
        return np.pad(order, ((0, 0), (0, max(0, k - order.shape[1]))), constant_values=-1)


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The graph of one shard."""
    graph = Graph(np.array([np.frombuffer(v, "<f8") for v in rows["raw"]]))
    return rows[["dim", "shard", "node", "raw"]].assign(place=np.arange(len(rows)), edges=[e.tobytes() for e in graph.edges], begins=np.isin(np.arange(len(rows)), graph.starts))


def _search(k: int):
    def search(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard) and len(queries):
            shard = shard.sort_values("place", ignore_index=True)
            x = np.array([np.frombuffer(v, "<f8") for v in shard["raw"]])
            graph = Graph(x, np.array([np.frombuffer(v, "<i4") for v in shard["edges"]]), np.flatnonzero(shard["begins"]).astype(np.int32))
            ids, q_ids = shard["node"].to_numpy(), queries["query"].to_numpy()
            q_all = np.array([np.frombuffer(v, "<f8") for v in queries["raw"]])
            for a in range(0, len(q_all), QUERY_BLOCK):
                q = q_all[a : a + QUERY_BLOCK]
                found = graph.nearest(q, k + 1)
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("ij,ikj->ik", q, x[found])
                good = found >= 0
                out.append(pd.DataFrame({"query": np.repeat(q_ids[a : a + QUERY_BLOCK], good.sum(1)), "node": ids[found[good]], "score": score[good]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return search


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = usable(batch.column("embedding"))
        band = [int(np.floor(np.log(lengths(x[None])[0]) / np.log(BAND))) for x in rows]
        yield pa.record_batch([batch.column("vec_id").take(pa.array(at)), pa.array([len(x) for x in rows], pa.int32()), pa.array(band, pa.int32()), pa.array([(x + 0.0).astype("<f8").tobytes() for x in rows], pa.binary())], names=["vec_id", "dim", "band", "raw"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Unusable vectors (null, zero, null or non-finite components) take no part, nor do null ids. Vectors of
    another length than the query's are no candidates. Equal scores rank by vec_id. Rows that repeat an id are
    rows of their own: each is a candidate, and as queries they are one if their vectors are equal. A query with
    fewer than k candidates gets all that are reached, which is all of them where shards are small. Other columns are not read, whatever their names. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(_usable, "vec_id long, dim int, band int, raw binary"), "vectors")
    nodes = rows.groupBy("raw", "dim", "band").agg(F.min("vec_id").alias("node"))
    # a band of lengths is dealt to as many shards as it needs; there are at most a few thousand bands of doubles
    bands = [(r.dim, r.band, -(-r["count"] // SHARD)) for r in nodes.groupBy("dim", "band").count().collect()]
    parts = F.broadcast(spark.createDataFrame(bands, "dim int, band int, parts long"))
    shard = F.concat_ws("|", "band", F.pmod(F.xxhash64("raw"), F.col("parts")))
    dealt = nodes.join(parts, ["dim", "band"]).select("dim", shard.alias("shard"), "node", "raw")
    graphs = written(dealt.groupBy("dim", "shard").applyInPandas(_build, "dim int, shard string, node long, raw binary, place long, edges binary, begins boolean"), "graphs")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), "raw", "dim").distinct()
    blocks = max(1, -(-queries.count() // QUERIES))
    there = graphs.select(F.col("dim").alias("of"), F.col("shard").alias("there")).distinct()
    sent = queries.join(there, F.col("dim") == F.col("of")).select("query", "raw", "dim", F.col("there").alias("shard"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))
    dealt = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = dealt.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInPandas(_search(k), "query long, node long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    best = written(best, "found")
    # of each vector's equal rows no more than k + 1 can rank
    own = rows.join(graphs.select("raw", "node"), "raw").select("vec_id", "node")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    ranked = best.join(own, "node").where("vec_id != query").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
