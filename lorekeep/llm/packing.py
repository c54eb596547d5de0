"""Packing documents into sequences of bounded length with large-item matching and best fit.

What goes where depends on nothing but lengths, and there are at most `capacity` of them. So the corpus is
counted by length, the counts are packed exactly on the driver (runs of equal bins are handled at once), and
each piece finds its place from its rank among the pieces of its length. No step sees all pieces in one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.store import driver_table, prepare, written
from lorekeep.llm.tokens import encoder

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLAN = "length long, low long, high long, first_sequence long, each long, at long"


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Place counts[length] pieces of each length; returns the runs and the number of sequences.

    A run (length, low, high, first_sequence, each, at): the pieces of that length with ranks low to high - 1
    go, `each` by each, to sequences from first_sequence on, side by side from offset `at`. Pieces above a
    third of the capacity, longest first, are matched with the longest other such piece that fits, so at
    most two share a bin. The others, longest first, go where the least gap that holds them is.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    placed: dict[int, int] = defaultdict(int)
    runs, bins = [], 0
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by gap: runs of bins (first, how many)

    def put(length: int, first: int, bins_: int, each: int, at: int) -> None:
        runs.append((length, placed[length], placed[length] + bins_ * each, first, each, at))
        placed[length] += bins_ * each

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            fits = bisect.bisect_right(large, min(length, capacity - length)) - 1
            while fits >= 0 and left[large[fits]] <= (large[fits] == length):
                fits -= 1
            if fits < 0:
                n, gap = left[length], capacity - length
                put(length, bins, n, 1, 0)
                left[length] = 0
            else:
                mate = large[fits]
                n, gap = left[length] // 2 if mate == length else min(left[length], left[mate]), capacity - length - mate
                put(length, bins, n, 1, 0)
                put(mate, bins, n, 1, length)
                left[length] -= n
                left[mate] -= n
            gaps[gap].append((bins, n))
            bins += n
    order = sorted(k for k in gaps if k)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[length]
        while n:
            k = bisect.bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                first, have = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(k)
                    del gaps[gap]
            else:
                gap, first, have = capacity, bins, -(-n // (capacity // length))
                bins += have
            each = gap // length
            use = min(have, n // each)
            if not use:  # fewer pieces than one bin takes
                use, each = 1, n
            put(length, first, use, each, capacity - gap)
            n -= use * each
            for rest, begin, many in ((gap - each * length, first, use), (gap, first + use, have - use)):
                if rest and many:
                    if rest not in gaps:
                        bisect.insort(order, rest)
                    gaps[rest].append((begin, many))
    return runs, bins


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token pieces of every document: only documents longer than `capacity` are cut, the first piece takes the remainder.

    `rank` counts the pieces of equal length within the task `part` that made them.
    """
    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, end = encoder(vocabulary, added=True), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        ranks: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encode(text.as_py()) + end)
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rows.append((doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), part, ranks[size]))
                    ranks[size] += 1
                    at, piece = at + size, piece + 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece of a written table of pieces (length, part, rank) its sequence_id and offset.

    Counts by (part, length) become first ranks; the join on both keys has as many rows per key as one
    task made of one length. The plan has a few runs for each of at most `capacity` lengths, so it is
    small whatever the corpus, and is broadcast.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    totals = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_bins(totals, capacity)
    plan = F.broadcast(driver_table(spark, runs, PLAN).withColumnRenamed("length", "of"))
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    placed = ranked.join(plan, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    within = F.col("rank") - F.col("low")
    return placed.select(
        *[c for c in pieces.columns if c not in ("part", "rank")],
        (F.col("first_sequence") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + within % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated documents are packed as often as they come; null
    ids are kept. Very long texts are encoded whole and cut into pieces of the capacity. Columns other than doc_id and
    text are not read, whatever their names. An empty table gives no rows.
    """
    return pack(written(cut_pieces(docs, capacity, end_id, vocabulary), "pieces"), capacity)
