"""Near copies of vectors by spherical-cap filters.

Each block of a vector's coordinates has a small random code (and there are CODES independent ones of these); a filter is one codeword of each block, and its
score the sum of the blocks' products. A vector is listed under every filter that scores over a threshold, and
vectors of one label that share a filter are candidates. Filters that few vectors have are joined with
themselves on (label, filter, id) alone; candidates are first held against short codes with a known error and
then against the vectors. Filters that many have (dense groups, whose links must all be counted) are compared
block by block as matrices; a pair counts there only under the least such filter that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.graph import connected
from lorekeep.llm.store import discard, prepare, written
from lorekeep.llm.vectors import stacked, units, usable

#: Independent codes, blocks of coordinates, codewords of each, and the threshold in standard deviations of a random score.
CODES, BLOCKS, WORDS, CAP = 4, 3, 64, 4.1
#: A vector that exceeds the threshold for fewer filters of a code is listed under this many best ones instead.
LEAST = 10
#: Filters of a label with more vectors are compared as matrices, of so many rows.
DENSE, BLOCK_ROWS = 128, 2000
SEED = 5


class Filters:
    """A random product code of `dim` coordinates."""

    def __init__(self, dim: int, number: int):
        rng = np.random.default_rng([SEED, number])
        self.dim, self.turn = dim, np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), min(BLOCKS, dim))
        self.codes = []
        for c in self.cuts:
            code = rng.normal(size=(WORDS, len(c)))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) * np.sqrt(len(c) / dim))

    def of(self, unit: np.ndarray) -> list[np.ndarray]:
        """The filters of each row of unit vectors, by extending all rows' lists block by block."""
        turned = unit @ self.turn
        scores = [turned[:, c] @ code.T for c, code in zip(self.cuts, self.codes)]
        rest = np.vstack([np.cumsum([s.max(1) for s in scores[::-1]], axis=0)[::-1][1:], np.zeros((1, len(unit)))])
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(unit)
        left, bar = np.arange(len(unit)), CAP / np.sqrt(self.dim)
        while len(left):
            row, ids, total = np.arange(len(left)), np.zeros(len(left), np.int64), np.zeros(len(left))
            for s, r in zip(scores, rest):
                more = total[:, None] + s[left][row]
                far, word = np.nonzero(more + r[left][row][:, None] >= bar)
                row, ids, total = row[far], ids[far] * WORDS + word, more[far, word]
            counts = np.bincount(row, minlength=len(left))
            enough = (counts >= LEAST) | (counts >= WORDS ** len(self.cuts))
            for k, (a, b) in enumerate(zip(np.append(0, np.cumsum(counts)), np.cumsum(counts))):
                if enough[k]:
                    mine = ids[a:b]
                    if bar < CAP / np.sqrt(self.dim):
                        mine = mine[np.argsort(-total[a:b], kind="stable")[:LEAST]]
                    out[left[k]] = np.sort(mine)
            left, bar = left[~enough], bar - 0.5 / np.sqrt(self.dim)
        return out


def lists(codes: list[Filters], unit: np.ndarray) -> list[np.ndarray]:
    """The filters of all codes of each row."""
    return [np.concatenate([f + k * WORDS**BLOCKS for k, f in enumerate(mine)]) for mine in zip(*(c.of(unit) for c in codes))]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each usable vector with its filters, its unit vector, and a code of one byte a coordinate and the code's error."""
    made: dict[int, list[Filters]] = {}
    for batch in batches:
        at, rows = usable(batch.column("embedding"))
        sizes = np.array([len(x) for x in rows])
        for dim in np.unique(sizes).tolist():
            code, mine = made.setdefault(dim, [Filters(dim, k) for k in range(CODES)]), np.flatnonzero(sizes == dim)
            for a in range(0, len(mine), 64):
                part = mine[a : a + 64]
                u = units(np.array([rows[k] for k in part]))
                step = np.abs(u).max(1, keepdims=True) / 127
                short = np.rint(u / step).astype(np.int8)
                error = np.linalg.norm(u - short * step, axis=1)
                rec = batch.take(pa.array(at[part]))
                yield pa.record_batch([rec.column("vec"), rec.column("label"), pa.array(np.full(len(part), dim, np.int32)), pa.array(lists(code, u), pa.list_(pa.int64())), pa.array([x.tobytes() for x in u.astype("<f8")], pa.binary()), pa.array([x.tobytes() for x in short], pa.binary()), pa.array(step[:, 0]), pa.array(error), rec.column("copies")], names=["vec", "label", "dim", "filters", "unit", "short", "step", "error", "copies"])


def _possible(limit: float):
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                col = lambda c: batch.column(c).to_numpy()
                about = np.einsum("ij,ij->i", stacked(batch.column("sx"), "i1").astype(np.int32), stacked(batch.column("sy"), "i1").astype(np.int32)) * col("tx") * col("ty")
                slack = col("ex") + col("ey") * (1 + col("ex")) + 1e-9
                yield batch.select(["a", "b"]).filter(pa.array(about + slack >= limit))

    return possible


def _exact(limit: float):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.einsum("ij,ij->i", stacked(batch.column("x"), "<f8"), stacked(batch.column("y"), "<f8")) >= limit
                yield batch.select(["a", "b", "nx", "ny"]).filter(pa.array(near))

    return exact


def _compare(limit: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links within one pair of blocks: partial counts of each vector, and edges of their local classes."""
        bucket, i, j = int(key[2]), int(key[3]), int(key[4])
        x = np.vstack([np.frombuffer(u, "<f8") for u in rows["unit"]])
        near = x @ x.T >= limit
        np.fill_diagonal(near, False)
        part = rows["part"].to_numpy()
        if i != j:
            near &= part[:, None] != part[None, :]
        # a smaller dense filter of both has the pair already
        smaller = [f[f < bucket] for f in rows["dense"]]
        names, which = np.unique(np.concatenate(smaller) if len(smaller) else np.zeros(0, np.int64), return_inverse=True)
        if len(names):
            has = np.zeros((len(x), len(names)), np.float32)
            has[np.repeat(np.arange(len(x)), [len(f) for f in smaller]), which] = 1
            near &= has @ has.T == 0
        copies, ids = rows["copies"].to_numpy(), rows["vec"].to_numpy()
        counts, root = near @ copies, np.arange(len(ids))
        while True:  # the least place of each class, by steps to the least neighbour's
            least = np.minimum(root, np.where(near, root[None, :], len(ids)).min(1, initial=len(ids)))
            least = least[least]
            if (least == root).all():
                break
            root = least
        linked = np.flatnonzero(counts)
        return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]], "n": counts[linked].astype(np.int64)})

    return compare


def near_copies(vectors: DataFrame, limit: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label).

    Equal vectors of a label are one, with its number of copies. Null labels and unusable vectors (null, zero,
    null or non-finite components) have no links and are their own component, as are rows without an id.
    vec_id should be unique; rows that repeat an id with an equal vector count as copies. Vectors of unequal
    length never link. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    # equal vectors meet by their digest; -0.0 and 0.0 are one value to Spark's grouping, and to its hash
    hashed = rows.withColumn("digest", F.md5(F.to_csv(F.struct(F.concat_ws(",", F.col("embedding").cast("array<string>")))))).withColumn("whole", F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    same = hashed.where("whole").groupBy("label", "digest").agg(F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    listed = written(same.mapInArrow(_listed, "vec long, label string, dim int, filters array<long>, unit binary, short binary, step double, error double, copies long"), "caps")
    held = listed.select("label", "dim", F.explode("filters").alias("filter"), "vec")
    sizes = held.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = written(held.join(sizes, ["label", "dim", "filter"]), "filters")
    # dense filters
    thick = sized.where(F.col("size") > DENSE)
    dense = thick.groupBy("vec").agg(F.sort_array(F.collect_list("filter")).alias("dense"))  # no more than a vector has filters
    cut = thick.join(dense, "vec").join(listed.select("vec", "unit", "copies"), "vec").withColumn("parts", F.ceil(F.col("size") / BLOCK_ROWS).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("label", "dim", "filter", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "vec", "dense", "unit", "copies")
    blocks = cut.groupBy("label", "dim", "filter", "i", "j").applyInPandas(_compare(limit), "a long, b long, n long")
    # the others
    thin = sized.where(F.col("size") <= DENSE).select("label", "dim", "filter", "vec")
    x, y = thin.withColumnRenamed("vec", "a"), thin.withColumnRenamed("vec", "b")
    met = x.join(y, ["label", "dim", "filter"]).where("a < b").select("a", "b").distinct()
    short = listed.select("vec", "short", "step", "error")
    sx, sy = (short.select(F.col("vec").alias(v), F.col("short").alias(f"s{k}"), F.col("step").alias(f"t{k}"), F.col("error").alias(f"e{k}")) for v, k in (("a", "x"), ("b", "y")))
    likely = met.join(sx, "a").join(sy, "b").mapInArrow(_possible(limit), "a long, b long")
    full = listed.select("vec", "unit", "copies").join(dense, "vec", "left")
    fx, fy = (full.select(F.col("vec").alias(v), F.col("unit").alias(k), F.col("copies").alias(f"n{k}"), F.col("dense").alias(f"d{k}")) for v, k in (("a", "x"), ("b", "y")))
    apart = likely.join(fx, "a").join(fy, "b").where(~F.coalesce(F.arrays_overlap("dx", "dy"), F.lit(False))).select("a", "b", "x", "y", "nx", "ny")
    links = apart.mapInArrow(_exact(limit), "a long, b long, nx long, ny long").select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("ny").alias("n")), F.struct(F.col("b").alias("of"), F.col("nx").alias("n")))).alias("half"))
    # (a, b, n): n links of a, which is in b's class
    found = written(links.select(F.col("half.of").alias("a"), "b", F.col("half.n").alias("n")).unionByName(links.select(F.col("a"), "b", F.lit(0).cast("long").alias("n"))).unionByName(blocks), "cap-links")
    discard(sized)
    counts = found.groupBy(F.col("a").alias("vec")).agg(F.sum("n").alias("n"))
    classes = connected(found.select("a", "b"))
    known = listed.select("vec", "copies").join(counts, "vec", "left").join(classes, F.col("vec") == F.col("node"), "left")
    known = known.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "vec").alias("of"))
    of = same.select(F.col("label").alias("l"), F.col("digest").alias("d"), "vec").join(known, "vec")
    out = hashed.join(of, F.col("whole") & (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("of", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
