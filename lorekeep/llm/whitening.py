"""Whitened embeddings by TSQR: no covariance matrix is formed.

Vectors become integer vectors. The distinct ones are centred by their exact sums, each task reduces its centred rows to
a triangular factor, factors are merged eight at a time in a tree, and the singular vectors of the last one whiten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.store import discard, filesystem, prepare, written

#: Entries are 64ths, moved up by so much.
STEPS, MOVED = 64, 1_000_000
#: Rows that a task holds as doubles before it reduces them, and factors that meet in one merge.
BLOCK, FAN = 4096, 8
COMPONENTS = 16
#: Of the greatest singular value: below it a direction has no variance.
NO_VARIANCE = 1e-13
_TYPES = ("<i1", "<i2", "<i4", "<i8")
LIMIT = float(1 << 61)


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes in the narrowest type that holds the row, so that equal rows are equal bytes."""
    most = np.abs(x).max(1, initial=0)
    kind = np.searchsorted([127, 32767, 2**31 - 1], most)
    out: list[bytes] = [b""] * len(x)
    for k in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == k)
        small = x[rows].astype(_TYPES[k])
        for r, row in zip(rows.tolist(), small):
            out[r] = bytes([k]) + row.tobytes()
    return out


def unpack(values: list[bytes], dim: int) -> np.ndarray:
    """The rows of `pack`, which are the integer vectors less MOVED."""
    out = np.empty((len(values), dim), np.int64)
    kinds = np.array([v[0] for v in values])
    for k in np.unique(kinds).tolist():
        rows = np.flatnonzero(kinds == k)
        out[rows] = np.frombuffer(b"".join(values[r][1:] for r in rows.tolist()), _TYPES[k]).reshape(len(rows), dim)
    return out


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, dim, x of each row whose entries are all finite: x is floor(64 c), packed."""
    for batch in batches:
        column = batch.column("embedding")
        offsets, values = column.offsets.to_numpy(), column.values
        flat = np.floor(STEPS * values.to_numpy(zero_copy_only=False).astype(np.float64))
        bad = ~pc.fill_null(pc.is_finite(values), False).to_numpy(zero_copy_only=False) | ~(np.abs(flat) < LIMIT)
        bad = np.append(0, np.cumsum(bad))[offsets]
        sizes = np.diff(offsets)
        good = (np.diff(bad) == 0) & (sizes > 0) & column.is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[good]).tolist():
            at = np.flatnonzero(good & (sizes == dim))
            x = flat[offsets[at][:, None] + np.arange(dim)].astype(np.int64)
            yield pa.record_batch([batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)), pa.array(pack(x), pa.binary())], names=["vec_id", "dim", "x"])


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Each length in a batch with the places of its rows, at most BLOCK at once."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        for a in range(0, len(at), BLOCK):
            yield dim, at[a : a + BLOCK]


class Model:
    """A written table with one row for each length of vectors. A task reads the rows of the lengths that it meets."""

    def __init__(self, rows: DataFrame):
        self.files, self.rows = rows.inputFiles(), {}

    def __getitem__(self, dim: int) -> dict | None:
        if dim not in self.rows:
            self.rows[dim] = None
            for uri in self.files:
                fs, path = filesystem(uri)
                for row in pq.read_table(path, filesystem=fs, filters=[("dim", "=", dim)]).to_pylist():
                    row["sums"] = [int(s) for s in row["sums"]]
                    if "axes" in row:
                        row["axes"] = np.frombuffer(row["axes"], "<f8").reshape(dim, -1)
                    self.rows[dim] = row
        return self.rows[dim]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, n, sums of a task's rows; sums as decimal digits, which have no bound."""
    held: dict[int, list] = {}
    for batch in batches:
        for dim, at in _by_dim(batch):
            x = unpack(batch.column("x").take(pa.array(at)).to_pylist(), dim)
            s = x.sum(0) if np.abs(x).max() < (1 << 62) // len(x) else x.astype(object).sum(0)
            mine = held.setdefault(dim, [0, [0] * dim])
            mine[0] += len(x)
            mine[1] = [p + int(q) for p, q in zip(mine[1], s)]
    for dim, (n, sums) in held.items():
        yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([n]), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["dim", "n", "sums"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: 64-bit integers where they hold it, else Python's."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _factors(model: Model, project: bool):
    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One triangular factor of a task's centred rows x - S / n, or of their components, for each length."""
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for dim, at in _by_dim(batch):
                if m := model[dim]:
                    z = (_centred(unpack(batch.column("x").take(pa.array(at)).to_pylist(), dim), m["n"], m["sums"]) / m["n"]).astype(np.float64)
                    mine = held.setdefault(dim, [])
                    mine.append(z @ m["axes"] if project else z)
                    if sum(map(len, mine)) >= BLOCK:
                        held[dim] = [np.linalg.qr(np.vstack(mine), mode="r")]
        for dim, mine in held.items():
            r = np.linalg.qr(np.vstack(mine), mode="r")
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary()), pa.array([r.shape[1]], pa.int32())], names=["dim", "part", "r", "wide"])

    return factors


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """At most FAN factors as one. Sorted, so that a repeated task gives the same bits."""
    rows, wide = rows.sort_values("part"), int(rows["wide"].iloc[0])
    r = np.linalg.qr(np.vstack([np.frombuffer(x, "<f8").reshape(-1, wide) for x in rows["r"]]), mode="r")
    return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "r": [r.astype("<f8").tobytes()], "wide": [wide]})


def triangular(rows: DataFrame, model: Model, project: bool = False) -> DataFrame:
    """dim, part, r, wide: the triangular factor of all rows of each length, by a tree of merges."""
    schema = "dim int, part long, r binary, wide int"
    now = written(rows.mapInArrow(_factors(model, project), schema), "factors")
    last = now.agg(F.max("part")).first()[0] or 0
    while last > 0:
        before, last = now, last // FAN
        now = written(before.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("dim", "part").applyInPandas(_merge, schema), "factors")
        discard(before)
    return now


def _axes(most: int):
    def axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The right singular vectors over the deviations, and what share of the variance each has."""
        for batch in batches:
            for dim, n, r in zip(*(batch.column(c).to_pylist() for c in ("dim", "n", "r"))):
                _, s, v = np.linalg.svd(np.frombuffer(r, "<f8").reshape(-1, dim))
                k = min(most, int((s > NO_VARIANCE * max(s[0], 1e-300)).sum())) if s[0] > 0 else 0
                if k:
                    axes = v[:k].T / (s[:k] / np.sqrt(n))
                    yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([np.ascontiguousarray(axes, "<f8").tobytes()], pa.binary()), pa.array([((s[:k] / s[0]) ** 2 / ((s / s[0]) ** 2).sum()).tolist()], pa.list_(pa.float64()))], names=["dim", "axes", "explained"])

    return axes


def _errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, n, r, wide in zip(*(batch.column(c).to_pylist() for c in ("dim", "n", "r", "wide"))):
            r = np.frombuffer(r, "<f8").reshape(-1, wide)
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([float(np.abs(r.T @ r / n - np.eye(wide)).max())])], names=["dim", "identity_error"])


def _whitened(model: Model):
    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each row and component."""
        for batch in batches:
            for dim, at in _by_dim(batch):
                if m := model[dim]:
                    exact = _centred(unpack(batch.column("x").take(pa.array(at)).to_pylist(), dim), m["n"], m["sums"])
                    if exact.dtype == np.int64 and float(np.abs(exact).max()) ** 2 * dim < 2.0**62:
                        apart = (exact * exact).sum(1).tolist()
                    else:
                        apart = [a if a < 1 << 63 else None for a in (sum(int(e) ** 2 for e in row) for row in exact)]
                    w = (exact / m["n"]).astype(np.float64) @ m["axes"]
                    rows, k = w.shape
                    again = np.repeat(np.arange(rows), k)
                    columns = {"vec_id": batch.column("vec_id").take(pa.array(at[again])), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows), "n": np.full(rows * k, m["n"]), "deviation": pa.array(apart, pa.int64()).take(pa.array(again))}
                    columns |= {"whitened": w.ravel(), "explained": np.tile(m["explained"], rows), "identity_error": np.full(rows * k, m["identity_error"])}
                    yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))

    return whitened


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of rows (vec_id, embedding).

    Null vectors, empty ones and those with null or non-finite entries are dropped, as are those with entries of 2^55
    and more, of which no integer vector is made. Each length of vectors is whitened by itself, with its own n. The fit
    is made of each distinct integer vector once, so repeated rows do not change it; every row comes back, with a null
    or repeated id too. A component without variance (all vectors equal, or fewer than components) has no rows. A
    deviation that a long cannot hold is null. An empty table gives no rows; other columns are not read.
    """
    prepare(vectors.sparkSession)
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    coded = written(source.mapInArrow(_encoded, "vec_id long, dim int, x binary"), "coded")
    fit = written(coded.select("dim", "x").distinct(), "fit")
    parts = fit.mapInArrow(_summed, "dim int, n long, sums array<string>")
    each = parts.select("dim", "n", F.posexplode("sums").alias("at", "s")).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    centre = written(each.groupBy("dim").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x.s.cast("string")).alias("sums")), "centre")
    factor = triangular(fit, Model(centre))
    axes = written(centre.join(factor.select("dim", "r"), "dim").mapInArrow(_axes(components), "dim int, axes binary, explained array<double>").join(centre, "dim"), "axes")
    again = triangular(fit, Model(axes), project=True)
    errors = again.join(centre.select("dim", "n"), "dim").mapInArrow(_errors, "dim int, identity_error double")
    model = written(axes.join(errors, "dim"), "model")
    discard(fit, factor, again)
    return coded.mapInArrow(_whitened(Model(model)), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
