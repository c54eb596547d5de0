"""Whitening against eigenvectors of a covariance matrix that is formed plainly."""

import numpy as np
import pytest

from lorekeep.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, dim int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 5, "n") for i, v in rows], SCHEMA)


def plain(rows, components=16):
    """By length of vectors: n, and each row's id, deviation and projections on the unit eigenvectors over deviations."""
    out, by = {}, {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            by.setdefault(len(v), []).append((i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]))
    for dim, mine in by.items():
        fit = sorted({tuple(x) for _, x in mine})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        z = np.array([[n * c - t for c, t in zip(x, s)] for x in fit], float) / n
        v = z.T @ z / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        k = min(components, int((e > 1e-9 * max(e[0], 1e-300)).sum())) if e[0] > 1e-9 else 0
        exact = [[n * c - t for c, t in zip(x, s)] for _, x in mine]
        out[dim] = n, [i for i, _ in mine], [sum(d * d for d in row) for row in exact], np.array(exact, float) / n @ u[:, :k] / np.sqrt(e[:k]) if k else np.zeros((len(mine), 0)), e[:k] / max(np.trace(v), 1e-300)
    return out


def check(got, rows, components=16):
    want = plain(rows, components)
    assert len(got) == sum(w[3].size for w in want.values())
    for _, ids, deviations, w, explained in want.values():
        mine = got[got.vec_id.isin(ids)].sort_values(["vec_id", "component"])
        g = mine.whitened.to_numpy().reshape(w.shape)
        w = w[np.argsort(ids, kind="stable")]
        if w.size:
            assert np.allclose(g * np.sign((g * w).sum(0)), w, atol=1e-8)
            assert np.allclose(mine.explained.to_numpy().reshape(w.shape), explained, rtol=1e-6) and (mine.identity_error < 1e-6).all()
            assert dict(zip(mine.vec_id, mine.deviation)) == dict(zip(ids, deviations))


def test_equals_eigenvectors_with_copies_and_several_merges(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 24)) @ np.diag(np.linspace(3, 0.2, 24)) + 7
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[0].tolist()) for k in range(200)]
    check(whitening.whiten(frame(spark, rows).repartition(9)).toPandas(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(30)] + [(50 + k, rng.normal(size=2).tolist()) for k in range(9)]
    rows += [(90, None), (91, []), (92, [None, 1.0]), (93, [float("nan")] * 4), (94, [float("inf"), 0.0]), (95, [1e30, 0.0]), (96, [0.0, 0.0]), (97, [-0.0, 0.0]), (98, [1.0, 2.0, 3.0])]
    got = whitening.whiten(frame(spark, [*rows, (None, [1.0, 1.0])])).toPandas()
    assert got.vec_id.isna().sum() == 2
    check(whitening.whiten(frame(spark, rows)).toPandas(), [r for r in rows if r[0] != 95])


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)]])
def test_without_variance_there_are_no_components(spark, rows):
    assert whitening.whiten(frame(spark, rows)).count() == 0


def test_large_entries_stay_exact(spark):
    big = float(2**50)
    rows = [(k, [big * k, float(k * k)]) for k in range(5)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert got[got.vec_id != 2].deviation.isna().all() and (got[got.vec_id == 2].deviation == 640**2).all() and (got.identity_error < 1e-6).all()
    rows = [(k, [float(2**12) * k, float(k * k)]) for k in range(5)]
    check(whitening.whiten(frame(spark, rows)).toPandas(), rows)


def test_packed_rows_are_equal_only_if_their_values_are():
    x = np.array([[1, -2, 3], [127, -127, 0], [128, 0, 0], [2**40, 1, -1], [1, -2, 3]])
    p = whitening.pack(x)
    assert p[0] == p[4] and len({*p}) == 4 and (whitening.unpack(p, 3) == x).all()
