"""Vector operators against brute force: uneven lengths, several shards, ties, few candidates, dense groups."""

import numpy as np
import pytest

from lorekeep.llm import caps, vamana


def best(rows, k, every):
    out = {}
    for i, v in rows:
        if i is not None and i % every == 0 and v is not None:
            scored = sorted((-float(np.dot(v, w)), j) for j, w in rows if j is not None and j != i and w is not None and len(w) == len(v))
            out[i] = scored[:k]
    return out


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_graphs_of_several_shards_reach_nearly_all(spark, monkeypatch, spread):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 32))
    x = base[rng.integers(0, 300, 9000)] + 0.3 * rng.normal(size=(9000, 32))
    x *= np.exp(spread * rng.normal(size=(9000, 1)))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vamana.nearest(frame, 20, 50).toPandas()
    hits = []
    for q, part in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        assert part.sort_values("rank").score.is_monotonic_decreasing and np.allclose(part.score, score[part.vec_id])
        hits.append(len({*part.vec_id} & {*np.argsort(-score)[:20].tolist()}) / 20)
    assert len(hits) == 180 and np.mean(hits) >= 0.9


def test_few_candidates_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, -3.0]), (4, [1.0, 0.0]), (20, [1.0, 1.0, 1.0]), (5, None), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [float("nan"), 1.0]), (8, [1e200, 1.0]), (9, [float("inf"), 1.0]), (10, [None, 1.0]), (4, [1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, i or 0) for i, v in rows], "vec_id long, embedding array<double>, node long")
    got = vamana.nearest(frame, 20, 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 8, 1e200), (0, 2, 1, 2.0), (0, 3, 2, 2.0), (0, 4, 4, 1.0), (0, 5, 4, 1.0), (0, 6, 3, 0.0)]
    assert vamana.nearest(frame.where("false")).count() == 0


@pytest.mark.parametrize("dense", [128, 6])
def test_components_and_links_equal_all_pairs(spark, monkeypatch, dense):
    monkeypatch.setattr(caps, "DENSE", dense)
    monkeypatch.setattr(caps, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 24))
    x = [base[k % 40 if k < 300 else 0] + rng.choice([0.1, 0.28]) * rng.normal(size=24) for k in range(420)]
    x = [v * s for v, s in zip(x, np.exp(rng.normal(size=420)))]
    x += [x[5], x[5], x[9]]
    label = [k % 2 for k in range(423)]
    rows = [(k, v.tolist(), label[k]) for k, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("inf")] * 24, 1), (903, x[0].tolist(), None)]
    got = caps.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(423)
    while True:
        least = np.minimum(root, np.where(near, root[None, :], 423).min(1))
        if (least == root).all():
            break
        root = least
    assert near.sum() > 1000
    assert got.n_links.tolist() == near.sum(1).tolist() + [0] * 4
    assert got.component_id.tolist() == root.tolist() + [900, 901, 902, 903]
    assert got.kept.tolist() == (got.index == got.component_id).tolist()


def test_no_vectors(spark):
    assert caps.near_copies(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0
