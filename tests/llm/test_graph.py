"""Components of random graphs, in one part and in many."""

import numpy as np
import pytest

from lorekeep.llm import graph


@pytest.mark.parametrize("each", [100_000, 60])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components(spark, monkeypatch, each, kind):
    monkeypatch.setattr(graph, "EDGES", each)
    rng = np.random.default_rng(1)
    pairs = [(k, k + 1) for k in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (170, 2))] + [(7, 7), (5, 4)]
    root = {v: v for p in pairs for v in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    name = (lambda v: v) if kind == "long" else (lambda v: b"%06d" % v)
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], f"a {kind}, b {kind}").repartition(4)
    got = {(r.node if kind == "long" else bytes(r.node)): (r.component if kind == "long" else bytes(r.component)) for r in graph.connected(edges).collect()}
    assert got == {name(v): name(r) for v, r in root.items() if v != r}
