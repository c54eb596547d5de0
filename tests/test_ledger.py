"""Selects, pages and joins of a ledger, and its schema."""

import pytest

from lorekeep.operators import ledger

ROWS = [(k, 1000 * (k // 2), f"s{k % 3}", f"u{k}", f'{{"name": "r{k % 2}"}}' if k % 5 else None, f"d{k % 4}", "t") for k in range(12)]


def test_ledger(spark):
    rows = ledger.same_schema(spark.createDataFrame(ROWS, ledger.CORRECTIONS), ledger.CORRECTIONS)
    ids = lambda **by: sorted(r.id for r in ledger.selected(rows, **by).collect())
    assert ids(session="s1") == [1, 4, 7, 10] and ids(repo="r1") == [1, 3, 7, 9, 11] and ids(since=4000) == [10, 11] and ids(between=(1000, 2000)) == [2, 3, 4, 5]
    assert ids(anchor=("s2", "u5")) == [5] and ids(anchor=("s1", "u5")) == [] and ids(digest="d3", session="s1") == [7] and ids() == list(range(12))
    assert [r.id for r in ledger.paged(rows, 3, 2).collect()] == [2, 3, 4] and [r.id for r in ledger.paged(rows, 2, newest=True).collect()] == [11, 10]
    met = ledger.with_decisions(rows, spark.createDataFrame([(1, "d1", "no"), (2, "d9", "yes"), (3, None, "no")], "decision_id int, tool_digest string, verdict string"))
    assert sorted((r.id, r.decision_id) for r in met.collect()) == [(1, 1), (5, 1), (9, 1)]
    with pytest.raises(ValueError):
        ledger.same_schema(rows.withColumnRenamed("text", "words"), ledger.CORRECTIONS)
    files = spark.createDataFrame([("a", 1), ("b", 2)], "path string, mtime int")
    assert sorted(tuple(r) for r in ledger.record_files(files, spark.createDataFrame([("b", 3), ("b", 1), ("c", 9)], "path string, mtime int")).collect()) == [("a", 1), ("b", 3), ("c", 9)]
    assert {r.session_id: r.n for r in ledger.counts_by(rows, "session_id").collect()} == {"s0": 4, "s1": 4, "s2": 4}
