"""What Python workers keep from one operator's tasks to the next one's, and tables that need none of their own."""

import pyarrow as pa
import pytest

from lorekeep.llm import jaccard, store, tokens, toxicity

TEXTS = pa.record_batch([pa.array([1, 2]), pa.array(["a b c d e f", None]), pa.array([b"x", None])], names=["doc_id", "text", "digest"])


@pytest.mark.parametrize("task", [jaccard._sets(5, pa.int64()), toxicity._count], ids=["sets", "count"])
def test_tasks_without_tokens_let_encoders_go(task):
    encode = tokens.encoder(added=True)
    encode("some words of an earlier task")
    assert tokens._encoders
    list(task(iter([TEXTS])))
    assert not tokens._encoders
    assert tokens.encoder(added=True)("some words") == encode("some words")


@pytest.mark.parametrize("rows", [[], [(1, "a", 0.5), (None, None, None), (2**62, "é", float("inf"))]])
def test_tables_of_the_driver_start_no_other_python_workers(spark, rows):
    table = store.driver_table(spark, rows, "k long, s string, x double")
    assert table.dtypes == [("k", "bigint"), ("s", "string"), ("x", "double")]
    assert [tuple(r) for r in table.collect()] == rows
    assert "PythonRDD" not in table._jdf.queryExecution().toRdd().toDebugString()
