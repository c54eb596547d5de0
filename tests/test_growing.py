"""Growing files and the lift that follows them: appends, half lines, rewriting, restarts and any split into batches."""

import json
import random

import pytest

from lorekeep.operators import session
from lorekeep.sources import growing
from lorekeep.sources.sessions import events
from lorekeep.streaming import lift, tail
from tests.test_sessions import MAIN, agent, done, use, user


class Tail:
    """A stream that is started anew for each look, as after a restart."""

    def __init__(self, spark, make, tmp_path):
        self.spark, self.make, self.state, self.rows = spark, make, str(tmp_path / "state"), []

    def look(self):
        got = []
        q = self.make().writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", self.state).trigger(availableNow=True).start()
        q.awaitTermination()
        return got


def put(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def test_lines_come_once_through_appends_half_lines_rewriting_and_restarts(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    put(folder / "a.jsonl", "one\ntwo\nhal")
    put(folder / "._a.jsonl", "no\n")
    put(folder / "a.txt", "no\n")
    growing.register(spark)
    look = Tail(spark, lambda: spark.readStream.format("growing_lines").option("from_start", "true").load(str(folder)), tmp_path).look
    told = lambda: sorted((r.path.rpartition("/")[2], r.offset, r.line, r.rewritten) for r in look())
    assert told() == [("a.jsonl", 0, "one", False), ("a.jsonl", 4, "two", False)]
    assert told() == []
    put(folder / "a.jsonl", "f line\n\nnext")
    put(folder / "sub" / "b.jsonl", "new file\n")
    assert told() == [("a.jsonl", 8, "half line", False), ("a.jsonl", 18, "", False), ("b.jsonl", 0, "new file", False)]
    put(folder / "a.jsonl", "short\n", "w")
    assert told() == [("a.jsonl", 0, "short", True)]
    put(folder / "a.jsonl", "öre\n")
    assert told() == [("a.jsonl", 6, "öre", False)]
    assert spark.read.format("growing_lines").load(str(folder)).count() == 3
    assert spark.read.format("growing_lines").load(str(tmp_path / "nothing")).count() == 0


def test_a_stream_may_start_at_the_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.jsonl", "old\nhal")
    growing.register(spark)
    look = Tail(spark, lambda: spark.readStream.format("growing_lines").load(str(folder)), tmp_path).look
    assert look() == []
    put(folder / "a.jsonl", "f\n")
    put(folder / "b.jsonl", "whole\n")
    assert sorted(r.line for r in look()) == ["half", "whole"]


@pytest.mark.parametrize("split", [1, 7, 64])
def test_splits_of_a_file_have_each_line_once(tmp_path, monkeypatch, split):
    monkeypatch.setattr(growing, "SPLIT", split)
    monkeypatch.setattr(growing, "STEP", 3)
    monkeypatch.setattr(growing, "ROWS", 2)
    text = "".join("x" * (k % 9) + "é\n" for k in range(30))
    put(tmp_path / "f.jsonl", text + "rest")
    path, size = str(tmp_path / "f.jsonl"), len((text + "rest").encode())
    assert growing.whole_lines(path, size) == len(text.encode())
    got = [(o, t) for s in growing.spans({path: 2}, {path: len(text.encode())}) for b in growing.lines_of(s) for o, t in zip(b.column("offset").to_pylist(), b.column("line").to_pylist())]
    want, at = [], 0
    for t in text.split("\n")[:-1]:
        want.append((at, t))
        at += len(t.encode()) + 1
    start = next(o for o, _ in want if o >= 2)
    assert got == [w for w in want if w[0] >= start] or got == [(2, want[0][1][1:])] + want[1:]


def test_each_uuid_once_until_the_file_is_rewritten(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    rec = lambda *ids: "".join(json.dumps({"uuid": i, "k": k}) + "\n" for k, i in enumerate(ids))
    put(folder / "a.jsonl", rec("x", "y", "x") + "{}\n{}\n")
    look = Tail(spark, lambda: lift.once(lift.tail_lines(spark, str(folder))), tmp_path).look
    assert sorted(str(r.uuid) for r in look()) == ["None", "None", "x", "y"]
    put(folder / "a.jsonl", rec("y", "z"))
    assert [r.uuid for r in look()] == ["z"]
    put(folder / "a.jsonl", rec("x", "w"), "w")
    assert sorted(r.uuid for r in look()) == ["w", "x"]


LOG = [agent(0, use("early", "Read")), *MAIN, user(20, [done("p", "at last"), done("b", "again", False)]), agent(21, use("b", "Bash", command="once more")), user(22, "third"), {"type": "mode", "mode": "plan"}, agent(24, use("z", "Read"))]


@pytest.mark.parametrize("seed", range(2))
def test_any_split_ends_with_the_rows_of_the_whole_log(spark, tmp_path, seed):
    rng = random.Random(seed)
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"a": "".join(json.dumps(r) + "\n" for r in LOG), "b": "".join(json.dumps(r) + "\n" for r in [user(1, "hi"), user(2, [done("q")]), agent(3, use("q", "Grep"))])}
    cuts = {n: [0, *sorted(rng.sample(range(1, len(t.encode())), 3)), len(t.encode())] for n, t in texts.items()}
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    keys = ["path", "kind", "turn", "idx", "at"]
    for k in range(4):
        for n, t in texts.items():
            with open(folder / f"{n}.jsonl", "ab") as f:
                f.write(t.encode()[cuts[n][k] : cuts[n][k + 1]])
        last = tail.to_table(lift.lifted(lift.tail(spark, str(folder))), keys, table, state)
    whole = session.with_turns(events(spark.read.format("growing_lines").load(str(folder)).selectExpr("path", "offset AS idx", "line")))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(lift.turns(last)) == rows(session.turns(whole).select(lift.turns(last).columns))
    want = session.calls(whole).selectExpr("path", "turn", "idx", "cast(at as int) at", "call_id", "name", "latency_ms", "result.content AS content", "is_error", "pending")
    assert rows(lift.calls(last)) == rows(want)


def test_idle_sessions_are_forgotten(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a.jsonl", json.dumps(user(1, "first")) + "\n")
    look = Tail(spark, lambda: lift.lifted(lift.tail(spark, str(folder)), idle_ms=1), tmp_path).look
    assert [(r.turn, r.prompt) for r in look()] == [(0, "first")]
    put(folder / "b.jsonl", json.dumps(user(1, "other")) + "\n")
    look()
    put(folder / "a.jsonl", json.dumps(user(2, "second")) + "\n")
    assert [(r.turn, r.prompt) for r in look()] == [(0, "second")]
