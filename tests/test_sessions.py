"""Transcripts of a few lines: failure rules, turns, pairing, marks, filters, mining, streams."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import markers, scalars
from lorekeep.operators import ledger, mining, session, spec
from lorekeep.sources import read_lines, read_sessions
from lorekeep.sources.sessions import changed_since, events, invalid_files, listed, newest_of
from lorekeep.streaming import tail


def rec(kind, n, session_id="s", **more):
    return {"type": kind, "uuid": f"{session_id}{n}", "sessionId": session_id, "timestamp": f"2024-01-01T00:{n:02d}:00+00:00", **more}


def user(n, content, **more):
    return rec("user", n, message={"role": "user", "content": content}, **more)


def agent(n, *blocks, **more):
    return rec("assistant", n, message={"role": "assistant", "model": "x-opus-1", "content": list(blocks), "usage": {"input_tokens": 10, "output_tokens": 2}}, **more)


def use(i, name, **args):
    return {"type": "tool_use", "id": i, "name": name, "input": args}


def done(i, content="ok", error=False):
    return {"type": "tool_result", "tool_use_id": i, "content": content, "is_error": error}


DENIED = f"{markers.DENIAL}. {markers.USER_SAID}use tabs\n{markers.USER_SAID_END} ..."
MAIN = [
    agent(0, {"type": "text", "text": "hello"}, {"type": "thinking", "thinking": "hm"}),
    user(1, "please fix it", isMeta=0),
    agent(2, {"type": "text", "text": "on it"}, use("a", "Edit", file_path="/r/a.py", old_string="x", new_string="y"), use("b", "Bash", command="ls -l"), use("p", "mcp__db__get_rows")),
    user(3, [done("a"), done("b", [{"type": "text", "text": "o"}, {"type": "text", "text": "k"}], True), done("zz")]),
    user(4, "[Request interrupted by user]"),
    user(5, "maybe you might not do that", isSidechain=""),
    user(6, "<teammate-message id=1>relay"),
    user(7, "    "),
    user(8, "meta", isMeta="yes"),
    agent(9, use("c", "Write", file_path="/r/b.md", content="q"), use("a", "Read", file_path="/r/a.py")),
    user(10, [done("c", DENIED, 1), done("a", "late")]),
    {"type": "mode", "mode": "plan"},
    user(12, "ok"),
    {"type": "queue-operation", "operation": "enqueue", "content": "x"},
    rec("system", 14, subtype="info", content="note"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("sessions")
    (at / "sub").mkdir()
    (at / "main.jsonl").write_text("\n".join([*map(json.dumps, MAIN), "", "{broken", "[1]", '"text"']) + "\n")
    (at / "sub" / "bad.jsonl").write_text(json.dumps(user(1, "fine", session_id="t")) + "\n" + json.dumps({"type": "user", "sessionId": "t", "message": {"content": "x"}}) + "\n")
    (at / "sub" / "notes.txt").write_text("no transcript")
    return at


@pytest.fixture(scope="module")
def turned(spark, folder):
    return session.with_turns(read_sessions(spark, str(folder))).cache()


def test_lines_that_are_skipped_and_files_that_fail(spark, folder, turned):
    got = turned.orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(15)) and {r.path.rpartition("/")[2] for r in got} == {"main.jsonl"}
    assert [(r.path.rpartition("/")[2], r.idx, r.problem) for r in invalid_files(read_lines(spark, str(folder))).collect()] == [("bad.jsonl", 1, "no uuid, session or time")]
    assert [r.kind for r in got][-4:] == ["mode", "user", "other", "system"] and got[14].text == "note" and got[13].detail == "enqueue"
    assert got[0].thinking == "hm" and got[8].is_meta and not got[1].is_meta and not got[5].is_sidechain
    assert got[3].results[1].content == "ok" and got[3].results[1].is_error and got[10].results[0].denial_kind == "user-rejected"
    files = listed(spark, str(folder))
    assert files.count() == 2 and changed_since(files, files.select("path", "mtime")).count() == 0
    assert {r.session for r in newest_of(files).collect()} == {"main", "bad"}


def test_turns_and_calls(turned):
    assert [r.turn for r in turned.orderBy("idx").collect()] == [0, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 3, 3]
    t = {r.turn: r for r in session.turns(turned).collect()}
    assert [t[k].prompt for k in range(4)] == ["", "please fix it", "maybe you might not do that", "ok"] and t[1].n_calls == 3
    c = {(r.call_id, r.idx): r for r in session.calls(turned).collect()}
    assert c["a", 2].result.content == "late" == c["a", 9].result.content and c["b", 2].is_error and c["p", 2].pending and c["c", 9].hunks[0].new == "q"
    assert c["b", 2].latency_ms == 60_000 and c["b", 2].command == "ls -l" and c["a", 2].file_path == "/r/a.py"
    got = session.predicates(session.calls(turned), {"edit": session.named("Edit") & session.touches("*.py"), "failed": session.named("Bash"), "mcp": session.named("get_rows"), "md": session.touches("[!a].md")}).first()
    assert (got.edit, got.failed, got.mcp, got.md) == (True, False, True, False)  # b.md's write was denied
    assert session.errors_of_earlier_calls(turned).collect()[0]["errors"] == 1
    assert session.activity(turned).first().mid_tool is False


def test_filters(turned):
    kept = spec.keep(turned, spec.SIGNAL).orderBy("idx")
    assert [r.idx for r in kept.collect()] == [0, 1, 2, 4, 5, 8, 9, 12]
    only = spec.keep(turned, [spec.Rule("text_in_set", {"phrases": ("ok",), "strip": "."}, applies_to=("user",), negate=True), spec.keep_only("user")])
    assert [r.idx for r in only.collect()] == [12]
    tags = spec.annotate(turned, [spec.Rule("words_at_most", 1, "tag", ("user",), label="short"), spec.Rule("kind_is", ("user",), "tag", ("assistant",), True, "agent")])
    assert {r.idx: r.labels for r in tags.collect()}[0] == ["agent"] and {r.idx: r.labels for r in tags.collect()}[12] == ["short"]
    with pytest.raises(ValueError):
        spec.Rule("meta_flag", "no_flag").column()


def test_mining(turned):
    found = {(r.detector, r.idx): r for r in mining.mine(turned).collect()}
    said = found["message", 5]
    assert said.confidence == 0.5 and said.reasons == ["user_message"] and found["message", 6].reasons == ["structural_only"] and found["message", 6].confidence == 0
    assert found["message", 12].reasons == ["user_message", "short_followup"] and ("message", 4) not in found and ("message", 7) not in found
    assert found["denial", 10].text == "use tabs" and found["denial", 10].trigger_idx == 9 and found["denial", 10].reasons == ["denied"]
    cut = found["interrupt", 4]
    assert cut.text == "maybe you might not do that" and cut.confidence == 0.5 and cut.reasons == ["interrupted", "substantive", "hedged"]
    assert found["plan_reentry", 12].trigger_idx == 9


def test_search_with_context_and_caps(turned):
    got = session.grep(turned, {"fix": "fix", "tab": "use tabs"}, context=1).orderBy("idx").collect()
    assert [(r.idx, r.hits) for r in got] == [(0, []), (1, ["fix"]), (2, []), (9, []), (10, ["tab"]), (11, [])]
    assert [r.idx for r in session.grep(turned, {"o": "o"}, cap=2, facets=("text",)).orderBy("idx").collect()] == [0, 2]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.truncate(F.lit(" a  b c "), 4).alias("t"), scalars.clip(F.lit("abcdef"), 4).alias("c"), scalars.human_size(F.lit(1280)).alias("h"), scalars.overlap(F.lit("a\n b  c\n\nd"), F.lit("b c\rd")).alias("o"),
        scalars.cost(F.lit("x-opus-2"), F.lit(1_000_000), F.lit(0), F.lit(0), F.lit(0), F.lit(1_000_000)).alias("usd"), markers.mcp_access(F.lit("bulk_get_x")).alias("m"), markers.is_bare_interrupt(F.lit(" [Request interrupted by user for tool use] ")).alias("b"),
    ).first()
    assert (row.t, row.c, row.h, round(row.o, 4), row.usd, row.m, row.b) == ("a b…", "abcd…(+2ch)", "1.2KB", 0.6667, 15.0, "read", True)
    assert [bool(__import__("re").search(session.glob_regex(g).replace(r"\z", r"\Z"), p)) for g, p in (("*.py", "/a/b.py"), ("a?c", "abc"), ("[!a]*", "bc"), ("a.c", "abc"))] == [True, True, True, False]
    assert abs(ledger.upper_bound(0, 100) - (1 - 0.05 ** 0.01)) < 1e-9 and ledger.upper_bound(3, 3) == 1.0


def test_streams_equal_batches(spark, tmp_path):
    first, second = MAIN[:3], MAIN[2:]  # the event in both comes once
    put = tmp_path / "in"
    put.mkdir()
    (put / "1.jsonl").write_text("\n".join(map(json.dumps, first)) + "\n")

    def run():
        stream = tail.once(tail.stream_events(spark, str(put)).where("kind in ('user', 'assistant')"))
        rows = []
        stream.writeStream.foreachBatch(lambda b, n: rows.extend(b.select("uuid").collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return [r.uuid for r in rows]

    assert sorted(run()) == ["s0", "s1", "s2"]
    (put / "2.jsonl").write_text("\n".join(map(json.dumps, second)) + "\n")
    assert sorted(run()) == sorted(r["uuid"] for r in MAIN[3:] if r["type"] in ("user", "assistant"))
    calls = tail.to_table(tail.calls_with_results(tail.stream_events(spark, str(put), max_files=1)), ["path", "call_id"], str(tmp_path / "calls"), str(tmp_path / "calls-state"))
    got = {r.call_id: (r.name, r.content, r.pending) for r in calls.collect()}
    assert got["b"] == ("Bash", "ok", False) and got["p"][2] and got["a"] == ("Read", "late", False)
