"""Walks over graphs with cycles, queues of notifications, and rollouts, each against a plain version."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import deep, notices, session
from lorekeep.sources import rollouts
from lorekeep.sources.sessions import events
from tests.test_sessions import agent, done, use, user


def lines(spark, files):
    rows = [(p, k, x if isinstance(x, str) else json.dumps(x)) for p, recs in files.items() for k, x in enumerate(recs)]
    return spark.createDataFrame(rows, "path string, idx int, line string")


def depth_first(children, root):
    """Each node that a recursive walk meets, with the way there."""
    seen, out = {root}, {}

    def go(node, way):
        for child in sorted(children.get(node, ())):
            if child not in seen:
                seen.add(child)
                out[child] = [*way, child]
                go(child, out[child])

    go(root, [])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_walks_over_cycles_equal_recursion(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)] + [("n3", "n3"), ("n1", "n2"), ("n1", "n2"), (None, "n1"), ("n1", None)]
    children = {}
    for a, b in edges:
        if a and b:
            children.setdefault(a, set()).add(b)
    frame, roots = spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([("n1",), ("n5",), ("lone",)], "node string")
    got = {}
    for r in deep.walk(frame, roots).collect():
        got.setdefault(r.root, {})[r.node] = r.way
        assert r.depth == len(r.way)
    assert got == {k: v for k in ("n1", "n5", "lone") if (v := depth_first(children, k))}
    near = {(r.root, r.node): r.depth for r in deep.reachable(frame, roots).collect()}
    for root in ("n1", "n5", "lone"):
        want, front, k = {root: 0}, {root}, 0
        while front:
            k += 1
            front = {c for n in front for c in children.get(n, ())} - want.keys()
            want |= dict.fromkeys(front, k)
        assert {n: v for (r, n), v in near.items() if r == root} == want


def test_four_nodes_that_all_lead_to_each_other_end(spark):
    edges = spark.createDataFrame([(a, b) for a in "abcd" for b in "abcd"], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in deep.reachable(edges, roots).collect()} == {"a": 0, "b": 1, "c": 1, "d": 1}
    assert {r.node: r.way for r in deep.walk(edges, roots).collect()} == {"b": ["b"], "c": ["b", "c"], "d": ["b", "c", "d"]}
    assert deep.reachable(edges, roots, depth=0).count() == 1
    assert deep.reachable(edges.where("false"), roots.where("false")).count() == 0 == deep.walk(edges.where("false"), roots.where("false")).count()


def test_sidechains_calls_and_whole_trees(spark):
    names = ["/s/a.jsonl", "/s/a/subagents/agent-t1.jsonl", "/s/a/subagents/agent-t1/subagents/agent-t2.jsonl", "/s/a/subagents/._agent-t9.jsonl", "/s/b.jsonl"]
    edges = deep.sidechains(spark.createDataFrame([(n,) for n in names], "path string"))
    assert sorted(tuple(r) for r in edges.collect()) == [(names[0], names[1], "t1"), (names[1], names[2], "t2")]
    log = lines(spark, {names[0]: [user(0, "go"), agent(1, use("t1", "Task", subagent_type="x"), use("e", "Edit", file_path="/a.py", old_string="x", new_string="y"))], names[1]: [user(0, "sub", isSidechain=True), agent(1, use("t2", "Task"), use("q", "Bash", command="ls"))], names[2]: [agent(1, use("s", "Skill", skill="lint")), user(2, [done("s", error=True)])], names[4]: [user(0, "other")]})
    turned = session.with_turns(events(log))
    roots = spark.createDataFrame([(names[0],)], "node string")
    calls = session.calls(turned)
    assert {(r.call_id, r.child) for r in deep.dispatched(calls, edges).collect()} == {("t1", names[1]), ("e", None), ("t2", names[2]), ("q", None), ("s", None)}
    seen = deep.view(calls, deep.walk(edges, roots, order="spawned_by"), roots)
    r = deep.inputs(seen, ["root"]).first()
    assert r.names == ["Task", "Edit", "Task", "Bash"] and r.files == ["/a.py"] == r.edited and r.commands == ["ls"] and r.skills == []  # the skill failed


NOTE = "<task-notification>done <tool-use-id>{}</tool-use-id></task-notification>"


def op(kind, content=None):
    return {"type": "queue-operation", "operation": kind, **({} if content is None else {"content": content})}


def plain_queue(steps):
    queue, came = [], []
    for s in steps:
        content = s.get("content", "")
        if s["operation"] == "enqueue":
            queue.append(content)
            came.append(content)
        elif s["operation"] in ("dequeue", "remove"):
            queue = queue[1:]
        elif s["operation"] == "popAll":
            queue = [q for q in queue if q not in content]
    return queue, came


def test_queues_equal_a_plain_replay(spark):
    rng = random.Random(5)
    files = {}
    for k in range(20):
        steps = [op(rng.choice(["enqueue", "enqueue", "dequeue", "remove", "popAll", "peek"]), rng.choice(["", "a", "b", NOTE.format("x"), "a b", "a " + NOTE.format("x")])) for _ in range(rng.randrange(30))]
        files[f"p{k}"] = [*steps, op("dequeue"), op("enqueue")]
    got = {r.path: (r.queued, r.enqueued) for r in notices.queues(events(lines(spark, files))).collect()}
    assert got == {p: plain_queue(s) for p, s in files.items()}


def test_what_a_session_waits_for(spark):
    launched = lambda i: [agent(1, use(i, "Task", subagent_type="x")), {**user(2, [done(i)]), "toolUseResult": {"isAsync": True}}]
    prompt = [user(0, "go")]
    files = {
        "async": prompt + launched("a") + [user(3, "next")],
        "queued": prompt + launched("a") + [op("enqueue", NOTE.format("a")), user(3, "next")],
        "taken": prompt + launched("a") + [op("enqueue", NOTE.format("a")), op("dequeue"), user(3, "next")],
        "told": prompt + launched("a") + [user(3, NOTE.format("a")), user(4, "next")],
        "command": prompt + launched("a") + [{**user(3, ""), "type": "attachment", "attachment": {"type": "queued_command", "prompt": NOTE.format("a")}}],
        "flow": prompt + [agent(1, use("w", "Workflow")), user(2, [done("w")]), user(3, "next")],
        "back": prompt + [agent(1, use("b", "Bash", run_in_background=True)), user(2, [done("b")])],
        "bare": prompt + [agent(1, use("t", "Agent")), user(2, [done("t")])],
        "ask": prompt + [agent(1, use("q", "AskUserQuestion"))],
        "mid": prompt + [agent(1, use("m", "Read"), use("n", "Monitor"), use("m", "Read"))],
        "old": prompt + [agent(1, use("m", "Read")), user(2, "next")],
        "failed": prompt + [agent(1, use("t", "Agent")), user(2, [done("t", error=True)])],
    }
    got = {r.path: (r.is_waiting, r.mid_tool, [(p.call_id, p.why) for p in r.pending]) for r in session.activity(session.with_turns(events(lines(spark, files)))).collect()}
    assert got == {
        "async": (True, False, [("a", "pending_async_task")]), "queued": (True, False, [("a", "pending_async_task")]), "taken": (False, False, []), "told": (False, False, []), "command": (False, False, []),
        "flow": (True, False, [("w", "pending_async_workflow")]), "back": (True, False, [("b", "background")]), "bare": (True, False, [("t", "subagentless_task")]), "ask": (False, False, []),
        "mid": (True, True, [("m", "mid_tool"), ("n", "waiting_tool")]), "old": (False, False, []), "failed": (False, False, []),
    }


def item(kind, payload, second=1):
    return {"timestamp": f"2026-01-01T00:00:{second:02d}Z", "type": kind, "payload": payload}


def say(role, *texts, **more):
    return item("response_item", {"type": "message", "role": role, "content": [{"type": "text", "text": t} for t in texts], **more})


ROLLOUT = [
    item("session_meta", {"id": "", "cwd": "/no"}), item("session_meta", {"id": "th", "cwd": "/home", "parent_thread_id": "up"}),
    say("user", " \n<environment_context>x</environment_context>"), say("user", "fix", "it", id="m1"), item("event_msg", {"type": "user_message", "message": "fix\nit"}), item("event_msg", {"type": "user_message", "message": "new words"}),
    item("turn_context", {"cwd": "/w", "model": "g1"}), item("response_item", {"type": "reasoning", "summary": [{"text": "hm"}]}), item("response_item", {"type": "reasoning", "summary": [{"text": " "}]}),
    item("response_item", {"type": "function_call", "name": "exec_command", "arguments": '{"cmd":"ls"}', "call_id": "c1"}), item("response_item", {"type": "function_call_output", "call_id": "c1", "output": '{"output":"no","metadata":{"exit_code":2}}'}),
    item("response_item", {"type": "function_call", "name": "get", "namespace": "srv", "arguments": "{}", "call_id": "c2"}), item("response_item", {"type": "function_call_output", "call_id": "c2", "output": [{"text": "a"}, {"text": "b"}, {"x": 1}]}),
    item("response_item", {"type": "custom_tool_call", "name": "apply_patch", "input": "*** Begin", "call_id": "c3"}), item("response_item", {"type": "custom_tool_call_output", "call_id": "c3", "output": {"output": "ok", "metadata": {"exit_code": 0}}}),
    item("response_item", {"type": "function_call_output", "call_id": "c4", "output": None}), item("response_item", {"type": "function_call", "name": "x"}), say("developer", "rules"), say("assistant", "done"), item("event_msg", {"type": "agent_message", "message": "done"}), item("event_msg", {"type": "agent_message", "message": "also"}),
    item("inter_agent_communication_metadata", {"trigger_turn": True}), item("response_item", {"type": "agent_message", "content": [{"text": "from a peer"}]}), item("response_item", {"type": "agent_message", "content": [{"text": "aside"}]}),
    item("compacted", {"message": "short"}), item("event_msg", {"type": "turn_aborted", "turn_id": "t1", "reason": "interrupted"}), "{broken", {"type": "odd", "payload": {}, "timestamp": "2026-01-01T00:00:01Z"}, {**say("user", "no time"), "timestamp": "?"},
    item("event_msg", {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 5, "total_tokens": 9}, "model_context_window": 100}}), item("event_msg", {"type": "token_count", "info": None}), item("event_msg", {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 7}}}),
    {**say("user", "content is text"), "payload": {"type": "message", "role": "user", "content": "plain"}},
]


def test_items_become_events(spark):
    e = {r.idx: r for r in rollouts.events(lines(spark, {"r": ROLLOUT})).collect()}
    assert len(e) == len(ROLLOUT)
    kinds = {k: (r.kind, r.text if r.kind != "other" else r.detail) for k, r in e.items()}
    assert kinds == {
        0: ("other", "session_meta"), 1: ("other", "session_meta"), 2: ("user", " \n<environment_context>x</environment_context>"), 3: ("user", "fix\nit"), 4: ("other", "user_message"), 5: ("user", "new words"), 6: ("other", "turn_context"),
        7: ("assistant", ""), 8: ("other", "reasoning"), 9: ("assistant", ""), 10: ("user", ""), 11: ("assistant", ""), 12: ("user", ""), 13: ("assistant", ""), 14: ("user", ""), 15: ("other", "function_call_output"), 16: ("other", "function_call"),
        17: ("user", "rules"), 18: ("assistant", "done"), 19: ("other", "agent_message"), 20: ("assistant", "also"), 21: ("other", "inter_agent_communication_metadata"), 22: ("user", "from a peer"), 23: ("user", "aside"), 24: ("user", "short"), 25: ("user", ""),
        26: ("other", "other"), 27: ("other", "odd"), 28: ("other", "message"), 29: ("other", "token_count"), 30: ("other", "token_count"), 31: ("other", "token_count"), 32: ("other", "message"),
    }
    assert [k for k, r in e.items() if r.is_meta] == [2, 17, 23] and e[24].is_compact_summary and e[7].thinking == "hm"
    assert (e[3].cwd, e[7].cwd, e[9].model, e[18].model, e[3].model) == ("/home", "/w", "g1", "g1", None)
    assert (e[9].calls[0]["name"], e[11].calls[0]["name"], e[13].calls[0].input) == ("exec_command", "mcp__srv__get", "*** Begin")
    assert [(e[k].results[0].content, e[k].results[0].is_error) for k in (10, 12, 14)] == [("no", True), ("a\nb", False), ("ok", False)]
    digest = hashlib.sha256(b"rollout:th:m1").digest()[:16]
    b = bytearray(digest)
    b[6], b[8] = b[6] & 15 | 128, b[8] & 63 | 128
    assert e[3].uuid.replace("-", "") == b.hex() and e[3].session_id == "th" and len({r.uuid for r in e.values() if r.uuid}) == sum(r.kind != "other" for r in e.values())
    turned = session.with_turns(rollouts.events(lines(spark, {"r": ROLLOUT})))
    assert session.calls(turned).where("call_id = 'c1'").select("command", "is_error").first() == ("ls", True)
    u = rollouts.usage(lines(spark, {"r": ROLLOUT})).first()
    assert (u.input_tokens, u.total_tokens, u.context_window, u.counts) == (7, None, 100, 3)
    kids = rollouts.children(lines(spark, {"r": ROLLOUT, "p": [item("session_meta", {"id": "up"})]}))
    assert [tuple(r) for r in kids.collect()] == [("p", "r")]
    both = rollouts.either(lines(spark, {"r": ROLLOUT, "s": [user(0, "hi")], "t": [item("session_meta", {"id": "x"})], "u": ["", '{"type":"event_msg"}', user(1, "yo")]}))
    assert {(r.path, r.rollout) for r in both.select("path", "rollout").distinct().collect()} == {("r", True), ("s", False), ("t", True), ("u", False)}


def mark(kind, turn=None, **more):
    return item("event_msg", {"type": kind, **({"turn_id": turn} if turn else {}), **more})


def call(i, turn=None, name="f"):
    return item("response_item", {"type": "function_call", "name": name, "arguments": "{}", "call_id": i, **({"internal_chat_message_metadata_passthrough": {"turn_id": turn}} if turn else {})})


def answer(i):
    return item("response_item", {"type": "function_call_output", "call_id": i, "output": "x"})


LIVES = {
    "open": ([mark("task_started", "a"), call("1"), answer("1"), call("2", name="wait")], ("open", "a", None, ["2"], True)),
    "closed": ([mark("task_started", "a"), call("1"), mark("task_complete", "a")], ("completed", "a", None, [], False)),
    "aborted": ([mark("task_started"), call("1"), mark("turn_aborted", reason="stop")], ("aborted", None, "stop", [], False)),
    "again": ([mark("task_started", "a"), mark("task_complete", "a"), call("0", "a"), mark("task_started", "a"), call("1", "a")], ("open", "a", None, ["0", "1"], False)),
    "two": ([mark("task_started", "a"), mark("task_started", "b"), mark("task_complete"), call("1", "a"), call("2", "b"), call("3")], ("uninstrumented", None, None, ["1", "3"], False)),
    "loose": ([mark("task_started", "a"), mark("task_complete", "a"), call("9"), say("user", "more")], ("uninstrumented", None, None, ["9"], False)),
    "none": ([say("user", "x"), call("1")], ("uninstrumented", None, None, ["1"], False)),
    "blank": ([item("session_meta", {"id": "x"})], ("uninitialized", None, None, [], False)),
    "unknown": ([mark("task_complete", "z"), mark("task_started", "a"), call("1", "q"), call("2")], ("open", "a", None, ["2"], False)),
}


def test_lives_of_turns(spark):
    got = {r.path: (r.state, r.turn_id, r.reason, [p.call_id for p in r.pending], r.is_waiting) for r in rollouts.lifecycle(lines(spark, {k: v[0] for k, v in LIVES.items()})).collect()}
    assert got == {k: v[1] for k, v in LIVES.items()}
    assert rollouts.lifecycle(lines(spark, LIVES and {"a": ["x"]}).where(F.lit(False))).count() == 0
