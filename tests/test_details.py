"""Typed details of records, and sinks."""

import json

from lorekeep.sources import details, sinks
from lorekeep.sources.sessions import events
from tests.test_sessions import agent, rec, use, user
from tests.test_trees import lines

LOG = [
    rec("system", 0, subtype="stop_hook_summary", hookCount=2, hookInfos=[{"command": "a", "durationMs": 5}, {"x": 1}, {"command": "b"}], hookErrors=["e", "f"], preventedContinuation=1, toolUseID=""),
    rec("system", 1, subtype="compact_boundary", compactMetadata={"trigger": "auto", "preTokens": 10, "precomputed": True, "preCompactDiscoveredTools": ["t"]}, logicalParentUuid="p"),
    rec("system", 2, subtype="turn_duration", durationMs=7, messageCount="no"), rec("system", 3, subtype="odd", durationMs=1),
    rec("attachment", 4, attachment={"type": "hook_success", "hookName": "n", "exitCode": 0, "durationMs": 3, "toolUseID": "t"}), rec("attachment", 5, attachment={"type": "queued_command", "prompt": "p", "origin": {"kind": "channel"}}),
    rec("attachment", 6, attachment={"type": "deferred_tools_delta", "addedNames": ["x", "y"]}), rec("attachment", 7, attachment={"type": "hook_blocking_error", "blockingError": {"k": 1}}), user(8, "two  words\nhere"), agent(9, use("c", "Bash", command="ls")),
]


def test_details_of_records(spark):
    e = events(lines(spark, {"p": LOG})).cache()
    r = details.system(e, "stop_hook_summary").first()
    assert (r.hook_count, r.hook_errors, r.prevented_continuation, r.has_output, r.tool_use_id, r.stop_reason) == (2, ["e", "f"], True, False, None, None)
    assert [(h.command, h.duration_ms) for h in details.hooks_of(e).collect()] == [("a", 5), ("b", None)]
    r = details.system(e, "compact_boundary").first()
    assert (r.trigger, r.pre_tokens, r.post_tokens, r.precomputed, r.pre_compact_discovered_tools, r.logical_parent_uuid) == ("auto", 10, None, True, ["t"], "p")
    assert [(r.idx, r.duration_ms, r.message_count) for r in details.system(e, "turn_duration").collect()] == [(2, 7, None)]
    r = details.attachment(e, "hook_success").first()
    assert (r.hook_name, r.exit_code, r.duration_ms, r.tool_use_id, r.stdout) == ("n", 0, 3, "t", None)
    assert details.attachment(e, "queued_command").select("prompt", "origin").first() == ("p", "channel")
    assert details.attachment(e, "deferred_tools_delta").first().added_names == ["x", "y"] and json.loads(details.attachment(e, "hook_blocking_error").first().blocking_error) == {"k": 1}
    for name in details.SYSTEM:
        assert len({*(c := details.system(e, name).columns)}) == len(c)
    for name in details.ATTACHMENT:
        assert len({*(c := details.attachment(e, name).columns)}) == len(c)


def test_sinks(spark, tmp_path):
    e = events(lines(spark, {"p": LOG}))
    shown = {r.idx: r.line for r in e.select("idx", sinks.line_of(8).alias("line")).collect()}
    assert shown[8] == "#8 user 2024-01-01T00:08:00 two wor…" and shown[9].endswith("assistant 2024-01-01T00:09:00 [Bash]")
    assert json.loads(sinks.as_json(e.where("idx = 8").select("path", "idx", "model")).first().value) == {"path": "p", "idx": 8}
    rows = [("b", 0, "x"), ("a", 1, "y"), ("a", 0, "x"), ("a", 2, "y"), ("c", 0, "z")]
    sinks.write_extract(spark.createDataFrame(rows, "path string, idx int, line string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["x", "y", "z"]
