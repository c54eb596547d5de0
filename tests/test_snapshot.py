"""Scores around a model, and questions about sessions, on small logs."""

from pyspark.sql import functions as F

from lorekeep.operators import sentiment, session, snapshot, stats
from lorekeep.sources.sessions import events
from tests.test_sessions import agent, done, rec, use, user
from tests.test_trees import lines


def test_negation_stays_in_its_clause(spark):
    cases = {"It isn't great, but fine": ["great"], "never good or bad": ["good"], "not not good": ["good"], "no\ngood": [], "can’t work; works": ["work"], "": [], "GREAT": []}
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: [x.token for x in r.k if x.negated] for r in frame.select("t", sentiment.tokens(F.col("t")).alias("k")).collect()}
    assert got == cases
    row = frame.where("t like 'can%'").select(sentiment.tokens(F.col("t")).alias("k")).first()
    assert [x.token for x in row.k] == ["ca", "n't", "work", ";", "works"]


def test_stages_before_and_behind_the_model(spark):
    lexicon = spark.createDataFrame([("great", 3), ("cool", 1), ("awful", -3), ("fine", 2), ("great", 3)], "word string, score int")
    words = sentiment.polarities(lexicon, spark.createDataFrame([("stop", -3), ("fine", 3)], "word string, score int"))
    assert {r.word: r.score for r in words.collect()} == {"great": 3, "awful": -3, "stop": -3, "fine": 3}
    rows = [(1, ["wtf is this"]), (2, ["ok cool"]), (3, ["that is great", "thanks a lot for all of it"]), (4, ["isn't great"]), (5, ["please stop"]), (6, ["hmm, again"]), (7, ["hmm, awful"]), (8, ["Go ahead!"]), (9, []), (10, [None, "hmm not awful"]), (11, None)]
    stages = [sentiment.Frustration(r"(?i)\bwtf\b", 1), sentiment.PositiveClamp(5, 3, 4), sentiment.MildIrritation(r"(?i)\bhmm\b", r"(?i)idiot", 2, 3), sentiment.Resume(("go ahead",), 4)]
    raw = {1: 9, 2: 5, 3: 5, 4: 5, 5: 2, 6: 2, 7: 2, 8: 1, 9: 5, 10: 2, 11: 5}
    frame = spark.createDataFrame([(k, t, raw[k]) for k, t in rows], "key int, texts array<string>, guess int")
    got = {r.key: (r.short, r.raw, r.score) for r in sentiment.scored(frame, words, F.col("guess"), stages).collect()}
    assert got == {1: (1, None, 1), 2: (None, 5, 3), 3: (None, 5, 5), 4: (None, 5, 3), 5: (None, 2, 2), 6: (None, 2, 3), 7: (None, 2, 2), 8: (None, 1, 4), 9: (None, 5, 5), 10: (None, 2, 3), 11: (None, 5, 5)}


LOG = {
    "a": [user(0, "first ask"), agent(1, use("e", "Edit", file_path="/r/src/a.py", old_string="x", new_string="y"), use("k", "Skill", skill="kit:lint"), use("b", "Bash", command="git  push origin"), {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "done"}), user(2, [done("e"), done("k")]), user(3, "OVERRIDE it"), user(4, "aside", isMeta=True), agent(5, use("w", "Write", file_path="/r/tests/x.py", content="c"), use("b", "Read", file_path="/r/doc.md"), use("p", "Monitor")), user(6, [done("w", error=True)]), rec("attachment", 7, attachment={"type": "queued_command", "prompt": "ping", "origin": {"kind": "channel"}})],
    "b": [user(0, "/go", isSidechain=True), agent(1, use("", "Bash", command="ls"), use("x", "Bash", command="ls"), {"type": "text", "text": "bye"})],
    "c": [agent(0, {"type": "text", "text": "alone"})],
}


def test_questions_about_sessions(spark):
    turned = session.with_turns(events(lines(spark, LOG))).cache()
    e = {r.path: r for r in snapshot.event_facts(turned, "/go", first=1).collect()}
    assert [(e[p].event_count, e[p].turn_count, e[p].user_messages, e[p].assistant_messages, e[p].has_users, e[p].all_sidechain, e[p].prefixed) for p in "abc"] == [(8, 2, 5, 2, True, False, False), (2, 1, 1, 1, True, True, True), (1, 1, 0, 1, False, False, False)]
    assert e["a"].prompts == ["first ask", "OVERRIDE it"] and e["a"].first_prompt == "first ask" and e["c"].last_prompt is None and e["a"].workflow_text == "first ask\ndone\nOVERRIDE it\naside"
    calls = session.calls(turned)
    tests = {"source": snapshot.is_source("/r", (".md",)) & session.named("Edit|Write"), "docs": snapshot.is_source("/r", prefixes=("src/",)), "push": snapshot.runs("git", "push"), "ls": snapshot.runs("ls"), "read": session.named("Read") & session.touches("*.md")}
    f = {r.path: r for r in snapshot.call_facts(calls, tests, pending="Monitor", skills=("lint",)).collect()}
    a, b = f["a"], f["b"]
    assert (a.has_edit, a.has_error, a.failures, a.has_skill, a.has_skill_suffix, a.has_pending, a.unresolved) == (True, True, 1, False, True, True, 1)
    assert a.files == ["/r/src/a.py", "/r/doc.md"] and a.edited == ["/r/src/a.py"] and (a.source, a.docs, a.push, a.ls, a.read) == (True, True, True, False, True)
    assert (b.has_edit, b.has_error, b.ls, b.files) == (False, False, True, [])
    assert {r.path: r.has_override for r in snapshot.overrides(turned, calls, "OVERRIDE", "Edit|Write").collect()} == {"a": True, "b": False, "c": False}  # the later write failed
    assert {r.path: r.has_override for r in snapshot.overrides(turned, calls, "OVERRIDE", "Read").collect()}["a"] is False
    w = sorted((r.path, r.first, r["name"], r.idx) for r in snapshot.winners(calls).collect())
    assert w == [("a", 0, "Edit", 1), ("a", 1, "Skill", 1), ("a", 2, "Read", 5), ("a", 3, "Write", 5), ("a", 5, "Monitor", 5), ("b", 0, "Bash", 1), ("b", 1, "Bash", 1)]
    texts = lambda *args: sorted((r.path, r.text) for r in snapshot.signal_texts(turned, *args).collect())
    assert texts(1) == [("a", "done"), ("b", "bye"), ("c", "alone")] and ("a", "hm") in texts(2, "assistant", True) and texts(None, "any") == [("a", "OVERRIDE it"), ("a", "aside"), ("b", "/go"), ("b", "bye"), ("c", "alone")]
    assert [(r.path, r.turn, r.text) for r in snapshot.meta_messages(turned).orderBy("idx").collect()] == [("a", 1, "aside"), ("a", 1, "ping")] and snapshot.meta_messages(turned, "ping").count() == 1
    assert sorted((r.path, r["at"]) for r in stats.error_events(turned).collect()) == [("a", 6)]
    assert [(r.idx, r.hidden) for r in stats.page(turned.where("path = 'a'").select("path", "idx"), ["idx"], first=2).orderBy("idx").collect()] == [(0, 6), (1, 6)]
    assert [r.idx for r in stats.page(turned.where("path = 'a'").select("path", "idx"), ["idx"], span=(2, 4)).orderBy("idx").collect()] == [2, 3]
