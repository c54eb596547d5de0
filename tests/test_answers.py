"""Answered questions and review comments against plain versions."""

import json

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import mining, questions, review, session
from lorekeep.sources.sessions import events
from tests.test_sessions import agent, done, use, user
from tests.test_trees import lines

BANNER = questions.ANSWERED + "{}" + questions.ANSWERED_END


def ask(i, *qs):
    return use(i, "AskUserQuestion", questions=[{"question": q, "header": "H", "multiSelect": len(labels) > 2, "options": [{"label": x} for x in labels] + [{"x": 1}]} for q, labels in qs] + [{"header": "no text"}])


TWO = (("Which?", ["A", "B, or so", "C (Recommended)"]), ("Why, so?", ["x"]), ("Last?", []))
CASES = {
    '"Which?"="A", "Why, so?"="because, ""no""", "Last?"="1"': [("Which?", "A", None, None), ("Why, so?", 'because, ""no""', None, None), ("Last?", "1", None, None)],
    '"Which?"="A, C (Recommended)" selected preview:\ncode notes: use it': [("Which?", "A, C (Recommended)", "code", "use it")],
    '"Which?"="B, or so" notes: ok, "Last?"=(no option selected) notes: none fits': [("Which?", "B, or so", None, "ok"), ("Last?", None, None, "none fits")],
    '"Last?"="z", "Which?"="A"': [("Which?", "A", None, None)],
    'x"Which?"="A", "Last?"="2) or"': [("Last?", "2) or", None, None)],
    '"Which?"=A, "Last?"="q"': [("Last?", "q", None, None)],
    "": [],
}


def test_banners(spark):
    bodies = list(CASES)
    frame = spark.createDataFrame([(b, json.dumps(ask("i", *TWO)["input"])) for b in bodies], "body string, input string")
    content = F.concat(F.lit(questions.ANSWERED), "body", F.lit(questions.ANSWERED_END))
    got = frame.select("body", questions.from_banner(content, questions.asked(F.col("input"))).alias("p")).collect()
    assert {r.body: [(p.question, p.answer, p.preview, p.notes) for p in r.p] for r in got} == CASES
    assert frame.select(questions.from_banner(F.col("body"), questions.asked(F.col("input"))).alias("p")).where("size(p) > 0").count() == 0
    assert spark.range(1).select(questions.asked(F.lit('{"questions": 5}')).alias("a"), questions.asked(F.lit("x")).alias("b")).first() == (None, None)


def plain_pick(answer, labels):
    out, start, held = [], 0, None
    for part in answer.split(", "):
        held = part if held is None else f"{held}, {part}"
        at = next((i for i in range(start, len(labels)) if labels[i] == held), None)
        if at is not None:
            out, start, held = [*out, labels[at]], at + 1, None
    if out and held is None:
        return out, True
    digits = answer[: len(answer) - len(answer.lstrip("0123456789"))]
    rest = answer[len(digits) :]
    if digits and 1 <= int(digits) <= len(labels) and (not rest or rest[0] in ",. )"):
        return [labels[int(digits) - 1]], not rest
    return [], False


def test_picks(spark):
    labels = ["A", "B, or so", "C", "A"]
    answers = ["A", "B, or so", "A, C", "C, A", "C, B, or so", "A, A", "2", "2) yes", "2x", "0", "9", "99999999999999", "", "A, ", "free words", "B", "3, and more"]
    frame = spark.createDataFrame([(a, labels) for a in answers] + [(None, labels)], "a string, l array<string>")
    got = frame.select("a", questions.picked(F.col("a"), F.col("l")).alias("p")).collect()
    assert [(r.a, (r.p.labels, r.p.whole)) for r in got] == [(a, plain_pick(a, labels)) for a in answers] + [(None, ([], False))]


FILES = {
    "q": [agent(0, ask("i", *TWO)), user(1, [done("i", BANNER.format('"Which?"="A", "Why, so?"="because I think so"'))]),
          agent(2, ask("j", *TWO)), {**user(3, [done("j", "anything")]), "toolUseResult": {"answers": {"Which?": "C (Recommended)", "Last?": 5}, "annotations": {"Last?": {"notes": "rather the other one"}}}},
          agent(4, ask("k", *TWO)), user(5, [done("k", BANNER.format('"Which?"="A"'), True)]), user(6, [done("none", BANNER.format('"Which?"="A"'))])],
    "r": [agent(0, use("b", "Bash"), use("t", "Task")), user(1, "src/a.py:3-5: too long\nnot a comment\nb.md:7: say why maybe"), user(2, [done("b", json.dumps({"result": {"findings": [{"file": "x.py", "line": "4-9", "comment": "wrong", "fix": "turn it"}, {"line": 3}, 5]}})), done("t", "c.py:1: own words"), done("zz", "c.py:1: unknown call")]), user(3, [done("b", '{"confirmed_a": [{"summary": 7, "line": 2}], "other": 1}')]), user(4, "see [[one|two]]"), user(5, "{broken json")],
}


def test_findings_of_questions_and_reviews(spark):
    turned = session.with_turns(events(lines(spark, FILES)))
    got = sorted((r.idx, r.text, r.confidence, r.reasons, r.trigger_idx) for r in mining.question_answers(turned).collect())
    assert got == [(1, "A", 0.25, ["option_pick"], 0), (1, "because I think so", 0.5, ["freeform_answer", "substantive", "hedged"], 0), (3, "C (Recommended)", 0.25, ["option_pick"], 2), (3, "rather the other one", 0.75, ["freeform_answer", "substantive"], 2)]
    assert [(r.question, r.recommended, r.picked) for r in questions.answers(turned).where("idx = 3 and answer is not null").collect()] == [("Which?", True, ["C (Recommended)"])]
    found = sorted((r.idx, r.at, r.provenance, r.format, r.file, r.line_start, r.line_end, r.comment) for r in review.comments(turned, **mining.REVIEW).collect())
    assert found == [(1, -1, "typed", "path_line", "b.md", 7, None, "say why maybe"), (1, -1, "typed", "path_line", "src/a.py", 3, 5, "too long"), (2, 0, "surfaced", "json", "x.py", 4, 9, "wrong turn it"), (3, 0, "surfaced", "json", None, 2, 2, "7")]
    own = review.ByFunction("pairs", r"\[\[", lambda text: [("f", k, None, part) for k, part in enumerate(text.partition("[[")[2].partition("]]")[0].split("|"))])
    assert sorted((r.idx, r.format, r.line_start, r.comment) for r in review.comments(turned, functions=[own]).collect()) == [(4, "pairs", 0, "one"), (4, "pairs", 1, "two")]
    assert [r.provenance for r in review.comments(turned, **mining.REVIEW, surfaces=("claude",)).collect()] == ["claude"]
    assert {(r.detector, r.rank) for r in mining.mine(turned).select("detector", "rank").distinct().collect()} == {("message", 0), ("review_comment", 5), ("question_answer", 6)}
    with pytest.raises(ValueError):
        review.comments(turned)
