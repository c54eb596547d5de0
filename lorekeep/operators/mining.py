"""Feedback that users gave in sessions, with a confidence and its reasons, by window functions over events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import markers
from lorekeep.operators import questions, review, session
from lorekeep.shared import written

FOUND = ("detector", "path", "idx", "uuid", "text", "trigger_idx", "confidence", "reasons")
PLAN_TOOLS = ("ExitPlanMode", "ExitSpecMode")
#: Denials of these are no feedback on work.
ASKING = ("AskUserQuestion", *PLAN_TOOLS)


@dataclass(frozen=True)
class Stage:
    """base, substantive (more words than `words`, and no match), hedged (match), short (at most `words`), proximate (trigger within `words` events) or noise."""

    kind: str
    delta: float
    reason: str
    pattern: str = "a^"
    words: int = 0


#: fixed value: words that hedge
HEDGES = r"(?i)\b(?:maybe|perhaps|possibly|might|not sure|i think|i guess|if you (?:want|prefer)|up to you)\b"
STRUCTURAL = rf"{markers.NOISE}|{markers.INJECTION}"
#: A message starts at one half; short ones lose, those soon behind the agent's turn gain.
USER_MESSAGE = [Stage("noise", 0.0, "structural_only", STRUCTURAL), Stage("base", 0.5, "user_message"), Stage("short", -0.25, "short_followup", words=2), Stage("proximate", 0.25, "trigger_proximate", words=2)]
CALIBRATED = [Stage("substantive", 0.25, "substantive", STRUCTURAL, words=2), Stage("hedged", -0.25, "hedged", HEDGES)]


def confidence(stages: list[Stage], text: Column, idx: Column, trigger: Column, start: Column, reasons: Column) -> Column:
    """struct(confidence, reasons): each stage that holds adds its delta, within [0, 1], and its reason; noise alone decides where it matches."""
    words = F.size(F.filter(F.split(text, r"[\s\p{Z}\x85]+"), lambda w: w != ""))

    def step(now: Column, s: Stage) -> Column:
        if s.kind == "noise":
            return now
        after = F.struct((F.lit(s.delta) if s.kind == "base" else F.least(F.lit(1.0), F.greatest(F.lit(0.0), now.confidence + s.delta))).alias("confidence"), F.concat(now.reasons, F.array(F.lit(s.reason))).alias("reasons"))
        holds = {"base": F.lit(True), "substantive": (words > s.words) & ~text.rlike(s.pattern), "hedged": text.rlike(s.pattern), "short": words <= s.words, "proximate": F.coalesce(idx - trigger <= s.words, F.lit(False))}[s.kind]
        return F.when(holds, after).otherwise(now)

    out = reduce(step, stages, F.struct(start.alias("confidence"), reasons.alias("reasons")))
    for s in reversed([s for s in stages if s.kind == "noise"]):
        out = F.when(text.rlike(s.pattern), F.struct(F.lit(s.delta).alias("confidence"), F.array(F.lit(s.reason)).alias("reasons"))).otherwise(out)
    return out


def _found(name: str, rows: DataFrame, stages: list[Stage], seed: str | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    told = confidence(stages, F.col("text"), F.col("idx"), F.col("trigger_idx"), F.lit(0.5 if seed else 0.0), F.array(F.lit(seed)) if seed else none)
    return rows.withColumn("_c", told).select(F.lit(name).alias("detector"), "path", "idx", "uuid", "text", "trigger_idx", "_c.confidence", "_c.reasons")


def prepared(turned: DataFrame) -> DataFrame:
    """Events with `before_assistant`, `next_user`, `last_edit` and `follow`, the next real user message's text strictly behind each."""
    if "follow" in turned.columns:
        return turned
    real = F.when((F.col("kind") == "user") & ~F.col("is_meta") & ~markers.is_blank(F.col("text")) & ~markers.is_interrupt(F.col("text")) & ~markers.is_noise(F.col("text")), F.col("text"))
    near = session.last_edit_within(session.nearest(turned))
    return near.withColumn("follow", F.first(real, True).over(session.in_order().rowsBetween(1, Window.unboundedFollowing)))


def messages(turned: DataFrame, stages: list[Stage] = USER_MESSAGE) -> DataFrame:
    """Every user text that is not blank and not a bare interruption, with the assistant's event before it."""
    said = prepared(turned).where((F.col("kind") == "user") & ~markers.is_blank(F.col("text")) & ~markers.is_bare_interrupt(F.col("text")))
    return _found("message", said.withColumn("trigger_idx", F.col("before_assistant")), stages)


def denials(turned: DataFrame, plan: bool = False, stages: list[Stage] = CALIBRATED) -> DataFrame:
    """Results that the user rejected; the text is what the result says the user said, else the next real message.

    With `plan`, only those of plan tools that hold the user's text; else those of other tools.
    """
    rejected = prepared(turned).select("path", "idx", "uuid", "follow", F.explode("results").alias("r")).where(F.col("r.denial_kind") == markers.USER_REJECTED)
    used = turned.select("path", F.col("idx").alias("trigger_idx"), F.explode("calls").alias("c")).select("path", "trigger_idx", F.col("c.id").alias("call_id"), "c.name")
    used = used.groupBy("path", "call_id").agg(F.max_by(F.struct("trigger_idx", "name"), "trigger_idx").alias("u"))  # the last use of an id
    told = rejected.withColumn("call_id", F.col("r.tool_use_id")).join(used, ["path", "call_id"], "left").withColumn("own", F.nullif(markers.embedded_user_text(F.col("r.content")), F.lit("")))
    if plan:
        rows = told.where(F.col("u.name").isin(*PLAN_TOOLS) & F.col("own").isNotNull()).withColumn("text", F.col("own"))
    else:
        rows = told.where(F.coalesce(~F.col("u.name").isin(*ASKING), F.lit(True))).withColumn("text", F.coalesce("own", "follow")).where("text is not null")
    return _found("plan_rejection" if plan else "denial", rows.withColumn("trigger_idx", F.col("u.trigger_idx")), stages, "denied")


def interrupts(turned: DataFrame, stages: list[Stage] = CALIBRATED) -> DataFrame:
    """User events that interrupted the agent, with the next real message as the correction."""
    near = prepared(turned).where((F.col("kind") == "user") & markers.is_interrupt(F.col("text")) & F.col("follow").isNotNull())
    return _found("interrupt", near.withColumn("text", F.col("follow")).withColumn("trigger_idx", F.col("before_assistant")), stages, "interrupted")


def plan_reentries(turned: DataFrame, back: int = 40, stages: list[Stage] = CALIBRATED) -> DataFrame:
    """The user's message behind a switch to plan mode, where an edit lies within the rows before the switch; once per message."""
    edited = prepared(turned) if back == 40 else session.last_edit_within(session.nearest(turned), back)
    switch = edited.where((F.col("kind") == "mode") & (F.col("mode") == "plan") & F.col("last_edit").isNotNull() & F.col("next_user").isNotNull())
    first = switch.groupBy("path", F.col("next_user").alias("idx")).agg(F.min_by("last_edit", "idx").alias("trigger_idx"))
    return _found("plan_reentry", first.join(turned.select("path", "idx", "uuid", "text"), ["path", "idx"]), stages, "plan")


def question_answers(turned: DataFrame, stages: list[Stage] = CALIBRATED) -> DataFrame:
    """Answers to the agent's questions: notes, or else the answer. A plain pick of options is weak, free words are scored."""
    told = questions.answers(turned).withColumn("text", F.coalesce("notes", "answer")).where("text is not null")
    near = prepared(turned).select("path", "idx", F.col("before_assistant").alias("trigger_idx"))
    rows = told.join(near, ["path", "idx"])
    plain = F.col("option_pick") & (F.coalesce("notes", F.lit("")) == "")
    weak = rows.where(plain).select(F.lit("question_answer").alias("detector"), "path", "idx", "uuid", "text", "trigger_idx", F.lit(0.25).alias("confidence"), F.array(F.lit("option_pick")).alias("reasons"))
    return _found("question_answer", rows.where(~plain), stages, "freeform_answer").unionByName(weak)


def review_comments(turned: DataFrame, formats: dict | None = None, stages: list[Stage] = CALIBRATED) -> DataFrame:
    """Comments of the formats (arguments of `review.comments`) as findings."""
    return _found("review_comment", review.comments(turned, **(formats or REVIEW)).withColumnRenamed("comment", "text"), stages, "format_match")


#: Comments as reviewers often write them: path:line: text, and JSON objects with a file and a comment.
REVIEW = {"patterns": [review.ByPattern("path_line", r"(?m)^([\w./-]+\.\w+):([0-9]+)(?:-([0-9]+))?: +(\S.*)$", (4,), 1, 2, 3)], "structured": [review.InJson("json", comment=("comment", "summary"), fix=("fix",))]}


def mine(turned: DataFrame, formats: dict | None = None) -> DataFrame:
    """All detectors' findings, `rank` being the detectors' order. The log is read and sorted once: it is written with what all need."""
    keep = ("path", "idx", "uuid", "kind", "text", "is_meta", "is_sidechain", "mode", "calls", "results", "payload", "before_assistant", "next_user", "last_edit", "follow")
    near = written(prepared(turned).select(*keep), "mined")
    parts = [messages(near), denials(near, plan=True), plan_reentries(near), denials(near), interrupts(near), review_comments(near, formats), question_answers(near)]
    ranked = [p.withColumn("rank", F.lit(k)) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, ranked)
