"""Questions that the agent asked in sessions, and what was answered, by higher-order functions over the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.rng import let

# fixed values
ASK = "AskUserQuestion"
ANSWERED, ANSWERED_END = "Your questions have been answered: ", ". You can now continue with these answers in mind."
PREVIEW, NOTES, NOTHING = " selected preview:\n", " notes: ", "(no option selected)"
RECOMMENDED = "(Recommended)"

_ASKED = "array<struct<question: string, header: string, multiSelect: boolean, options: array<struct<label: string>>>>"
_QUESTION = "array<struct<question: string, header: string, multi_select: boolean, labels: array<string>>>"
_PAIR = "array<struct<question: string, header: string, multi_select: boolean, labels: array<string>, answer: string, preview: string, notes: string>>"


def asked(json: Column) -> Column:
    """The questions of a JSON object (question, header, multi_select, labels); those without a text are left out, null without a list."""
    listed = F.from_json(F.get_json_object(json, "$.questions"), _ASKED)
    labels = lambda q: F.transform(F.filter(F.coalesce(q.options, F.array().cast("array<struct<label: string>>")), lambda o: o.label.isNotNull()), lambda o: o.label)
    return F.transform(F.filter(listed, lambda q: q.question.isNotNull()), lambda q: F.struct(q.question.alias("question"), q.header.alias("header"), F.coalesce(q.multiSelect, F.lit(False)).alias("multi_select"), labels(q).alias("labels"))).cast(_QUESTION)


def _behind(text: Column, start: Column, length: Column | None = None) -> Column:
    """The text from a place counted from 0."""
    return F.substring(text, start + 1, F.length(text) if length is None else length)


def _split(segment: Column) -> Column:
    """struct(head, preview, notes) of what stands behind a question."""
    preview, notes = F.locate(PREVIEW, segment), F.locate(NOTES, segment)
    rest = _behind(segment, preview - 1 + len(PREVIEW))
    deep = let(rest, lambda r: F.struct(F.substring(segment, F.lit(1), preview - 1).alias("head"), F.when(F.locate(NOTES, r) > 0, F.substring(r, F.lit(1), F.locate(NOTES, r) - 1)).otherwise(r).alias("preview"), F.when(F.locate(NOTES, r) > 0, _behind(r, F.locate(NOTES, r) - 1 + len(NOTES))).alias("notes")))
    none = F.lit(None).cast("string")
    flat = F.struct(F.when(notes > 0, F.substring(segment, F.lit(1), notes - 1)).otherwise(segment).alias("head"), none.alias("preview"), F.when(notes > 0, _behind(segment, notes - 1 + len(NOTES))).alias("notes"))
    return F.when(preview > 0, deep).otherwise(flat)


def from_banner(content: Column, questions: Column) -> Column:
    """Questions with what a result's text says of each: "question"="answer", with a preview or notes behind it.

    A question is looked for behind the one before, at the text's start or behind a comma; one that is not there, or
    has neither a quoted answer nor the mark of none, is left out.
    """
    body = F.when(content.startswith(ANSWERED) & content.endswith(ANSWERED_END) & (F.length(content) >= len(ANSWERED) + len(ANSWERED_END)), F.substring(content, F.lit(len(ANSWERED) + 1), F.length(content) - (len(ANSWERED) + len(ANSWERED_END))))

    def pairs(b: Column) -> Column:
        def find(s: Column, q: Column) -> Column:
            mark = F.concat(F.lit('"'), q.question, F.lit('"='))
            later = F.position(F.concat(F.lit(", "), mark), b, F.greatest(s.pos - 1, F.lit(1)))
            at = F.when((s.pos == 0) & b.startswith(mark), 0).when(later > 0, later + 1)
            hit = F.struct((at + F.length(mark)).alias("pos"), F.concat(s.found, F.array(F.struct(q.alias("q"), at.alias("at"), (at + F.length(mark)).alias("value")))).alias("found"))
            return F.when(at.isNotNull(), hit).otherwise(s)

        kind = "array<struct<q: struct<question: string, header: string, multi_select: boolean, labels: array<string>>, at: int, value: int>>"
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("found"))
        found = F.aggregate(F.coalesce(questions, F.array().cast(_QUESTION)), start, find, lambda s: s.found)

        def told(all_: Column) -> Column:
            def one(f: Column, i: Column) -> Column:
                more = i + 1 < F.size(all_)
                end = F.when(more, F.try_element_at(all_, i + 2)["at"]).otherwise(F.length(b))
                raw = _behind(b, f.value, end - f.value)
                segment = F.when(more, F.regexp_replace(raw, ", \\z", "")).otherwise(raw)
                return let(_split(segment), lambda s: F.struct(*[f.q[c].alias(c) for c in ("question", "header", "multi_select", "labels")], F.when(s.head.startswith('"'), F.regexp_replace(_behind(s.head, F.lit(1)), '"\\z', "")).alias("answer"), s.preview.alias("preview"), s.notes.alias("notes"), (s.head.startswith('"') | s.head.startswith(NOTHING)).alias("whole")))

            return F.filter(F.transform(all_, one), lambda p: p.whole)

        return let(found, told)

    return F.transform(let(body, pairs), lambda p: F.struct(*[p[c].alias(c) for c in ("question", "header", "multi_select", "labels", "answer", "preview", "notes")])).cast(_PAIR)


def from_answers(result: Column, questions: Column) -> Column:
    """Questions with what a result's object (answers, annotations by question) says of each."""
    answers = F.from_json(F.get_json_object(result, "$.answers"), "map<string, variant>")
    notes = F.from_json(F.get_json_object(result, "$.annotations"), "map<string, struct<preview: string, notes: string>>")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    item = lambda q: F.struct(*[q[c].alias(c) for c in ("question", "header", "multi_select", "labels")], text(F.try_element_at(answers, q.question)).alias("answer"), F.try_element_at(notes, q.question)["preview"].alias("preview"), F.try_element_at(notes, q.question)["notes"].alias("notes"))
    return F.transform(F.coalesce(questions, F.array().cast(_QUESTION)), item).cast(_PAIR)


def picked(answer: Column, labels: Column) -> Column:
    """struct(labels, whole): the labels that an answer names, and whether it names nothing else.

    Labels may hold commas: parts are joined until they are a label, in the labels' order. A number in front, behind
    which nothing, a comma, a point, a space or a bracket stands, names the label at its place.
    """
    def join(s: Column, part: Column) -> Column:
        text = F.when(s.held.isNull(), part).otherwise(F.concat(s.held, F.lit(", "), part))

        def put(t: Column) -> Column:
            at = F.array_min(F.filter(F.transform(labels, lambda x, i: F.when((x == t) & (i >= s.start), i)), lambda i: i.isNotNull()))
            return F.when(at.isNotNull(), F.struct((at + 1).alias("start"), F.lit(None).cast("string").alias("held"), F.concat(s.out, F.array(t)).alias("out"))).otherwise(F.struct(s.start.alias("start"), t.alias("held"), s.out.alias("out")))

        return let(text, put)

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("start"), F.lit(None).cast("string").alias("held"), none.alias("out"))
    joined = F.aggregate(F.split(answer, ", "), start, join, lambda s: F.when(s.held.isNull() & (F.size(s.out) > 0), s.out))
    digits = F.regexp_extract(answer, r"\A[0-9]*", 0)
    rest = F.substring(answer, F.length(digits) + 1, F.length(answer))
    n = F.when(digits != "", digits.try_cast("int"))
    fits = n.between(1, F.size(labels)) & ((rest == "") | rest.rlike(r"\A[,. )]"))
    ordinal = F.struct(F.array(F.try_element_at(labels, F.when(fits, n))).alias("labels"), (rest == "").alias("whole"))
    nothing = F.struct(none.alias("labels"), F.lit(False).alias("whole"))
    return F.when(answer.isNull(), nothing).otherwise(let(joined, lambda j: F.when(j.isNotNull(), F.struct(j.alias("labels"), F.lit(True).alias("whole"))).when(F.coalesce(fits, F.lit(False)), ordinal).otherwise(nothing)))


def answers(turned: DataFrame) -> DataFrame:
    """path, idx, uuid, at, number, call_id, question, header, multi_select, answer, preview, notes, picked, option_pick, recommended.

    One row for each answered question of each result of a question tool, in the order of the questions. The record's
    own result counts if it has answers and did not fail, with its questions or else the call's; otherwise the text of
    the result is read. The call is the last one of its id.
    """
    used = turned.select("path", "idx", F.posexplode("calls").alias("k", "c")).select("path", F.col("c.id").alias("call_id"), F.struct("idx", "k", F.col("c.name").alias("name"), F.col("c.input").alias("input")).alias("u"))
    last = used.groupBy("path", "call_id").agg(F.max("u").alias("u")).where(F.col("u.name") == ASK)
    told = turned.select("path", "idx", "uuid", "payload", F.posexplode("results").alias("at", "r")).select("path", "idx", "uuid", "at", "r", F.col("r.tool_use_id").alias("call_id"), F.get_json_object("payload", "$.toolUseResult").alias("own"))
    met = told.join(last, ["path", "call_id"])
    questions = asked(F.col("u.input"))
    structured = ~F.col("r.is_error") & F.get_json_object("own", "$.answers").isNotNull()
    pairs = F.when(structured, from_answers(F.col("own"), F.coalesce(asked(F.col("own")), questions))).when(~F.col("r.is_error"), from_banner(F.col("r.content"), questions))
    each = met.select("path", "idx", "uuid", "at", "call_id", F.posexplode(pairs).alias("number", "p")).select("path", "idx", "uuid", "at", "number", "call_id", "p.*")
    each = each.withColumn("_pick", picked(F.col("answer"), F.col("labels")))
    return each.select("path", "idx", "uuid", "at", "number", "call_id", "question", "header", "multi_select", "answer", "preview", "notes", F.col("_pick.labels").alias("picked"), F.col("_pick.whole").alias("option_pick"), F.exists("_pick.labels", lambda x: F.contains(x, F.lit(RECOMMENDED))).alias("recommended"))
