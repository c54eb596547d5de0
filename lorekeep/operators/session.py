"""Turns, tool calls and questions about sessions, over events as `sources.events` gives them.

Sessions are partitioned by `path` and ordered by `idx`. A session is bounded by its file, so windows over one are too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import markers
from lorekeep.operators import notices

#: Other names of tools that a name stands for.
ALIASES = {"Bash": ("Execute", "exec_command"), "Edit": ("apply_patch",), "Write": ("Create",), "Agent": ("Task",), "WebFetch": ("FetchUrl",), "ExitPlanMode": ("ExitSpecMode",)}
#: Tools that wait by themselves, that may run in the background, that start agents, and that ask people.
WAITING = "Monitor|ScheduleWakeup|SendMessage|TeamCreate"
BACKGROUND, AGENTS, ASKING = "Agent|Task|Bash", "Agent|Task", "AskUserQuestion|ExitPlanMode"
EDITS = ("Edit", "MultiEdit", "Write", "Create", "NotebookEdit")


def in_order():
    """The window of a session's events in their order."""
    return Window.partitionBy("path").orderBy("idx")


def opens_turn() -> Column:
    """A prompt that the user wrote: not meta, of a sidechain, a summary, an interruption or a relayed banner, and not blank."""
    flags = F.col("is_meta") | F.col("is_sidechain") | F.col("is_compact_summary")
    return (F.col("kind") == "user") & ~F.coalesce(flags, F.lit(False)) & ~markers.is_interrupt(F.col("text")) & ~markers.is_injection(F.col("text")) & ~markers.is_blank(F.col("text"))


def with_turns(events: DataFrame) -> DataFrame:
    """`turn` of each event: prompts open turns from 0; events before the first prompt are a turn 0 of their own."""
    opens = F.when(opens_turn(), 1).otherwise(0)
    run = F.sum("opens").over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("opens").over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return events.withColumn("opens", opens).withColumn("turn", (run - first).cast("long")).withColumn("opens", F.col("opens") == 1)


def turns(turned: DataFrame) -> DataFrame:
    """path, turn, prompt, started_at, ended_at, n_events, n_calls: one row per turn.

    Times are those of the first and last event that has one, by place, not the least and the greatest.
    """
    timed = F.when(F.col("ts").isNotNull(), F.col("idx"))
    return turned.groupBy("path", "turn").agg(
        F.coalesce(F.min_by("text", F.when(F.col("opens"), F.col("idx"))), F.lit("")).alias("prompt"),
        F.min_by("ts", timed).alias("started_at"),
        F.max_by("ts", timed).alias("ended_at"),
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.size("calls")).cast("long").alias("n_calls"),
    )


def current_turn(turned: DataFrame) -> DataFrame:
    """The events of each session's last turn."""
    return turned.withColumn("_last", F.max("turn").over(Window.partitionBy("path"))).where("turn = _last").drop("_last")


def _one_result(events: DataFrame) -> DataFrame:
    """tool_use_id's last result and the place of its first."""
    each = events.select("path", "idx", "ts", F.posexplode("results").alias("at", "r")).select("path", "idx", "at", "ts", "r.*")
    place = F.struct("idx", "at")
    return each.groupBy("path", "tool_use_id").agg(F.max_by(F.struct("idx", "ts", "content", "is_error", "is_async", "denial_kind"), place).alias("result"), F.min("idx").alias("first_result_idx"))


def calls(turned: DataFrame) -> DataFrame:
    """One row per tool call with its last result, if any: path, turn, idx, at, call_id, name, input, file_path, hunks, latency_ms, ...

    `hunks` are the edit's (old, new) texts: of Edit one, of MultiEdit one each, of Write and NotebookEdit the new text
    alone. `file_path` comes from the input's file or notebook. A call is pending if no result names it.
    """
    each = turned.select("path", "turn", "idx", "ts", F.posexplode("calls").alias("at", "c")).select("path", "turn", "idx", "at", "ts", F.col("c.id").alias("call_id"), "c.name", "c.input")
    field = lambda k: F.get_json_object("input", f"$.{k}")
    hunk = lambda old, new: F.array(F.struct(old.alias("old"), new.alias("new")))
    many = F.transform(F.from_json(field("edits"), "array<struct<old_string string, new_string string>>"), lambda e: F.struct(e.old_string.alias("old"), e.new_string.alias("new")))
    hunks = (
        F.when(F.col("name") == "Edit", hunk(field("old_string"), field("new_string")))
        .when(F.col("name") == "MultiEdit", many)
        .when(F.col("name").isin("Write", "Create"), hunk(F.lit(""), field("content")))
        .when(F.col("name") == "NotebookEdit", hunk(F.lit(""), field("new_source")))
    )
    each = each.withColumn("file_path", F.coalesce(field("file_path"), field("notebook_path"))).withColumn("hunks", hunks)
    each = each.withColumn("command", F.when(F.col("name").isin("Bash", *ALIASES["Bash"]), F.coalesce(field("command"), field("cmd")))).withColumn("skill", F.when(F.col("name") == "Skill", field("skill")))
    joined = each.join(_one_result(turned).withColumnRenamed("tool_use_id", "call_id"), ["path", "call_id"], "left")
    ms = F.bround((F.unix_micros("result.ts") - F.unix_micros("ts")) / 1000).cast("long")
    return joined.withColumn("latency_ms", ms).withColumn("is_error", F.coalesce("result.is_error", F.lit(False))).withColumn("pending", F.col("result").isNull())


def named(spec: str) -> Column:
    """Calls whose tool a pipe-separated list names, by any alias or as the tool of mcp__server__tool."""
    names = {x.strip() for x in spec.split("|")}
    for canonical, others in ALIASES.items():
        if names & {canonical, *others}:
            names |= {canonical, *others} if canonical in names else {canonical}
    return F.col("name").isin(*sorted(names)) | F.coalesce(markers.mcp_parts(F.col("name"))["tool"].isin(*sorted(names)), F.lit(False))


def glob_regex(glob: str) -> str:
    """The pattern of a file glob: * and ? cross /, classes may be negated with !."""
    out, k = [], 0
    while k < len(glob):
        c, end = glob[k], glob.find("]", k + 2)
        if c == "[" and end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner.replace("^", "\\^", 1) if inner.startswith("^") else inner) + "]")
            k = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        k += 1
    return rf"(?s)\A{''.join(out)}\z"


def touches(*globs: str, path: str = "file_path") -> Column:
    """A path, or its last part, matches one of the globs."""
    p = F.col(path)
    tests = [p.rlike(glob_regex(g)) | F.regexp_extract(p, r"[^/]*\z", 0).rlike(glob_regex(g)) for g in globs]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def is_test(path: str = "file_path") -> Column:
    return touches("test_*", "*_test.*", "*/tests/*", path=path)


def under(prefix: str, path: str = "file_path") -> Column:
    """A path that begins with the prefix, or has it behind any slash."""
    return F.coalesce(F.col(path).startswith(prefix) | F.col(path).contains(f"/{prefix}"), F.lit(False))


def suffix(path: str = "file_path") -> Column:
    """The last part's ending with its point; empty without one, or if nothing else is there."""
    return F.regexp_extract(F.col(path), r"[^/.][^/]*(\.[^/.]+)\z", 1)


def predicates(calls_: DataFrame, tests: dict[str, Column], with_errors: tuple[str, ...] = ()) -> DataFrame:
    """One row per session with a boolean for each test: is any call as the test says? All in one pass.

    Failed calls are hidden, but from the tests that `with_errors` names.
    """
    shown = ~F.col("is_error")
    return calls_.groupBy("path").agg(*[F.max((F.lit(n in with_errors) | shown) & F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])


def call_counts(calls_: DataFrame) -> DataFrame:
    """Per session and tool: calls, failures, pending ones, and the total and greatest latency."""
    return calls_.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_error"), 1)).alias("failures"), F.count(F.when(F.col("pending"), 1)).alias("pending"), F.sum("latency_ms").alias("ms"), F.max("latency_ms").alias("slowest_ms"))


def failed_results(events: DataFrame) -> DataFrame:
    """path, idx, at, name: failed results with the tool of the last call of their id before them in the file; others are left out."""
    used = events.select("path", "idx", F.posexplode("calls").alias("k", "c")).select("path", F.struct("idx", "k").alias("use"), F.col("c.id").alias("tool_use_id"), "c.name")
    failed = events.select("path", "idx", F.posexplode("results").alias("at", "r")).where("r.is_error").select("path", "idx", "at", "r.tool_use_id")
    seen = failed.join(used, ["path", "tool_use_id"]).where("use.idx < idx")
    return seen.groupBy("path", "idx", "at").agg(F.max_by("name", "use").alias("name"))


def errors_of_earlier_calls(turned: DataFrame) -> DataFrame:
    """name, errors: failed results by their call's tool, where the call came earlier in the session."""
    return failed_results(turned).groupBy("name").agg(F.count(F.lit(1)).alias("errors"))


def nearest(turned: DataFrame) -> DataFrame:
    """Each event with `before_assistant`, the nearest assistant event strictly before it, and `next_user`, the first user event with text at or after it."""
    before, after = in_order().rowsBetween(Window.unboundedPreceding, -1), in_order().rowsBetween(0, Window.unboundedFollowing)
    spoken = (F.col("kind") == "user") & ~markers.is_blank(F.col("text"))
    return turned.withColumn("before_assistant", F.last(F.when(F.col("kind") == "assistant", F.col("idx")), True).over(before)).withColumn("next_user", F.first(F.when(spoken, F.col("idx")), True).over(after))


def last_edit_within(turned: DataFrame, rows: int = 40) -> DataFrame:
    """`last_edit`: the place of the last event with an edit among the rows before each event."""
    edits = F.exists("calls", lambda c: c["name"].isin(*EDITS))
    return turned.withColumn("last_edit", F.max(F.when(edits, F.col("idx"))).over(in_order().rowsBetween(-rows, -1)))


def assistant_text(turned: DataFrame, n: int, cap: int) -> DataFrame:
    """path, text: the last n non-blank assistant texts, each cut to cap characters, oldest first."""
    said = turned.where((F.col("kind") == "assistant") & ~markers.is_blank(F.col("text")))
    ranked = said.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("idx")))).where(F.col("r") <= n)
    parts = F.array_sort(F.collect_list(F.struct("idx", F.substring("text", 1, cap).alias("t"))))
    return ranked.groupBy("path").agg(F.array_join(F.transform(parts, lambda x: x.t), "\n\n").alias("text"))


def after_last(turned: DataFrame, test: Column, before: bool = False) -> DataFrame:
    """The events behind (or before) the last that meets the test; none behind, and all before, if no event does."""
    at = F.max(F.when(test, F.col("idx"))).over(Window.partitionBy("path"))
    marked = turned.withColumn("_at", at)
    kept = marked.where(F.col("_at").isNull() | (F.col("idx") < F.col("_at"))) if before else marked.where(F.col("idx") > F.col("_at"))
    return kept.drop("_at")


def grep(turned: DataFrame, patterns: dict[str, str], context: int = 0, cap: int | None = None, facets: tuple[str, ...] = ("text", "thinking", "tools")) -> DataFrame:
    """Events that match any pattern, or lie within `context` events of one, with the names of what they match.

    A pattern's matches beyond the first `cap`, by path and place, count as none; equal to stopping early.
    """
    tools = F.concat_ws("\n", F.transform("calls", lambda c: F.concat_ws(" ", c["name"], c.input)), F.transform("results", lambda r: r.content))
    parts = {"text": F.col("text"), "thinking": F.nullif(F.col("thinking"), F.lit("")), "tools": F.nullif(tools, F.lit(""))}
    told = turned.withColumn("_all", F.concat_ws("\n", *[parts[f] for f in facets]))
    told = told.withColumn("hits", F.array_compact(F.array(*[F.when(F.col("_all").rlike(p), F.lit(n)) for n, p in patterns.items()]))).drop("_all")
    if cap is not None:
        each = told.select("path", "idx", F.explode("hits").alias("hit"))
        kept = each.withColumn("r", F.row_number().over(Window.partitionBy("hit").orderBy("path", "idx"))).where(F.col("r") <= cap)
        told = told.drop("hits").join(kept.groupBy("path", "idx").agg(F.array_sort(F.collect_list("hit")).alias("hits")), ["path", "idx"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    near = F.max(F.size("hits") > 0).over(in_order().rowsBetween(-context, context))
    return told.withColumn("_near", near).where("_near").drop("_near")


def activity(turned: DataFrame) -> DataFrame:
    """path, is_waiting, mid_tool, pending (call_id, name, why, in order), last_ts of each session.

    Waiting are undelivered notifications, calls of the current turn that wait, run in the background or are agents
    without a type, and asynchronous agents and workflows of any turn whose notification has not arrived. mid_tool: a
    call of the current turn has no result yet, and asks no person. Failed calls count for nothing.
    """
    queue = notices.queues(turned)
    done = notices.completed(queue).withColumn("_done", F.lit(True))
    current = turned.groupBy("path").agg(F.max("turn").alias("_now"))
    each = calls(turned).where("not is_error").join(current, "path").join(done, ["path", "call_id"], "left")
    field = lambda k: F.get_json_object("input", f"$.{k}")
    now, open_ = F.col("turn") == F.col("_now"), F.col("_done").isNull()
    why = (
        F.when(now & named(WAITING), "waiting_tool")
        .when(now & named(BACKGROUND) & (field("run_in_background") == "true"), "background")
        .when(now & named(AGENTS) & field("subagent_type").isNull(), "subagentless_task")
        .when(F.col("name").isin("Agent", "Task") & F.coalesce(F.col("result.is_async"), F.lit(False)) & open_, "pending_async_task")
        .when((F.col("name") == "Workflow") & open_, "pending_async_workflow")
    )
    unanswered = now & F.col("pending") & ~named(ASKING)
    told = each.select("path", "idx", "at", "call_id", "name", why.alias("why"), unanswered.alias("mid")).where("why is not null or mid")
    first = told.withColumn("_r", F.row_number().over(Window.partitionBy("path", "call_id").orderBy("idx", "at")))
    item = F.when(F.col("_r") == 1, F.struct("idx", "at", "call_id", "name", F.coalesce("why", F.lit("mid_tool")).alias("why")))
    found = first.groupBy("path").agg(F.max(F.col("why").isNotNull()).alias("waits"), F.max("mid").alias("mid"), F.array_sort(F.collect_list(item)).alias("items"))
    undelivered = queue.select("path", F.exists("queued", lambda x: F.contains(x, F.lit(markers.TASK_NOTIFICATION))).alias("undelivered"))
    out = turned.groupBy("path").agg(F.max("ts").alias("last_ts")).join(undelivered, "path").join(found, "path", "left")
    items = F.transform("items", lambda x: F.struct(x.call_id.alias("call_id"), x["name"].alias("name"), x.why.alias("why")))
    no = F.lit(False)
    return out.select("path", (F.col("undelivered") | F.coalesce("waits", no)).alias("is_waiting"), F.coalesce("mid", no).alias("mid_tool"), F.coalesce(items, F.array().cast("array<struct<call_id string, name string, why string>>")).alias("pending"), "last_ts")
