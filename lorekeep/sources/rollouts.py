"""Rollouts: the logs of another host, as events with the columns of `sources.sessions.events`.

Each line is an item with a payload. Items become one event each; what a later event of the same text only repeats
stays as `other`. A line that is no JSON stays as `other`, too: a rollout has no invalid files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import markers
from lorekeep.sources import sessions

# fixed values: kinds of items, and tags around texts that the host puts in the user's place
ITEMS = ("session_meta", "response_item", "event_msg", "turn_context", "world_state", "compacted", "inter_agent_communication_metadata")
WRAPPERS = ("environment_context", "user_instructions", "skills_instructions", "plugins_instructions", "apps_instructions", "recommended_plugins")
UNKNOWN_MODEL = "unknown"
#: Tools by which a rollout waits.
WAIT_TOOLS = ("wait", "wait_agent")
CALLS = ("function_call", "custom_tool_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output")


def _text(path: str) -> Column:
    """A string at a path, null for other values."""
    v = F.try_variant_get("v", path, "variant")
    return F.when(sessions._is(v, "STRING"), F.try_variant_get("v", path, "string"))


def _texts(path: str) -> Column:
    """The texts of an array's blocks, a line each."""
    blocks = F.try_variant_get("v", path, "array<struct<text string>>")
    return F.array_join(F.transform(F.filter(F.coalesce(blocks, F.array().cast("array<struct<text string>>")), lambda b: b.text.isNotNull()), lambda b: b.text), "\n")


def items(lines: DataFrame) -> DataFrame:
    """path, idx, line, v, item, kind_of (the payload's type), ts, and of the whole rollout: thread_id, parent_thread_id, cwd, model.

    Thread and parent are those of the first item that names a thread. The working folder and the model are those that
    the last item up to a line has set; before the first model, that one counts.
    """
    v = F.try_parse_json("line")
    each = lines.select("path", F.col("idx").cast("long").alias("idx"), "line", v.alias("v")).where(F.trim("line") != "")
    item = F.when(_text("$.type").isin(*ITEMS), _text("$.type"))
    parsed = each.withColumn("item", item).withColumn("kind_of", _text("$.payload.type")).withColumn("ts", F.try_to_timestamp(_text("$.timestamp")))
    file = Window.partitionBy("path").orderBy("idx")
    upto, behind, whole = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(1, Window.unboundedFollowing), file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda kind, path: F.when(F.col("item") == kind, _text(path))
    named = (F.col("item") == "session_meta") & (F.coalesce(_text("$.payload.id"), F.lit("")) != "")
    first = F.first(F.when(named, F.struct(_text("$.payload.id").alias("id"), _text("$.payload.parent_thread_id").alias("parent"), _text("$.payload.cwd").alias("cwd"))), True).over(whole)
    model = F.coalesce(F.last(of("turn_context", "$.payload.model"), True).over(upto), F.first(of("turn_context", "$.payload.model"), True).over(behind), F.lit(UNKNOWN_MODEL))
    told = parsed.withColumn("_first", first).withColumn("model", model).withColumn("cwd", F.last(of("turn_context", "$.payload.cwd"), True).over(upto))
    before = F.lag(F.struct("idx", "item", F.try_variant_get("v", "$.payload.trigger_turn", "boolean").alias("trigger"))).over(file)
    opens = F.coalesce((before["idx"] == F.col("idx") - 1) & (before["item"] == ITEMS[6]) & before["trigger"], F.lit(False))
    return told.select("path", "idx", "line", "v", "item", "kind_of", "ts", F.coalesce("_first.id", F.lit("")).alias("thread_id"), F.col("_first.parent").alias("parent_thread_id"), F.coalesce("cwd", "_first.cwd").alias("cwd"), "model", opens.alias("triggered"))


def _said(i: DataFrame) -> DataFrame:
    """path, role, text: what messages of a rollout say."""
    messages = i.where("item = 'response_item' and kind_of = 'message'").select("path", _text("$.payload.role").alias("role"), _texts("$.payload.content").alias("text"), sessions._is(F.try_variant_get("v", "$.payload.content", "variant"), "ARRAY").alias("whole"))
    return messages.where("whole and role in ('user', 'assistant')").select("path", "role", "text").distinct()


def events(lines: DataFrame, namespace: str = "rollout") -> DataFrame:
    """Typed events of a rollout's lines (path, idx, line), with all columns of `sources.sessions.events`.

    Messages, reasoning, calls, outputs, compactions and interruptions become user and assistant events. An event
    message whose text a message of the same rollout has is an echo and stays `other`, as do all other items; `detail`
    has an other item's type. Ids are made of the namespace, the thread and the item's id, or its line.
    """
    i = items(lines)
    role, kind = _text("$.payload.role"), F.col("kind_of")
    response, event = F.coalesce(F.col("item") == "response_item", F.lit(False)), F.coalesce(F.col("item") == "event_msg", F.lit(False))
    message = response & (kind == "message") & sessions._is(F.try_variant_get("v", "$.payload.content", "variant"), "ARRAY")
    body = _texts("$.payload.content")
    injected = F.regexp_replace(body, rf"\A{markers.SPACE}+", "").rlike(rf"\A<(?:{'|'.join(WRAPPERS)})>")
    thought = _texts("$.payload.summary")
    call_id, name = _text("$.payload.call_id"), _text("$.payload.name")
    argument = F.when(kind == "function_call", _text("$.payload.arguments")).when(kind == "custom_tool_call", _text("$.payload.input"))
    calls = response & kind.isin(*CALLS) & call_id.isNotNull() & name.isNotNull() & argument.isNotNull()
    output = F.try_variant_get("v", "$.payload.output", "variant")
    is_output = response & kind.isin(*OUTPUTS) & call_id.isNotNull() & F.coalesce(F.schema_of_variant(output) != "VOID", F.lit(False))
    echoed = F.when(event & (kind == "user_message"), "user").when(event & (kind == "agent_message"), "assistant")
    aborted = event & (kind == "turn_aborted")
    compacted = F.coalesce(F.col("item") == "compacted", F.lit(False))
    spoken = F.coalesce(_text("$.payload.message"), F.lit(""))
    marked = i.withColumn("_role", echoed).withColumn("_text", F.when(echoed.isNotNull(), spoken))
    heard = _said(i).select("path", F.col("role").alias("_role"), F.col("text").alias("_text"), F.lit(True).alias("_echo"))
    joined = marked.join(heard, ["path", "_role", "_text"], "left")
    new = F.col("_echo").isNull()
    to = (
        F.when(F.col("ts").isNull(), "other")
        .when(message & (role == "assistant"), "assistant")
        .when(message & role.isin("developer", "user"), "user")
        .when(response & (kind == "agent_message"), "user")
        .when(response & (kind == "reasoning") & ~markers.is_blank(thought), "assistant")
        .when(calls, "assistant")
        .when(is_output | aborted | compacted, "user")
        .when(F.col("_role").isNotNull() & new, F.col("_role"))
        .otherwise("other")
    )
    text = F.when(message | (response & (kind == "agent_message")), body).when(F.col("_role").isNotNull() | compacted, spoken).otherwise("")
    bare = F.coalesce(name, F.lit(""))
    space = F.when(kind == "function_call", _text("$.payload.namespace"))
    tool = F.when(bare.startswith("mcp__") | (F.coalesce(space, F.lit("")) == ""), bare).otherwise(F.concat(F.lit("mcp__"), space, F.lit("__"), bare))
    plain = F.try_variant_get("v", "$.payload.output", "string")
    inner = F.when(sessions._is(output, "STRING"), F.try_parse_json(plain)).otherwise(output)
    inner_text = F.when(sessions._is(F.try_variant_get(inner, "$.output", "variant"), "STRING"), F.try_variant_get(inner, "$.output", "string"))
    flat = F.when(sessions._is(output, "ARRAY"), _texts("$.payload.output")).otherwise(F.coalesce(inner_text, plain))
    code = F.try_variant_get(inner, "$.metadata.exit_code", "bigint")
    own = F.when(response & ~F.coalesce(kind.isin(*OUTPUTS), F.lit(False)), _text("$.payload.id"))
    digest = F.sha2(F.concat(F.lit(f"{namespace}:"), F.col("thread_id"), F.lit(":"), F.coalesce(own, F.concat(F.lit("line:"), F.col("idx").cast("string")))), 256)
    nibble = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    made = F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-8"), F.substring(digest, 14, 3), F.lit("-"), nibble, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))
    typed = joined.withColumn("kind", to)
    is_, no = F.col("kind") != "other", F.lit(False)
    when = lambda test, value: F.when(is_ & test, value)
    meta = F.coalesce(when(message & (role == "developer"), F.lit(True)), when(message & (role == "user"), injected), when(response & (kind == "agent_message"), ~F.col("triggered")), no)
    call_type, result_type = "array<struct<id string, name string, input string>>", "array<struct<tool_use_id string, content string, is_error boolean, is_async boolean, denial_kind string>>"
    null = lambda kind: F.lit(None).cast(kind)
    return typed.select(
        "path", "idx", "kind", when(F.lit(True), made).alias("uuid"), null("string").alias("parent_uuid"), when(F.lit(True), F.col("thread_id")).alias("session_id"), when(F.lit(True), F.col("ts")).alias("ts"), when(F.lit(True), _text("$.timestamp")).alias("ts_raw"),
        when(F.lit(True), F.col("cwd")).alias("cwd"), *[null("string").alias(c) for c in ("git_branch", "entrypoint", "user_type", "slug", "version")],
        *[(is_ & compacted if c == "is_compact_summary" else meta if c == "is_meta" else no).alias(c) for c in sessions.FLAGS],
        F.when(F.col("kind") == "assistant", F.col("model")).alias("model"), null("string").alias("stop_reason"),
        F.when(is_, text).alias("text"), F.coalesce(when(response & (kind == "reasoning"), thought), F.lit("")).alias("thinking"),
        F.coalesce(when(calls, F.array(F.struct(call_id.alias("id"), tool.alias("name"), argument.alias("input")))), F.array()).cast(call_type).alias("calls"),
        F.coalesce(when(is_output, F.array(F.struct(call_id.alias("tool_use_id"), flat.alias("content"), F.coalesce(code != 0, no).alias("is_error"), no.alias("is_async"), null("string").alias("denial_kind")))), F.array()).cast(result_type).alias("results"),
        F.array().cast("array<struct<from_model string, to_model string>>").alias("fallbacks"), F.array().cast("array<string>").alias("other_blocks"),
        *[null("bigint").alias(c) for c in (*sessions.USAGE, "written_5m_tokens", "written_1h_tokens")], null("string").alias("subtype"), null("string").alias("mode"),
        F.when(~is_, F.coalesce(F.when(response | event, kind), "item", F.try_variant_get("v", "$.type", "string"), F.lit("other"))).alias("detail"), F.when(~is_, F.col("line")).alias("payload"),
    )


def is_rollout(lines: DataFrame) -> DataFrame:
    """path, rollout: whether a file's first line that is not blank is an item with a payload."""
    first = lines.where(F.trim("line") != "").groupBy("path").agg(F.min_by("line", "idx").alias("line"))
    v = F.try_parse_json("line")
    told = F.coalesce(F.try_variant_get(v, "$.type", "string").isin(*ITEMS) & F.try_variant_get(v, "$.payload", "variant").isNotNull(), F.lit(False))
    return first.select("path", told.alias("rollout"))


def either(lines: DataFrame) -> DataFrame:
    """The events of files of both hosts, each read as its first line tells; `rollout` says which."""
    told = lines.join(is_rollout(lines), "path")
    own, other = sessions.events(told.where("not rollout")), events(told.where("rollout"))
    return own.withColumn("rollout", F.lit(False)).unionByName(other.withColumn("rollout", F.lit(True)))


def usage(lines: DataFrame) -> DataFrame:
    """path, input_tokens, cached_input_tokens, output_tokens, reasoning_output_tokens, total_tokens, context_window, counts.

    Totals are cumulative: those of the last line that has them count. `counts` is how many lines told a count.
    """
    v = F.try_parse_json("line")
    got = lambda path, kind: F.try_variant_get(v, path, kind)
    told = lines.where((got("$.type", "string") == "event_msg") & (got("$.payload.type", "string") == "token_count"))
    names = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
    total = F.struct(*[got(f"$.payload.info.total_token_usage.{c}", "bigint").alias(c) for c in names])
    has = sessions._is(got("$.payload.info.total_token_usage", "variant"), "OBJECT")
    window = got("$.payload.info.model_context_window", "bigint")
    last = told.groupBy("path").agg(F.max_by(total, F.when(has, F.col("idx"))).alias("t"), F.max_by(window, F.when(window.isNotNull(), F.col("idx"))).alias("context_window"), F.count(F.lit(1)).alias("counts"))
    return last.select("path", "t.*", "context_window", "counts")


def children(lines: DataFrame) -> DataFrame:
    """parent, child: rollouts that another one's thread started."""
    v = F.try_parse_json("line")
    got = lambda path: F.try_variant_get(v, path, "string")
    named = lines.where((got("$.type") == "session_meta") & (F.coalesce(got("$.payload.id"), F.lit("")) != ""))
    first = named.groupBy("path").agg(F.min_by(F.struct(got("$.payload.id").alias("id"), got("$.payload.parent_thread_id").alias("up")), "idx").alias("m"))
    up = first.select(F.col("path").alias("parent"), F.col("m.id").alias("id"))
    return first.select(F.col("path").alias("child"), F.col("m.up").alias("id")).where("id is not null").join(up, "id").select("parent", "child")


def _turns(marks: Column) -> Column:
    """Turns in the order in which they are first told, each with its last state, after all marks (what, turn_id, reason)."""
    kind = "array<struct<id string, state string, reason string>>"

    def told(turns: Column, m: Column) -> Column:
        opened = m.what == "task_started"
        state = F.struct(m.turn_id.alias("id"), F.when(opened, "open").when(m.what == "task_complete", "completed").otherwise("aborted").alias("state"), F.when(m.what == "turn_aborted", m.reason).alias("reason"))
        same = F.transform(turns, lambda t, k: F.when(t.id == m.turn_id, k))
        last_open = F.transform(turns, lambda t, k: F.when(t.state == "open", k))
        at = F.when(m.turn_id.isNotNull(), F.array_min(same)).when(~opened, F.array_max(last_open))
        put = F.transform(turns, lambda t, k: F.when(k == at, F.struct(t.id.alias("id"), state["state"].alias("state"), state["reason"].alias("reason"))).otherwise(t))
        return F.when(at.isNull(), F.concat(turns, F.array(state))).otherwise(put)

    return F.aggregate(marks, F.array().cast(kind), told)


def lifecycle(lines: DataFrame) -> DataFrame:
    """path, state, turn_id, reason, pending (call_id, name), is_waiting, last_ts of each rollout.

    The state is that of the last turn: open, completed or aborted; uninstrumented if work goes on behind the last end
    of a turn without a start, or if there are no turns at all; uninitialized without content. Pending are unanswered
    calls of open turns, those without a turn behind the open turn's start or, uninstrumented, behind the last end.
    """
    i = items(lines).withColumn("turn_id", F.when(F.col("item") == "event_msg", _text("$.payload.turn_id")).otherwise(_text("$.payload.internal_chat_message_metadata_passthrough.turn_id")))
    event, response, kind = F.coalesce(F.col("item") == "event_msg", F.lit(False)), F.coalesce(F.col("item") == "response_item", F.lit(False)), F.col("kind_of")
    starts, ends = event & (kind == "task_started"), event & kind.isin("task_complete", "turn_aborted")
    call_id = _text("$.payload.call_id")
    calls = response & ((kind.isin(*CALLS) & call_id.isNotNull() & _text("$.payload.name").isNotNull()) | ((kind == "tool_search_call") & call_id.isNotNull()))
    asked = (event & (kind == "user_message")) | (response & (kind == "message") & (_text("$.payload.role") == "user")) | calls
    mark = F.when(starts | ends, F.struct("idx", kind.alias("what"), "turn_id", _text("$.payload.reason").alias("reason")))
    work = F.when(asked, F.struct("idx", F.when(event, F.lit(None)).otherwise(F.col("turn_id")).alias("turn_id")))
    begun = F.when(starts, F.struct("idx", "turn_id"))
    of = i.groupBy("path").agg(
        _turns(F.array_sort(F.collect_list(mark))).alias("turns"), F.max(F.when(ends, F.col("idx"))).alias("ended"), F.max(F.when(starts, F.col("idx"))).alias("last_start"), F.collect_list(begun).alias("begun"), F.collect_list(work).alias("work"),
        F.max(response | event | F.coalesce(F.col("item") == "compacted", F.lit(False))).alias("content"), F.max("ts").alias("last_ts"),
    )
    known = F.transform("turns", lambda t: t.id)
    after = F.exists("work", lambda w: (w.idx > F.col("ended")) & (w.turn_id.isNull() | ~F.coalesce(F.array_contains(known, w.turn_id), F.lit(False))))
    loose = F.coalesce((F.coalesce(F.col("last_start"), F.lit(-1)) < F.col("ended")) & after, F.lit(False))
    last = F.try_element_at("turns", F.lit(-1))
    state = F.when(loose, "uninstrumented").when(last.isNotNull(), last["state"]).when(F.col("content"), "uninstrumented").otherwise("uninitialized")
    shown = ~loose & last.isNotNull()
    of = of.withColumn("state", state).withColumn("turn_id", F.when(shown, last["id"])).withColumn("reason", F.when(shown, last["reason"]))
    same = F.transform(F.filter("begun", lambda b: b.turn_id.eqNullSafe(F.col("turn_id"))), lambda b: b.idx)
    of = of.withColumn("start", F.when(F.col("state") == "open", F.when(F.col("turn_id").isNotNull(), F.array_min(same)).otherwise(F.array_max(same))))
    answered = i.where(response & kind.isin(*OUTPUTS, "tool_search_output") & call_id.isNotNull()).select("path", call_id.alias("call_id")).distinct()
    name = F.when(kind == "tool_search_call", "tool_search").otherwise(_text("$.payload.name"))
    open_calls = i.where(calls).select("path", "idx", call_id.alias("call_id"), name.alias("name"), F.col("turn_id").alias("of")).join(answered, ["path", "call_id"], "left_anti").join(of.select("path", "turns", "state", "ended", "start"), "path")
    own = F.try_element_at(F.transform(F.filter("turns", lambda t: t.id == F.col("of")), lambda t: t.state), F.lit(1))
    behind = (F.col("state") == "uninstrumented") & (F.col("ended").isNull() | (F.col("idx") > F.col("ended")))
    waits = F.when(F.col("of").isNull(), F.when(F.col("state") == "open", F.coalesce(F.col("idx") > F.col("start"), F.lit(False))).otherwise(behind)).when(own.isNull(), behind).otherwise(own == "open")
    pending = open_calls.where(waits).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "call_id", "name"))).alias("p"))
    out = of.join(pending, "path", "left")
    listed = F.coalesce(F.transform("p", lambda x: F.struct(x.call_id.alias("call_id"), x["name"].alias("name"))), F.array().cast("array<struct<call_id string, name string>>"))
    return out.select("path", "state", "turn_id", "reason", listed.alias("pending"), F.coalesce(F.exists("p", lambda x: x["name"].isin(*WAIT_TOOLS)), F.lit(False)).alias("is_waiting"), "last_ts")
