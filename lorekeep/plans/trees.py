"""Queries over rollouts, trees of sessions and queues of notifications, each made of the driver's tables by stated rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators import deep, notices, session
from lorekeep.plans.registry import query
from lorekeep.plans.sessions import CALLS, EV, log
from lorekeep.sources import rollouts
from lorekeep.sources.sessions import events
from lorekeep.tables import table

BASE = 1_704_067_200


def rollout_lines(spark: SparkSession, d: str) -> DataFrame:
    """path, idx, line: each conversation as a rollout of five lines a turn behind its head.

    0 turn context (every third turn), 1 the message, 2 what the host echoes of it (in odd conversations another text),
    3 a call (assistants' turns 1, 4, ...) or the output of the turn before, 4 a count of tokens or a mark of a turn.
    """
    c = table(spark, d, "conversations").where("text is not null")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    stamp = lambda s: F.date_format(F.timestamp_seconds(F.lit(BASE) + F.col("conv_id") * 3600 + s), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def line(slot: int, kind: Column | str, payload: Column, when: Column) -> DataFrame:
        body = F.to_json(F.struct(stamp(turn * 50 + slot).alias("timestamp"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), payload.alias("payload")))
        return c.where(when).select(F.concat(F.lit("r"), conv).alias("path"), (1 + 5 * turn + slot).alias("idx"), body.alias("line"))

    heads = c.select("conv_id").distinct()
    up = F.when(F.col("conv_id") >= 3, F.concat(F.lit("th"), F.floor(F.col("conv_id") / 3).cast("string")))
    head = heads.select(F.concat(F.lit("r"), conv).alias("path"), F.lit(0).alias("idx"), F.to_json(F.struct(stamp(F.lit(0)).alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("th"), conv).alias("id"), F.lit("/home").alias("cwd"), up.alias("parent_thread_id")).alias("payload"))).alias("line"))
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    said = F.struct(F.lit("message").alias("type"), role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), "text"), F.struct(F.lit("text").alias("type"), F.lit("!").alias("text"))).alias("content"))
    whole = F.concat("text", F.lit("\n!"), F.when(F.col("conv_id") % 2 == 1, "?").otherwise(""))
    echo = F.struct(F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("type"), whole.alias("message"))
    agent, call = F.col("role") == "assistant", F.concat(F.lit("c"), conv, F.lit("-"))
    used = F.struct(F.lit("function_call").alias("type"), F.lit("exec_command").alias("name"), F.when(F.col("conv_id") % 2 == 0, "srv").alias("namespace"), F.lit('{"cmd":"ls"}').alias("arguments"), F.concat(call, turn.cast("string")).alias("call_id"))
    output = F.struct(F.lit("function_call_output").alias("type"), F.concat(call, (turn - 1).cast("string")).alias("call_id"), F.concat(F.lit('{"output":"done","metadata":{"exit_code":'), (F.col("conv_id") % 3).cast("string"), F.lit("}}")).alias("output"))
    count = F.struct(F.lit("token_count").alias("type"), F.struct(F.struct((turn * 100 + 7).alias("input_tokens"), (turn * 10).alias("total_tokens")).alias("total_token_usage")).alias("info"))
    mark = F.struct(F.when(F.col("role") == "user", "task_started").otherwise("task_complete").alias("type"), F.concat(F.lit("t"), (turn - F.when(agent, 1).otherwise(0)).cast("string")).alias("turn_id"))
    parts = [
        line(0, "turn_context", F.struct(F.concat(F.lit("/w/"), turn.cast("string")).alias("cwd"), F.concat(F.lit("m"), (turn % 2).cast("string")).alias("model")), turn % 3 == 1),
        line(1, "response_item", said, F.lit(True)),
        line(2, "event_msg", echo, F.col("role").isin("user", "assistant")),
        line(3, "response_item", used, agent & (turn % 3 == 1)),
        line(3, "response_item", output, F.col("role") == "user"),
        line(4, "event_msg", count, (F.col("conv_id") % 2 == 0) & agent),
        line(4, "event_msg", mark, (F.col("conv_id") % 2 == 1) & (F.col("role") != "system")),
    ]
    out = head
    for p in parts:
        out = out.unionByName(p)
    return out


#: Lines of rollouts that become events, and the rest by its type.
ROLL = """c AS (SELECT *, role = 'assistant' AS agent FROM conversations WHERE text IS NOT NULL),
ctx AS (SELECT conv_id, turn, '/w/' || turn AS cwd, 'm' || turn % 2 AS model FROM c WHERE turn % 3 = 1),
raw AS (SELECT conv_id, 0 AS idx, 0 AS turn, 'other' AS kind, 'session_meta' AS detail, NULL AS text, NULL AS tool, false AS is_meta FROM (SELECT DISTINCT conv_id FROM c)
 UNION ALL SELECT conv_id, 1 + 5 * turn, turn, 'other', 'turn_context', NULL, NULL, false FROM ctx
 UNION ALL SELECT conv_id, 2 + 5 * turn, turn, CASE WHEN agent THEN 'assistant' ELSE 'user' END, NULL, text || chr(10) || '!', NULL, role = 'system' FROM c
 UNION ALL SELECT e.conv_id, 3 + 5 * e.turn, e.turn, CASE WHEN h THEN 'other' WHEN agent THEN 'assistant' ELSE 'user' END, CASE WHEN h THEN CASE WHEN agent THEN 'agent_message' ELSE 'user_message' END END, CASE WHEN NOT h THEN said END, NULL, false
   FROM (SELECT *, text || chr(10) || '!' || CASE WHEN conv_id % 2 = 1 THEN '?' ELSE '' END AS said, EXISTS (SELECT 1 FROM c o WHERE o.conv_id = c.conv_id AND o.role = c.role AND o.text || chr(10) || '!' = c.text || chr(10) || '!' || CASE WHEN c.conv_id % 2 = 1 THEN '?' ELSE '' END) AS h FROM c WHERE role IN ('user', 'assistant')) e
 UNION ALL SELECT conv_id, 4 + 5 * turn, turn, 'assistant', NULL, '', CASE WHEN conv_id % 2 = 0 THEN 'mcp__srv__exec_command' ELSE 'exec_command' END, false FROM c WHERE agent AND turn % 3 = 1
 UNION ALL SELECT conv_id, 4 + 5 * turn, turn, 'user', NULL, '', CASE WHEN conv_id % 3 = 0 THEN 'done' ELSE 'failed' END, false FROM c WHERE role = 'user'
 UNION ALL SELECT conv_id, 5 + 5 * turn, turn, 'other', 'token_count', NULL, NULL, false FROM c WHERE agent AND conv_id % 2 = 0
 UNION ALL SELECT conv_id, 5 + 5 * turn, turn, 'other', CASE WHEN agent THEN 'task_complete' ELSE 'task_started' END, NULL, NULL, false FROM c WHERE role <> 'system' AND conv_id % 2 = 1)"""


@query(f"""WITH {ROLL} SELECT 'r' || conv_id AS path, idx, kind, detail, text, tool, is_meta,
 CASE WHEN kind <> 'other' THEN coalesce((SELECT arg_max(cwd, x.turn) FROM ctx x WHERE x.conv_id = raw.conv_id AND 1 + 5 * x.turn <= idx), '/home') END AS cwd,
 CASE WHEN kind = 'assistant' THEN coalesce((SELECT arg_max(model, x.turn) FROM ctx x WHERE x.conv_id = raw.conv_id AND 1 + 5 * x.turn <= idx), (SELECT arg_min(model, x.turn) FROM ctx x WHERE x.conv_id = raw.conv_id), 'unknown') END AS model FROM raw""")
def rollout_events(spark, d):
    """Items of rollouts as events: echoes stay other, folder and model are the last ones set."""
    e = rollouts.events(rollout_lines(spark, d))
    tool = F.coalesce(F.try_element_at("calls", F.lit(1))["name"], F.when(F.try_element_at("results", F.lit(1))["is_error"], "failed").otherwise(F.try_element_at("results", F.lit(1))["content"]))
    return e.select("path", "idx", "kind", "detail", "text", tool.alias("tool"), "is_meta", "cwd", "model")


@query("SELECT 'r' || conv_id AS path, max(turn) * 100 + 7 AS input_tokens, max(turn) * 10 AS total_tokens, count(*) AS counts FROM conversations WHERE text IS NOT NULL AND role = 'assistant' AND conv_id % 2 = 0 GROUP BY conv_id")
def rollout_usage(spark, d):
    """The last cumulative totals of each rollout."""
    return rollouts.usage(rollout_lines(spark, d)).select("path", "input_tokens", "total_tokens", "counts")


@query("SELECT DISTINCT 'r' || a.conv_id // 3 AS parent, 'r' || a.conv_id AS child FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id // 3 WHERE a.conv_id >= 3 AND a.text IS NOT NULL AND b.text IS NOT NULL")
def rollout_children(spark, d):
    return rollouts.children(rollout_lines(spark, d))


@query("""WITH c AS (SELECT *, conv_id % 2 = 1 AND role <> 'system' AS marks FROM conversations WHERE text IS NOT NULL),
t AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END AS t, min(turn) AS first, arg_max(CASE WHEN role = 'assistant' THEN 'completed' ELSE 'open' END, turn) AS state FROM c WHERE marks GROUP BY ALL),
l AS (SELECT conv_id, arg_max(t, first) AS t, arg_max(state, first) AS state FROM t GROUP BY conv_id),
e AS (SELECT conv_id, max(turn) FILTER (WHERE marks AND role = 'assistant') AS ended, max(turn) FILTER (WHERE marks AND role = 'user') AS started FROM c GROUP BY conv_id),
w AS (SELECT c.conv_id, bool_or(c.turn > e.ended AND (e.started IS NULL OR e.started < e.ended) AND (role = 'user' OR role = 'assistant' AND c.turn % 3 = 1)) AS loose FROM c JOIN e ON e.conv_id = c.conv_id GROUP BY c.conv_id)
SELECT 'r' || e.conv_id AS path, CASE WHEN coalesce(w.loose, false) OR l.state IS NULL THEN 'uninstrumented' ELSE l.state END AS state, CASE WHEN NOT coalesce(w.loose, false) THEN 't' || l.t END AS turn_id
FROM e LEFT JOIN l ON l.conv_id = e.conv_id LEFT JOIN w ON w.conv_id = e.conv_id""")
def rollout_lifecycle(spark, d):
    """Whether each rollout's last turn is open or completed; work behind the last end without a start is uninstrumented."""
    return rollouts.lifecycle(rollout_lines(spark, d)).select("path", "state", "turn_id")


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    """parent, child: conversation k hangs below k // 3, and every fifth leads back to k // 9, so there are cycles."""
    k = table(spark, d, "conversations").where("text is not null").select("conv_id").distinct()
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    down = k.where("conv_id > 0").select(name(F.floor(F.col("conv_id") / 3)).alias("parent"), name(F.col("conv_id")).alias("child"))
    back = k.where("conv_id % 5 = 0").select(name(F.col("conv_id")).alias("parent"), name(F.floor(F.col("conv_id") / 9)).alias("child"))
    return down.unionByName(back)


_TREE = """k AS (SELECT DISTINCT conv_id AS k FROM conversations WHERE text IS NOT NULL), ed AS (SELECT 'c' || k // 3 AS parent, 'c' || k AS child FROM k WHERE k > 0 UNION ALL SELECT 'c' || k, 'c' || k // 9 FROM k WHERE k % 5 = 0),
wk(root, node) AS (SELECT r, r FROM (VALUES ('c1'), ('c2'), ('c7')) v(r) UNION SELECT w.root, e.child FROM wk w JOIN ed e ON e.parent = w.node)"""


@query(f"WITH RECURSIVE {CALLS}, {_TREE} SELECT w.root, count(DISTINCT w.node) AS sessions, count(*) AS n_events, sum(ev.has_call::INT)::BIGINT AS n_calls FROM wk w JOIN ev ON ev.path = w.node GROUP BY w.root")
def deep_view(spark, d):
    """Sessions, events and calls of all that three roots lead to, over a tree with ways back."""
    roots = spark.createDataFrame([("c1",), ("c2",), ("c7",)], "node string")
    seen = deep.view(log(spark, d), deep.walk(tree_edges(spark, d), roots), roots)
    return seen.groupBy("root").agg(F.countDistinct("path").alias("sessions"), F.count(F.lit(1)).alias("n_events"), F.sum(F.size("calls")).cast("long").alias("n_calls"))


@query(f"WITH RECURSIVE {CALLS}, {_TREE}, i AS (SELECT w.root, cr.name, cr.file_path FROM wk w JOIN cr ON cr.path = w.node WHERE NOT cr.is_error) SELECT root, count(*) AS names, count(file_path) AS files, count(*) FILTER (WHERE name = 'Bash') AS commands, count(*) FILTER (WHERE name = 'Edit') AS edited FROM i GROUP BY root")
def deep_inputs(spark, d):
    """What predicates read of whole trees."""
    roots = spark.createDataFrame([("c1",), ("c2",), ("c7",)], "node string")
    seen = deep.view(session.calls(log(spark, d)), deep.walk(tree_edges(spark, d), roots), roots)
    return deep.inputs(seen, ["root"]).select("root", *[F.size(c).cast("long").alias(c) for c in ("names", "files", "commands", "edited")])


def queue_lines(spark: SparkSession, d: str) -> DataFrame:
    """path, idx, line: each user's events as steps of a queue; an item names its place, popAll those of 1, 2 and 7 places before."""
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_type", F.row_number().over(own).alias("k"))
    item = lambda k: F.concat(F.lit("<task-notification><tool-use-id>t"), k.cast("string"), F.lit("</tool-use-id>"))
    k, t = F.col("k"), F.col("event_type")
    step = F.when(t.isin("click", "purchase"), "enqueue").when(t == "error", "popAll").when(t == "signup", "remove").otherwise(F.when(k % 3 == 0, "dequeue").otherwise("peek"))
    content = F.when(step == "enqueue", item(k)).when(step == "popAll", F.concat_ws(" ", item(k - 1), item(k - 2), item(k - 7)))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), k.alias("idx"), F.to_json(F.struct(F.lit("queue-operation").alias("type"), step.alias("operation"), content.alias("content"))).alias("line"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, k, CASE WHEN t IN ('click', 'purchase') THEN 'enqueue' WHEN t = 'error' THEN 'popAll' WHEN t = 'signup' OR k % 3 = 0 THEN 'dequeue' ELSE 'peek' END AS op FROM e),
f(user_id, k, queue) AS (SELECT user_id, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT user_id FROM s) UNION ALL
 SELECT f.user_id, s.k, CASE s.op WHEN 'enqueue' THEN list_append(f.queue, s.k) WHEN 'dequeue' THEN f.queue[2:] WHEN 'popAll' THEN list_filter(f.queue, lambda x: x NOT IN (s.k - 1, s.k - 2, s.k - 7)) ELSE f.queue END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
SELECT 'u' || f.user_id AS path, coalesce(list_aggregate(list_transform(arg_max(f.queue, f.k), lambda x: 't' || x), 'string_agg', ','), '') AS queued, (SELECT count(*) FROM s WHERE s.user_id = f.user_id AND op = 'enqueue') AS enqueued,
 (SELECT count(*) FROM s WHERE s.user_id = f.user_id AND op = 'enqueue') - len(arg_max(f.queue, f.k)) AS completed FROM f GROUP BY f.user_id""")
def notification_queue(spark, d):
    """What still waits in each session's queue, and how many calls are told of."""
    q = notices.queues(events(queue_lines(spark, d)))
    done = notices.completed(q).groupBy("path").agg(F.count(F.lit(1)).alias("completed"))
    ids = F.array_join(F.transform("queued", lambda x: F.regexp_extract(x, "(t[0-9]+)<", 1)), ",")
    return q.select("path", ids.alias("queued"), F.size("enqueued").cast("long").alias("enqueued")).join(done, "path", "left").withColumn("completed", F.coalesce("completed", F.lit(0)))


@query(f"WITH {EV} SELECT count(*) AS n, count(*) FILTER (WHERE idx = 0) AS firsts FROM ev")
def both_hosts(spark, d):
    """Files of both hosts read by one call, each as its first line tells; counted are those of transcripts."""
    from lorekeep.plans.sessions import lines

    e = rollouts.either(lines(spark, d).unionByName(rollout_lines(spark, d))).where("not rollout")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("idx") == 0, 1)).alias("firsts"))
