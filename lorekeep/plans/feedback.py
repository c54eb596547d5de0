"""Queries over questions, review comments, seeded windows and audits, made of the driver's tables by stated rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import mining, questions, review, sampling, session
from lorekeep.plans.registry import query
from lorekeep.plans.sessions import EV, TURNED, log
from lorekeep.sources.sessions import events
from lorekeep.tables import table

STAMP = "2024-01-01T00:00:00Z"


def asked_lines(spark: SparkSession, d: str) -> DataFrame:
    """path, idx, line: assistants' turns 1, 4, ... ask a question, which a user's next turn answers as its conversation's number says.

    Other users' turns type a review comment of two lines.
    """
    c = table(spark, d, "conversations").where("text is not null and role in ('user', 'assistant')")
    before = c.where("role = 'assistant' and turn % 3 = 1").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("asked"))
    c = c.join(before, ["conv_id", "turn"], "left")
    conv, turn, last = F.col("conv_id").cast("string"), F.col("turn").cast("string"), (F.col("turn") - 1).cast("string")
    head = [F.concat(F.lit("q"), conv, F.lit("-"), turn).alias("uuid"), F.concat(F.lit("s"), conv).alias("sessionId"), F.lit(STAMP).alias("timestamp")]
    option = lambda x: F.struct(x.alias("label"))
    ask = F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("a"), turn).alias("id"), F.lit(questions.ASK).alias("name"), F.struct(F.array(F.struct(F.concat(F.lit("Q"), turn, F.lit("?")).alias("question"), F.array(option(F.concat(F.lit("A"), turn)), option(F.lit("B, C (Recommended)"))).alias("options"))).alias("questions")).alias("input"))
    n = F.col("conv_id") % 5
    told = F.when(n == 0, F.concat(F.lit('"A'), last, F.lit('"'))).when(n == 1, '"B, C (Recommended)"').when(n == 2, '"2"').when(n == 3, F.concat(F.lit('"because I said '), conv, F.lit('"'))).otherwise(questions.NOTHING + questions.NOTES + "maybe later on")
    banner = F.concat(F.lit(questions.ANSWERED + '"Q'), last, F.lit('?"='), told, F.lit(questions.ANSWERED_END))
    result = F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("a"), last).alias("tool_use_id"), banner.alias("content"))
    typed = F.concat(F.lit("src/m"), (F.col("conv_id") % 7).cast("string"), F.lit(".py:"), turn, F.lit("-"), (F.col("turn") + 2).cast("string"), F.lit(": not as we agreed\nand so on"))
    asks = (F.col("role") == "assistant") & (F.col("turn") % 3 == 1)
    said = F.struct(F.lit("text").alias("type"), F.lit("ok").alias("text"))
    agent = lambda block: F.to_json(F.struct(F.lit("assistant").alias("type"), *head, F.struct(F.lit("m").alias("model"), F.array(block).alias("content")).alias("message")))
    person = lambda content: F.to_json(F.struct(F.lit("user").alias("type"), *head, F.struct(content.alias("content")).alias("message")))
    line = F.when(asks, agent(ask)).when(F.col("role") == "assistant", agent(said)).when(F.col("asked"), person(F.array(result))).otherwise(person(typed))
    return c.select(F.concat(F.lit("f"), conv).alias("path"), F.col("turn").alias("idx"), line.alias("line"))


_ANSWERED = """u AS (SELECT c.conv_id, c.turn FROM conversations c WHERE c.text IS NOT NULL AND c.role = 'user' AND EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn = c.turn - 1 AND a.role = 'assistant' AND a.turn % 3 = 1 AND a.text IS NOT NULL))"""


@query(f"""WITH {_ANSWERED} SELECT 'f' || conv_id AS path, turn AS idx, 'Q' || (turn - 1) || '?' AS question,
 CASE conv_id % 5 WHEN 0 THEN 'A' || (turn - 1) WHEN 1 THEN 'B, C (Recommended)' WHEN 2 THEN '2' WHEN 3 THEN 'because I said ' || conv_id ELSE 'maybe later on' END AS text, conv_id % 5 IN (0, 1, 2) AS option_pick, conv_id % 5 IN (1, 2) AS recommended FROM u""")
def answered_questions(spark, d):
    """What was answered to each question, picks apart from free words."""
    a = questions.answers(session.with_turns(events(asked_lines(spark, d))))
    return a.select("path", "idx", "question", F.coalesce("notes", "answer").alias("text"), "option_pick", "recommended")


@query(f"WITH {_ANSWERED} SELECT 'f' || conv_id AS path, turn AS idx, CASE WHEN conv_id % 5 < 3 THEN 0.25 WHEN conv_id % 5 = 3 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence, turn - 1 AS trigger_idx FROM u")
def mine_questions(spark, d):
    return mining.question_answers(session.with_turns(events(asked_lines(spark, d)))).select("path", "idx", "confidence", "trigger_idx")


@query(f"""WITH {_ANSWERED} SELECT 'f' || conv_id AS path, turn AS idx, 'src/m' || conv_id % 7 || '.py' AS file, turn AS line_start, turn + 2 AS line_end, 'not as we agreed' AS comment FROM conversations c
WHERE text IS NOT NULL AND role = 'user' AND NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = c.conv_id AND u.turn = c.turn)""")
def review_comments(spark, d):
    """Comments with file and lines that users typed."""
    found = review.comments(session.with_turns(events(asked_lines(spark, d))), **mining.REVIEW)
    return found.select("path", "idx", "file", "line_start", "line_end", "comment")


@query("SELECT 'd' || page_id AS path, page_id AS line, 'b' || page_id % 3 AS comment FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'd' || page_id, page_id, 'c' FROM pages WHERE page_id % 2 = 0")
def review_json(spark, d):
    """Two comments of a JSON result of every second page, by the table function."""
    p = table(spark, d, "pages").where("page_id % 2 = 0")
    item = lambda text: F.struct(F.col("page_id").alias("line"), text.alias("comment"))
    payload = F.to_json(F.struct(F.struct(F.array(item(F.concat(F.lit("b"), (F.col("page_id") % 3).cast("string"))), item(F.lit("c"))).alias("findings")).alias("result")))
    user = F.to_json(F.struct(F.lit("user").alias("type"), F.lit("u").alias("uuid"), F.lit("s").alias("sessionId"), F.lit(STAMP).alias("timestamp"), F.struct(payload.alias("content")).alias("message")))
    lines = p.select(F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("path"), F.lit(0).alias("idx"), user.alias("line"))
    found = review.comments(session.with_turns(events(lines)), structured=[review.InJson("json")])
    return found.select("path", F.col("line_start").alias("line"), "comment")


_M = "18446744073709551616::UHUGEINT"


@query(f"""WITH RECURSIVE {TURNED}, tt AS (SELECT path, conv_id, turn, arg_min(uuid, idx) AS uuid FROM tu GROUP BY ALL), ex AS (SELECT DISTINCT path, turn FROM tu WHERE is_meta),
cand AS (SELECT * FROM tt WHERE turn < (SELECT max(turn) FROM tt x WHERE x.path = tt.path) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.path = tt.path AND ex.turn - tt.turn BETWEEN 0 AND 1)),
li AS (SELECT path, list(uuid ORDER BY turn) AS pool, sha256('0:s' || conv_id) AS h FROM cand GROUP BY path, conv_id),
r(path, i, st, pool) AS (SELECT path, 0, ('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT, pool FROM li UNION ALL
 SELECT path, i + 1, s2, list_transform(range(1, len(pool) + 1), lambda k: CASE k WHEN i + 1 THEN pool[j + 1] WHEN j + 1 THEN pool[i + 1] ELSE pool[k] END) FROM (SELECT *, (i + xor(z2, z2 >> 31) % (len(pool) - i)::UBIGINT)::BIGINT AS j FROM
  (SELECT *, (xor(z1, z1 >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % {_M})::UBIGINT AS z2 FROM (SELECT *, (xor(s2, s2 >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % {_M})::UBIGINT AS z1 FROM
   (SELECT *, ((st::UHUGEINT + 11400714819323198485::UHUGEINT) % {_M})::UBIGINT AS s2 FROM r WHERE i < 2 AND i < len(pool))))))
SELECT path, unnest(pool[:2]) AS uuid FROM (SELECT path, arg_max(pool, i) AS pool FROM r GROUP BY path)""")
def negative_windows(spark, d):
    """Two turns of each session, drawn by its name, but for its last, those with meta events and those before them."""
    t = log(spark, d)
    return sampling.negative_windows(t, 2, t.where("is_meta").select("uuid"), radius=1).select("path", "uuid")


@query(f"""WITH {EV}, {TURNED.removeprefix(EV)[2:]}, tt AS (SELECT path, turn FROM tu GROUP BY ALL) SELECT a.path, a.turn, (SELECT count(*) FROM tt b WHERE b.path = a.path AND b.turn BETWEEN a.turn - 2 AND a.turn - 1) AS before, (SELECT count(*) FROM tt b WHERE b.path = a.path AND b.turn = a.turn + 1) AS after FROM tt a""")
def turn_windows(spark, d):
    """How many of two turns before and one after each turn there are."""
    t = session.turns(log(spark, d))
    return sampling.around(t, t.select("path", "turn"), before=2, after=1).select("path", "turn", F.size("before").cast("long").alias("before"), F.size("after").cast("long").alias("after"))


@query("""WITH j AS (SELECT d.source AS kind, l.quality = 1 AS accepted, d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL), s AS (SELECT accepted, kind, count(*) AS size FROM j GROUP BY ALL),
t AS (SELECT accepted, kind, least(size, 8) AS take, size FROM s WHERE kind IN (SELECT DISTINCT source FROM documents ORDER BY 1 LIMIT 3)),
p AS (SELECT accepted, kind, CASE WHEN take = size THEN take ELSE take - 2 END AS core, CASE WHEN take = size THEN 0 ELSE 2 END AS over FROM t)
SELECT accepted, kind, 'core' AS part, core AS n FROM p UNION ALL SELECT accepted, kind, 'oversample', over FROM p WHERE over > 0""")
def audit_draw(spark, d):
    """Eight rows of each of three kinds and sides, a quarter of them the least confident."""
    docs = table(spark, d, "documents")
    kinds = [r.source for r in docs.select("source").distinct().orderBy("source").limit(3).collect()]
    judged = docs.join(table(spark, d, "labels"), "doc_id").where("quality is not null").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key"), F.col("source").alias("kind"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 100 / 100).alias("confidence"), (F.col("quality") == 1).alias("accepted"))
    drawn = sampling.audit(judged, 0, 0, dict.fromkeys(kinds, 8), "", share=0.25)
    return drawn.groupBy("accepted", "kind", "part").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH j AS (SELECT d.source AS kind, l.quality = 1 AS accepted, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL),
c AS (SELECT count(*) AS judged, count(*) FILTER (WHERE accepted) AS accepted, avg(1.0 - toxic) FILTER (WHERE accepted) AS p, avg(1.0 - toxic) FILTER (WHERE NOT accepted) AS c FROM j)
SELECT judged, accepted, round(p, 9)::DOUBLE AS precision, round(c, 9)::DOUBLE AS contamination, round(accepted * p / (accepted * p + (judged - accepted) * c), 9)::DOUBLE AS recall_hat FROM c""")
def audit_rates(spark, d):
    """What labels tell of a judgement: precision, contamination, and the recall they let expect."""
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality is not null and toxic is not null").select(F.monotonically_increasing_id().alias("key"), (F.col("quality") == 1).alias("accepted"), (F.col("toxic") == 0).alias("genuine"))
    from lorekeep.shared import written

    rows = written(both, "judged")
    r = sampling.audited_rates(rows, rows)
    return r.select("judged", "accepted", *[F.round(c, 9).alias(c) for c in ("precision", "contamination", "recall_hat")])


@query("SELECT d.source AS kind, count(*) AS judged, count(*) FILTER (WHERE l.quality = 1) AS accepted FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL GROUP BY d.source")
def verdicts_by_kind(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return sampling.by_kind(both.select(F.col("source").alias("kind"), (F.col("quality") == 1).alias("accepted"))).where("judged > 0")
