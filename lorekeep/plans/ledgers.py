"""Queries over ledgers: inserts, upserts, matches in time, verdicts and samples on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.operators import ledger
from lorekeep.plans.registry import query
from lorekeep.tables import table


@query("WITH n AS (SELECT l_orderkey % 500 AS k, l_linenumber, l_partkey FROM lineitem) SELECT k, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM n WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY k")
def insert_or_ignore(spark, d):
    """Rows that an insert adds: the first of each key that the target lacks."""
    target = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"))
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("k"), "l_linenumber", "l_partkey")
    return ledger.insert_or_ignore(target, rows, ["k"], ["l_linenumber", "l_partkey"]).select("k", "l_partkey")


@query("""WITH o AS (SELECT doc_id AS dedup_key, CASE WHEN doc_id % 3 = 0 THEN 'summary' ELSE 'full' END AS fidelity, lang AS category FROM documents WHERE doc_id % 2 = 0),
n AS (SELECT doc_id AS dedup_key, CASE WHEN doc_id % 5 = 0 THEN 'summary' ELSE 'full' END AS fidelity, source AS category FROM documents WHERE doc_id % 4 <> 1)
SELECT coalesce(o.dedup_key, n.dedup_key) AS dedup_key, CASE WHEN o.dedup_key IS NULL OR (n.dedup_key IS NOT NULL AND o.fidelity = 'summary' AND n.fidelity = 'full') THEN n.fidelity ELSE o.fidelity END AS fidelity,
CASE WHEN o.dedup_key IS NULL OR (n.dedup_key IS NOT NULL AND o.fidelity = 'summary' AND n.fidelity = 'full') THEN n.category ELSE o.category END AS category FROM o FULL JOIN n ON o.dedup_key = n.dedup_key""")
def verdict_upsert(spark, d):
    """A full verdict replaces a summary; other repeats are ignored."""
    docs = table(spark, d, "documents")
    told = lambda rows, every, category: rows.select(F.col("doc_id").alias("dedup_key"), F.lit("judge").alias("role"), F.lit(1).alias("prompt_version"), F.when(F.col("doc_id") % every == 0, "summary").otherwise("full").alias("fidelity"), F.col(category).alias("category"))
    return ledger.record_verdicts(told(docs.where("doc_id % 2 = 0"), 3, "lang"), told(docs.where("doc_id % 4 != 1"), 5, "source")).select("dedup_key", "fidelity", "category")


@query("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id, event_type")
def heartbeat_upsert(spark, d):
    """Two batches of heartbeats put into one ledger: counts add up, the first and the last time stay."""
    ev = table(spark, d, "events")
    beat = lambda rows: rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    before, now = beat(ev.where("event_id % 2 = 0")), beat(ev.where("event_id % 2 = 1"))
    return before.unionByName(now).groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


_NEAR = """SELECT p.event_id, arg_max(c.event_id, ({gap}, c.event_id)) AS match_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.user_id = p.user_id AND {cond} GROUP BY p.event_id"""


@query(_NEAR.format(gap="-(epoch_us(p.ts) - epoch_us(c.ts))", cond="epoch_us(p.ts) - epoch_us(c.ts) BETWEEN 0 AND 86400000000"))
def asof_within(spark, d):
    """The last click of the day before each purchase."""
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return ledger.nearest_before(ev.where("event_type = 'purchase'"), ev.where("event_type = 'click'"), ["user_id"], "ts", "event_id", 86400).select("event_id", "match_id")


@query(_NEAR.format(gap="-abs(epoch_us(p.ts) - epoch_us(c.ts))", cond="abs(epoch_us(p.ts) - epoch_us(c.ts)) <= 43200000000"))
def asof_nearest(spark, d):
    """The click nearest to each purchase, on either side within half a day."""
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return ledger.nearest_before(ev.where("event_type = 'purchase'"), ev.where("event_type = 'click'"), ["user_id"], "ts", "event_id", 43200, either=True).select("event_id", "match_id")


@query("SELECT doc_id, quality AS before, toxic AS after FROM labels WHERE quality <> toxic")
def flip_pairs(spark, d):
    """Documents that two passes judged differently."""
    l = table(spark, d, "labels")
    return ledger.flips(l.select("doc_id", F.col("quality").alias("side")), l.select("doc_id", F.col("toxic").alias("side")), "doc_id", "side")


@query("SELECT d.doc_id, d.doc_id % 2 AS expected, l.quality::BIGINT AS actual, l.quality IS NULL AS missing, coalesce(d.doc_id % 2 = l.quality, false) AS agrees FROM documents d LEFT JOIN labels l USING (doc_id)")
def golden_gate(spark, d):
    """Expected sides against the actual ones."""
    expected = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 2).alias("side"))
    return ledger.gate(expected, table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("side")), "doc_id", "side")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fn FROM labels)
SELECT n, tp / nullif(tp + fp, 0)::DOUBLE AS precision, fp / nullif(tp + fp, 0)::DOUBLE AS contamination, tp / nullif(tp + fn, 0)::DOUBLE AS recall FROM c""")
def verdict_rates(spark, d):
    return ledger.metrics(table(spark, d, "labels"), "quality", "toxic")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS dr FROM documents), w AS (SELECT lang, doc_id, CASE WHEN dr <= 2 THEN 'doubtful' ELSE 'uniform' END AS why FROM r)
SELECT lang, doc_id, why FROM w QUALIFY why = 'doubtful' OR row_number() OVER (PARTITION BY lang, why ORDER BY sha256('7:' || doc_id::VARCHAR)) <= 3""")
def audit_strata(spark, d):
    """Of each language the two least certain rows and three others."""
    return ledger.audit_sample(table(spark, d, "documents"), ["lang"], 3, "doc_id", "n_chars", 2).select("lang", "doc_id", "why")


_UNIT = """v AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY label, i),
u AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS u FROM c)"""


@query(f"WITH {_UNIT} SELECT a.label AS a, b.label AS b, round(sum(a.u * b.u), 6) AS similarity FROM u a JOIN u b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label HAVING sum(a.u * b.u) > 0.05")
def centroid_overlap(spark, d):
    """Pairs of labels whose normalised mean vectors are alike."""
    return ledger.alike_keys(table(spark, d, "embeddings"), "label", "embedding", 0.05).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) SELECT label, round(max(score), 6) AS best, string_agg(vec_id::VARCHAR, ',' ORDER BY r) AS evidence FROM r WHERE r <= 3 GROUP BY label""")
def key_suggestions(spark, d):
    """Each label's best likeness to one vector, with up to three rows as evidence."""
    e = table(spark, d, "embeddings")
    probe = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("probe")))
    scored = e.where("vec_id != 0").join(probe).select("label", "vec_id", tx.cosine(F.col("embedding"), F.col("probe")).alias("score"))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).where("r <= 3")
    ids = F.array_sort(F.collect_list(F.struct("r", F.col("vec_id").cast("string").alias("v"))))
    return top.groupBy("label").agg(F.round(F.max("score"), 6).alias("best"), F.array_join(F.transform(ids, lambda x: x.v), ",").alias("evidence"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderdate > TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey")
def ledger_since(spark, d):
    """One key's rows strictly later than a time, in order."""
    return table(spark, d, "orders").where((F.col("o_custkey") == 7) & (F.col("o_orderdate") > F.lit("1995-01-01").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS last_good, count(*) FILTER (WHERE event_type <> 'error') AS n FROM events GROUP BY user_id")
def last_cumulative(spark, d):
    """The last row that counts, and how many do."""
    good = F.col("event_type") != "error"
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.when(good, F.struct("ts", "event_id"))).alias("last_good"), F.count(F.when(good, 1)).alias("n"))


def corrections(spark, d):
    """Orders as a ledger of corrections."""
    k = F.col("o_orderkey")
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    rows = table(spark, d, "orders").select(k.cast("long").alias("id"), (k * 37 % 100_000).cast("long").alias("ts_ms"), text("s", k % 11).alias("session_id"), text("u", k % 5).alias("anchor_uuid"), F.concat(F.lit('{"name":"r'), (k % 3).cast("string"), F.lit('"}')).alias("repo"), text("d", k % 97).alias("incorrect_digest"), F.lit("x").alias("text"))
    return ledger.same_schema(rows, ledger.CORRECTIONS)


@query("SELECT o_orderkey AS id, o_orderkey * 37 % 100000 AS ts_ms FROM orders WHERE o_orderkey % 11 = 7 AND o_orderkey % 3 = 1 AND o_orderkey * 37 % 100000 > 20000 ORDER BY 2, 1 LIMIT 20 OFFSET 5")
def ledger_page(spark, d):
    """A page of one session's corrections in one repository behind a time."""
    return ledger.paged(ledger.selected(corrections(spark, d), session="s7", repo="r1", since=20_000), 20, 5).select("id", "ts_ms")


@query("SELECT o.o_orderkey AS id, s.s_suppkey AS decision_id FROM orders o JOIN supplier s ON s.s_suppkey % 97 = o.o_orderkey % 97 WHERE o.o_orderkey * 37 % 100000 BETWEEN 500 AND 2500 AND o.o_orderkey % 11 = 3")
def ledger_decisions(spark, d):
    """Corrections of a span of time, both ends included, with decisions on the same digest."""
    made = table(spark, d, "supplier").select(F.col("s_suppkey").alias("decision_id"), F.concat(F.lit("d"), (F.col("s_suppkey") % 97).cast("string")).alias("tool_digest"), F.lit("no").alias("verdict"))
    return ledger.with_decisions(ledger.selected(corrections(spark, d), session="s3", between=(500, 2500)), made).select("id", "decision_id")
