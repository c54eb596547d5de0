"""Joins and aggregations over timed events, and over calls with their results (orders and lineitems)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import timed
from lorekeep.plans.registry import query
from lorekeep.tables import table


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def stats_span(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""WITH o AS (SELECT user_id, epoch_us(ts) AS us, (min(epoch_us(ts)) OVER (PARTITION BY user_id) // 180000000) * 180000000 AS origin FROM events)
SELECT user_id, (us - origin) // 180000000 AS bucket, count(*) AS n, min(us) AS first_us FROM o GROUP BY ALL""")
def buckets_3min(spark, d):
    return timed.buckets(table(spark, d, "events"), "user_id", "ts", 180)


@query("""SELECT p.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS click_id FROM (SELECT * FROM events WHERE event_type='purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type='click') c ON c.user_id = p.user_id AND c.ts <= p.ts GROUP BY p.event_id""")
def asof_preceding(spark, d):
    ev = table(spark, d, "events")
    hits = timed.as_of(ev.where("event_type = 'purchase'"), ev.where("event_type = 'click'"), "user_id", "ts", "event_id")
    return hits.select("event_id", F.col("match_id").alias("click_id"))


@query("""SELECT e.event_id, count(s.event_id) AS signups FROM (SELECT * FROM events WHERE event_type='error') e
LEFT JOIN (SELECT * FROM events WHERE event_type='signup') s ON s.user_id = e.user_id AND epoch_us(s.ts) BETWEEN epoch_us(e.ts) - 86400000000 AND epoch_us(e.ts) GROUP BY e.event_id""")
def edit_lookback(spark, d):
    ev = table(spark, d, "events")
    return timed.count_within(ev.where("event_type in ('error','signup')"), "user_id", "ts", F.col("event_type") == "signup", 86400).where("event_type = 'error'").select("event_id", F.col("hits").alias("signups"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_event(spark, d):
    return timed.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY ALL")
def session_gaps(spark, d):
    s = timed.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 21600)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("SELECT o.o_orderkey, l.l_linenumber, l.l_partkey FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS l_linenumber, arg_max(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey")
def call_result_last_wins(spark, d):
    last = timed.latest(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], ["l_linenumber", "l_partkey"])
    calls = table(spark, d, "orders").select("o_orderkey")
    return calls.join(last, calls.o_orderkey == last.l_orderkey, "left").select("o_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unresolved_calls(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_quantity > 40) AS large FROM lineitem GROUP BY l_returnflag")
def flag_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_quantity") > 40, 1)).alias("large"))
