"""Verdict ledgers and metrics over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.plans.registry import query
from lorekeep.tables import table


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unjudged(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def judged(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "toxic")


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fp,
count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels""")
def verdict_metrics(spark, d):
    cell = lambda q, t, name: F.count(F.when((F.col("quality") == q) & (F.col("toxic") == t), 1)).alias(name)
    return table(spark, d, "labels").agg(F.count("*").alias("n"), cell(1, 1, "tp"), cell(1, 0, "fp"), cell(0, 1, "fn"), cell(0, 0, "tn"))


@query("SELECT a.doc_id FROM labels a JOIN documents d ON a.doc_id = d.doc_id WHERE a.quality = 1 AND a.toxic = 1")
def good_and_toxic(spark, d):
    return table(spark, d, "labels").where("quality = 1 AND toxic = 1").join(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id")
