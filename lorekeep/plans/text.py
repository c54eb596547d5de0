"""Search and dedup over texts, scalar functions, and vector retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.plans.registry import query
from lorekeep.tables import table


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(the|und|les)\\b')) AS hits FROM documents WHERE regexp_matches(text, '(?i)\\b(the|und|les)\\b')")
def grep_hits(spark, d):
    p = tx.whole_words("the", "und", "les")
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(p)).cast("long").alias("hits")).where("hits > 0")


@query("SELECT doc_id, i::INT AS line, s AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(s, '\\bthe\\b')")
def grep_lines(spark, d):
    return tx.matching_lines(table(spark, d, "documents"), "doc_id", "text", r"\bthe\b")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def corpus_dedup(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("SELECT doc_id, sha256(lang || chr(0) || source) AS key FROM documents")
def dedup_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat("lang", F.lit("\0"), "source"), 256).alias("key"))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 39) || '…' END AS clip FROM documents")
def clip(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clip(F.col("text"), 40).alias("clip"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slug(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("""WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM v GROUP BY label, i) SELECT label, round(sqrt(sum(m*m)), 6) AS norm FROM c GROUP BY label""")
def centroid_norms(spark, d):
    v = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    c = v.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return c.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> 0)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    probe = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("probe")))  # one row, or none
    scored = e.where("vec_id != 0").join(probe).select("vec_id", F.round(tx.cosine(F.col("embedding"), F.col("probe")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id::VARCHAR)) <= 3")
def audit_sample(spark, d):
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256))
    return table(spark, d, "documents").select("lang", "doc_id", F.row_number().over(w).alias("r")).where("r <= 3").drop("r")
