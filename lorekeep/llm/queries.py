"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import caps, crf, divergence, feistel, jaccard, mixing, packing, simhash, tokenfiles, toxicity, vamana, warc, whitening
from lorekeep.tables import table


#: For the test tables only: whoever has a key can invert the pseudonyms made with it.
TEST_KEY = b"pseudonyms"


def pii_key() -> bytes:
    """The key of the driver's environment, else the one for test tables."""
    return os.environ.get("LOREKEEP_PII_KEY", "").encode() or TEST_KEY


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target rate gives, in global random order."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.EQUAL)
    return mixed.select("doc_id", "source", "copy", "place")


def op3_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vamana.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.identify(docs, crf.fit(docs))


def op5_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_copies(table(spark, sf_dir, "embeddings"), limit=0.93)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise(table(spark, sf_dir, "documents"), pii_key()).select("doc_id", "text", "n_values")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_documents(table(spark, sf_dir, "documents"), radius=8)


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, ranks=50)


QUERIES = {f.__name__: f for f in (op1_warc, op2_poisson_mixing, op3_pruned_graph, op4_language_crf, op5_spherical_caps, op6_best_fit_packing, op7_toxicity, op8_ngram_jaccard, op9_feistel_pseudonyms, op10_token_files, op11_simhash, op12_tsqr_whitening, op13_source_divergence)}
#: Tokenizers, trained models, keyed permutations and binary files are beyond SQL; the tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op1_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM p LEFT JOIN k ON p.h = k.h""",
    "op13_source_divergence": divergence.SQL,
}
