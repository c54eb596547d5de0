"""Documents to packed training sequences: filter, deduplicate, pseudonymise, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a table that is written before the next stage reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import feistel, jaccard, mixing, packing, toxicity
from lorekeep.llm.queries import pii_key
from lorekeep.llm.store import written
from lorekeep.tables import table


def beside(docs: DataFrame, names: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents' columns behind an operator that adds columns of these names, which documents may have as well."""
    own = {c: f"{c}_of_documents" for c in docs.columns if c.lower() in names}
    return operator(docs.withColumnsRenamed(own)).drop(*names).withColumnsRenamed({v: c for c, v in own.items()}).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; every row is judged by its own text."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each class of near copies; five-word shingles, similarity 0.8.

    Rows are told apart by id and text, so a near copy goes even if its id has another text as well. Equal rows stay
    once. Rows without an id come behind those with one, in the order of their texts' digests.
    """
    return jaccard.one_of_each(docs, words=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced; n_chars follows the new text."""
    swapped = beside(docs, ("n_values",), lambda d: feistel.pseudonymise(d, pii_key()))
    return swapped.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate gives, in random order."""
    return beside(docs, ("copy", "place"), lambda d: mixing.mix(d, mixing.EQUAL))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_filter), ("ngram_jaccard", jaccard_dedup), ("pii", pseudonyms), ("mixing", mix_sources), ("packing", pack)]
#: Trained models, keyed permutations and tokenizers are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
