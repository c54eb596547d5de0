"""Operators on empty tables, repeated and null ids, clashing columns and labels of one class."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import caps, crf, feistel, packing, tokenfiles, toxicity
from lorekeep.llm.tokens import encoder

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "en", len(t or "")) for i, t in rows], DOCS)


def test_token_files_of_no_rows_and_of_repeated_and_null_ids(spark):
    assert tokenfiles.token_files(docs_of(spark, [])).count() == 0
    rows = [(3, "three words here"), (1, None), (3, "three words here"), (None, "no id"), (2, "")]
    got = tokenfiles.token_files(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    encode = encoder()
    for i, text in rows:
        ids = np.array([*np.frombuffer(encode(text or ""), "<u4"), 0], "<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) in {(r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i}
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]


def test_packing_and_pseudonyms_of_no_rows(spark):
    assert packing.pack_documents(docs_of(spark, [])).count() == 0
    assert feistel.pseudonymise(docs_of(spark, []), b"k").count() == 0


def test_languages_of_no_rows_and_of_repeated_ones(spark):
    words = {"aa": "baba bobo bubu", "bb": "tete titi toto"}
    rows = [(100 * k + i, words[lang], lang) for k, lang in enumerate(words) for i in range(30)]
    model = crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "baba " * 3000, "x", 5.0), (1, "baba", "x", 5.0), (1, "baba", "x", 5.0), (None, "titi", None, 5.0), (2, None, None, 5.0), (3, "12 !?", None, 5.0)], "doc_id long, text string, lang_pred string, score double")
    got = crf.identify(odd, model).select("doc_id", "lang_pred").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "aa"), (1, "aa"), (1, "aa"), (None, "bb"), (2, "und"), (3, "und")], key=str)
    assert crf.identify(odd.where("false"), model).count() == 0


def test_caps_with_columns_of_its_own_names(spark):
    rows = [(1, [1.0, 0.0], 1, 9, 9, 9), (2, [1.0, 0.01], 1, 9, 9, 9), (3, [0.0, 1.0], 1, 9, 9, 9)]
    got = caps.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, vec int, copies int, dim int"))
    assert sorted((r.vec_id, r.component_id, r.n_links) for r in got.collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_class_still_score_every_row(spark, toxic):
    docs = docs_of(spark, [(k, f"word{k % 7} and more {k}") for k in range(60)] + [(None, None), (70, "")])
    labels = spark.createDataFrame([(k, toxic) for k in range(60)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 62 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    own = ("_id", "row", "copy", "place", "n_values", "digest", "node")
    docs = docs_of(spark, [(k, f"text number {k} of the table with some words {k * 7}") for k in range(40)])
    for c in own:
        docs = docs.withColumn(c, F.lit(-1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.where(" or ".join(f"{c} != -1" for c in own)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
