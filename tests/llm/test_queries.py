"""Whole queries against plain versions on small tables, with nulls, empty texts, ties, repeated rows and clashing columns."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import crf, feistel, mixing, packing, queries, tokenfiles, toxicity
from lorekeep.llm.tokens import vocabulary_path

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def uniform(*parts):
    import hashlib

    return (int(hashlib.md5("\x1f".join("\x00" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def plain_poisson(rate, u):
    import math

    k, p = 0, math.exp(-rate)
    cdf = p
    while cdf < u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_mixing_equals_a_plain_version(spark):
    rows = [(i, f"t{i}", "abc"[min(2, i % 5)] if i % 7 else None) for i in range(300)] + [(3, "t3", "c"), (3, "t3", "c"), (None, "x", "a"), (None, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit(-1.0)).withColumn("of", F.lit("zz")).withColumn("rows", F.lit(0)).withColumn("copy", F.lit(-5)).withColumn("place", F.lit(-5.0)).withColumn("copies", F.lit(1))
    out = mixing.mix(docs, {}, seed=3)
    got = out.collect()
    size, sources = Counter(r[2] for r in rows), len({r[2] for r in rows})
    want = [(i, t, s, c) for i, t, s in rows for c in range(plain_poisson(len(rows) / sources / size[s], uniform(3, i)))]
    assert Counter((r.doc_id, r.text, r.source, r["copy"]) for r in got) == Counter(want)
    assert all(r.place == uniform(3, "place", r.doc_id, r["copy"]) and r.of == "zz" and r.rate == -1.0 for r in got)
    places = [r.place for r in got]
    assert places == sorted(places) and len(out.columns) == len({*out.columns})
    assert mixing.mix(docs.where("doc_id < 0"), {}).count() == 0


def test_packing_equals_the_library_and_wastes_little(spark):
    from tokenizers import Tokenizer

    rng, whole = random.Random(5), Tokenizer.from_file(vocabulary_path())
    texts = [None, "", "a", "a"] + [" ".join(rng.choices(["one", "zwei", "trois", "naïve", "\n\n", "9,1"], k=rng.choice([3, 40, 200, 380, 500, 3000]))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, "no id")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("rank", F.lit(2))).collect()
    want, lengths = Counter(), []
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            lengths.append(b - a)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        placed.sort()
        assert [a for a, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))] and sum(n for _, n in placed) <= 1024
    assert len(bins) <= 1.1 * max(sum(lengths) / 1024, sum(n > 512 for n in lengths)) + 1


def test_pseudonyms_of_a_table_equal_those_of_each_text(spark):
    swap = feistel.Pseudonyms(b"key")
    texts = [None, "", "no values", "on 2024-02-29 call +33 1 23 45 67 89", "card 4111 1111 1111 1111", "card 4111 1111 1111 1111", "x " * 200_000 + "078-05-1120"]
    docs = spark.createDataFrame([(k, t, "kept", 9) for k, t in enumerate(texts)], "doc_id long, text string, other string, n_values int")
    got = {r.doc_id: r for r in feistel.pseudonymise(docs, b"key").collect()}
    assert {k: (r.text, r.n_values) for k, r in got.items()} == {k: swap(t) for k, t in enumerate(texts)}
    assert got[4].text == got[5].text != texts[4] and got[6].n_values == 1 and all(r.other == "kept" for r in got.values())
    assert feistel.pseudonymise(docs.where("doc_id < 0"), b"key").count() == 0


def test_pseudonyms_need_a_key(spark, monkeypatch):
    monkeypatch.delenv("LOREKEEP_PII_KEY", raising=False)
    with pytest.raises(ValueError):
        feistel.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"))


COMMON = "the a of and to in house river green walk quickly table paper morning we they see find little garden stone light water bread".split()
BAD = "grumbled vexing louts snarling wretches".split()


def chatter(rng, toxic, n=30):
    words = rng.choices(COMMON, k=n)
    if toxic:
        for _ in range(6):
            words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words)


def labelled(n, every=6, seed=2):
    rng = random.Random(seed)
    return [(k, chatter(rng, k % every == 0), "s", "en", 0) for k in range(n)], [(k, int(k % every == 0)) for k in range(n)]


@pytest.mark.parametrize("n", [240, 1500])
def test_toxic_texts_are_told_from_few_and_more_labels(spark, n):
    rows, labels = labelled(n)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    assert len(got) == n and all(r.held_out == held_out(k) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    right = [got[k].predicted == t for k, t in labels if held_out(k)]
    assert np.mean(right) >= 0.95


def test_toxicity_of_odd_rows(spark):
    rows, labels = labelled(600)
    odd = [(None, None, "s", "en", 0), (None, " ".join(BAD * 4), "s", "en", 0), (7, rows[7][1], "s", "en", 0), (9001, "", "s", "en", 0), (9002, None, "s", None, 0), (9003, "the house " * 100_000, "s", "en", 0), (9004, "?!", None, "en", 0)]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumn("toxic", F.lit(9)).withColumn("part", F.lit(9)).withColumn("sums", F.lit("x")).withColumn("predicted", F.lit("x"))
    marks = spark.createDataFrame([*labels, (None, 1), (8, None), (9005, 1)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows + odd)
    empty = {r.score for r in got if r.doc_id in (9001, 9002, 9004)}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1
    kept, calls = toxicity.accepted(docs, model), Counter((r.doc_id, r.predicted) for r in got)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, 0) for r in kept.collect()) == Counter({k: n for k, n in calls.items() if k[1] == 0})
    assert calls[None, 1] == 1  # a row without an id is judged by its text
    assert toxicity.score(docs.where("false"), model).count() == 0
    none = toxicity.fit(docs, marks.where("false"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0} and toxicity.accepted(docs, none).count() == docs.count()


def test_languages_of_odd_rows_and_held_out_texts(spark):
    speech = {"en": "the house is green and we walk to it", "de": "das haus ist grün und wir gehen zu ihm hin", "fr": "la maison est verte et nous y allons à pied"}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(speech[lang].split(), k=25)), "s", lang, 0) for k in range(300) for lang in [("en", "de", "fr")[k % 3]]]
    odd = [(9001, None, "s", "en", 0), (9002, "", "s", "fr", 0), (9003, "12 + 3!", "s", "de", 0), (None, rows[1][1], "s", "de", 0), (7, rows[7][1], "s", "de", 0), (9004, "das haus " * 30_000, "s", None, 0)]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(7)).withColumn("held_out", F.lit(1))
    got = crf.identify(docs, crf.fit(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows + odd)
    by = {r.doc_id: r for r in got}
    assert all(by[k].held_out == held_out(k) for k, *_ in rows) and all(0 <= r.score <= 1 for r in got)
    assert [by[k].lang_pred for k in (9001, 9002, 9003, None, 9004)] == ["und", "und", "und", "de", "de"]
    assert np.mean([by[k].lang_pred == lang for k, _, _, lang, _ in rows if held_out(k)]) >= 0.98
    blank = crf.identify(docs, crf.fit(docs.where("false"))).collect()
    assert {(r.lang_pred, r.score) for r in blank} == {("und", 0.0)}


def test_ids_that_do_not_fit_are_refused(tmp_path):
    shard = tokenfiles.ShardWriter(f"file://{tmp_path}/s")
    with pytest.raises(OverflowError):
        shard.add(1, np.array([1, 65_536], "<u4"))


def shingle_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_each_stage_equals_a_plain_version(spark, tmp_path):
    rows, labels = labelled(240)
    rng = random.Random(9)
    base = " ".join(rng.choices(COMMON, k=120))
    near = base + " end"
    rows += [(1000, base, "t", "en", 5), (1001, near, "t", "en", 5), (1002, base, None, "en", 5), (1002, base, None, "en", 5), (None, base, "t", "en", 5), (None, "only here 4111 1111 1111 1111", "t", "en", 5), (None, "only here 4111 1111 1111 1111", "t", "en", 5), (1003, None, "t", "en", None), (1004, "", "s", "en", 0), (None, " ".join(BAD * 5), "s", "en", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    write(docs, tmp_path, "documents")
    write(spark.createDataFrame(labels, "doc_id long, toxic int"), tmp_path, "labels")
    stages = dict(corpus_pipeline.STAGES)
    columns = lambda df: Counter(tuple(r) for r in df.select("doc_id", "text", "source", "lang", "n_chars").collect())

    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    calls = toxicity.score(docs, model).where("predicted = 0").groupBy("doc_id").count().collect()
    kept = stages["toxicity"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and Counter({r.doc_id: r["count"] for r in calls}) == Counter(r.doc_id for r in kept.collect())
    assert not any(r.text == " ".join(BAD * 5) for r in kept.collect())

    distinct = list({(r[0], r[1]): r for r in rows}.values())
    sets = [shingle_set(r[1]) for r in distinct]
    root = list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(distinct)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k, r in enumerate(distinct):
        groups[find(k)].append(r)
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values())
    assert columns(stages["ngram_jaccard"](spark, docs, str(tmp_path))) == want

    swap = feistel.Pseudonyms(queries.pii_key())
    want = Counter((i, swap(t)[0], s, lang, n if t is None else len(swap(t)[0])) for i, t, s, lang, n in rows)
    assert columns(stages["pii"](spark, docs, str(tmp_path))) == want

    size = Counter(r[2] for r in rows)
    want = Counter({r: sum(q == r for q in rows) * plain_poisson(len(rows) / len(size) / size[r[2]], uniform(0, r[0])) for r in rows})
    assert columns(stages["mixing"](spark, docs, str(tmp_path))) == +want

    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows)

    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ids and not ids & {1001, 1002} and ids <= {r.doc_id for r in kept.collect()}
