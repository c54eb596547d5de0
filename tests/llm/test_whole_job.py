"""Cases that once got less than the whole job."""

import itertools
import math
import re

import numpy as np
import pytest

from lorekeep.llm import crf, feistel, mixing, packing, tokenfiles, vamana


def test_poisson_inverts_at_any_rate(spark):
    from pyspark.sql import functions as F

    us = [2.0**-53, 1e-9, 0.001, 0.2, 0.5, 0.9, 0.9999, 1 - 1e-9]
    for rate in (17.0, 399.5, 400.5, 5000.0, 2e6):
        low, high = max(0, int(rate - 12 * math.sqrt(rate))), int(rate + 12 * math.sqrt(rate)) + 60
        logs = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in (low,)]
        for k in range(low + 1, high):
            logs.append(logs[-1] + math.log(rate / k))
        top = max(logs)
        terms = [math.exp(x - top) for x in logs]
        total, cdf, want, at = math.fsum(terms), 0.0, [], 0
        for k, p in zip(range(low, high), terms):
            cdf += p / total
            while at < len(us) and cdf >= us[at]:
                want.append(k)
                at += 1
        got = spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson(F.lit(rate), F.col("u")).alias("k")).toPandas().k.tolist()
        assert got == want


def test_tiny_sources_meet_their_share(spark):
    docs = spark.createDataFrame([(i, "t", "one" if i == 0 else "few" if i < 20 else "many") for i in range(60_000)], "doc_id long, text string, source string")
    got = {r["source"]: (r["n"], r["kinds"]) for r in mixing.replicate(docs, {}).groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").join(
        mixing.replicate(docs, {}).distinct().groupBy("source").count().withColumnRenamed("count", "kinds"), "source").collect()}
    assert all(abs(n - 20_000) < 700 and n == kinds for n, kinds in got.values()) and len(got) == 3


@pytest.mark.parametrize("card", ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "3782 822463 10005"])
@pytest.mark.parametrize("around", ["{} 123", "12 {}", "5 {}", "12 {} 123", "7 8 {} 12/27", "1 22 333 4444 {} 55555", "tel 555-123-4567 {}", "{} 10.0.0.1", "123 {} 4012888888881881"])
def test_cards_beside_other_numbers(card, around):
    swap = feistel.Pseudonyms(b"k")
    new, n = swap(around.format(card))
    assert re.sub(r"\D", "", card) not in re.sub(r"\D", "", new) and n >= 1
    assert re.sub(r"\d+", "9", new) == re.sub(r"\d+", "9", around.format(card))


def test_runs_that_are_no_card_hide_nothing():
    swap = feistel.Pseudonyms(b"k")
    for value in ("555-123-4567", "078-05-1120", "2024-02-29"):
        new, n = swap(f"123 {value} 77")
        assert n == 1 and new == f"123 {swap(value)[0]} 77"
    assert swap("4111 1111 1111 1112") == ("4111 1111 1111 1112", 0)
    assert swap("4111 1111 1111 1111 123")[0][:19] == swap("4111 1111 1111 1111")[0]


@pytest.mark.parametrize("value", ["2024-02-29", "29/02/2024", "29.02.2024", "29-02-2024", "02/29/2024", "2024/02/29", "1.2.2020", "20240229", "+33 1 23 45 67 89", "+33 (0)1 23 45 67 89", "0033 1 23 45 67 89", "01 23 45 67 89", "+49 30 12345678", "030 12345678", "(030) 123456-78", "0151/23456789", "+34 612 345 678", "612 345 678", "91 234 56 78", "+1 (743) 555-3824", "+44 20 7946 0958", "réé.50@mail8.example.com", "Ωμέγα@mail8.example.com", "re\u0301.50@mail8.example.com"])
def test_formats_of_four_languages(value):
    swap = feistel.Pseudonyms(b"k")
    new, n = swap(f"am {value}, x")
    assert n == 1 and new != f"am {value}, x"
    assert [c for c in new if not c.isalnum()] == [c for c in f"am {value}, x" if not c.isalnum()] and len(new) == len(f"am {value}, x")
    assert swap(new)[1] == 1  # valid again


def test_dates_that_do_not_exist_and_times_stay():
    swap = feistel.Pseudonyms(b"k")
    for value in ("30/02/2024", "31.04.2023", "20230229", "2024-13-01", "00/10/2024", "01.01.1850", "4559894937", "812088970", "90433955"):
        assert swap(f"on {value}.") == (f"on {value}.", 0)
    new, n = swap("2024-02-29T10:00:00Z and 20240229T100000Z")
    assert n == 2 and new.startswith(swap("2024-02-29")[0] + "T10:00:00Z and ") and new.endswith("T100000Z")
    days = [f"{d:02d}/{m:02d}/2024" for d in range(1, 29) for m in range(1, 13)] + [f"{m:02d}/{d:02d}/2024" for d in range(13, 29) for m in range(1, 13)]
    assert len({swap(d)[0] for d in days}) == len({*days})


def tongue(lang: int, doc: int, n: int = 40) -> str:
    """Words that only this language has, made of its own few letters."""
    script = (0x61, 0x430, 0x561, 0x10D0)[lang // 26]
    letters = [chr(script + (5 * lang + 3 * k) % 26) + chr(script + (7 * lang + k) % 26) for k in range(6)]
    return " ".join("".join(letters[(doc * 7 + w * k + k) % 6] for k in range(1, 4)) for w in range(n))


def test_languages_are_learned_behind_a_shared_head(spark):
    head = "all rights reserved by the holders of this work " * 40 + "0123456789 " * 150
    rows = [(i, head + tongue(i % 3, i, 400), "xyz"[i % 3]) for i in range(90)]
    model = crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    best = crf.posteriors(model, [tongue(k, 1000 + k) for k in range(3)]).argmax(1)
    assert [model.langs[k] for k in best] == ["x", "y", "z"]
    assert len(crf.run_of(7, head + tongue(1, 1, 400))) == crf.RUN and crf.run_of(7, "Un deux") == ["un", "deux"]
    assert crf.run_of(7, "12 " * 600 + "mot") == ["mot"]


def test_values_behind_a_telephone_number():
    swap = feistel.Pseudonyms(b"k")
    for phone in ("+1 (826) 555-4081", "+33 1 23 45 67 89", "+49 30 1234567"):
        new, n = swap(f"{phone} 190.12.3.44")
        assert n == 2 and new == f"{swap(phone)[0]} {swap('190.12.3.44')[0]}"
    assert swap("0054994038693466") == ("0054994038693466", 0)


def test_rare_languages_are_learned_too(spark):
    rows = [(100 * k + i, tongue(k, i), f"l{k:03d}") for k in range(80) for i in range(40 if k else 3)]
    model = crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == [f"l{k:03d}" for k in range(80)] and model.weights.shape[0] < crf.BUCKETS
    best = crf.posteriors(model, [tongue(k, 50) for k in range(80)]).argmax(1)
    assert np.mean(best == np.arange(80)) >= 0.7 and best[0] == 0


def test_pair_sums_and_bounded_parts_match():
    rng = np.random.default_rng(8)
    e, t, sizes = rng.normal(size=(5, 6, 3)), rng.normal(size=(3, 3)), np.array([6, 4, 1, 5, 6])
    want = np.zeros((3, 3))
    for x, n in zip(e, sizes):
        paths = list(itertools.product(range(3), repeat=int(n)))
        p = np.array([np.exp(sum(x[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        for path, q in zip(paths, p / p.sum()):
            for a, b in zip(path, path[1:]):
                want[a, b] += q
    assert np.allclose(crf.marginals(e, t, sizes)[1], want)


def test_added_tokens_have_the_ids_of_the_unaltered_library(spark):
    import random
    import zlib

    from tokenizers import Tokenizer

    from lorekeep.llm.tokens import encoder, vocabulary_path

    whole, rng = Tokenizer.from_file(vocabulary_path()), random.Random(4)
    parts = [*"ab cZ' \n.!9", "é", "'ll", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "\r\n"]
    texts = ["a<|endoftext|>b"] + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1000)]
    want = [whole.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(encoder(added=True)(x), "<u4").tolist() for x in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts[:50])), "doc_id long, text string")
    for got, end in ((tokenfiles.token_files(docs), 0), (packing.pack_documents(docs).withColumnRenamed("length", "n_tokens"), 2)):
        rows = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got.collect()}
        assert rows == {k: (len(x) + 1, zlib.crc32(np.array([*x, end], "<u4").tobytes())) for k, x in enumerate(want[:50])}


def test_all_letters_of_a_word_make_features(spark):
    """Scripts without spaces make long words; what tells them apart may lie anywhere in them."""
    word = "的" * 40 + "漢字仮名"
    assert {crf._hashes(crf.BUCKETS)[2][g] for g in ("漢字仮", "字仮名", "名$")} <= {*crf.features(word)}
    rows = [(100 * k + i, "的是不了在有" * 6 + ("漢字仮名交" if k else "简体中文字") * 3 + "人我他" * (2 + i % 5), "xy"[k]) for k in range(2) for i in range(60)]
    model = crf.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    best = crf.posteriors(model, ["的是不了在有" * 6 + mark * 3 + "人我他" * 9 for mark in ("简体中文字", "漢字仮名交")]).argmax(1)
    assert [model.langs[k] for k in best] == ["x", "y"]
    long = crf.Emissions(model)
    long.learn(["語" * 3_000_000 + "漢字", "仮名"])
    assert len(long) == 2 and np.isfinite(long.rows[:2]).all()


def test_small_shards_are_graphs_as_well():
    x = np.random.default_rng(3).normal(size=(200, 16))
    graph = vamana.Graph(x)
    assert (graph.edges >= 0).any(1).all()
    want = np.argsort(-(x[:50] @ x.T), axis=1)[:, :21]
    assert np.mean([len({*g} & {*w}) / 21 for g, w in zip(graph.nearest(x[:50], 21).tolist(), want.tolist())]) >= 0.9
