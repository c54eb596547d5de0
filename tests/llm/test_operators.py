"""Operators against brute-force versions on small inputs."""

import itertools
import re

import numpy as np
import pytest

from lorekeep.llm import caps, crf, feistel, jaccard, mixing, packing, tokenfiles, vamana, warc

TEXTS = ["a b c d e f", "A B C D E F", None, "", "one", "one", "x " * 3000, "a b c d e g h i j k l m n o p q r s t u v w x y z", "a b c d e g h i j k l m n o p q r s t u v w x y z end", "ü ß 漢字 \t tab"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if i % 3 else "s", 0, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, node string")


def test_jaccard_classes_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = [[str(x) for x in rng.integers(0, 400, 60)] for _ in range(8)]
    texts = list(TEXTS)
    for b in base:
        for k in range(8):
            w = list(b)
            for p in rng.integers(0, 60, k % 3):
                w[p] = "z%d" % rng.integers(99)
            texts.append(" ".join(w))
    sets = [set(zip(*(w[i:] for i in range(min(4, len(w)))))) for w in (re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts)]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    got = jaccard.components(frame(spark, texts), 4, 85).toPandas().set_index("doc_id").sort_index()
    assert got.component_id.tolist() == root and got.n_shingles.tolist() == [len(s) for s in sets]


def test_jaccard_of_nothing(spark):
    assert jaccard.components(frame(spark, []), 4, 85).count() == 0


def test_near_copies_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 16))
    x = np.vstack([base[k % 6] + rng.normal(size=16) * 0.15 * (k % 4) for k in range(60)])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, x[0].tolist(), None)]
    got = caps.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas().set_index("vec_id").sort_index()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.arange(60) % 2
    near = (u @ u.T >= 0.93) & (same[:, None] == same[None, :])
    np.fill_diagonal(near, False)
    assert got.n_links.tolist() == near.sum(1).tolist() + [0, 0, 0, 0]
    assert got.component_id.loc[[100, 101, 102, 103]].tolist() == [100, 101, 102, 103]


def test_graph_search_finds_the_nearest():
    x = np.random.default_rng(4).normal(size=(1500, 24))
    graph = vamana.Graph(x)
    found, _ = graph.search(np.hstack([x[:60], np.zeros((60, 1))]), vamana.BEAM)
    want = np.argsort(-(x[:60] @ x.T), axis=1)[:, :20]
    assert np.mean([len({*f[:20]} & {*w}) / 20 for f, w in zip(found.tolist(), want.tolist())]) >= 0.9


def test_bins_hold_every_piece_once():
    counts = {1024: 3, 700: 5, 400: 9, 341: 4, 100: 30, 7: 200, 1: 50}
    runs, bins = packing.plan_bins(counts, 1024)
    used, seen = np.zeros((bins, 1024), int), {k: 0 for k in counts}
    for length, low, high, first, each, at in runs:
        for r in range(high - low):
            a = at + r % each * length
            used[first + r // each, a : a + length] += 1
            seen[length] += 1
    assert used.max() == 1 and seen == counts


def test_feistel_is_a_permutation_in_format():
    assert sorted(feistel.permute(v, 1000, b"k", "t") for v in range(1000)) == list(range(1000))
    swap = feistel.Pseudonyms(b"k")
    text = "pay 4111 1111 1111 1111 on 2024-02-29 from 10.0.0.1, not 4111 1111 1111 1112 on 2023-02-30"
    new, n = swap(text)
    card = re.search(r"pay (\d{4}(?: \d{4}){3})", new)[1].replace(" ", "")
    assert n == 3 and feistel.check_digit(card[:-1]) == card[-1] and new.endswith("not 4111 1111 1111 1112 on 2023-02-30")
    assert swap(text) == (new, n) and swap(None) == (None, 0) and swap("") == ("", 0)


def test_poisson_counts_invert_the_distribution(spark):
    from math import exp, factorial

    from pyspark.sql import functions as F

    us = [0.001, 0.2, 0.5, 0.9, 0.9999]
    for rate in (0.3, 2.0, 16.0):
        want = [next(k for k in range(200) if sum(exp(-rate) * rate**i / factorial(i) for i in range(k + 1)) >= u) for u in us]
        got = spark.createDataFrame([(u,) for u in us], "u double").select(mixing.poisson(F.lit(rate), F.col("u")).alias("k")).toPandas().k.tolist()
        assert got == want
    assert mixing.mix(frame(spark, []), {}).count() == 0
    mixed = mixing.mix(frame(spark, TEXTS * 20), {"s": 0.8})
    assert {*mixed.columns} == {"doc_id", "text", "lang", "source", "n_chars", "node", "copy", "place"}


def test_marginals_match_all_paths():
    rng = np.random.default_rng(6)
    e, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    total, want = 0.0, np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(sum(e[0, i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, y in enumerate(path):
            want[i, y] += p
    assert np.allclose(crf.marginals(e, t, np.array([4]))[0][0], want / total)
    assert np.allclose(crf._states(e, t, np.array([4]))[0], want / total)


def test_chunks_and_lengths():
    for payload in (b"", b"x", b"ab" * 9000):
        assert warc.unframe(warc.frame(payload)) == payload
    with pytest.raises(ValueError):
        warc.unframe(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab\r\n")


def test_ids_are_those_of_the_library(spark):
    import random

    from tokenizers import Tokenizer

    from lorekeep.llm.tokens import encoder, vocabulary_path

    whole = Tokenizer.from_file(vocabulary_path())
    whole.encode_special_tokens = True
    parts = [*"ab cZ' \n\t.,!19", "\x1c", "\x85", "\xa0", "\u3000", "é", "ß", "漢", "²", "'ll", "<|endoftext|>", "😀", "\u0301", "\x00", "\r\n"]
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert np.frombuffer(encoder()(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_files_give_every_id_back(spark):
    import zlib

    from lorekeep.llm.tokens import encoder

    got = tokenfiles.token_files(frame(spark, TEXTS)).toPandas().sort_values("doc_id")
    start = 0
    for row, text in zip(got.itertuples(), TEXTS):
        ids = encoder()(text) + b"\0\0\0\0"
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


@pytest.mark.parametrize("seed", range(9))
def test_shards_of_many_batches_are_read_at_any_place(tmp_path, seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in rng.integers(1, 90, 200)]
    writer = tokenfiles.ShardWriter(f"file://{tmp_path}/s", sequence=8, rows=4)
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    writer.close()
    shard, flat = tokenfiles.Shard(f"file://{tmp_path}/s"), np.concatenate(docs)
    for entries in shard.documents():
        for k, start, n in zip(*(c.to_pylist() for c in entries.columns)):
            assert (shard.ids(start, n) == docs[k]).all()
    for k in range(len(flat) // 8):
        ids, mask = shard.sequence(k)
        assert (ids == flat[8 * k : 8 * k + 8]).all() and mask.all()
