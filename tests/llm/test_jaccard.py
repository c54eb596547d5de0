"""Large groups of near copies, shared passages and skewed copies against all pairs."""

import itertools
import re

import numpy as np
import pytest

from lorekeep.llm import jaccard


def brute(texts, width, percent):
    sets = [set(zip(*(w[i:] for i in range(min(width, len(w)))))) for w in (re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts)]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return root


def varied(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for p in rng.choice(len(w), rng.integers(0, changes + 1), replace=False):
            w[p] = "z%d" % rng.integers(10**6)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_large_groups_equal_all_pairs(spark, width, percent):
    rng = np.random.default_rng(width)
    word = lambda n: ["w%d" % x for x in rng.integers(0, 5000, n)]
    line = " ".join(word(70))
    texts = varied(rng, word(150), 250, 5) + varied(rng, word(60), 120, 3)
    texts += [f"{line} {' '.join(word(int(k)))}" for k in rng.integers(1, 40, 150)]  # a passage of most or half of unlike texts
    texts += [line] * 50 + ["a b", "a b c", "a b c d e f g", "a b c d e f g h"] + varied(rng, word(3000), 6, 90)
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = jaccard.components(docs, width, percent).toPandas().set_index("doc_id").sort_index()
    assert got.component_id.tolist() == brute(texts, width, percent)


def test_hubs_and_differences_lose_no_pair():
    rng, counts = np.random.default_rng(3), np.zeros(jaccard.CELLS, np.int64)
    base = np.unique(rng.integers(0, 1 << 62, 120).astype(np.uint64))
    for percent in (80, 85):
        sets = []
        for _ in range(60):
            keep = base[rng.random(len(base)) > rng.choice([0.02, 0.08, 0.15])]
            sets.append(np.unique(np.append(keep, rng.choice(base + np.uint64(1), rng.integers(0, 14)))))
        hub = sets[0]
        told = [jaccard.differences(x, hub, counts, percent) for x in sets]
        for (x, (p, d, linked)), (y, (q, e, other)) in itertools.combinations(zip(sets, told), 2):
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both) and not (linked and other):
                shared = np.intersect1d(p, q)
                assert len(shared)
                left = min(d - int(np.argmax(np.isin(p, shared))), e - int(np.argmax(np.isin(q, shared))))
                assert (100 + percent) * (d + e - 2 * left) <= (100 - percent) * (len(x) + len(y))


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(200):
        every = rng.integers(0, 1 << 62, 900).astype(np.uint64)
        x, y = (np.unique(rng.choice(every, rng.integers(1, 800))) for _ in range(2))
        assert jaccard.most_shared(jaccard.bitmap(x), jaccard.bitmap(y), len(x), len(y)) >= len(np.intersect1d(x, y))


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a b c d e", 1), (7, "a b c d e", 2), (7, "q r s t u v", 3), (None, "only here of all", 4), (9, None, 5), (9, " \n", 6)]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string, node long"), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted([("None", 2, "7"), ("7", 2, "7"), ("7", 3, "7"), ("None", 1, "None"), ("9", 0, "9"), ("9", 0, "9")])


def test_one_id_on_two_texts_keeps_neither_copy(spark):
    """The near copy goes although its id's other text stays; equal rows stay once, clashing columns stay as they are."""
    import random

    rng = random.Random(2)
    a, other = (" ".join(rng.choices([f"w{k}" for k in range(500)], k=60)) for _ in range(2))
    rows = [(3, a), (7, a + " end"), (7, other), (7, other), (None, a), (None, "alone here with five words"), (9, None), (9, ""), (2**62 + 5, other + " more")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, digest int")
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in [rows[0], rows[2], rows[5], rows[6], rows[7]])
    assert jaccard.one_of_each(docs.where("false")).count() == 0
