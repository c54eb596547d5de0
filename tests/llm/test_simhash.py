"""SimHash against plain versions: fingerprints term by term, edits over several ranges, links against all pairs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import simhash, words


def plain_print(text):
    """The same fingerprint with Python's integers, one vote at a time."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    found, word = [], b""
    for b in lower.encode() + b" ":
        if words.ALNUM[b]:
            word += bytes([b])
        elif word:
            found.append(word)
            word = b""
    hashes = [next(words.pieces(pa.array([w.decode()]), words.ALNUM)).hashes()[0] for w in found]
    terms = [(h, simhash.WORD_WEIGHT) for h in hashes]
    with np.errstate(over="ignore"):
        terms += [(words.mix(np.array([a * simhash._PAIR + b]))[0], simhash.PAIR_WEIGHT) for a, b in zip(hashes, hashes[1:])]
    votes = [0] * simhash.BITS
    for term, weight in terms:
        for k, seed in enumerate(simhash._SEEDS):
            h = int(term) * int(seed) % 2**64
            h ^= h >> 29
            for i in range(64):  # bits as they lie in memory: bytes from the low end, each from its high bit
                votes[64 * k + i] += weight if h >> (8 * (i // 8) + 7 - i % 8) & 1 else -weight
    return np.packbits(np.array(votes) > 0)


def test_fingerprints_equal_one_vote_at_a_time(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Beta", "süß", "x1", "的话", "-", "z"]) for _ in range(n)) for n in (1, 2, 3, 40, 700)]
    want = [plain_print(t) for t in texts]
    assert (simhash.fingerprints(pa.array(texts)) == want).all()
    monkeypatch.setattr(words.pieces, "__defaults__", (64,))  # every text in many pieces
    monkeypatch.setattr(simhash, "CHUNK", 10)
    assert (simhash.fingerprints(pa.array(texts)) == want).all()


def test_texts_without_words_and_likeness():
    p = simhash.fingerprints(pa.array([None, "", "...", "!!!", "one", "ONE", "two"]))
    assert not p[:2].any() and p[2].any() and (p[2] != p[3]).any() and (p[4] == p[5]).all()
    assert simhash.likeness(p[[0, 0, 4, 4]], p[[1, 4, 5, 6]])[:3].tolist() == [1.0, 0.0, 1.0]
    assert 0 <= simhash.likeness(p[4:5], p[6:7])[0] < 0.5


ROWS = [(3, "the last half goes"), (1, None), (2, "a much longer text than the one before it, öäü and 漢字"), (None, "no id at all"), (7, ""), (5, "x" * 3001), (5, "five again"), (5, "five again"), (-4, "least of all"), (9, "wörter " * 5000)]


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_edits_equal_a_plain_version(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "partitions_for", lambda df: parts)
    rows = [*ROWS, *((100 + k, f"document {k} " * (k % 9)) for k in range(200))]
    frame = spark.createDataFrame([(i, t, "x", -1) for i, t in rows], "doc_id long, text string, hash string, place int").repartition(5)
    got = simhash.near_documents(frame).toPandas()
    keys = {t: spark.sql("SELECT xxhash64(:t)", {"t": t}).first()[0] for t in {"x" * 3001, "five again"}}
    order = sorted(((i is None, i or 0, keys.get(t, 0), t or "", i) for i, t in rows), key=lambda r: r[:4])
    texts = [r[3] for r in order]
    after = texts[1:] + texts[:1]
    new = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, after)]
    old_prints, new_prints = simhash.fingerprints(pa.array(texts)), simhash.fingerprints(pa.array(new))
    want = sorted((str(r[4]), len(t), hashlib.sha256(n.encode()).hexdigest(), p.tobytes().hex(), q.tobytes().hex()) for r, t, n, p, q in zip(order, texts, new, old_prints, new_prints))
    have = sorted((str(None if i != i else int(i)), *r) for i, *r in got[["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]].itertuples(index=False))
    assert have == want
    assert got.groupby("fingerprint").near_id.nunique().max() == 1 and got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def test_one_row_follows_itself_and_none_gives_none(spark):
    frame = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    r = simhash.near_documents(frame).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0 and r.n_near == 0 and r.near_id == 1
    assert simhash.near_documents(frame.where("false")).count() == 0


@pytest.mark.parametrize(("radius", "block"), [(8, 4096), (8, 20), (3, 4096), (0, 50)])
def test_links_equal_all_pairs(spark, monkeypatch, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (12, 32), dtype=np.uint8)
    prints = []
    for k in range(400):  # a third lies around one centre
        p = np.unpackbits(base[0 if k % 3 == 0 else k % 12])
        p[rng.choice(256, rng.integers(0, 8), replace=False)] ^= 1
        prints.append(np.packbits(p))
    prints += [prints[0], prints[0], prints[5]]
    frame = spark.createDataFrame([(k, p.tobytes().hex()) for k, p in enumerate(prints)] + [(None, prints[7].tobytes().hex())], "doc_id long, fingerprint string")
    got = {r.fingerprint: (r.n_near, r.near_id) for r in simhash.within(frame, radius).collect()}
    prints.append(prints[7])
    w = np.array(prints).view(np.uint64)
    near = sum(np.bitwise_count(w[:, None, k] ^ w[None, :, k]).astype(int) for k in range(4)) <= radius
    np.fill_diagonal(near, False)
    root = np.arange(len(w))
    while True:
        least = np.minimum(root, np.where(near, root[None, :], len(w)).min(1))
        if (least == root).all():
            break
        root = least
    assert [got[p.tobytes().hex()] for p in prints] == [(int(n), int(r)) for n, r in zip(near.sum(1), root)]


def test_some_table_joins_any_two_within_the_radius():
    rng = np.random.default_rng(1)
    for count in (10, 1 << 30, 1 << 50):
        masks = np.array([np.unpackbits(m) for m in simhash.tables(count)])
        for _ in range(500):
            bits = rng.choice(256, 8, replace=False)
            assert (masks[:, bits].sum(1) == 0).any()


def test_edited_texts_are_told_from_unlike_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = simhash.compare_with_edits(docs).where("n_chars >= 200").agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("told"), F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert r.told > 0.97 and r.e > r.n + 0.3
