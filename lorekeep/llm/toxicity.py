"""Toxicity by two Kneser-Ney bigram models, one of toxic and one of ordinary text.

Words are counted on the executors over a bounded sample of labelled documents. Both classes discount their
counts and fall back from bigrams to words, from words to their first letters, and from there to one shared
distribution: how many different words a word follows, and how many words begin with these letters, in either
class. So inflected and compound forms that were never counted share what their beginnings tell. A document's
score comes from the length-normalised difference of both log-likelihoods, set against labels of documents
that were not counted; words that the classes use almost equally often may be left out of it (`MARGINS`).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.store import driver_table, fold, let_go, prepare, written
from lorekeep.llm.words import ALNUM, mix, pieces

#: Labelled documents of each class that are learned from, at most; those with the least hash are taken.
SAMPLE_ROWS = 10_000
#: Words and bigrams that the model keeps, at most; the most frequent stay.
KEPT_WORDS, KEPT_BIGRAMS = 100_000, 100_000
#: Occurrences in the sample from which on a bigram is kept.
LEAST_BIGRAM = 3
#: Characters of a word's beginning.
HEAD = 4
#: Discounts of the toxic class, length exponents, and least differences of a word's log-probabilities to choose from by the likelihood of calibration labels.
DISCOUNTS, EXPONENTS, MARGINS = (0.75, 5.0, 20.0, 40.0, 100.0, 300.0), (0.5, 0.75, 1.0), (0.0, 1.0, 2.0, 3.0)
_SHIFT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    unigram: np.ndarray  # (2, n + 1) discounted probabilities, zero in the last column, which is any other word's
    rest: np.ndarray  # (n + 1) what the word's beginning shares out to it
    heads: np.ndarray  # sorted hashes of beginnings
    head: np.ndarray  # (2, k + 1) probabilities of beginnings over their shared ones, one in the last column
    backoff: np.ndarray  # (2, n + 1) mass that a preceding word leaves to the word's own probability
    pairs: np.ndarray  # sorted hashes of bigrams
    bigram: np.ndarray  # (2, m + 1) discounted probabilities, zero in the last column
    scale: tuple[float, float] = (1.0, 0.0)  # logistic slope and intercept
    exponent: float = 1.0  # the difference of log-likelihoods is divided by the number of words to this power
    margin: float = 0.0
    known: bool = True

    def terms(self, word: np.ndarray, head: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log P(toxic model) - log P(ordinary model) of each word; `head`: its beginning, `first`: no word precedes."""
        at = _find(self.words, word)
        before = np.concatenate([word[:1], word[:-1]])
        pair = _find(self.pairs, pair_hash(before, word))
        previous = np.concatenate([at[:1], at[:-1]])
        direct, left = self.bigram[:, pair], self.backoff[:, previous]
        direct[:, first], left[:, first] = 0.0, 1.0
        own = self.unigram[:, at] + self.rest[at] * self.head[:, _find(self.heads, head)]
        p = np.log(direct + left * own)
        return p[1] - p[0]


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _SHIFT + b)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of wanted keys, len(keys) for others."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        toxic = batch.column(0).to_numpy().astype(np.int64)
        for piece in pieces(batch.column(1), ALNUM):
            h, heads = piece.hashes(), piece.hashes(piece.heads(HEAD))
            cls = toxic[piece.first + piece.row]
            inner = np.flatnonzero(piece.row[1:] == piece.row[:-1]) + 1
            frame = pd.DataFrame({"toxic": np.concatenate([cls, cls[inner]]), "a": np.concatenate([heads.view(np.int64), h[inner - 1].view(np.int64)]), "b": np.concatenate([h.view(np.int64), h[inner].view(np.int64)]), "pair": np.concatenate([np.zeros(len(h), bool), np.ones(len(inner), bool)])})
            counts = frame.groupby(["toxic", "a", "b", "pair"], sort=False).size().rename("n").reset_index()
            yield pa.RecordBatch.from_pandas(counts, preserve_index=False)


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """toxic, part (0: calibration, else counting), text of at most `rows` labelled documents of each class outside the held-out fifth.

    Copies of one text count once. A document with several labels is toxic if one says so; null labels and ids count for nothing.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("part", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).cast("int") - 1).where("part >= 0")
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    picked = [tuple(r) for c in (0, 1) for r in known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(rows).collect()]
    ids = F.broadcast(driver_table(spark, picked, "id long, toxic int, part int"))
    taken = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id").select("toxic", "part", "text")
    return taken.withColumn("same", F.md5("text")).dropDuplicates(["toxic", "same"]).drop("same")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled documents; without any label every score is 0.

    Labels of one class alone give a model that scores every row as well. Very long texts are learned whole; null texts
    and labels teach nothing. Columns other than doc_id, text and toxic are not read. An empty table is like no label.
    """
    spark = docs.sparkSession
    prepare(spark)
    taken = written(sample(docs, labels, rows), "toxicity-sample")
    counts = taken.where("part > 0").select("toxic", "text").mapInArrow(_count, "toxic long, a long, b long, pair boolean, n long")
    grams = counts.groupBy("pair", "a", "b").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in (0, 1)])
    grams = written(grams, "toxicity-grams")
    pairs, words = grams.where("pair"), grams.where("not pair").select(F.col("b").alias("w"), F.col("a").alias("head"), "n0", "n1")
    totals = grams.where("not pair").agg(*[F.coalesce(F.sum(f"n{c}"), F.lit(0)).cast("double") for c in (0, 1)], *[F.count(F.when(F.col(f"n{c}") > 0, 1)).cast("double") for c in (0, 1)], F.count("*")).first()
    if not totals[0] or not totals[1]:
        none = np.zeros(0, np.uint64)
        return Model(none, np.zeros((2, 1)), np.ones(1), none, np.ones((2, 1)), np.ones((2, 1)), none, np.zeros((2, 1)), known=False)
    follows = pairs.groupBy(F.col("b").alias("w")).agg(F.count("*").alias("after"))
    kept = words.join(follows, "w", "left").orderBy(F.desc(F.col("n0") + F.col("n1")), "w").limit(KEPT_WORDS).na.fill(0).toPandas()
    kept = kept.assign(w=kept.w.to_numpy().view(np.uint64)).sort_values("w", ignore_index=True)
    heads = words.groupBy("head").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("after"))
    heads = heads.orderBy(F.desc(F.col("n0") + F.col("n1")), "head").limit(KEPT_WORDS).toPandas()
    heads = heads.assign(head=heads["head"].to_numpy().view(np.uint64)).sort_values("head", ignore_index=True)
    common = pairs.where(F.col("n0") + F.col("n1") >= LEAST_BIGRAM).orderBy(F.desc(F.col("n0") + F.col("n1")), "a", "b").limit(KEPT_BIGRAMS).toPandas()
    n_pairs = pairs.count()
    models = [_model(kept, heads, common, np.array(totals[:2]), totals[4], n_pairs, d) for d in DISCOUNTS]
    tried = _scored(taken.where("part = 0").select("toxic", "text"), models, "toxic", MARGINS).toPandas()
    y, best = tried["key"].to_numpy(), (np.inf, models[0])
    for k, (model, margin) in enumerate(itertools.product(models, MARGINS)):
        sums = np.array([v[k] for v in tried["sums"]])
        for exponent in EXPONENTS:
            loss, scale = _calibrated(sums / np.maximum(tried["words"], 1).to_numpy() ** exponent, y)
            if loss < best[0]:
                best = loss, replace(model, scale=scale, exponent=exponent, margin=margin)
    return best[1]


def _equal_mass(counts: np.ndarray, totals: np.ndarray, discount: float) -> tuple[np.ndarray, float]:
    """Discounted probabilities of both classes that leave the same mass, and that mass.

    The smaller class has `discount` taken off each count. The other's discount is so large that it leaves
    as much, so a word that both classes have too seldom says nothing about the class.
    """
    few = int(np.argmin(totals))
    probs = np.empty_like(counts, float)
    probs[few] = np.maximum(counts[few] - discount, 0) / totals[few]
    low, high = 0.0, float(counts.max(initial=1))
    for _ in range(60):
        mid = (low + high) / 2
        probs[1 - few] = np.maximum(counts[1 - few] - mid, 0) / totals[1 - few]
        low, high = (mid, high) if probs[1 - few].sum() > probs[few].sum() else (low, mid)
    return probs, max(1e-9, 1 - float(probs.sum(1).max()))


def _model(kept: pd.DataFrame, heads: pd.DataFrame, common: pd.DataFrame, totals: np.ndarray, kinds: int, n_pairs: int, discount: float) -> Model:
    """The model of counted words, beginnings and bigrams under one discount."""
    shared = (np.append(kept.after.to_numpy(), 0) + 1.0) / (n_pairs + kinds + 1.0)
    probs, left = _equal_mass(np.vstack([np.append(kept[f"n{c}"], 0) for c in (0, 1)]), totals, discount)
    begin, begin_left = _equal_mass(np.vstack([np.append(heads[f"n{c}"], 0) for c in (0, 1)]), totals, discount)
    begin_shared = (np.append(heads.after.to_numpy(), 0) + 1.0) / (kinds + len(heads) + 1.0)
    head = begin / begin_shared + begin_left
    a, b = (common[k].to_numpy().view(np.uint64) for k in "ab")
    at = _find(kept.w.to_numpy(), a)
    inside = at < len(kept)
    common, a, b, at = common[inside], a[inside], b[inside], at[inside]
    preceding = np.vstack([np.append(kept[f"n{c}"], 1) for c in (0, 1)])[:, at]
    direct = np.maximum(np.vstack([common[f"n{c}"] for c in (0, 1)]) - discount * np.maximum(totals / totals.min(), 1)[:, None], 0) / np.maximum(preceding, 1)
    given = np.vstack([np.bincount(at, direct[c], len(kept) + 1) for c in (0, 1)])
    least = given.min(0)  # a word's bigrams have the same mass in both classes too
    direct *= (least / np.maximum(given, 1e-12))[:, at]
    backoff = np.vstack([np.maximum(1 - least, 1e-9)] * 2)
    keys = pair_hash(a, b)
    order = np.argsort(keys)
    return Model(kept.w.to_numpy(), probs, left * shared, heads["head"].to_numpy(), head, backoff, keys[order], np.hstack([direct[:, order], np.zeros((2, 1))]))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float]]:
    """The mean loss, and the logistic slope, never below zero, and intercept by Newton's method with halved steps; with one class only, a flat fit."""
    if len(np.unique(y)) < 2:
        return 0.0, (1.0, 0.0)
    weight = np.ones(len(y))
    spread = x.std() or 1.0
    z, ridge = np.column_stack([x / spread, np.ones(len(x))]), 1e-2

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + ridge * w[0] ** 2 / 2)

    w = np.array([0.0, np.log((weight * y).sum() / (weight * (1 - y)).sum())])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        gradient = z.T @ (weight * (p - y)) + [ridge * w[0], 0.0]
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-9])
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    if w[0] < 0:
        w = np.array([0.0, np.log((weight * y).sum() / (weight * (1 - y)).sum())])
    return loss(w) / float(weight.sum()), (float(w[0] / spread), float(w[1]))


def _sums(column: pa.Array, models: list[Model], margins: tuple[float, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's difference of log-likelihoods under each model and margin, and its number of words."""
    n = len(column)
    sums, words = np.zeros((n, len(models) * len(margins or [0]))), np.zeros(n)
    for piece in pieces(column, ALNUM):
        if len(piece.row):
            first, h, head = np.append(True, piece.row[1:] != piece.row[:-1]), piece.hashes(), piece.hashes(piece.heads(HEAD))
            row, k = piece.first + piece.row, 0
            for model in models:
                terms = model.terms(h, head, first)
                for margin in margins or [model.margin]:
                    sums[:, k] += np.bincount(row, np.where(np.abs(terms) >= margin, terms, 0.0), n)
                    k += 1
            words += np.bincount(row, minlength=n)
    return sums, words


def _scored(docs: DataFrame, models: list[Model], key: str, margins: tuple[float, ...] | None = None) -> DataFrame:
    """key, sums, words: each row's difference of log-likelihoods under each model and margin, and its number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # at most KEPT_WORDS and KEPT_BIGRAMS entries each

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sums, words = _sums(batch.column(1), shared.value, margins)
            n, width = sums.shape
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(sums.ravel()))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), lists, pa.array(words)], names=["key", "sums", "words"])

    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(score, "key long, sums array<double>, words double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, in any order.

    Null and empty texts get the score of a mean of 0; repeated rows come as often as they are. Very long texts are
    scored whole. Columns other than doc_id and text are not read, whatever their names. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    slope, intercept = model.scale
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("sums")[0] / F.pow(F.greatest("words", F.lit(1.0)), F.lit(model.exponent)) + F.lit(intercept)))) if model.known else F.lit(0.0)
    scored = _scored(docs, [model], "doc_id").select(F.col("key").alias("doc_id"), p.alias("score"))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose own text the model does not call toxic, with all their columns.

    Ids play no part: rows with null or repeated ids are judged like any other.
    """
    prepare(docs.sparkSession)
    if not model.known:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        model = shared.value
        for batch in batches:
            sums, words = _sums(batch.column("text"), [model])
            x = model.scale[0] * sums[:, 0] / np.maximum(words, 1.0) ** model.exponent + model.scale[1]
            yield batch.filter(pa.array(x < 0))

    return docs.mapInArrow(keep, docs.schema)
