"""Language of code-switched text by a linear-chain conditional random field over words.

Features of a word are itself, its affixes and letter n-grams, and the lexicons of frequent words that hold
it. Their weights and the transitions between languages are learned from a bounded sample, in which runs of
words of several documents follow each other; forward-backward gives each word's probabilities.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.store import fold, prepare

#: Documents of each language that are learned from, at most, and words of a document's run and of the pieces that make it.
SAMPLE_DOCS, RUN, PIECE = 400, 60, 10
#: All languages are learned. Above this many, they share as many hashed weights and sampled documents as so many have, but no language has fewer than FEW documents.
FULL, FEW = 64, 20
#: Hashed weights of a language, words of a lexicon, and known words of a worker.
BUCKETS, LEXICON, KNOWN = 1 << 16, 300, 200_000
#: Numbers of an array that holds one for each word and language, at most (or one document's).
HELD = 1 << 22
STEPS, RATE = 40, 0.3
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Hashed(dict):
    """Buckets of strings behind a mark, remembered."""

    def __init__(self, mark: str, buckets: int):
        super().__init__()
        self.mark, self.buckets = mark, buckets

    def __missing__(self, x: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[x] = found = zlib.crc32((self.mark + x).encode()) % self.buckets
        return found


@functools.lru_cache(maxsize=4)
def _hashes(buckets: int) -> tuple[Hashed, Hashed, Hashed]:
    return Hashed("p", buckets), Hashed("s", buckets), Hashed("g", buckets)


def features(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word, its affixes and all its n-grams."""
    first, last, gram = _hashes(buckets)
    marked = f"^{word}$"
    n = len(marked)
    out = [zlib.crc32(b"w" + word.encode()) % buckets, first[word[:1]], first[word[:2]], first[word[:3]], last[word[-1:]], last[word[-2:]], last[word[-3:]]]
    out += [gram[marked[k : k + 2]] for k in range(n - 1)]
    out += [gram[marked[k : k + 3]] for k in range(n - 2)]
    return out


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray  # (hashed + languages, languages)
    moves: np.ndarray  # (languages, languages) transition scores
    lexicons: dict[str, list[int]]

    def buckets(self, word: str) -> list[int]:
        hashed = len(self.weights) - len(self.langs)
        return features(word, hashed) + [hashed + k for k in self.lexicons.get(word, ())]

    def emission(self, word: str) -> np.ndarray:
        return self.weights[self.buckets(word)].sum(0)


def marginals(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over (sequences, steps, languages); each step's probabilities, and summed pair probabilities."""
    n, steps, k = scores.shape
    e, t = np.exp(scores - scores.max(2, keepdims=True)), np.exp(moves - moves.max())
    forward, backward, pairs = np.empty_like(e), np.ones_like(e), np.zeros((k, k))
    forward[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for s in range(1, steps):
        f = (forward[:, s - 1] @ t) * e[:, s]
        forward[:, s] = f / f.sum(1, keepdims=True)
    for s in range(steps - 2, -1, -1):
        b = (backward[:, s + 1] * e[:, s + 1]) @ t.T
        b = np.where((s + 1 < sizes)[:, None], b / b.sum(1, keepdims=True), 1.0)
        backward[:, s] = b
    p = forward * backward
    p /= p.sum(2, keepdims=True)
    for s in range(1, steps):
        before, after = forward[:, s - 1][s < sizes], (e[:, s] * backward[:, s])[s < sizes]
        pairs += t * ((before / ((before @ t) * after).sum(1, keepdims=True)).T @ after)
    return p, pairs


def run_of(doc_id: int, text: str) -> list[str]:
    """RUN words: one piece from each equal part of the whole text, at a place that a hash of the id chooses; short texts are whole."""
    words = WORD.findall(text.lower())
    if len(words) <= RUN:
        return words
    cuts, out = [len(words) * k // (RUN // PIECE) for k in range(RUN // PIECE + 1)], []
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        at = low + zlib.crc32(f"{doc_id}|{k}".encode()) % (high - low - PIECE + 1)
        out += words[at : at + PIECE]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [run_of(i, t) for i, t in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(2)))]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "lang", "words"])


def fit(docs: DataFrame) -> Field:
    """Learn from documents with a language outside the held-out fifth; without any, the field has no languages."""
    prepare(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0)).select("doc_id", "lang")
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    each = max(FEW, min(SAMPLE_DOCS, SAMPLE_DOCS * FULL // max(1, len(langs))))
    # a first bar on the hash leaves about three times the wanted rows of each language, whatever the number of tasks
    bars = F.broadcast(docs.sparkSession.createDataFrame([(x, (3.0 * each + 100) / n) for x, n in counts.items()], "of string, bar double"))
    near = known.join(bars, known["lang"] == bars["of"]).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("bar") * (1 << 30)).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    taken = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each)
    ids = [(r.doc_id, r.lang) for r in taken.select("doc_id", "lang").collect()]
    picked = F.broadcast(docs.sparkSession.createDataFrame(ids, "id long, as string"))
    texts = docs.join(picked, (docs["doc_id"] == picked["id"]) & (docs["lang"] == picked["as"])).where(docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"], docs["text"])
    # one run of each sampled id, however often the id is repeated
    rows = texts.mapInArrow(_runs, "doc_id long, lang string, words array<string>").groupBy("doc_id", "lang").agg(F.max("words").alias("words")).collect()
    place = {x: k for k, x in enumerate(langs)}
    runs = [(place[r.lang], r.words) for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.words))]
    runs = [(y, w) for y, w in runs if w]
    common = [Counter() for _ in langs]
    for y, ws in runs:
        common[y].update(ws)
    lexicons: dict[str, list[int]] = {}
    for y, c in enumerate(common):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons.setdefault(w, []).append(y)
    hashed = BUCKETS if len(langs) <= FULL else max(1 << 10, BUCKETS * FULL // len(langs))
    model = Field(langs, np.zeros((hashed + len(langs), len(langs))), np.zeros((len(langs), len(langs))), lexicons)
    if len(langs) > 1 and runs:
        _learn(model, runs)
    return model


def _learn(model: Field, runs: list[tuple[int, list[str]]]) -> None:
    """Gradient ascent with per-weight rates; sequences hold three documents' runs each."""
    k, rng = len(model.langs), np.random.default_rng(11)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in runs for w in ws))}
    lists = [np.array(model.buckets(w), np.int32) for w in vocabulary]
    flat, begins = np.concatenate(lists), np.append(0, np.cumsum([len(x) for x in lists]))
    order = rng.permutation(len(runs))
    joined = [sum(([(vocabulary[w], runs[i][0]) for w in runs[i][1]] for i in order[a : a + 3]), []) for a in range(0, len(order), 3)]
    sizes = np.array([len(x) for x in joined])
    word, gold = np.zeros((len(joined), sizes.max()), np.int64), np.zeros((len(joined), sizes.max()), np.int64)
    for i, x in enumerate(joined):
        word[i, : len(x)], gold[i, : len(x)] = zip(*x)
    real = np.arange(sizes.max()) < sizes[:, None]
    moved = np.zeros((k, k))
    both = real[:, 1:]
    np.add.at(moved, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    g_w, g_m = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)
    many = max(1, HELD // (sizes.max() * k))
    for _ in range(STEPS):
        grad, pairs = np.zeros_like(model.weights), np.zeros((k, k))
        for a in range(0, len(joined), many):  # sequences
            steps = sizes[a : a + many].max()
            used, at = np.unique(word[a : a + many, :steps], return_inverse=True)
            at, here, y = at.reshape(-1, steps), real[a : a + many, :steps], gold[a : a + many, :steps]
            parts = [used[b : b + max(1, HELD // (64 * k))] for b in range(0, len(used), max(1, HELD // (64 * k)))]
            spread = [(begins[x], begins[x + 1] - begins[x]) for x in parts]
            places = [flat[np.repeat(b - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] for b, n in spread]
            emit = np.vstack([np.add.reduceat(model.weights[f], np.append(0, np.cumsum(n)[:-1])) for f, (_, n) in zip(places, spread)])
            p, moves = marginals(emit[at], model.moves, sizes[a : a + many])
            pairs += moves
            error = np.negative(p, out=p)
            np.put_along_axis(error, y[:, :, None], np.take_along_axis(error, y[:, :, None], 2) + 1, 2)
            by_word = _summed(at[here], error[here], len(used))
            low = 0
            for f, (_, n) in zip(places, spread):
                np.add.at(grad, f, np.repeat(by_word[low : low + len(n)], n, axis=0))
                low += len(n)
        grad = grad / len(joined) - 1e-4 * model.weights
        step = (moved - pairs) / len(joined) - 1e-3 * model.moves
        g_w += grad**2
        g_m += step**2
        model.weights += RATE * grad / np.sqrt(g_w)
        model.moves += RATE * step / np.sqrt(g_m)


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each place."""
    out = np.zeros((n, rows.shape[1]))
    np.add.at(out, at, rows)
    return out


class Emissions(dict):
    """Places of words in a growing matrix of their emissions; forgotten between batches when there are too many."""

    def __init__(self, model: Field):
        super().__init__()
        self.model, self.rows = model, np.empty((1024, len(model.langs)))

    def learn(self, words: Iterable[str]) -> None:
        """Give every word a place, those that are new all at once."""
        if len(self) * max(len(self.model.langs), 8) > KNOWN * 8:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self]
        step = max(1, HELD // (64 * self.rows.shape[1]))
        for a in range(0, len(new), step):
            lists = [self.model.buckets(w) for w in new[a : a + step]]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum()))
            if len(flat) * self.rows.shape[1] > 4 * HELD:  # very long words: piece by piece
                found = np.array([sum(self.model.weights[x[k : k + 10_000]].sum(0) for k in range(0, len(x), 10_000)) for x in lists])
            else:
                found = np.add.reduceat(self.model.weights[flat], np.cumsum(sizes) - sizes)
            have = len(self)
            if have + len(found) > len(self.rows):
                self.rows = np.vstack([self.rows[:have], np.empty((max(have, len(found)) * 2, self.rows.shape[1]))])
            self.rows[have : have + len(found)] = found
            self.update(zip(new[a : a + step], range(have, have + len(found))))


def posteriors(model: Field, texts: list[str | None], known: Emissions | None = None) -> np.ndarray:
    """Mean probabilities of the languages over the words of each whole text; zeros without a letter."""
    known = Emissions(model) if known is None else known
    k, out, low = len(model.langs), np.zeros((len(texts), len(model.langs))), 0
    while low < len(texts):  # whole batches where languages are few
        high, size = low + 1, len(texts[low] or "")
        while high < len(texts) and (size + len(texts[high] or "")) * k <= 16 * HELD:
            size += len(texts[high] or "")
            high += 1
        out[low:high] = _posteriors(model, texts[low:high], known)
        low = high
    return out


def _posteriors(model: Field, texts: list[str | None], known: Emissions) -> np.ndarray:
    k = len(model.langs)
    out = np.zeros((len(texts), k))
    words = [WORD.findall(text.lower()) if text else [] for text in texts]
    known.learn(itertools.chain.from_iterable(words))
    emitted = [(i, known.rows[list(map(known.__getitem__, ws))]) for i, ws in enumerate(words) if ws]
    emitted.sort(key=lambda x: len(x[1]))
    a = 0
    while a < len(emitted):  # sequences of similar length together
        b, steps = a, len(emitted[a][1]) * 1.3 + 8
        while b < len(emitted) and len(emitted[b][1]) <= steps and b - a < 512:
            b += 1
        sizes = np.array([len(x) for _, x in emitted[a:b]])
        scores = np.zeros((b - a, sizes.max(), k))
        for j, (_, x) in enumerate(emitted[a:b]):
            scores[j, : len(x)] = x
        p = _states(scores, model.moves, sizes)
        p *= (np.arange(sizes.max()) < sizes[:, None])[:, :, None]
        out[[i for i, _ in emitted[a:b]]] = p.sum(1) / sizes[:, None]
        a = b
    return out


def _states(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each step's probabilities by forward-backward."""
    e, t = np.exp(scores - scores.max(2, keepdims=True)), np.exp(moves - moves.max())
    p = np.empty_like(e)
    f = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    p[:, 0] = f
    for s in range(1, e.shape[1]):
        f = (f @ t) * e[:, s]
        f /= f.sum(1, keepdims=True)
        p[:, s] = f
    b = np.ones_like(f)
    for s in range(e.shape[1] - 2, -1, -1):
        b = (b * e[:, s + 1]) @ t.T
        b = np.where((s + 1 < sizes)[:, None], b / b.sum(1, keepdims=True), 1.0)
        p[:, s] *= b
    return p / p.sum(2, keepdims=True)


def identify(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; `und` with score 0 for texts that are null or have no letter.

    Very long texts are read whole, all letters of a word included; repeated rows come as often as they are, with one
    prediction; of equally likely languages the first of the model's is taken. Columns of docs other than doc_id and
    text are not read, whatever their names. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS * FULL weights up to 4096 languages, and then 1024 and as many as there are languages for each

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Emissions(model)
        for batch in batches:
            if not model.langs:
                yield pa.record_batch([batch.column(0), pa.array(["und"] * batch.num_rows), pa.array([0.0] * batch.num_rows)], names=["doc_id", "lang_pred", "score"])
                continue
            p = posteriors(model, batch.column(1).to_pylist(), known)
            best = p.argmax(1)
            score = np.minimum(p[np.arange(len(p)), best], 1.0)
            yield pa.record_batch([batch.column(0), pa.array([model.langs[k] if s > 0 else "und" for k, s in zip(best, score)]), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(label, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
