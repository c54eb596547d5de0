"""Exact Jaccard join of word n-gram sets by prefixes and token combinations, as classes of near copies.

Equal sets are one node. Tokens are ordered from rare to frequent by counts over all documents, and a set of n
tokens may miss `spare` = n - ceil(t * n) of them in a similar one. Its prefix has spare + 1 tokens and some
more, one for each subclass that frequent tokens are dealt to. Tokens that few prefixes have are indexed alone.
Tokens that more than COMMON prefixes have are indexed in pairs of one subclass: of the shared tokens of two
similar sets' prefixes one is rare, or two lie in one subclass. So no similar pair is missed, at any size.

Before anything else is compared, the sets of each token meet one or two hubs of theirs, which joins groups of
copies without pairing their members. Where sets of several classes still share a rare token, those of different
classes are compared; pairs of frequent tokens are made only where sets of several classes share one. Where many sets share a pair, each is written as its differences from the entry's
hub: two sets that are similar, of which one is not similar to the hub, share a difference. So prefixes of the
differences are indexed, which few sets share. The sets of these indexes meet hubs of theirs once more, and what is
then still of different classes is compared pair by pair. Candidates are first held against an upper bound of their overlap
from parity bitmaps, which no similar pair fails, and then against their whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lorekeep.llm.graph import connected
from lorekeep.llm.store import discard, leading_number, let_go, maybe_member, membership, prepare, written
from lorekeep.llm.words import NOT_SPACE, mix, pieces

#: Tokens are counted in so many cells; the order of tokens may be any, as long as it is one for all.
CELLS = 1 << 16
#: A token in more prefixes than this is indexed in pairs; a pair of tokens in more sets than this, by differences.
COMMON = 32
#: Tokens of cells above this multiple of the mean count are surely frequent; their rows are dealt to so many tasks.
HOT, SALTS = 8, 64
#: Keys whose hubs a set meets before sets of different classes are compared with each other. It only saves work.
MEETINGS = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of all runs of `width` words, sorted; of fewer words, the whole sequence's."""
    if not len(words):
        return words
    width = min(width, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * _STEP + words[k : len(words) - width + 1 + k])
    return np.unique(h)


def token_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted token sets of a text column's rows, in order."""
    held: list[np.ndarray] = []
    for piece in pieces(column, NOT_SPACE):
        h, cuts = piece.hashes(), np.searchsorted(piece.row, np.arange(piece.rows + 1))
        if not piece.last or held:
            held.append(h)
            if piece.last:
                yield shingles(np.concatenate(held), width)
                held = []
            continue
        for k in range(piece.rows):
            yield shingles(h[cuts[k] : cuts[k + 1]], width)


def name_of(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.astype("<u8").tobytes()).digest()


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts in as many bits as the next power of two, at least 256."""
    bits = 1 << max(8, int(len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def most_shared(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """An upper bound of the overlap: every differing bit is a token that only one set has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return (nx + ny - int(np.bitwise_count(a ^ b).sum())) // 2


def _sets(width: int, id_type: pa.DataType):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each document, and then the task's token counts by cell, where each set counts once."""
        let_go()
        counts, seen = np.zeros(CELLS, np.int64), set()
        for batch in batches:
            n, nodes, bits, held = [], [], [], [np.zeros(0, np.int64)]
            for x in token_sets(batch.column(1), width):
                node = name_of(x)
                n.append(len(x))
                nodes.append(node)
                bits.append(bitmap(x))
                if node not in seen:
                    seen.add(node)
                    held.append((x & np.uint64(CELLS - 1)).astype(np.int64))
            counts += np.bincount(np.concatenate(held), minlength=CELLS)
            none = pa.nulls(len(n), pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bits, pa.binary()), none, none], names=["doc_id", "digest", "n", "node", "bits", "cell", "count"])
        cells = np.flatnonzero(counts)
        none = [pa.nulls(len(cells), t) for t in (id_type, pa.binary(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.record_batch([*none, pa.array(cells), pa.array(counts[cells])], names=["doc_id", "digest", "n", "node", "bits", "cell", "count"])

    return sets


def spare_of(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100


def size_class(n: int, percent: int) -> int:
    """Sets whose sizes allow similarity are of one class or of two that follow each other."""
    return int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9))


def subclasses(c: int, percent: int) -> int:
    """The number of subclasses that frequent tokens of sets of class c, and of the one below, are dealt to."""
    return max(1, spare_of(int((100 / percent) ** c), percent) // 4)


def prefix(tokens: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The tokens that a set is indexed under: enough for any set of frequent tokens. Sets of one token match only their equals."""
    n = len(tokens)
    if n < 2:
        return tokens[:0]
    size = spare_of(n, percent) + 1 + subclasses(size_class(n, percent) + 1, percent)
    return tokens[np.lexsort((tokens, counts[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]))[:size]]


def _index(shared, hot: float, width: int, percent: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts, seen = shared.value, set()
        for batch in batches:
            keys, at, n, score = [], [], [], []
            for x in token_sets(batch.column(0), width):
                node = name_of(x)
                if len(x) > 1 and node not in seen:
                    seen.add(node)
                    keys.append(prefix(x, counts, percent))
                    at.append(int.from_bytes(node[:8], "little", signed=True))
                    n.append(len(x))
                    score.append(counts[(x & np.uint64(CELLS - 1)).astype(np.int64)].mean())
            if keys:
                sizes, flat = [len(k) for k in keys], np.concatenate(keys)
                rows = [flat.view(np.int64), np.repeat(np.array(at, np.int64), sizes), np.repeat(np.array(n, np.int32), sizes), np.repeat(np.array(score, np.float32), sizes), counts[(flat & np.uint64(CELLS - 1)).astype(np.int64)] > hot]
                for a in range(0, len(flat), 50_000):
                    yield pa.record_batch([pa.array(c[a : a + 50_000]) for c in rows], names=["key", "at", "n", "score", "hot"])

    return index


def _combined(percent: int):
    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of each set's frequent tokens that lie in one subclass, for its own size class and the next."""
        let_go()
        for batch in batches:
            for at, n, of, score, row in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                keys, out = np.unique(row.values.to_numpy(zero_copy_only=False).view(np.uint64)), []
                for c in (size_class(n, percent), size_class(n, percent) + 1):
                    sub = (mix(keys) % np.uint64(subclasses(c, percent))).astype(np.int64)
                    order = np.argsort(sub, kind="stable")
                    for part in np.split(keys[order], np.flatnonzero(np.diff(sub[order])) + 1):
                        a, b = np.triu_indices(len(part), 1)
                        out.append(mix(mix(part[a] * _STEP + part[b]) + np.uint64(c)))
                flat = np.concatenate(out).view(np.int64)
                for a in range(0, len(flat), 50_000):
                    some = pa.array(flat[a : a + 50_000])
                    yield pa.record_batch([some, pa.array([at] * len(some)), pa.array([n] * len(some), pa.int32()), pa.array([of] * len(some), pa.binary()), pa.array([score] * len(some), pa.float32())], names=["key", "at", "n", "of", "score"])

    return combined


def _possible(percent: int):
    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            keep = []
            for x, y, nx, ny in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "nx", "ny"))):
                most = min(most_shared(x, y, nx, ny), nx, ny)
                keep.append(100 * most >= percent * (nx + ny - most))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return possible


def _verify(width: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            keep = []
            for x, y in zip(token_sets(batch.column("x"), width), token_sets(batch.column("y"), width)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def differences(x: np.ndarray, hub: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int, bool]:
    """The first differences of a set from its hub, how many there are in all, and whether both are similar.

    Sets x and y differ by |Dx| + |Dy| - 2 * |Dx and Dy|, where D is the difference from the hub, and are similar
    if that is at most k * (|x| + |y|), k = (1 - t) / (1 + t). If one of them is not similar to the hub, they
    share at least `least` differences. Differences that x has come before those that only the hub has.
    """
    more, fewer = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
    cost = lambda t: t[np.lexsort((t, counts[(t & np.uint64(CELLS - 1)).astype(np.int64)]))]
    every = np.concatenate([mix(cost(more)), mix(~cost(fewer))])
    d, up, down = len(every), 100 - percent, 100 + percent
    linked = down * d <= up * (len(x) + len(hub))
    if linked:  # twice the shared ones are more than this over `down`
        least = (down * d - up * (len(x) - len(hub))) // (2 * down) + 1
    else:
        least = -(-(down * d - up * (len(x) + len(hub))) // (2 * down))
    return every[: max(0, d - max(1, least) + 1)], d, linked


def _differences(shared, width: int, percent: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the index of differences, and a row with both names for each set that is similar to its hub."""
        let_go()
        counts = shared.value
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("at", "n", "of", "hub", "a", "b")]
            for at, n, of, hub, a, b, x, y in zip(*cols, token_sets(batch.column("x"), width), token_sets(batch.column("y"), width)):
                first, d, linked = differences(x, y, counts, percent)
                keys = mix(first * _STEP + np.uint64(hub % (1 << 64))).view(np.int64)
                if linked and a != b:
                    yield pa.record_batch([[None], [at], [n], [of], [d], [0], [a], [b]], schema=_DIFFERENCE)
                for k in range(0, len(keys), 50_000):
                    m = len(keys[k : k + 50_000])
                    none = pa.nulls(m, pa.binary())
                    left = d - np.arange(k, k + m)
                    yield pa.record_batch([pa.array(keys[k : k + m]), pa.array([at] * m), pa.array([n] * m, pa.int32()), pa.array([of] * m, pa.binary()), pa.array([d] * m, pa.int32()), pa.array(left.astype(np.int32)), none, none], schema=_DIFFERENCE)

    return listed


_DIFFERENCE = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("of", pa.binary()), ("d", pa.int32()), ("left", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _texts(shared):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts (text, digest) whose digest the filter lets pass, once a task. Texts are not read for that."""
        let_go()
        bits, seen = shared.value, set()
        for batch in batches:
            take = []
            for k, digest in enumerate(batch.column(1).to_pylist()):
                if digest is not None and digest not in seen and maybe_member(bits, digest):
                    seen.add(digest)
                    take.append(k)
            if take:
                yield batch.take(pa.array(take, pa.int64()))

    return texts


class Join:
    """The steps that candidates of one corpus go through."""

    def __init__(self, docs: DataFrame, words: int, percent: int):
        if percent < 60:
            raise ValueError("similarities below 0.6 need longer prefixes")
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        digest = F.unhex(F.md5("text")).alias("digest")
        self.texts = docs.select("text", digest)
        named = docs.select("doc_id" if isinstance(docs.schema["doc_id"].dataType, StructType) else F.col("doc_id").cast("long").alias("doc_id"), "text", digest)
        kind = named.schema["doc_id"].dataType
        both = written(named.mapInArrow(_sets(words, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, digest binary, n long, node binary, bits binary, cell long, count long"), "sets")
        self.rows = both.where("node is not null").select("doc_id", "digest", "n", "node", "bits")
        cells = both.where("cell is not null").groupBy("cell").agg(F.sum("count").alias("n")).toPandas()  # at most CELLS rows
        self.counts = np.zeros(CELLS, np.int64)
        self.counts[cells["cell"]] = cells["n"]
        least = self.rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("digest").alias("digest"), F.min("doc_id").alias("least"))
        self.nodes = written(least.withColumn("at", leading_number("node")), "nodes")

    def alike(self, nx: str, ny: str):
        """Sizes that allow similarity."""
        return 100 * F.least(nx, ny) >= self.percent * F.greatest(nx, ny)

    def entries(self) -> DataFrame:
        """Rows (key, at, n, score, m, often, low, high) of all tokens that several prefixes have.

        The hubs low and high are the least set and the one with the most frequent tokens, which is in the midst of its copies.
        """
        hot = float(HOT * self.counts.mean() + 1000)
        index = self.texts.select("text").mapInArrow(_index(self.spark.sparkContext.broadcast(self.counts), hot, self.words, self.percent), "key long, at long, n int, score float, hot boolean")
        dealt = index.withColumn("salt", F.when(F.col("hot"), F.pmod("at", F.lit(SALTS))).otherwise(0).cast("int"))
        whole = dealt.repartition("key", "salt").distinct()  # copies in several tasks
        every = Window.partitionBy("key", "salt")
        low, high = F.struct("n", "at"), F.max(F.struct("score", "n", "at")).over(every)
        sized = whole.select("key", "at", "n", "score", "hot", F.count(F.lit(1)).over(every).alias("m"), F.min(low).over(every).alias("low"), F.struct(high["n"].alias("n"), high["at"].alias("at")).alias("high"))
        return written(sized.where("m > 1 or hot").select("key", "at", "n", "score", F.col("m").cast("int").alias("m"), (F.col("hot") | (F.col("m") > COMMON)).alias("often"), "low", "high"), "entries")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Edges (a, b) of nodes whose sets are similar enough, of candidate pairs (a, b) of places."""
        of = self.nodes.select("at", "node", "bits", "n")
        x = of.select(F.col("at").alias("a"), F.col("node").alias("na"), F.col("bits").alias("x"), F.col("n").alias("nx"))
        y = of.select(F.col("at").alias("b"), F.col("node").alias("nb"), F.col("bits").alias("y"), F.col("n").alias("ny"))
        bound = pairs.join(x, "a").join(y, "b").where("na != nb").select(F.col("na").alias("a"), F.col("nb").alias("b"), "x", "y", "nx", "ny")
        likely = written(bound.mapInArrow(_possible(self.percent), "a binary, b binary"), "likely")
        x, y = self.sides(likely)
        near = written(likely.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(self.words, self.percent), "a binary, b binary"), "links")
        discard(likely)
        return near

    def sides(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A text of each node of pairs (a, b), as (a, x) and as (b, y)."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.nodes.select("node", "digest"), "node")
        bits = membership(wanted, "digest")
        passed = self.texts.mapInArrow(_texts(self.spark.sparkContext.broadcast(bits)), "text string, digest binary")
        texts = written(passed.join(wanted, "digest").groupBy("node").agg(F.first("text").alias("text")), "wanted")
        return tuple(texts.select(F.col("node").alias(p), F.col("text").alias(t)) for p, t in (("a", "x"), ("b", "y")))

    def first_pairs(self, entries: DataFrame) -> DataFrame:
        """The sets of each token with their hubs: where only two sets have a token, these two."""
        met = entries.select("at", "n", F.explode(F.array("low", "high")).alias("hub"))
        met = met.where((F.col("at") != F.col("hub.at")) & self.alike("n", "hub.n"))
        return met.select(F.least("at", "hub.at").alias("a"), F.greatest("at", "hub.at").alias("b")).distinct()

    def classed(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Those rows (key, at, n) of entries that hold several classes, with the class as `of`."""
        known = self.nodes.select("at", "node").join(classes, "node", "left").select("at", F.coalesce("component", "node").alias("of"))
        with_class = rows.join(known, "at").select("key", "at", "n", "score", "of")
        mixed = with_class.groupBy("key").agg(F.min("of").alias("l"), F.max("of").alias("h"), F.count(F.lit(1)).alias("m")).where("l != h").select("key", "m")
        return with_class.join(mixed, "key")

    def pairs_of(self, rows: DataFrame, more: list[str], test) -> DataFrame:
        """Pairs of different classes that share a key and pass the test of columns named ...x and ...y."""
        x, y = (rows.select("key", F.col("at").alias(p), *[F.col(c).alias(c + s) for c in ("n", "of", *more)]) for p, s in (("a", "x"), ("b", "y")))
        return x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ofx") != F.col("ofy")) & self.alike("nx", "ny") & test).select("a", "b").distinct()

    def indexed(self, entries: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index rows (key, at, n, of, by, d, left) of what sets of different classes still share, and edges found on the way.

        Keys are rare tokens, pairs of frequent tokens of a subclass, and differences from a hub, which have d and left.
        """
        none = F.lit(None).cast("int")
        plain = lambda df: df.select("key", "at", "n", "of", (-F.col("score")).cast("float").alias("by"), none.alias("d"), none.alias("left"))
        few = plain(self.classed(entries.where("not often and m > 2").select("key", "at", "n", "score"), classes))
        often = self.classed(entries.where("often").select("key", "at", "n", "score"), classes)
        by_set = often.groupBy("at", "n").agg(F.first("of").alias("of"), F.first("score").alias("score"), F.collect_list("key").alias("keys"))  # no longer than a prefix
        pairs = written(by_set.select("at", "n", "of", "score", "keys").mapInArrow(_combined(self.percent), "key long, at long, n int, of binary, score float"), "combinations")
        mixed = pairs.groupBy("key").agg(F.min("of").alias("l"), F.max("of").alias("h"), F.count(F.lit(1)).alias("m"), F.max(F.struct("score", "n", "at")).alias("hub")).where("l != h")
        small = plain(pairs.join(mixed.where(F.col("m") <= COMMON).select("key"), "key", "left_semi"))
        large = pairs.join(mixed.where(F.col("m") > COMMON).select("key", F.col("hub.at").alias("hub")), "key").select("at", "n", "of", "hub").distinct()
        name, hub = self.nodes.select("at", F.col("node").alias("a")), self.nodes.select(F.col("at").alias("hub"), F.col("node").alias("b"))
        told = written(large.join(name, "at").join(hub, "hub"), "hubs")
        if told.isEmpty():
            return written(few.unionByName(small), "index"), told.select("a", "b")
        x, y = self.sides(told)
        work = _differences(self.spark.sparkContext.broadcast(self.counts), self.words, self.percent)
        found = written(told.join(x, "a").join(y, "b").select("at", "n", "of", "hub", "a", "b", "x", "y").mapInArrow(work, "key long, at long, n int, of binary, d int, left int, a binary, b binary"), "differences")
        far = found.where("key is not null").select("key", "at", "n", "of", F.col("d").cast("float").alias("by"), "d", "left")
        return written(few.unionByName(small).unionByName(far), "index"), found.where("key is null").select("a", "b")

    def meetings(self, index: DataFrame) -> DataFrame:
        """Pairs of each set with the hubs of its keys that most sets have, of MEETINGS keys at most; all others are compared later."""
        hub = index.groupBy("key").agg(F.min(F.struct("by", "at", "n", "of")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 2")
        met = index.join(hub, "key").where((F.col("of") != F.col("hub.of")) & self.alike("n", "hub.n"))
        most = Window.partitionBy("at").orderBy(F.desc("m"), "key")  # no more rows than a set has keys
        met = met.withColumn("r", F.row_number().over(most)).where(F.col("r") <= MEETINGS)
        return met.select(F.least("at", "hub.at").alias("a"), F.greatest("at", "hub.at").alias("b")).distinct()

    def rest(self, index: DataFrame, classes: DataFrame) -> DataFrame:
        """The candidate pairs of sets that are still of different classes."""
        named = self.nodes.select("at", "node").join(classes, "node", "left").select("at", F.coalesce("component", "node").alias("of"))
        rows = index.drop("of").join(named, "at")
        # at its first shared difference a similar pair has enough differences left
        shared = (100 + self.percent) * (F.col("dx") + F.col("dy") - 2 * F.least("leftx", "lefty")) <= (100 - self.percent) * (F.col("nx") + F.col("ny"))
        return self.pairs_of(rows, ["d", "left"], F.coalesce(shared, F.lit(True)))


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; null and empty texts link with nothing.

    Repeated rows come as often as they are, in one class. Null ids take part; a class of nothing else has a
    null id. An id may be a struct, which is then ordered by its fields. Other columns than doc_id and text are not
    looked at. Very long texts are shingled whole. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    join = Join(docs, words, percent)
    entries = join.entries()
    first = written(join.first_pairs(entries), "first-pairs")
    near = join.links(first)
    classes = connected(near)
    index, more = join.indexed(entries, classes)
    second = written(join.meetings(index).join(first, ["a", "b"], "left_anti"), "meetings")
    near = near.unionByName(more).unionByName(join.links(second))
    rest = written(join.rest(index, connected(near)).join(first.unionByName(second), ["a", "b"], "left_anti"), "rest")
    discard(entries, first, second, index)
    classes = connected(near.unionByName(join.links(rest)))
    owned = join.nodes.select("node", "least").join(classes, "node", "left").withColumn("of", F.coalesce("component", "node"))
    ids = owned.groupBy("of").agg(F.min("least").alias("component_id"))
    named = owned.join(ids, "of").select("node", "component_id")
    out = join.rows.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of which each class of near copies keeps one: the least doc_id, null ids last, then the least digest.

    A row is known by its id and its text, so rows with one id and different texts are judged apart, and equal ones stay
    once. Null and empty texts, and those without words, are classes of their own. Columns stay as they are.
    """
    row = F.struct(F.col("doc_id").isNull().alias("bare"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("digest"))
    classes = components(docs.select(row.alias("doc_id"), "text"), words, percent)
    mark = "row"
    while mark in (c.lower() for c in docs.columns):
        mark += "_"
    kept = classes.where("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    return docs.withColumn(mark, row).join(kept, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)
