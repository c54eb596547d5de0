"""SimHash fingerprints of whole texts, and all fingerprints within a Hamming radius of each other.

Every word and every pair of neighbouring words votes with a weight on each bit by a hash of its own. Fingerprints are
cut into blocks; a table is keyed by some of the blocks, and there are as many tables as ways to choose them, so that
any two fingerprints within the radius agree on the key of one table at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.graph import connected
from lorekeep.llm.store import discard, partitions_for, prepare, written
from lorekeep.llm.words import ALNUM, mix, pieces

BITS, RADIUS = 256, 8
WORD_WEIGHT, PAIR_WEIGHT = 1, 2
#: Terms that vote at once.
CHUNK = 4080
#: Fingerprints of one key that are compared in one task, and those of a block of a larger key's.
BLOCK = 4096
#: Up to so many rows of a key are compared one by one, without arrays.
FEW = 24
_SEEDS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _vote(votes: np.ndarray, rows: np.ndarray, terms: np.ndarray, weight: int) -> None:
    """Add the votes of terms, whose rows are in order; they are summed in bytes, which hold 255 terms."""
    for a in range(0, len(terms), CHUNK):
        row = rows[a : a + CHUNK]
        hashes = terms[a : a + CHUNK, None] * _SEEDS
        hashes ^= hashes >> np.uint64(29)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1)
        first = np.append(True, row[1:] != row[:-1])
        first[::255] = True
        cut = np.flatnonzero(first)
        ones = np.add.reduceat(bits.view(np.uint64), cut, axis=0).view(np.uint8).astype(np.int64)  # eight sums in a word
        np.add.at(votes, row[cut], weight * (2 * ones - np.diff(np.append(cut, len(row)))[:, None]))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A row of BITS / 8 bytes for each text. ASCII case does not count; letters, digits and characters beyond ASCII make words.

    A text without words is one term, if it is not empty; without a term all bits are 0.
    """
    votes = np.zeros((len(texts), BITS), np.int64)
    held = None  # the last word of a text that goes on in the next piece
    for p in pieces(texts, ALNUM):
        h, row = p.hashes(), p.first + p.row
        if held is not None:
            h, row = np.append(held[1], h), np.append(held[0], row)
        pair = np.flatnonzero(row[1:] == row[:-1])
        both = mix(h[pair] * _PAIR + h[pair + 1])
        own = slice(held is not None, None)  # the held word has voted
        _vote(votes, row[own], h[own], WORD_WEIGHT)
        _vote(votes, row[pair], both, PAIR_WEIGHT)
        held = None if p.last or not len(h) else (row[-1:], h[-1:])
    for k in np.flatnonzero(~votes.any(1)).tolist():
        if texts[k].as_py():  # no words at all, or votes that are all even
            votes[k] = np.unpackbits(np.frombuffer(hashlib.sha256(texts[k].as_py().encode()).digest(), np.uint8))
    return np.packbits(votes > 0, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of the terms' weights as the differing bits estimate it, at least 0; 0 if one of two has no terms, 1 for equal ones."""
    apart = np.bitwise_count(a ^ b).sum(1)
    out = np.maximum(0.0, np.cos(np.pi * apart / BITS))
    return np.where(apart == 0, 1.0, np.where(a.any(1) & b.any(1), out, 0.0))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_ROW_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: pa.Array, texts: list[str], prints: np.ndarray, after: list[str], after_prints: np.ndarray) -> dict:
    """The result of each text with the one that follows it."""
    new = [edited(t, f) for t, f in zip(texts, after)]
    changed = fingerprints(pa.array(new, pa.large_string()))
    hexed = lambda rows: pa.array([r.tobytes().hex() for r in rows], pa.string())
    columns = [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()), hexed(prints), hexed(changed), pa.array(likeness(prints, changed)), pa.array(likeness(prints, after_prints))]
    return dict(zip(_ROW, columns))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order with the next one's; the first (edge 1) and the last (edge 2) of a task come with their texts."""
    part, held = TaskContext.get().partitionId(), None

    def edge(kind: int, doc_id: pa.Array, text: str) -> pa.RecordBatch:
        bare = [doc_id, *[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]]
        return pa.record_batch([*bare, pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([text], pa.string())], names=[*_ROW, "edge", "part", "text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        prints = fingerprints(batch.column("text"))
        if held is None:
            yield edge(1, ids[:1], texts[0])
        else:
            ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], np.vstack([held[2], prints])
        if len(texts) > 1:
            n = len(texts) - 1
            made = _compared(ids[:n], texts[:n], prints[:n], texts[1:], prints[1:])
            yield pa.record_batch([*made.values(), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part)), pa.nulls(n, pa.string())], names=[*_ROW, "edge", "part", "text"])
        held = (ids[-1:], texts[-1], prints[-1:])
    if held is not None:
        yield edge(2, held[0], held[1])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            texts, after = (batch.column(c) for c in ("text", "after"))
            made = _compared(batch.column("doc_id"), texts.to_pylist(), fingerprints(texts), after.to_pylist(), fingerprints(after))
            yield pa.record_batch(list(made.values()), names=list(made))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of documents (doc_id, text).

    The next document is that of the next greater doc_id, null ids behind all others and equal ids in the order of
    their texts; after the last comes the first. Texts are dealt to tasks by ranges of that order, so only the texts at
    a range's ends are read once more. Null texts are empty. Repeated rows are rows of their own, each the next of the
    one before. An empty table gives no rows; a single row follows itself; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the last key deals equal rows to several tasks; their order is of no consequence
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash").asc(), F.col("place").asc()]
    dealt = rows.repartitionByRange(partitions_for(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = written(dealt.mapInArrow(_in_order, f"{_ROW_SCHEMA}, edge int, part long, text string"), "compared")
    first = made.where("edge = 1").select("part", F.col("text").alias("after"))
    parts = first.select("part").distinct()  # one number for each task
    following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("next"))
    last = made.where("edge = 2").select("doc_id", "text", "part").join(following, "part").select("doc_id", "text", F.col("next").alias("part"))
    ends = last.join(first, "part").select("doc_id", "text", "after").mapInArrow(_at_edges, _ROW_SCHEMA)
    return made.where("edge = 0").select(*_ROW).unionByName(ends)


def tables(count: int, radius: int = RADIUS) -> list[np.ndarray]:
    """Masks over a fingerprint's bytes' bits, one for each table: any two fingerprints within the radius agree on one at least.

    There are radius + 1 blocks or more, of which all but `radius` make a key; the fewest for which a key has as many
    bits as it takes to tell `count` random fingerprints apart.
    """
    blocks = radius + 1
    while blocks < min(BITS, radius + 4) and BITS * (blocks - radius) // blocks < np.log2(max(2, count)):
        blocks += 1
    at = np.arange(BITS) * blocks // BITS
    return [np.packbits(np.isin(at, chosen)) for chosen in combinations(range(blocks), blocks - radius)]


def _keyed(masks: list[np.ndarray]):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                prints, node = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(batch.num_rows, -1), batch.column("node")
                for k, mask in enumerate(masks):
                    words = np.ascontiguousarray(prints & mask).view(np.uint64)
                    key = np.full(len(words), k, np.uint64)
                    for w in words.T:
                        key = mix(key * _PAIR + w)
                    yield pa.record_batch([pa.array(np.full(len(words), k, np.int32)), pa.array(key.view(np.int64)), node], names=["which", "key", "node"])

    return keyed


def _few(masks: list[int], which: int, radius: int, prints: list[bytes], blocks: list[int] | None, docs: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """What each of a few rows gains by its links, and the links. With blocks, only pairs of different ones count."""
    x, gain, edges = [int.from_bytes(p, "big") for p in prints], [0] * len(prints), []
    for p in range(len(x)):
        for q in range(p):
            apart = x[p] ^ x[q]
            if apart.bit_count() <= radius and not apart & masks[which] and all(apart & m for m in masks[:which]) and (blocks is None or blocks[p] != blocks[q]):
                gain[p] += docs[q]
                gain[q] += docs[p]
                edges.append((q, p))
    return gain, edges


def _many(masks: list[np.ndarray], which: int, radius: int, prints: list[bytes], blocks: list[int] | None, docs: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """The same for many rows, with the edges of trees over their classes in place of all links."""
    x = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
    block, weight = np.array(blocks if blocks else [0] * len(x)), np.array(docs)
    gain, left, edges = np.zeros(len(x), np.int64), np.ones(len(x), bool), []
    near = np.zeros((len(x), len(x)), bool)
    for a in range(0, len(x), 256):
        apart = sum(np.bitwise_count(x[a : a + 256, w, None] ^ x[None, :, w]).astype(np.uint16) for w in range(x.shape[1]))
        p, q = np.nonzero(apart <= radius)
        p += a
        new = (p != q) & (block[p] != block[q] if blocks else True)
        p, q = p[new], q[new]
        new = (((x[p] ^ x[q]) & masks[which]) == 0).all(1)
        for m in masks[:which]:
            new &= (((x[p] ^ x[q]) & m) != 0).any(1)
        p, q = p[new], q[new]
        near[p, q] = True
        np.add.at(gain, p, weight[q])
    for start in np.flatnonzero(near.any(1)).tolist():
        if left[start]:
            left[start], todo = False, [start]
            while todo:
                v = todo.pop()
                found = np.flatnonzero(near[v] & left).tolist()
                left[found] = False
                edges += [(v, f) for f in found]
                todo += found
    return gain.tolist(), edges


def _linked(masks: list[np.ndarray], radius: int):
    words, numbers = [m.view(np.uint64) for m in masks], [int.from_bytes(m.tobytes(), "big") for m in masks]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each key, or between two blocks of one: what each row gains, and edges. A key's rows follow each other.

        A pair counts where the tables before disagree on it; that keys are hashes, which may be equal by chance, does no harm.
        """
        out: tuple[list, list, list] = [], [], []

        def take(key: tuple, rows: list[tuple]) -> None:
            block, node, prints, docs = zip(*rows)
            which, apart = key[0], list(block) if key[2] != key[3] else None
            gain, edges = _few(numbers, which, radius, prints, apart, docs) if len(rows) <= FEW else _many(words, which, radius, prints, apart, docs)
            some = [(node[p], node[p], g) for p, g in enumerate(gain) if g] + [(node[p], node[q], 0) for p, q in edges]
            for column, values in zip(out, zip(*some)):
                column.extend(values)

        held, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                if row[:4] != held:
                    if len(rows) > 1:
                        take(held, rows)
                    held, rows = row[:4], []
                rows.append(row[4:])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b", "n"])
            out = [], [], []
        if len(rows) > 1:
            take(held, rows)
        yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b", "n"])

    return linked


def within(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fingerprint, n_near, near_id of rows (doc_id, fingerprint): one row for each different fingerprint.

    n_near is how many other documents' fingerprints are within the radius, equal ones included; near_id is the least
    doc_id that is reached by such links. All of them are found: equal fingerprints are one node, nodes meet by every
    table, and a pair counts at the first table on whose key it agrees. The nodes of a key are compared block by block,
    so a task holds two blocks at most, and only sums and the edges of trees are written, not pairs. Null ids are
    documents as well, but no near_id; an empty table gives no rows.
    """
    nodes = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least"))
    nodes = written(nodes.select("*", F.unhex("fingerprint").alias("print"), F.monotonically_increasing_id().alias("node")), "nodes")
    masks = tables(nodes.count(), radius)
    keyed = nodes.select("print", "node").mapInArrow(_keyed(masks), "which int, key long, node long")
    full = written(keyed.groupBy("which", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "keys")
    held = written(keyed.join(full, ["which", "key"]), "held")
    cut = held.join(nodes.select("node", "print", "docs"), "node").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("which", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "print", "docs")
    together = ["which", "key", "i", "j"]
    found = written(cut.repartition(*together).sortWithinPartitions(*together, "node").mapInArrow(_linked(masks, radius), "a long, b long, n long"), "near")
    discard(full, held)
    gained = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    classes = connected(found.select("a", "b")).select("node", "component")
    of = nodes.select("node", "fingerprint", "docs", "least").join(gained, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("least").alias("near_id"))
    return of.join(least, "component").select("fingerprint", (F.coalesce("n", F.lit(0)) + F.col("docs") - 1).alias("n_near"), "near_id")


def near_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `compare_with_edits`, with `n_near` and `near_id` of each fingerprint."""
    compared = written(compare_with_edits(docs), "fingerprints")
    return compared.join(within(compared.select("doc_id", "fingerprint"), radius), "fingerprint").select(*_ROW, "n_near", "near_id")
