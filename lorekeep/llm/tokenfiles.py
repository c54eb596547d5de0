"""Token ids in Arrow file format, as fixed-size-list batches with random access to equal-length sequences.

Each shard holds a run of documents in ascending order: `<shard>.arrow` has the shard's ids as rows of
exactly `sequence` ids and a mask of the ids that are real (only the end of a shard's last row is padding);
`<shard>.index.arrow` has where each document lies. Both are memory-mapped or read by record batch, so any
sequence, or any document, is had without reading the rest and without a copy.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.store import filesystem, partitions_for, prepare, shared_dir, written
from lorekeep.llm.tokens import encoder

SEQUENCE, ROWS = 1024, 512
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
CONTENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class ShardWriter:
    """Writes one shard; `rows` sequences make a record batch."""

    def __init__(self, uri: str, sequence: int = SEQUENCE, dtype: str = "<u2", rows: int = ROWS):
        self.uri, self.sequence, self.dtype, self.size = uri, sequence, np.dtype(dtype), sequence * rows
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        fs, path = filesystem(uri)
        fs.create_dir(path.rpartition("/")[0])
        self.out = fs.open_output_stream(path + ".arrow")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.index_out = fs.open_output_stream(path + ".index.arrow")
        self.index = pa.ipc.new_file(self.index_out, INDEX)
        self.pending, self.held, self.total, self.docs, self.entries = [], 0, 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.entries.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.docs += 1
        if len(ids) and int(ids.max()) > np.iinfo(self.dtype).max:
            raise OverflowError(f"a token id does not fit into {self.dtype}")
        self.pending.append(ids.astype(self.dtype))
        self.held += len(ids)
        if self.held >= self.size:
            self._flush(False)
        if len(self.entries) >= 50_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.zeros(0, self.dtype)
        if last:  # the last row is padded within the last batch
            real, flat = len(flat), np.append(flat, np.zeros(-len(flat) % self.sequence, self.dtype))
        else:  # every batch before is whole, so that a place tells its batch
            real = len(flat) // self.size * self.size
        for a in range(0, real, self.size):
            self._batch(flat[a : a + self.size], min(self.size, real - a))
        self.pending, self.held = [flat[real:].copy()], len(flat) - real

    def _batch(self, ids: np.ndarray, real: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, np.arange(len(ids)) < real)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def _flush_index(self) -> None:
        if self.entries:
            self.index.write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in zip(*self.entries)], schema=INDEX))
        self.entries = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        for x in (self.writer, self.out, self.index, self.index_out):
            x.close()


class Shard:
    """Random access to one shard: `sequence(k)` and `ids(start, n)` are views of the file's batches where they can be."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        local = fs.type_name == "local"
        opened = [pa.memory_map(path + x) if local else fs.open_input_file(path + x) for x in (".arrow", ".index.arrow")]
        self.data, self.index = map(pa.ipc.open_file, opened)
        self.width = self.data.schema.field("ids").type.list_size
        self.rows = self.data.get_batch(0).num_rows if self.data.num_record_batches else 0
        self.at, self.batch = -1, None

    def _flat(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.batch = k, self.data.get_batch(k)
        return self.batch.column("ids").flatten().to_numpy()

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of the shard's k-th sequence."""
        flat, a = self._flat(k // self.rows), k % self.rows * self.width
        mask = self.batch.column("mask").flatten()[a : a + self.width].to_numpy(zero_copy_only=False)
        return flat[a : a + self.width], mask

    def ids(self, start: int, n: int) -> np.ndarray:
        size, parts = self.rows * self.width, []
        while n:
            k, a = divmod(start, size)
            part = self._flat(k)[a : a + n]
            if not len(part):
                raise ValueError("the shard ends before the document does")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for k in range(self.index.num_record_batches):
            yield self.index.get_batch(k)


def write_tokens(docs: DataFrame, path: str, end_id: int = 0, vocabulary: str | None = None, sequence: int = SEQUENCE, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append `end_id`, and write the ids in ascending id order; returns the manifest.

    Rows are dealt by ranges of the id, so shard k holds smaller ids than shard k + 1, and each shard is
    sorted. Null ids come first, repeated ids lie side by side, null texts are just the end id. An attempt
    of a task writes under a name of its own and only finished attempts are in the manifest (shard, path,
    n_docs, n_tokens), which is itself a written table. `dtype` must hold every id of the vocabulary. Very long texts
    are encoded whole; other columns are not read, whatever their names; an empty table gives an empty manifest.
    """
    prepare(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = cols.repartitionByRange(partitions_for(docs), F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, end = encoder(vocabulary, added=True), None, np.array([end_id], "<u4").tobytes()
        shard = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                writer = writer or ShardWriter(f"{path}/{shard:06d}-{uuid.uuid4().hex[:8]}", sequence, dtype)
                writer.add(doc_id, np.frombuffer(encode(text.as_py()) + end, "<u4"))
        if writer:
            writer.close()
            yield pa.record_batch([[shard], [writer.uri], [writer.docs], [writer.total]], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return written(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids before it in all shards), n_tokens, ids_crc32.

    The offsets of shards come from the manifest, which has one row per shard.
    """
    spark = manifest.sparkSession
    shards = sorted((r.shard, r.path, r.n_tokens) for r in manifest.select("shard", "path", "n_tokens").collect())
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    base, rows = 0, []
    for shard, path, n in shards:
        rows.append((shard, path, base))
        base += n
    spread = spark.createDataFrame(rows, "shard int, path string, base long").repartition(len(rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(path)
                for entries in shard.documents():
                    starts, sizes = (entries.column(k).to_numpy() for k in (1, 2))
                    crc = [zlib.crc32(shard.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.record_batch([entries.column(0), pa.array(starts + base), entries.column(2), pa.array(crc, pa.int64())], schema=CONTENT)

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the token files of all documents to the shared folder and read their documents back.

    Rows that repeat an id are documents of their own, null ids come first, null texts are the end id alone, very long
    texts are encoded whole. Columns other than doc_id and text are not read. An empty table gives no rows.
    """
    return read_tokens(write_tokens(docs, shared_dir(docs.sparkSession, "tokens"), **options))
