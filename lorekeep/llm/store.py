"""Files and tables in the folder that driver and executors share, and other helpers of all operators.

The folder is the one that the cluster names in spark.checkpoint.dir. Where the setting is missing and
the master is local, as in tests, a folder of this machine is used; on a cluster that is an error.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Arrow batches to Python are held small, so that a batch of long texts fits into a worker.
BATCH_ROWS, BATCH_BYTES = "4000", "8m"


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session and check that dates and times are in UTC."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for `name` under the shared folder, as a URI."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "lorekeep")
    if "://" not in base:  # a path of the default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()).replace("file:/", "file:///", 1)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: computed once, with no lineage to recompute."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path there. Used by executors to write and read binary files."""
    return pafs.FileSystem.from_uri(uri)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: what was made of them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def driver_table(spark: SparkSession, rows: Sequence[tuple], schema: str | StructType) -> DataFrame:
    """A small table of the driver's rows, sent as Arrow.

    Spark turns pickled rows into its own by Python workers of another kind than SQL's, which executors then keep as well.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) or [()] * len(arrow)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kind)


#: Mappings that tasks fill for later tasks of the same Python worker.
_kept: list[dict] = []


def kept_by_worker(mapping: dict) -> dict:
    """A mapping that lasts in this worker until a task of another operator lets it go."""
    _kept.append(mapping)
    return mapping


def let_go() -> None:
    """Give back what earlier operators' tasks left in this worker, which outlives them; called where a task begins."""
    for mapping in _kept:
        mapping.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def partitions_for(df: DataFrame, each: int = 16 << 20) -> int:
    """So many partitions that each gets about `each` bytes of the input as stored, and at least the session's count."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size > 1 << 62 else size  # unknown
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; rows where it is 0 are held out of all learning. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))


#: Bits of a membership filter: 4 MB, whatever the corpus. Filters only save work: above their size more rows pass.
FILTER_BITS = 1 << 25
_BUCKET = 1 << 15  # bits of one bitmap of Spark's bitmap functions


def leading_number(name: str) -> Column:
    """The first eight bytes of a binary column as a little-endian signed number."""
    return F.expr(f"cast(conv(concat_ws('', reverse(transform(sequence(1, 8), i -> hex(substring({name}, i, 1))))), 16, -10) as long)")


def membership(keys: DataFrame, name: str) -> bytes:
    """A bitmap with the place of every value of a binary column set: its leading number modulo FILTER_BITS."""
    bit = F.pmod(leading_number(name), F.lit(FILTER_BITS)) + 1  # counted from 1, as Spark's bitmap functions do
    found = keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # at most FILTER_BITS / 32768 rows
    bits = bytearray(FILTER_BITS // 8)
    for r in found:
        bits[(r.bucket - 1) * _BUCKET // 8 : r.bucket * _BUCKET // 8] = r.bits
    return bytes(bits)


def maybe_member(bits: bytes, key: bytes) -> bool:
    """False only if the key is not among those that the bitmap was made of."""
    b = int.from_bytes(key[:8], "little") % FILTER_BITS
    return bool(bits[b >> 3] >> (b & 7) & 1)
