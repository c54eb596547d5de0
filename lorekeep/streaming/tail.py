"""Streams of session events: parsed per line, once per event, paired with late results, and counted in windows.

Writers add files of whole lines to a folder (a line is never in two files); each new file is read once, which the
checkpoint records, so a restarted stream goes on where it stopped. State is keyed by session or event id and
bounded by the watermark where one is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorekeep.shared import folder_for  # noqa: F401
from lorekeep.sources.sessions import events


def stream_events(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """The events of all *.jsonl files at or below a folder, and of those that come. Lines that cannot be an event are skipped.

    There is no place in a file here: `idx` is the event's time in microseconds.
    """
    lines = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", max_files).load(folder)
    parsed = events(lines.select(F.col("_metadata.file_path").alias("path"), F.lit(0).alias("idx"), F.col("value").alias("line")), keep_invalid=True)
    good = parsed.where("problem is null").drop("problem")
    return good.withColumn("path", F.coalesce("session_id", "path")).withColumn("idx", F.unix_micros("ts"))


def once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each uuid once, as long as its repeats come within the delay; events without one are dropped."""
    return stream.where("uuid is not null and ts is not null").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["uuid"])


def heartbeats(stream: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Per key the count and the first and last time so far, for update mode."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def windows(stream: DataFrame, keys: list[str], ts: str = "ts", size: str = "3 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per key and tumbling window the count so far; rows later than the delay are dropped."""
    return stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, size).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def calls_with_results(stream: DataFrame) -> DataFrame:
    """path, call_id, name, idx, content, is_error, pending: a call and its result meet in one state row, whichever comes first."""
    used = stream.select("path", "idx", F.explode("calls").alias("c")).select("path", F.col("c.id").alias("call_id"), F.struct("idx", F.col("c.name").alias("name")).alias("u"), F.lit(None).cast("struct<idx:bigint,content:string,is_error:boolean>").alias("r"))
    back = stream.select("path", "idx", F.explode("results").alias("x")).select("path", F.col("x.tool_use_id").alias("call_id"), F.lit(None).cast("struct<idx:bigint,name:string>").alias("u"), F.struct("idx", F.col("x.content").alias("content"), F.col("x.is_error").alias("is_error")).alias("r"))
    both = used.unionByName(back).groupBy("path", "call_id").agg(F.max("u").alias("u"), F.max("r").alias("r"))
    return both.where("u is not null").select("path", "call_id", "u.name", "u.idx", "r.content", F.coalesce("r.is_error", F.lit(False)).alias("is_error"), F.col("r").isNull().alias("pending"))


def to_table(updates: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run an update-mode stream over all there is now, and return its last row of each key.

    Every micro-batch is its own folder of the table, overwritten if it is retried, so each counts once.
    """
    schema = StructType(updates.schema.fields)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    updates.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start().awaitTermination()
    spark = updates.sparkSession
    rows = spark.read.option("basePath", path).schema(schema.add("batch", "long")).parquet(path)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in updates.columns if c not in keys]), "batch").alias("row"))
    return last.select(*keys, "row.*").select(*updates.columns)


def replayed(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    """A table of a data folder as a stream."""
    return spark.readStream.schema(columns).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
