"""Events and lines as files: JSON lines, one line of text an event, and extracts without repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import scalars


def as_json(rows: DataFrame) -> DataFrame:
    """value: each row as a JSON object; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def line_of(width: int = 80) -> Column:
    """An event as one line: #place kind time text, with white space collapsed and cut to the width, and its calls in brackets."""
    calls = F.array_join(F.transform("calls", lambda c: c["name"]), ", ")
    parts = F.concat_ws(" ", F.concat(F.lit("#"), F.col("idx").cast("string")), "kind", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.nullif(scalars.truncate(F.coalesce("text", F.lit("")), width), F.lit("")), F.when(calls != "", F.concat(F.lit("["), calls, F.lit("]"))))
    return parts


def distinct_lines(lines: DataFrame) -> DataFrame:
    """path, idx, line: each different line once, where it comes first by path and place. Partial minima meet; no group is gathered."""
    first = lines.groupBy("line").agg(F.min(F.struct("path", "idx")).alias("f"))
    return first.select("f.path", "f.idx", "line")


def write_extract(lines: DataFrame, folder: str) -> None:
    """The different lines as text files, in order; files of a job that fails do not appear."""
    distinct_lines(lines).orderBy("path", "idx").select(F.col("line").alias("value")).write.text(folder)
