"""Text and vector functions built of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_words(*words: str) -> str:
    """A pattern for any of the words in any case, not within a longer run of ASCII word characters."""
    return rf"(?i)(?<![0-9A-Za-z_])({'|'.join(words)})(?![0-9A-Za-z_])"


def clip(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def matching_lines(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Each line that matches, with its number from 1; texts without a match are not split."""
    lines = docs.where(F.col(text).rlike(pattern)).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "text"))
    return lines.where(F.col("text").rlike(pattern)).select(key, (F.col("pos") + 1).alias("line"), "text")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero or one is null."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a.cast("array<double>")) * dot(b, b.cast("array<double>"))))
