"""Scalar functions: sizes, cuts, times, overlaps of edits, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: dollars for a million tokens of a model family (input, output, cache read, cache written for 5 minutes, and for an hour)
PRICES = {"fable": (10.0, 50.0, 1.0, 12.5, 20.0), "opus": (5.0, 25.0, 0.5, 6.25, 10.0), "sonnet": (3.0, 15.0, 0.3, 3.75, 6.0), "haiku": (1.0, 5.0, 0.1, 1.25, 2.0)}
#: Separators of lines as Python splits them.
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def truncate(text: Column, n: int) -> Column:
    """White space collapsed, then n - 1 characters and an ellipsis if it is longer; 0 cuts nothing."""
    flat = F.trim(F.regexp_replace(text, r"[\s\p{Z}\x1c-\x1f\x85]+", " "))
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat) if n else flat


def clip(text: Column, limit: int) -> Column:
    """`limit` characters, and how many were cut."""
    more = F.char_length(text) - limit
    return F.when(more > 0, F.concat(F.substring(text, 1, limit), F.lit("…(+"), more.cast("string"), F.lit("ch)"))).otherwise(text)


def human_size(n: Column) -> Column:
    """Bytes in B, KB, MB, GB or TB of 1024, with one digit behind the point from KB on."""
    step = lambda k, unit: F.concat(F.format_string("%.1f", F.bround(n / float(1 << k), 1)), F.lit(unit))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, step(10, "KB")).when(n < 1 << 30, step(20, "MB")).when(n < 1 << 40, step(30, "GB")).otherwise(step(40, "TB"))


def epoch_ms(ts: Column) -> Column:
    return F.bround(F.unix_micros(ts) / 1000).cast("long")


def normalized_lines(text: Column) -> Column:
    """Lines with white space collapsed, empty ones dropped."""
    lines = F.transform(F.split(text, LINES), lambda x: F.trim(F.regexp_replace(x, r"[\s\p{Z}\x1c-\x1f\x85]+", " ")))
    return F.filter(lines, lambda x: x != "")


def overlap(new: Column, old: Column) -> Column:
    """The share of new lines that are among the old ones; 0 without new lines."""
    n, o = normalized_lines(new), normalized_lines(old)
    return F.when(F.size(n) > 0, F.size(F.filter(n, lambda x: F.array_contains(o, x))) / F.size(n)).otherwise(0.0)


def cost(model: Column, input_: Column, output: Column, cache_read: Column, written_5m: Column, written_1h: Column | None = None) -> Column:
    """Dollars of a row's tokens by the family that the model's name holds; null for other models. A null counter is 0."""
    parts = [F.coalesce(p, F.lit(0)) for p in (input_, output, cache_read, written_5m, F.lit(0) if written_1h is None else written_1h)]
    out = F.lit(None).cast("double")
    for family, prices in reversed(PRICES.items()):
        total = sum((p / 1e6 * F.lit(x) for p, x in zip(parts[1:], prices[1:])), parts[0] / 1e6 * F.lit(prices[0]))
        out = F.when(model.contains(family), total).otherwise(out)
    return out
