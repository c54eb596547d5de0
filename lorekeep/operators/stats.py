"""What a log is made of, in one pass over its events: totals, and histograms whose ties follow who was seen first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import markers
from lorekeep.operators import session


def totals(events: DataFrame) -> DataFrame:
    """One row: files, events, sessions, text_chars, thinking_chars, tool_io, interrupts, tool_errors, sidechain, first_ts, last_ts.

    Texts of users and assistants, thoughts and results are counted in characters, inputs of tools in bytes of their
    JSON. Sessions are exact; partial sums and sets meet in one last step.
    """
    said = F.col("kind").isin("user", "assistant")
    chars = lambda c: F.coalesce(F.char_length(c), F.lit(0))
    over = lambda column, f: F.aggregate(F.transform(column, f), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    io = over("calls", lambda c: F.octet_length(c.input)) + over("results", lambda r: F.char_length(r.content))
    failed = F.size(F.filter("results", lambda r: r.is_error))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return events.agg(
        F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("events"), F.countDistinct("session_id").alias("sessions"), whole(F.when(said, chars("text"))).alias("text_chars"), whole(chars("thinking")).alias("thinking_chars"), whole(io).alias("tool_io"),
        F.count(F.when((F.col("kind") == "user") & markers.is_interrupt(F.col("text")), 1)).alias("interrupts"), whole(failed).alias("tool_errors"), F.count(F.when(F.col("is_sidechain"), 1)).alias("sidechain"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def error_events(events: DataFrame) -> DataFrame:
    """path, at: the places (counted from 0) of each file's events that hold a failed result."""
    placed = events.withColumn("at", (F.row_number().over(session.in_order()) - 1).cast("long"))
    return placed.where(F.exists("results", lambda r: r.is_error)).select("path", "at")


def histograms(events: DataFrame) -> DataFrame:
    """what, name, n, place: kinds, models, tools, attachment types and errors by tool, the most frequent first.

    Of equal counts that comes first whose first event does, by path and place. A failed result counts for the tool of
    an earlier call of its id in the file.
    """
    item = lambda what, name, when: F.when(when, F.struct(F.lit(what).alias("what"), name.alias("name"), F.lit(0).alias("at")))
    own = F.array_compact(F.array(item("kind", F.col("kind"), F.lit(True)), item("model", F.col("model"), F.col("kind") == "assistant"), item("attachment", F.coalesce("detail", F.lit("")), F.col("kind") == "attachment")))
    tools = F.transform("calls", lambda c, k: F.struct(F.lit("tool").alias("what"), c["name"].alias("name"), k.alias("at")))
    each = events.select("path", "idx", F.explode(F.concat(own, tools)).alias("x")).select("path", "idx", "x.*")
    failed = session.failed_results(events).select("path", "idx", F.lit("tool_error").alias("what"), "name", F.col("at").alias("at"))
    counts = each.unionByName(failed).groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "idx", "at")).alias("first"))
    order = Window.partitionBy("what").orderBy(F.desc("n"), "first")  # a row a name
    return counts.select("what", "name", "n", F.row_number().over(order).cast("long").alias("place"))


def page(rows: DataFrame, order: list[str], first: int | None = None, last: int | None = None, span: tuple[int, int] | None = None, cap: int = 200) -> DataFrame:
    """Each session's first or last rows, those at places [a, b), or its newest `cap`; `hidden` is how many of the session are not shown."""
    up = Window.partitionBy("path").orderBy(*order)
    placed = rows.withColumn("_up", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("path")))
    behind = F.col("_n") - F.col("_up") + 1
    test: Column = F.col("_up") <= first if first is not None else behind <= last if last is not None else (F.col("_up") > span[0]) & (F.col("_up") <= span[1]) if span else behind <= cap
    shown = placed.where(test)
    return shown.withColumn("hidden", F.col("_n") - F.count(F.lit(1)).over(Window.partitionBy("path"))).drop("_up", "_n")
