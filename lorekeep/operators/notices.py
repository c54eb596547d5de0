"""The queue of notifications of each session, replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import markers


def _replayed(steps: Column) -> Column:
    """The items still queued after all steps (operation, content): first in, first out; popAll takes all that its content holds."""
    empty = F.array().cast("array<string>")

    def step(queue: Column, s: Column) -> Column:
        return (
            F.when(s.operation == "enqueue", F.concat(queue, F.array(s.content)))
            .when(s.operation.isin("dequeue", "remove"), F.slice(queue, 2, F.greatest(F.size(queue), F.lit(1))))
            .when(s.operation == "popAll", F.filter(queue, lambda x: ~F.contains(s.content, x)))
            .otherwise(queue)
        )

    return F.aggregate(steps, empty, step)


def queues(events: DataFrame) -> DataFrame:
    """path, queued, enqueued, delivered of each session: what still waits, what ever came in, and the texts that reached the agent.

    A session's records lie in one file, so the steps of one are an array. Delivered are user texts with a task
    notification and prompts of queued commands. Unknown operations and those on an empty queue do nothing.
    """
    line = F.col("payload")
    operation = (F.col("kind") == "other") & (F.get_json_object(line, "$.type") == "queue-operation")
    content = F.coalesce(F.get_json_object(line, "$.content"), F.lit(""))
    steps = F.array_sort(F.collect_list(F.when(operation, F.struct("idx", F.col("detail").alias("operation"), content.alias("content")))))
    told = F.when((F.col("kind") == "user") & F.col("text").contains(markers.TASK_NOTIFICATION), F.col("text")).when((F.col("kind") == "attachment") & (F.col("detail") == "queued_command"), F.coalesce(F.get_json_object(line, "$.attachment.prompt"), F.lit("")))
    each = events.groupBy("path").agg(steps.alias("steps"), F.array_sort(F.collect_list(F.when(told.isNotNull(), F.struct("idx", told.alias("text"))))).alias("told"))
    came = F.transform(F.filter("steps", lambda s: s.operation == "enqueue"), lambda s: s.content)
    return each.select("path", _replayed(F.col("steps")).alias("queued"), came.alias("enqueued"), F.transform("told", lambda t: t.text).alias("delivered"))


def _named_calls(queues_: DataFrame, texts: str) -> DataFrame:
    """path, call_id: calls that a notification of the column reports."""
    found = queues_.select("path", F.explode(texts).alias("t")).select("path", F.explode(F.regexp_extract_all("t", F.lit(markers.NOTIFIED_CALL), F.lit(1))).alias("call_id"))
    return found.distinct()


def completed(queues_: DataFrame) -> DataFrame:
    """path, call_id of calls whose notification was delivered, or came in and waits no more."""
    gone = _named_calls(queues_, "enqueued").join(_named_calls(queues_, "queued"), ["path", "call_id"], "left_anti")
    return _named_calls(queues_, "delivered").unionByName(gone).distinct()
