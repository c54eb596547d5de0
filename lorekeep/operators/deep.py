"""Sessions that other sessions lead to: side chains by file name, reachability along edges, and views over a whole tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.shared import discard, written


def sidechains(files: DataFrame) -> DataFrame:
    """parent, child, spawned_by: the files `<stem>/subagents/agent-<id>.jsonl` of each file `<stem>.jsonl`."""
    pattern = r"\A(.*)/subagents/agent-([^/]+)\.jsonl\z"
    found = files.where(F.col("path").rlike(pattern))
    return found.select(F.concat(F.regexp_extract("path", pattern, 1), F.lit(".jsonl")).alias("parent"), F.col("path").alias("child"), F.regexp_extract("path", pattern, 2).alias("spawned_by"))


def dispatched(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls (path, call_id) with the session that they started, if its file is there, as `child`."""
    of = edges.select(F.col("parent").alias("path"), F.col("spawned_by").alias("call_id"), "child")
    return calls.join(of, ["path", "call_id"], "left")


def reachable(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """root, node, depth of all that each root leads to along edges (parent, child), itself at 0, each at its least depth.

    Rounds of a frontier against what has been seen, so cycles, loops, repeated edges and several ways to a node end by
    themselves; a round costs a join of its frontier. Rounds are written tables. Null ends are no edges.
    """
    ways = written(edges.select("parent", "child").where("parent is not null and child is not null and parent != child").distinct(), "edges")
    front = written(roots.select(F.col("node").alias("root"), "node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "reached")
    rounds = [front]
    seen = front
    while (depth is None or len(rounds) <= depth) and not front.isEmpty():
        step = front.join(ways, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        front = written(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(len(rounds))), "reached")
        rounds.append(front)
        seen = seen.unionByName(front)
    out = written(seen, "reachable")
    discard(ways, *rounds)
    return out


def walk(edges: DataFrame, roots: DataFrame, order: str = "child") -> DataFrame:
    """root, node, depth, way: what a walk from each root finds first, going down before it goes on; without the root itself.

    Children are taken by `order` (then by name), a node counts where it is met first, and `way` is the list of places
    that leads there, so sorting by it gives the walk's order. That is the least of all ways without a cycle: each round
    passes on the ways that got better, until none does.
    """
    place = F.struct(F.col(order).cast("string").alias("order"), F.col("child").cast("string").alias("child"))
    ways = written(edges.where("parent is not null and child is not null").select("parent", "child", place.alias("place")).distinct(), "edges")
    start = roots.select(F.col("node").alias("root"), "node", F.array().cast("array<struct<order:string,child:string>>").alias("way")).where("node is not null").distinct()
    best = front = written(start, "ways")
    while not front.isEmpty():
        step = front.join(ways, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), F.concat("way", F.array("place")).alias("way"))
        least = step.groupBy("root", "node").agg(F.min("way").alias("way"))
        known = best.select("root", "node", F.col("way").alias("known"))
        better = written(least.join(known, ["root", "node"], "left").where("known is null or way < known").drop("known"), "ways")
        merged = written(best.join(better.select("root", "node"), ["root", "node"], "left_anti").unionByName(better), "best-ways")
        discard(best, *([front] if front is not best else []))
        best, front = merged, better
    return best.where(F.size("way") > 0).select("root", "node", F.size("way").alias("depth"), F.transform("way", lambda p: p.child).alias("way"))


def view(rows: DataFrame, walked: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows by `path` of each root and of all sessions that a walk found: root, depth, way, and the row's columns.

    Sort by root, way and place to read them as the walk does: the root first, then each session before its own children.
    """
    own = roots.select(F.col("node").alias("root"), F.col("node").alias("path"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("way")).distinct()
    return rows.join(own.unionByName(walked.withColumnRenamed("node", "path")), "path")


def inputs(calls: DataFrame, by: list[str], also: Column | None = None) -> DataFrame:
    """What questions about sessions need, by root or session: names, files, commands, edited files and skills, each in order.

    Failed calls are left out. `also` keeps further calls out.
    """
    shown = calls.where(~F.col("is_error") & (also if also is not None else F.lit(True)))
    place = [c for c in ("way", "path", "idx", "at") if c in calls.columns]

    def listed(value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*place, value.alias("v"))))), lambda x: x.v)

    edited = F.when(F.col("hunks").isNotNull(), F.col("file_path"))
    return shown.groupBy(*by).agg(listed(F.col("name")).alias("names"), listed(F.col("file_path")).alias("files"), listed(F.col("command")).alias("commands"), listed(edited).alias("edited"), listed(F.col("skill")).alias("skills"))
