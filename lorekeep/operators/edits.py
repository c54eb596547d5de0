"""Edits of sessions: patch envelopes and diffs read as hunks, what later edits take back, who wrote a file, and who may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import paths, scalars
from lorekeep.functions.rng import let
from lorekeep.operators import session

_HUNKS = "array<struct<old: string, new: string>>"
_PATCHED = "array<struct<file_path: string, kind: string, move_path: string, hunks: array<struct<old: string, new: string>>>>"
#: Stands before each line while lines are grouped; no text of a log holds it.
_MARK = "\x00"


def _grouped(lines: Column) -> Column:
    """Lines in groups that lines beginning with @@ part; what is before the first of these is the first group."""
    flat = F.array_join(F.transform(lines, lambda x: F.concat(F.lit(_MARK), x)), "")
    split = F.split(flat, _MARK + "@@[^" + _MARK + "]*")
    return F.transform(split, lambda g: F.when(g == "", F.array().cast("array<string>")).otherwise(F.slice(F.split(g, _MARK), F.lit(2), F.size(F.split(g, _MARK)))))


def _joined(lines: Column, drop: str, strip: tuple[str, ...]) -> Column:
    cut = F.transform(F.filter(lines, lambda x: ~x.startswith(drop)), lambda x: F.when(F.substring(x, 1, 1).isin(*strip), F.substring(x, F.lit(2), F.length(x))).otherwise(x))
    return F.array_join(cut, "\n")


def patched(envelope: Column) -> Column:
    """The files of a patch envelope: file_path, kind (update, add, delete), move_path, hunks. Empty if it is malformed in any place.

    In an update, lines behind @@ are a hunk each: lines with - are old, with + new, all others both. An added file has
    one hunk, its new text; a deleted one has none. Only an update may be moved.
    """
    none = F.array().cast(_PATCHED)
    marker = "*** "

    def read(raw: Column) -> Column:
        lines = F.when(F.try_element_at(raw, F.lit(-1)) == "", F.slice(raw, F.lit(1), F.size(raw) - 1)).otherwise(raw)
        placed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        end = F.array_min(F.transform(F.filter(placed, lambda p: p.x == "*** End Patch"), lambda p: p.i))
        heads = F.filter(placed, lambda p: (p.i > 0) & (p.i < end) & p.x.startswith(marker) & ~p.x.startswith("*** Move to:"))

        def sections(hs: Column) -> Column:
            def section(h: Column, k: Column) -> Column:
                upto = F.when(k + 1 < F.size(hs), F.try_element_at(hs, k + 2)["i"]).otherwise(end)
                body = F.slice(lines, h.i + 2, upto - h.i - 1)
                kind = F.when(h.x.startswith("*** Update File:"), "update").when(h.x.startswith("*** Add File:"), "add").when(h.x.startswith("*** Delete File:"), "delete")
                file = F.trim(F.regexp_extract(h.x, r"\A[^:]*:(.*)\z", 1))
                move = F.transform(F.filter(body, lambda x: x.startswith("*** Move to:")), lambda x: F.trim(F.substring(x, F.lit(13), F.length(x))))
                own = F.filter(body, lambda x: ~x.startswith(marker))
                update = F.transform(F.filter(_grouped(own), lambda g: F.size(g) > 0), lambda g: F.struct(_joined(g, "+", ("-", " ")).alias("old"), _joined(g, "-", ("+", " ")).alias("new")))
                add = F.when(F.size(own) > 0, F.array(F.struct(F.lit("").alias("old"), F.array_join(F.transform(own, lambda x: F.regexp_replace(x, r"\A\+", "")), "\n").alias("new"))))
                hunks = F.coalesce(F.when(kind == "update", update).when(kind == "add", add), F.array().cast(_HUNKS)).cast(_HUNKS)
                right = kind.isNotNull() & (file != "") & ((F.size(move) == 0) | ((kind == "update") & ~F.array_contains(move, ""))) & ((kind != "delete") | (F.size(own) == 0))
                return F.struct(file.alias("file_path"), kind.alias("kind"), F.try_element_at(move, F.lit(-1)).alias("move_path"), hunks.alias("hunks"), F.coalesce(right, F.lit(False)).alias("right"))

            return F.transform(hs, section)

        starts = F.coalesce(F.try_element_at(heads, F.lit(1))["i"], end)
        whole = (F.try_element_at(lines, F.lit(1)) == "*** Begin Patch") & end.isNotNull() & (starts == 1) & ~F.exists(placed, lambda p: (p.i > end) & (p.x != ""))
        cut = lambda s: F.transform(s, lambda x: F.struct(x.file_path.alias("file_path"), x.kind.alias("kind"), x.move_path.alias("move_path"), x.hunks.alias("hunks"))).cast(_PATCHED)
        return F.when(whole, let(let(heads, sections), lambda s: F.when(F.forall(s, lambda x: x.right), cut(s)).otherwise(none))).otherwise(none)

    return F.coalesce(let(F.split(envelope, r"\r?\n"), read), none)


def diff_hunks(diff: Column) -> Column:
    """The hunks of a unified diff: lines with - are old, with + new; heads of files and all else are left out."""
    groups = _grouped(F.split(diff, scalars.LINES))
    later = F.slice(groups, F.lit(2), F.size(groups))
    side = lambda g, mark: F.array_join(F.transform(F.filter(g, lambda x: x.startswith(mark) & ~x.startswith(mark * 3)), lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")
    return F.transform(later, lambda g: F.struct(side(g, "-").alias("old"), side(g, "+").alias("new")))


def edits(turned: DataFrame) -> DataFrame:
    """path, turn, idx, at, nth, call_id, name, ts, cwd, session_id, file_path, kind, move_path, hunks, is_error: a row for each file that a call edits.

    Calls with a path and hunks are edits, and each file of a patch envelope, with its kind; a deletion has no hunks.
    """
    c = session.calls(turned)
    told = c.join(turned.select("path", "idx", "cwd", "session_id"), ["path", "idx"])
    own = F.array(F.struct("file_path", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("move_path"), F.col("hunks").cast(_HUNKS).alias("hunks"))).cast(_PATCHED)
    each = F.when(F.col("name") == "apply_patch", patched(F.col("input"))).when(F.col("file_path").isNotNull() & (F.size("hunks") > 0), own)
    keep = ["path", "turn", "idx", "at", "call_id", "name", "ts", "cwd", "session_id", "is_error"]
    return told.select(*keep, F.posexplode(each).alias("nth", "e")).select(*keep, "nth", "e.*")


def overlap(new: Column, old: Column) -> Column:
    """The greatest share of new lines among old ones over all pairs of two edits' hunks; 0 without hunks."""
    pairs = F.flatten(F.transform(new, lambda a: F.transform(old, lambda b: scalars.overlap(a.new, b.old))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def corrections(edited: DataFrame, lookahead: int, best: bool = False) -> DataFrame:
    """Edits with later ones of the same file in the same turn or the next `lookahead` that take back what they wrote.

    path, file_path, idx, at, nth and c_idx, c_at, c_nth of the later one, overlap (above 0) and rank: the greatest
    overlap first, then the earlier. With `best` only rank 1. Edits of one event do not correct each other.
    """
    a = edited.select("path", "file_path", "turn", "idx", "at", "nth", "hunks")
    b = edited.select("path", "file_path", F.col("turn").alias("_t"), F.col("idx").alias("c_idx"), F.col("at").alias("c_at"), F.col("nth").alias("c_nth"), F.col("hunks").alias("_h"))
    met = a.join(b, ["path", "file_path"]).where((F.col("c_idx") > F.col("idx")) & (F.col("_t") - F.col("turn") <= lookahead))
    scored = met.withColumn("overlap", overlap(F.col("hunks"), F.col("_h"))).where("overlap > 0")
    order = Window.partitionBy("path", "file_path", "idx", "at", "nth").orderBy(F.desc("overlap"), "c_idx", "c_at", "c_nth")
    out = scored.withColumn("rank", F.row_number().over(order)).select("path", "file_path", "idx", "at", "nth", "c_idx", "c_at", "c_nth", "overlap", "rank")
    return out.where("rank = 1") if best else out


def edits_before(edited: DataFrame, anchors: DataFrame, lookback: int, most: int | None = None) -> DataFrame:
    """Edits in the `lookback` turns before each anchor (path, turn, idx) and earlier in its own, with `anchor_idx` and `back`, 1 for the newest; at most so many."""
    of = anchors.select("path", F.col("turn").alias("_t"), F.col("idx").alias("anchor_idx")).distinct()
    met = edited.join(of, "path").where(F.col("turn").between(F.col("_t") - lookback, F.col("_t") - 1) | ((F.col("turn") == F.col("_t")) & (F.col("idx") < F.col("anchor_idx"))))
    newest = Window.partitionBy("path", "anchor_idx").orderBy(F.desc("idx"), F.desc("at"), F.desc("nth"))
    out = met.withColumn("back", F.row_number().over(newest)).drop("_t")
    return out if most is None else out.where(F.col("back") <= most)


def harvest(edited: DataFrame, anchors: DataFrame, lookback: int = 40, lookahead: int = 120, most: int = 12) -> DataFrame:
    """The edits before each anchor, newest first, each with its best correction, if there is one."""
    best = corrections(edited, lookahead, best=True).drop("rank")
    return edits_before(edited, anchors, lookback, most).join(best, ["path", "file_path", "idx", "at", "nth"], "left")


def first_prompts(turned: DataFrame) -> DataFrame:
    """path, first_prompt: the first prompt that is not empty, else the first user text that is not blank."""
    from lorekeep.functions import markers

    prompt = F.when(F.col("opens") & (F.col("text") != ""), F.col("idx"))
    said = F.when((F.col("kind") == "user") & ~markers.is_blank(F.col("text")), F.col("idx"))
    return turned.groupBy("path").agg(F.coalesce(F.min_by("text", prompt), F.min_by("text", said)).alias("first_prompt"))


def in_repository(edited: DataFrame, root: str) -> DataFrame:
    """Edits within a repository, with `tree` and `rel`."""
    return edited.withColumn("_p", paths.relative(F.col("file_path"), F.col("cwd"), root)).where("_p is not null").withColumn("tree", F.col("_p.tree")).withColumn("rel", F.col("_p.rel")).drop("_p")


def writes(edited: DataFrame, turned: DataFrame, root: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """rel, path, session_id, tree, first_ts, last_ts, writes, tools, first_prompt, place: who wrote each file of a repository.

    One row for each session and tree, of edits from `since` on and before `until`; tools in the order in which they are
    first seen; `place` is 1 for the newest last write of a file, ties to the smaller session.
    """
    w = in_repository(edited, root).where("ts is not null")
    if since:
        w = w.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until:
        w = w.where(F.col("ts") < F.lit(until).cast("timestamp"))
    tools = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("idx", "at", "nth", "name"))), lambda x: x["name"]))  # of one session
    each = w.groupBy("rel", "path", "tree").agg(F.min("session_id").alias("session_id"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("writes"), tools.alias("tools"))
    newest = Window.partitionBy("rel").orderBy(F.desc("last_ts"), "session_id", "path", "tree")
    return each.join(first_prompts(turned), "path", "left").withColumn("place", F.row_number().over(newest))


def attribute(files: DataFrame, edited: DataFrame, turned: DataFrame, root: str, suspects: int = 5, cell: int = 86_400) -> DataFrame:
    """rel, verdict, session_id, tool, candidates of files (rel, mtime) of a repository.

    `written`: the session of the newest write, ties to the smaller one. Else `generated`, if sessions of the repository
    that ran commands were at work at that time: candidates are these, the last to end first, each with its last
    commands up to then. Else `external`. Times meet by cells of a day, of which a session has as many as it lasts.
    """
    last = in_repository(edited, root).where("ts is not null").groupBy("rel").agg(F.min_by(F.struct("session_id", "name"), F.struct(-F.unix_micros("ts"), F.col("session_id"), F.col("idx"))).alias("w"))
    known = files.select("rel", "mtime").join(last, "rel", "left")
    member = F.max(F.coalesce(paths.tree_of(F.col("cwd"), root).isNotNull(), F.lit(False)))
    spans = turned.where("ts is not null").groupBy("path").agg(F.min_by("session_id", "idx").alias("session_id"), F.min("ts").alias("begin"), F.max("ts").alias("end"), member.alias("member")).where("member")
    ran = session.calls(turned).where("command is not null and ts is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ts", "idx", "at", "command"))).alias("ran"))  # of one session
    at = lambda c: F.floor(F.unix_seconds(c) / cell)
    cells = spans.join(ran, "path").withColumn("_cell", F.explode(F.sequence(at("begin"), at("end"))))
    open_ = known.where("w is null").select("rel", "mtime", at("mtime").alias("_cell"))
    met = open_.join(cells, "_cell").where(F.col("mtime").between(F.col("begin"), F.col("end")))
    before = F.filter("ran", lambda r: r.ts <= F.col("mtime"))
    shown = F.transform(F.slice(before, F.greatest(F.size(before) - suspects + 1, F.lit(1)), F.lit(suspects)), lambda r: r.command)
    item = F.struct((-F.unix_micros("end")).alias("k"), "session_id", shown.alias("commands"))
    found = met.groupBy("rel", "mtime").agg(F.array_sort(F.collect_list(item)).alias("c"))
    out = known.join(found, ["rel", "mtime"], "left")
    listed = F.transform("c", lambda x: F.struct(x.session_id.alias("session_id"), x.commands.alias("commands")))
    verdict = F.when(F.col("w").isNotNull(), "written").when(F.col("c").isNotNull(), "generated").otherwise("external")
    return out.select("rel", verdict.alias("verdict"), F.col("w.session_id").alias("session_id"), F.col("w.name").alias("tool"), F.coalesce(listed, F.array().cast("array<struct<session_id: string, commands: array<string>>>")).alias("candidates"))
