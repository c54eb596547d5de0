"""Review comments in sessions: by pattern, in JSON, or by a function of the user's, from what was typed and what tools surfaced."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lorekeep.operators import session

#: Results of these tools, and all of sidechains, are the agent's own words.
SUBAGENTS = "Agent|Task"
FOUND = "format string, file string, line_start bigint, line_end bigint, comment string"


@dataclass(frozen=True)
class ByPattern:
    """A pattern whose groups are a comment's file, first and last line and parts; the parts that are not blank are joined."""

    name: str
    pattern: str
    comment: tuple[int, ...]
    file: int | None = None
    line_start: int | None = None
    line_end: int | None = None
    join: str = " "

    def found(self, text: Column) -> Column:
        """All comments of a text, as an array."""
        of = lambda g: F.regexp_extract_all(text, F.lit(self.pattern), F.lit(g))
        groups = sorted({*self.comment, *(g for g in (self.file, self.line_start, self.line_end) if g is not None)})
        rows = F.arrays_zip(*[of(g).alias(f"g{g}") for g in groups])
        trim = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
        none = lambda kind: F.lit(None).cast(kind)

        def row(x: Column) -> Column:
            part = lambda g: x[f"g{g}"]
            line = lambda g: none("bigint") if g is None else trim(part(g)).try_cast("bigint")
            parts = F.filter(F.array(*[trim(part(g)) for g in self.comment]), lambda p: p != "")
            return F.struct(F.lit(self.name).alias("format"), (none("string") if self.file is None else F.nullif(part(self.file), F.lit(""))).alias("file"), line(self.line_start).alias("line_start"), line(self.line_end).alias("line_end"), F.array_join(parts, self.join).alias("comment"))

        return F.transform(rows, row)


@dataclass(frozen=True)
class InJson:
    """Objects of a JSON text: its list, or one under a key, or within `result`, or under keys that begin with `confirmed`."""

    name: str
    findings: tuple[str, ...] = ("findings",)
    file: tuple[str, ...] = ("file",)
    line: tuple[str, ...] = ("line",)
    comment: tuple[str, ...] = ("comment",)
    fix: tuple[str, ...] = ()


@dataclass(frozen=True)
class ByFunction:
    """A function from a text that the pattern is in to rows (file, line_start, line_end, comment). It runs in Python, row by row."""

    name: str
    pattern: str
    extract: Callable[[str], Iterable[tuple]] = field(compare=False)


def _first(obj: dict, keys: tuple[str, ...]):
    return next((obj[k] for k in keys if obj.get(k) is not None), None)


def _listed(payload, keys: tuple[str, ...]) -> list:
    while isinstance(payload, dict):
        if isinstance(nested := _first(payload, keys), list):
            return nested
        if not isinstance(payload.get("result"), dict):
            return [x for k, v in payload.items() if k.startswith("confirmed") and isinstance(v, list) for x in v]
        payload = payload["result"]
    return payload if isinstance(payload, list) else []


def _shown(value) -> str:
    return value if isinstance(value, str) else str(value) if isinstance(value, (bool, int, float)) else json.dumps(value)


def _lines(value) -> tuple[int | None, int | None]:
    if isinstance(value, int) and not isinstance(value, bool):
        return value, value
    if isinstance(value, str) and (m := re.fullmatch(r"\s*([0-9]+)\s*(?:-\s*([0-9]+)\s*)?", value)):
        return int(m[1]), int(m[2] or m[1])
    return None, None


def json_comments(text: str, formats: Iterable[InJson]) -> Iterator[tuple]:
    """Rows of FOUND of a text that is JSON; of others none."""
    try:
        payload = json.loads(text)
    except (ValueError, RecursionError):
        return
    for f in formats:
        for obj in _listed(payload, f.findings):
            if isinstance(obj, dict) and (told := _first(obj, f.comment)) is not None:
                fix, file = _first(obj, f.fix), _first(obj, f.file)
                yield (f.name, None if file is None else _shown(file), *_lines(_first(obj, f.line)), " ".join(_shown(x) for x in (told, fix) if x is not None))


def extractor(functions: list[ByFunction], structured: list[InJson]):
    """A table function of a text that yields several comments, for a lateral join."""

    class Comments:
        def eval(self, text: str):
            for f in functions:
                if text and re.search(f.pattern, text):
                    yield from ((f.name, *row) for row in f.extract(text))
            if text and text.lstrip()[:1] in ("{", "["):
                yield from json_comments(text, structured)

    return udtf(Comments, returnType=FOUND)


def scanned(turned: DataFrame, surfaces: tuple[str, ...] = ("typed", "surfaced")) -> DataFrame:
    """path, idx, uuid, at, text, provenance, trigger_idx: what users typed (at -1), and results of known tools.

    A result is `surfaced`, or `claude` if a subagent gave it or it lies in a sidechain; a result of an unknown call is
    not read. The trigger of a typed text is the nearest assistant before it.
    """
    near = (turned if "before_assistant" in turned.columns else session.nearest(turned)).where("kind = 'user'")
    typed = near.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").select("path", "idx", "uuid", F.lit(-1).alias("at"), "text", F.lit("typed").alias("provenance"), F.col("before_assistant").alias("trigger_idx"))
    used = turned.select("path", "idx", F.posexplode("calls").alias("k", "c")).select("path", F.col("c.id").alias("call_id"), F.struct("idx", "k", F.col("c.name").alias("name")).alias("u"))
    last = used.groupBy("path", "call_id").agg(F.max("u").alias("u")).select("path", "call_id", F.col("u.name").alias("name"))
    results = turned.where("kind = 'user'").select("path", "idx", "uuid", "is_sidechain", F.posexplode("results").alias("at", "r")).select("path", "idx", "uuid", "is_sidechain", "at", F.col("r.tool_use_id").alias("call_id"), F.col("r.content").alias("text"))
    own = F.col("is_sidechain") | session.named(SUBAGENTS)
    surfaced = results.join(last, ["path", "call_id"]).select("path", "idx", "uuid", "at", "text", F.when(own, "claude").otherwise("surfaced").alias("provenance"), F.lit(None).cast("bigint").alias("trigger_idx"))
    return typed.unionByName(surfaced).where(F.col("provenance").isin(*surfaces))


def comments(turned: DataFrame, patterns: list[ByPattern] = (), functions: list[ByFunction] = (), structured: list[InJson] = (), surfaces: tuple[str, ...] = ("typed", "surfaced")) -> DataFrame:
    """path, idx, uuid, at, provenance, trigger_idx, format, file, line_start, line_end, comment of all formats.

    Patterns stay in Spark's own functions; only texts that may hold JSON, or that a function's pattern is in, go to
    the table function.
    """
    texts = scanned(turned, surfaces)
    keep = ["path", "idx", "uuid", "at", "provenance", "trigger_idx"]
    parts = [texts.where(F.col("text").rlike(p.pattern)).select(*keep, F.explode(p.found(F.col("text"))).alias("f")).select(*keep, "f.*") for p in patterns]
    if functions or structured:
        test = F.lit(False)
        for f in functions:
            test = test | F.col("text").rlike(f.pattern)
        if structured:
            test = test | F.col("text").rlike(r"\A\s*[\[{]")
        made = extractor(list(functions), list(structured))
        parts.append(texts.where(test).lateralJoin(made(F.col("text").outer())).select(*keep, "format", "file", "line_start", "line_end", "comment"))
    if not parts:
        raise ValueError("no format is given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
