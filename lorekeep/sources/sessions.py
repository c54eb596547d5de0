"""Session transcripts (one JSON object per line) as one table of typed events.

Blank lines, lines that are no JSON and lines that are no object are skipped. A record that lacks what its kind
requires, or whose time cannot be read, makes its whole file invalid: none of the file's events are loaded, and
`invalid_files` names it. Kinds other than the known ones are kept as `other` with their payload.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import markers

BLOCK = "array<struct<type string, text string, thinking string, id string, name string, input string, tool_use_id string, content variant, is_error string, `from` struct<model string>, `to` struct<model string>>>"
FLAGS = {"is_sidechain": "isSidechain", "is_meta": "isMeta", "is_compact_summary": "isCompactSummary", "is_visible_in_transcript_only": "isVisibleInTranscriptOnly"}
KINDS = ("user", "assistant", "system", "mode", "permission-mode", "attachment")
USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
#: Files up to so many bytes are one row until their lines are numbered; larger ones are split.
WHOLE = 64 << 20


def read_lines(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """path, idx, line of all *.jsonl files at or below a path; `idx` is a line's place in its file, blank ones counted.

    A file of up to `whole` bytes is read in one piece. A larger one is read in splits, whose lines are in order, and
    its lines are numbered by a window over the file; Spark skips files of the other kind by their size.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    size, name = F.col("_metadata.file_size"), F.col("_metadata.file_path").alias("path")
    small = reader.text(path, wholetext=True).where(size <= whole).select(name, F.posexplode(F.split("value", "\n")).alias("idx", "line"))
    split = reader.option("lineSep", "\n").text(path).where(size > whole).select(name, F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    large = split.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("_split", "_row")) - 1).alias("idx"), "line")
    return small.unionByName(large).where(F.trim("line") != "")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _truthy(v: Column, path: str) -> Column:
    """Any JSON value but null, false, 0, "" and empty lists and objects."""
    return F.coalesce(~_text(v, path).isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))


def _is(v: Column, kind: str) -> Column:
    """The value is a STRING, ARRAY or OBJECT; false for null."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _joined_text(blocks: Column, sep: str) -> Column:
    """The texts of text blocks."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b.type == "text") & b.text.isNotNull()), lambda b: b.text), sep)


def _flat(content: Column) -> Column:
    """A result's content: a string as it is, of an array its texts."""
    texts = F.try_variant_get(content, "$", "array<struct<type string, text string>>")
    return F.when(_is(content, "STRING"), F.try_variant_get(content, "$", "string")).when(_is(content, "ARRAY"), _joined_text(texts, ""))


def _problem(v: Column, type_: Column, blocks: Column) -> Column:
    """What a record lacks that its kind requires; null if nothing."""
    typed = type_.isin("user", "assistant", "system", "attachment")
    content = F.try_variant_get(v, "$.message.content", "variant")
    none = lambda *columns: reduce(Column.__or__, [c.isNull() for c in columns])
    bad_result = F.exists(blocks, lambda b: (b.type == "tool_result") & (b.tool_use_id.isNull() | ~(_is(b.content, "STRING") | _is(b.content, "ARRAY"))))
    bad_block = F.exists(blocks, lambda b: b.type.isNull() | ((b.type == "text") & b.text.isNull()) | ((b.type == "thinking") & b.thinking.isNull()) | ((b.type == "tool_use") & none(b.id, b["name"], b.input)) | ((b.type == "fallback") & none(b["from"].model, b["to"].model)))
    return (
        F.when(type_.isNull(), "no type")
        .when(typed & none(_text(v, "$.uuid"), _text(v, "$.sessionId"), _text(v, "$.timestamp")), "no uuid, session or time")
        .when(typed & F.try_to_timestamp(_text(v, "$.timestamp")).isNull(), "unreadable time")
        .when((type_ == "user") & ~(_is(content, "STRING") | _is(content, "ARRAY")), "no content")
        .when((type_ == "user") & F.coalesce(bad_result, F.lit(False)), "a result without call or content")
        .when((type_ == "assistant") & (_text(v, "$.message.model").isNull() | ~_is(content, "ARRAY")), "no model or blocks")
        .when((type_ == "assistant") & F.coalesce(bad_block, F.lit(False)), "an unreadable block")
        .when((type_ == "system") & _text(v, "$.subtype").isNull(), "no subtype")
        .when(((type_ == "mode") & _text(v, "$.mode").isNull()) | ((type_ == "permission-mode") & _text(v, "$.permissionMode").isNull()), "no mode")
    )


def events(lines: DataFrame, keep_invalid: bool = False) -> DataFrame:
    """Typed events of lines (path, idx, line), in no order; `idx` orders a path's events.

    Columns: path, idx, kind, uuid, parent_uuid, session_id, ts, ts_raw, cwd, git_branch, version, entrypoint,
    user_type, slug, the four flags, model, stop_reason, text, thinking, calls (id, name, input), results
    (tool_use_id, content, is_error, is_async, denial_kind), fallbacks (from_model, to_model), other_blocks (their
    types), usage tokens, subtype, mode, detail, payload. With keep_invalid the rows of invalid files stay, with
    `problem` saying what is wrong. Of a key that a record repeats the last value counts.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # else such lines would be lost
    v = F.col("v")
    parsed = lines.withColumn("v", F.try_parse_json("line")).where(_is(v, "OBJECT"))
    type_ = _text(v, "$.type")
    array = _is(F.try_variant_get(v, "$.message.content", "variant"), "ARRAY")
    parsed = parsed.withColumn("blocks", F.when(array, F.from_json(_text(v, "$.message.content"), BLOCK))).withColumn("problem", _problem(v, type_, F.col("blocks")))
    own_text = F.when(type_.isin("user", "assistant"), F.when(array, _joined_text(F.col("blocks"), " ")).otherwise(_text(v, "$.message.content"))).when(type_ == "system", F.coalesce(_text(v, "$.content"), F.lit("")))
    b, assistant, user = F.col("blocks"), type_ == "assistant", type_ == "user"
    error = lambda x: F.coalesce(~x.is_error.isin("false", "0", ""), F.lit(False))
    denial = F.nullif(_text(v, "$.toolDenialKind"), F.lit(""))
    pick = lambda when, kind: F.filter(F.when(when, b), lambda x: x.type == kind)
    or_none = lambda column, kind: F.coalesce(column, F.array().cast(kind))
    calls = F.transform(pick(assistant, "tool_use"), lambda x: F.struct(x.id.alias("id"), x["name"].alias("name"), x.input.alias("input")))
    is_async = F.coalesce(F.try_variant_get(v, "$.toolUseResult.isAsync", "boolean"), F.lit(False))
    results = F.transform(pick(user, "tool_result"), lambda x: F.struct(x.tool_use_id.alias("tool_use_id"), _flat(x.content).alias("content"), error(x).alias("is_error"), is_async.alias("is_async"), F.coalesce(denial, F.when(error(x) & _flat(x.content).startswith(markers.DENIAL), markers.USER_REJECTED)).alias("denial_kind")))
    others = F.transform(F.filter(F.when(assistant, b), lambda x: ~x.type.isin("text", "thinking", "tool_use", "fallback")), lambda x: x.type)
    full = parsed.select(
        "path",
        F.col("idx").cast("long").alias("idx"),
        F.when(type_.isin("mode", "permission-mode"), "mode").when(type_.isin(*KINDS), type_).otherwise("other").alias("kind"),
        _text(v, "$.uuid").alias("uuid"),
        F.nullif(_text(v, "$.parentUuid"), F.lit("")).alias("parent_uuid"),
        _text(v, "$.sessionId").alias("session_id"),
        F.try_to_timestamp(_text(v, "$.timestamp")).alias("ts"),
        _text(v, "$.timestamp").alias("ts_raw"),
        *[_text(v, f"$.{j}").alias(c) for c, j in (("cwd", "cwd"), ("git_branch", "gitBranch"), ("entrypoint", "entrypoint"), ("user_type", "userType"), ("slug", "slug"))],
        F.nullif(_text(v, "$.version"), F.lit("")).alias("version"),
        *[_truthy(v, f"$.{j}").alias(c) for c, j in FLAGS.items()],
        F.when(assistant, _text(v, "$.message.model")).alias("model"),
        F.when(assistant, _text(v, "$.message.stop_reason")).alias("stop_reason"),
        own_text.alias("text"),
        F.coalesce(F.array_join(F.transform(pick(assistant, "thinking"), lambda x: x.thinking), " "), F.lit("")).alias("thinking"),
        or_none(calls, "array<struct<id string, name string, input string>>").alias("calls"),
        or_none(results, "array<struct<tool_use_id string, content string, is_error boolean, is_async boolean, denial_kind string>>").alias("results"),
        or_none(F.transform(pick(assistant, "fallback"), lambda x: F.struct(x["from"].model.alias("from_model"), x["to"].model.alias("to_model"))), "array<struct<from_model string, to_model string>>").alias("fallbacks"),
        or_none(others, "array<string>").alias("other_blocks"),
        *[F.try_variant_get(v, f"$.message.usage.{c}", "bigint").alias(c) for c in USAGE],
        *[F.try_variant_get(v, f"$.message.usage.cache_creation.ephemeral_{t}_input_tokens", "bigint").alias(f"written_{t}_tokens") for t in ("5m", "1h")],
        _text(v, "$.subtype").alias("subtype"),
        F.when(type_ == "mode", _text(v, "$.mode")).when(type_ == "permission-mode", _text(v, "$.permissionMode")).alias("mode"),
        F.coalesce(_text(v, "$.attachment.type"), _text(v, "$.operation")).alias("detail"),
        F.when(~(user | assistant) | F.coalesce(_text(v, "$.toolUseResult"), denial).isNotNull(), F.col("line")).alias("payload"),
        "problem",
    )
    if keep_invalid:
        return full
    return full.drop("problem").join(full.where("problem is not null").select("path").distinct(), "path", "left_anti")  # few paths, if any


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The events of all transcripts at or below a path."""
    return events(read_lines(spark, path))


def invalid_files(lines: DataFrame) -> DataFrame:
    """path, idx, problem: the first problem of each file that is not loaded."""
    bad = events(lines, keep_invalid=True).where("problem is not null")
    return bad.groupBy("path").agg(F.min(F.struct("idx", "problem")).alias("first")).select("path", "first.*")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime, size of all transcripts at or below a path, without reading them; newest first by `orderBy`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def changed_since(files: DataFrame, known: DataFrame) -> DataFrame:
    """Those files (path, mtime) that are new or newer than in the table of known ones."""
    before = known.select("path", F.col("mtime").alias("_known"))
    return files.join(before, "path", "left").where(F.col("_known").isNull() | (F.col("mtime") > F.col("_known"))).drop("_known")


def newest_of(files: DataFrame) -> DataFrame:
    """session, path: the newest file of each session name; of equal times the first path."""
    session = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    ranked = files.withColumn("session", session).groupBy("session").agg(F.max("mtime").alias("m"))
    named = files.withColumn("session", session).join(ranked, "session").where("mtime = m")
    return named.groupBy("session").agg(F.min("path").alias("path"))
