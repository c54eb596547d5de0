"""What system and attachment records tell beyond their text, as typed columns of the events' payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: fields of each kind of record; a type behind a colon, else text. `+` marks ids of which an empty one is none
SYSTEM = {
    "stop_hook_summary": "hookCount:bigint hookErrors:array<string> hookAdditionalContext:array<string> preventedContinuation:truth stopReason hasOutput:truth toolUseID+",
    "compact_boundary": "logicalParentUuid+ compactMetadata.trigger compactMetadata.preTokens:bigint compactMetadata.postTokens:bigint compactMetadata.durationMs:bigint compactMetadata.cumulativeDroppedTokens:bigint compactMetadata.preCompactDiscoveredTools:array<string> compactMetadata.precomputed:boolean",
    "turn_duration": "durationMs:bigint messageCount:bigint pendingWorkflowCount:bigint pendingBackgroundAgentCount:bigint",
    "model_refusal_fallback": "apiRefusalCategory apiRefusalExplanation trigger direction originalModel fallbackModel retractedMessageUuids:array<string> refusedUserMessageUuid+",
}
ATTACHMENT = {
    "hook_success": "hookName hookEvent toolUseID+ command content stdout stderr exitCode:bigint durationMs:bigint",
    "hook_blocking_error": "hookName hookEvent toolUseID+ blockingError",
    "hook_non_blocking_error": "hookName hookEvent toolUseID+ command stdout stderr exitCode:bigint durationMs:bigint",
    "hook_cancelled": "hookName hookEvent toolUseID+ command durationMs:bigint timedOut:boolean timeoutMs:bigint",
    "hook_additional_context": "hookName hookEvent toolUseID+ content:array<string>",
    "async_hook_response": "hookName hookEvent processId stdout stderr exitCode:bigint response",
    "queued_command": "prompt commandMode origin.kind",
    "deferred_tools_delta": "addedNames:array<string> removedNames:array<string>",
}


def _snake(name: str) -> str:
    last = name.rpartition(".")[2] if not name.startswith("origin") else "origin"
    return "".join("_" + c.lower() if c.isupper() and not last[k - 1 : k].isupper() else c.lower() for k, c in enumerate(last)).lstrip("_")


def _field(spec: str, root: str) -> Column:
    name, _, kind = spec.partition(":")
    empty_is_none = name.endswith("+")
    path = f"$.{root}{name.rstrip('+')}"
    v = F.col("_v")
    if kind == "truth":  # any value but null, false, 0, "" and empty lists and objects
        return F.coalesce(~F.try_variant_get(v, path, "string").isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False)).alias(_snake(name))
    got = F.try_variant_get(v, path, kind or "string")
    return (F.nullif(got, F.lit("")) if empty_is_none else got).alias(_snake(name.rstrip("+")))


def _told(events: DataFrame, kind: str, type_column: str, wanted: str, fields: str, root: str) -> DataFrame:
    rows = events.where((F.col("kind") == kind) & (F.col(type_column) == wanted)).withColumn("_v", F.try_parse_json("payload"))
    return rows.select("path", "idx", "uuid", "ts", *[_field(f, root) for f in fields.split()])


def system(events: DataFrame, subtype: str) -> DataFrame:
    """path, idx, uuid, ts and the fields of one subtype of system records (see SYSTEM). Fields of another type are null."""
    return _told(events, "system", "subtype", subtype, SYSTEM[subtype], "")


def hooks_of(events: DataFrame) -> DataFrame:
    """path, idx, command, duration_ms: the hooks that stop summaries list; those without a command are left out."""
    rows = events.where("kind = 'system' and subtype = 'stop_hook_summary'")
    listed = F.from_json(F.get_json_object("payload", "$.hookInfos"), "array<struct<command: string, durationMs: bigint>>")
    return rows.select("path", "idx", F.explode(listed).alias("h")).where("h.command is not null").select("path", "idx", "h.command", F.col("h.durationMs").alias("duration_ms"))


def attachment(events: DataFrame, type_: str) -> DataFrame:
    """path, idx, uuid, ts and the fields of one type of attachments (see ATTACHMENT)."""
    return _told(events, "attachment", "detail", type_, ATTACHMENT[type_], "attachment.")
