"""Marker strings of transcripts, and what is read from them. The values are fixed: they must equal what hosts write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
DENIAL = "The user doesn't want to proceed with this tool use. The tool use was rejected"
USER_REJECTED = "user-rejected"
USER_SAID = "To tell you how to proceed, the user said:\n"
USER_SAID_END = "Note: The user's next message"
INTERRUPT = r"(?i)^\s*\[Request interrupted by user"
INJECTION = r"(?i)\A\s*<(?:teammate-message|scheduled-task|agent-message|cross-session-message)(?:[\s/>]|$)|\A\s*Another Claude session sent a message:|\A\s*# Augment Agent(?:\s|$)|\A\s*\[Role Reminder(?:[\s:\]]|$)"
NOISE = r"(?i)<(?:system[_-](?:instruction|reminder)|local-command-(?:stdout|stderr|caveat)|command-(?:name|message|args)|task-notification|persisted-output|output-file)\b|Caveat: The messages below were generated by the user while running local commands\.|REMAINING_TASKS_ACKNOWLEDGED|<<[a-z][a-z0-9-]*>>|^Base directory for this skill:|(?:###\s+[\w][\w \-]{0,30}\s+){3,}###"
STOP_HOOK = r"(?i)Stop hook feedback:"
COMMAND_ECHO = r"(?i)\A\s*<bash-(?:input|stdout|stderr)\b"
CONTINUATION = r"(?i)^\s*(?:(?:yea+h?|yep|yup|sure|ok(?:ay)?|sounds good|looks good|lgtm|perfect)[\s,.!]+){0,2}(?:go ahead\b|(?:go ahead and\s+)?(?:commit|push|rebase|merge|deploy)\b|ship it\b|cut (?:a |the )?(?:new )?release\b|proceed\b)|\byou must resume\b|\b(?:resume|restart) (?:them|it|the (?:sub-?agents?|workflows?|agents?|tasks?))\b"
TASK_NOTIFICATION = "<task-notification>"
NOTIFIED_CALL = r"<tool-use-id>([^<]+)</tool-use-id>"
READ_VERBS = ("get", "list", "search", "read", "view", "fetch", "query", "describe", "show", "find")
#: Kinds of user texts that nobody wrote as feedback, by pattern.
JUNK = {"structural": NOISE, "agent_injection": INJECTION, "interrupt": INTERRUPT, "stop_hook": STOP_HOOK, "continuation": CONTINUATION, "command_echo": COMMAND_ECHO}
#: White space as Python strips it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def is_interrupt(text: Column) -> Column:
    return F.coalesce(text.rlike(INTERRUPT), F.lit(False))


def is_bare_interrupt(text: Column) -> Column:
    """Nothing but the bracketed marker."""
    return F.coalesce(text.rlike(rf"(?i)\A{SPACE}*\[Request interrupted by user[^\]]*\]?{SPACE}*\z"), F.lit(False))


def is_injection(text: Column) -> Column:
    return F.coalesce(text.rlike(INJECTION), F.lit(False))


def is_noise(text: Column) -> Column:
    return F.coalesce(text.rlike(NOISE) | text.rlike(INJECTION), F.lit(False))


def embedded_user_text(text: Column) -> Column:
    """What the user said, within a denied result; null without the marker."""
    after = F.substring_index(F.substring(text, F.locate(USER_SAID, text) + len(USER_SAID), 1 << 30), USER_SAID_END, 1)
    return F.when(text.contains(USER_SAID), strip(after))


def mcp_parts(name: Column) -> Column:
    """Server and tool of mcp__server__tool, null for other names."""
    pattern = r"\Amcp__(.+?)__(.+)\z"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("server"), F.regexp_extract(name, pattern, 2).alias("tool")))


def mcp_access(tool: Column) -> Column:
    """read if the tool's name begins with a verb of reading or has one between underscores."""
    verbs = "|".join(READ_VERBS)
    return F.when(F.lower(tool).rlike(rf"\A(?:{verbs})|(?:\A|_)(?:{verbs})(?:_|\z)"), "read").otherwise("write")
