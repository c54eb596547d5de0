"""Filter specs over session events: clauses that drop or tag rows, each one column expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import markers

FLAGS = ("is_sidechain", "is_meta", "is_compact_summary", "is_visible_in_transcript_only")


@dataclass(frozen=True)
class Rule:
    """One clause. `applies_to`: kinds that it may match, before negation; none given are all. `action`: drop or tag."""

    test: str
    value: Any = None
    action: str = "drop"
    applies_to: tuple[str, ...] = ()
    negate: bool = False
    label: str | None = None

    def column(self) -> Column:
        text = F.coalesce(F.col("text"), F.lit(""))
        tests = {
            "kind_is": lambda: F.col("kind").isin(*self.value),
            "model_is": lambda: (F.col("kind") == "assistant") & F.col("model").isin(*self.value),
            "text_empty": self._empty,
            "text_matches": lambda: text.rlike(("(?i)" if self.value.get("ignore_case") else "") + "|".join(f"(?:{p})" for p in self.value["patterns"])),
            "text_in_set": lambda: bare(text, self.value.get("strip", "")).isin(*self.value["phrases"]),
            "words_at_most": lambda: F.size(F.filter(F.split(text, r"[\s\p{Z}\x85]+"), lambda w: w != "")) <= self.value,
            "meta_flag": lambda: F.col(self.value) if self.value in FLAGS else None,
            "entrypoint_in": lambda: F.col("entrypoint").isin(*self.value),
        }
        if self.test not in tests or (found := tests[self.test]()) is None:
            raise ValueError(f"unknown clause: {self.test} {self.value}")
        found = F.coalesce(found, F.lit(False))
        found = ~found if self.negate else found
        return F.col("kind").isin(*self.applies_to) & found if self.applies_to else found

    def _empty(self) -> Column:
        """Users' and assistants' blank texts; with value True, an assistant that calls a tool is not empty."""
        blank = F.col("kind").isin("user", "assistant") & (trim(F.coalesce("text", F.lit(""))) == "")
        return blank & ~((F.col("kind") == "assistant") & (F.size("calls") > 0)) if self.value else blank


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"\A[\s\p{Z}\x85]+|[\s\p{Z}\x85]+\z", "")


def bare(text: Column, trailing: str) -> Column:
    """Trimmed, without the trailing characters, trimmed again, in lower case."""
    ends = "".join("\\" + c if not c.isalnum() else c for c in trailing)
    cut = F.regexp_replace(trim(text), rf"[{ends}]+\z", "") if trailing else text
    return F.lower(trim(cut))


def keep(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that no drop rule matches."""
    drops = [r.column() for r in rules if r.action == "drop"]
    return events.where(~reduce(lambda a, b: a | b, drops)) if drops else events


def annotate(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """`labels`: those of the tag rules that match, in the rules' order."""
    tags = [F.when(r.column(), F.lit(r.label)) for r in rules if r.action == "tag" and r.label is not None]
    return events.withColumn("labels", F.array_compact(F.array(*tags)) if tags else F.array().cast("array<string>"))


def keep_only(*kinds: str) -> Rule:
    return Rule("kind_is", kinds, negate=True)


def drop_synthetic() -> Rule:
    return Rule("model_is", ("<synthetic>",), applies_to=("assistant",))


def drop_empty(consider_tool_use: bool = True) -> list[Rule]:
    return [Rule("text_empty", False, applies_to=("user",)), Rule("text_empty", consider_tool_use, applies_to=("assistant",))]


def drop_sidechain(except_assistants: bool = False) -> Rule:
    return Rule("meta_flag", "is_sidechain", applies_to=("user",) if except_assistants else ())


def drop_meta_flag(flag: str, only_from: tuple[str, ...] = ()) -> Rule:
    return Rule("meta_flag", flag, applies_to=only_from)


def drop_compacted() -> list[Rule]:
    """Summaries of compaction and entries that only the transcript shows."""
    return [Rule("meta_flag", "is_compact_summary"), Rule("meta_flag", "is_visible_in_transcript_only")]


def drop_junk(*categories: str, only_from: tuple[str, ...] = ("user",)) -> Rule:
    """Texts that match a category of `markers.JUNK`."""
    return Rule("text_matches", {"patterns": [markers.JUNK[c] for c in categories]}, applies_to=only_from)


def build_spec(*parts: Rule | list[Rule]) -> list[Rule]:
    """Rules and lists of rules as one list."""
    return [r for p in parts for r in (p if isinstance(p, list) else [p])]


def drop_entrypoints(*names: str) -> Rule:
    return Rule("entrypoint_in", names)


def drop_noise() -> Rule:
    return drop_junk("structural", "agent_injection", "command_echo")


def drop_phrases(*phrases: str, strip: str = ".!?") -> Rule:
    return Rule("text_in_set", {"phrases": phrases, "strip": strip}, applies_to=("user",))


def drop_short(words: int, kinds: tuple[str, ...] = ("user",)) -> Rule:
    return Rule("words_at_most", words, applies_to=kinds)


#: Conversation without noise, sidechains and empty turns; and noise alone.
SIGNAL = build_spec(keep_only("assistant", "user"), drop_noise(), drop_synthetic(), drop_sidechain(), drop_empty())
NOISE = build_spec(drop_junk("structural"))
