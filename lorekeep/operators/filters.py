"""Declarative filter clauses compiled to one column, so that they reach the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clause:
    """One test of a row; unknown counts as false before negation."""

    kind: str
    value: Any
    negate: bool = False
    column: str | None = None

    def compiled(self) -> Column:
        text = F.col(self.column or ("role" if self.kind == "role" else "text"))
        tests = {
            "role": lambda: text.isin(*self.value),
            "matches": lambda: text.rlike(self.value),
            "contains": lambda: text.contains(self.value),
            "min_words": lambda: F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")) >= self.value,
            "max_chars": lambda: F.char_length(text) <= self.value,
            "min_chars": lambda: F.char_length(text) >= self.value,
            "empty": lambda: (text.isNull() | (F.trim(text) == "")) == F.lit(self.value),
            "between": lambda: text.between(*self.value),
            "equals": lambda: text.eqNullSafe(F.lit(self.value)),
        }
        if self.kind not in tests:
            raise ValueError(f"unknown clause: {self.kind}")
        test = F.coalesce(tests[self.kind](), F.lit(False))
        return ~test if self.negate else test


def all_of(clauses: list[Clause]) -> Column:
    return reduce(lambda a, b: a & b, [c.compiled() for c in clauses], F.lit(True))


def keep(df: DataFrame, clauses: list[Clause]) -> DataFrame:
    """Rows that meet every clause."""
    return df.where(all_of(clauses))


def labelled(df: DataFrame, rules: dict[str, list[Clause]]) -> DataFrame:
    """`labels`: the names of all rules that a row meets, in the rules' order."""
    return df.withColumn("labels", F.array_compact(F.array(*[F.when(all_of(c), F.lit(name)) for name, c in rules.items()])))
