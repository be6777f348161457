"""Declarative steps: what a user writes instead of an English request.

A ``Step`` is a named function ``(target, sources) -> DataFrame`` plus what the
reference recorded about it: the kind of statement, the touched table/fields
and the column lineage.  Steps are plain data, so runs, lineage and reports are
derived from them exactly (no SQL text scraping, no guessing)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

StepFn = Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class ColumnLineage:
    """Target column <- source column, with the transformation applied (if any)."""
    target_column: str
    source_table: str | None = None
    source_column: str | None = None
    transformation_type: str = "none"

    @property
    def transformed(self) -> bool:
        return self.transformation_type != "none"


@dataclass(frozen=True)
class Step:
    name: str
    fn: StepFn
    kind: str = "transformation"          # or "data_movement" (replayed on _src, R2)
    statement: str = "OTHER"               # INSERT-SELECT, UPDATE-FROM, ALTER-ADD, ... (R7 vocabulary)
    source_tables: Sequence[str] = ()
    fields: Sequence[str] = ()
    lineage: Sequence[ColumnLineage] = field(default_factory=tuple)
    description: str = ""

    def apply(self, target: DataFrame, sources: Mapping[str, DataFrame]) -> DataFrame:
        return self.fn(target, sources)
