"""The seven-condition filter, compiled to one Column."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions.parsing import LEVELS
from quarrylog.functions.patterns import to_java

# The bits of the level mask.
LEVEL_BITS = {"V": 1, "D": 2, "I": 4, "W": 8, "E": 16, "F": 32}
ALL_LEVELS = 63


@dataclass(frozen=True)
class FilterField:
    pattern: str = ""
    regex: bool = False
    enabled: bool = True

    def is_active(self) -> bool:
        return self.enabled and bool(self.pattern.strip())

    def values(self) -> list[str]:
        """The pattern is a list split at |, before anything is compiled."""
        return [v for part in self.pattern.split("|") if (v := part.strip())] if self.enabled else []


@dataclass(frozen=True)
class FilterSpec:
    levels: int = ALL_LEVELS
    marked_only: bool = False
    pid: FilterField = field(default_factory=FilterField)
    tid: FilterField = field(default_factory=FilterField)
    tag_include: FilterField = field(default_factory=FilterField)
    tag_exclude: FilterField = field(default_factory=FilterField)
    word_include: FilterField = field(default_factory=FilterField)
    word_exclude: FilterField = field(default_factory=FilterField)

    def is_active(self) -> bool:
        fields = (self.pid, self.tid, self.tag_include, self.tag_exclude, self.word_include, self.word_exclude)
        return self.levels != ALL_LEVELS or self.marked_only or any(f.is_active() for f in fields)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> FilterSpec:
        raw = json.loads(text)
        return FilterSpec(**{k: FilterField(**v) if isinstance(v, dict) else v for k, v in raw.items()})

    def summary(self) -> list[str]:
        """The active conditions in words."""
        out = []
        if self.levels != ALL_LEVELS:
            out.append("levels " + "".join(x for x in LEVELS if self.levels & LEVEL_BITS[x]))
        if self.marked_only:
            out.append("marked only")
        for name in ("pid", "tid", "tag_include", "tag_exclude", "word_include", "word_exclude"):
            f = getattr(self, name)
            if f.is_active():
                out.append(f"{name.replace('_', ' ')} {'~' if f.regex else '='} {f.pattern.strip()}")
        return out


def level_mask(letters: str) -> int:
    return sum(LEVEL_BITS[x] for x in set(letters))


def _any(spark: SparkSession, f: FilterField, c: Column, exact: bool) -> Column | None:
    values = f.values()
    if not values:
        return None
    if f.regex:
        tests = [c.rlike(to_java(spark, v)) for v in values]
    elif exact:
        return c.isin(*values)
    else:
        tests = [c.contains(v) for v in values]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def compile_filter(spark: SparkSession, spec: FilterSpec) -> Column:
    """All conditions but `marked_only`; raises PatternError before a job starts."""
    out: Column | None = None

    def also(c: Column | None):
        nonlocal out
        if c is not None:
            out = c if out is None else out & c

    if spec.levels & ALL_LEVELS != ALL_LEVELS:
        allowed = [x for x in LEVELS if spec.levels & LEVEL_BITS[x]]
        also(F.col("level").isin(*allowed) if allowed else F.lit(False))
    also(_any(spark, spec.pid, F.col("pid"), True))
    also(_any(spark, spec.tid, F.col("tid"), True))
    for include, exclude, c in ((spec.tag_include, spec.tag_exclude, F.col("tag")), (spec.word_include, spec.word_exclude, F.col("message"))):
        also(_any(spark, include, c, False))
        no = _any(spark, exclude, c, False)
        also(None if no is None else ~no)
    return F.lit(True) if out is None else out


def apply_filter(rows: DataFrame, spec: FilterSpec, bookmarks: DataFrame | None = None) -> DataFrame:
    """Rows that meet all conditions; works on streams as well, as it keeps no state."""
    out = rows.where(compile_filter(rows.sparkSession, spec))
    if spec.marked_only:
        if bookmarks is None:
            return out.where(F.lit(False))
        out = out.join(bookmarks.select("line_no"), "line_no", "left_semi")
    return out
