"""Global search over all rows, and navigation among its hits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions.parsing import FIELDS
from quarrylog.functions.patterns import quote, to_java


@dataclass(frozen=True)
class SearchSpec:
    query: str
    regex: bool = False
    case_sensitive: bool = False


def text_matches(spark: SparkSession, spec: SearchSpec, c: Column) -> Column:
    if not spec.query:
        return F.lit(False)
    if spec.case_sensitive and not spec.regex:
        return c.contains(spec.query)
    pattern = to_java(spark, spec.query) if spec.regex else quote(spec.query)
    return c.rlike(pattern if spec.case_sensitive else f"(?iu){pattern}")


def entry_matches(spark: SparkSession, spec: SearchSpec) -> Column:
    """True if one of the seven fields matches; a match never spans fields."""
    return reduce(lambda a, b: a | b, [text_matches(spark, spec, F.col(f)) for f in FIELDS])


def search(rows: DataFrame, spec: SearchSpec) -> DataFrame:
    return rows.where(entry_matches(rows.sparkSession, spec))


def summary(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("matches"), F.min("line_no").alias("first_line"))


def navigate(hits: DataFrame, from_line: int, forward: bool = True) -> DataFrame:
    """The hit strictly after (or before) a line, else around the end: one row, null without hits."""
    line = F.col("line_no")
    if forward:
        target = F.coalesce(F.min(F.when(line > from_line, line)), F.min(line))
    else:
        target = F.coalesce(F.max(F.when(line < from_line, line)), F.max(line))
    return hits.agg(target.alias("line_no"))
