"""Export and split: rows of a view or range in line order, and parts by lines or bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RADIUS = 4096


def export(view: DataFrame, path: str) -> None:
    """Raw lines in line order, as text parts whose names sort in that order; cancel by job group."""
    ordered = view.select("line_no", F.col("raw").cast("string").alias("value")).repartitionByRange("line_no").sortWithinPartitions("line_no")
    ordered.select("value").write.option("lineSep", "\n").text(path)


def export_range(rows: DataFrame, start: int, end: int) -> DataFrame:
    if start < 1 or end < start:
        raise ValueError("the range must start at 1 or later and not end before it starts")
    return rows.where(F.col("line_no").between(start, end)).select("line_no", "raw")


def summary(view: DataFrame) -> DataFrame:
    """Lines and bytes of an export, newlines included."""
    return view.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)).alias("bytes"))


def problem_bounds(events: DataFrame, total: int, radius: int | None = None) -> DataFrame:
    """first_line and last_line of an event's export: its own range, or that widened by a radius of at most 4096."""
    r = 0 if radius is None else min(radius, MAX_RADIUS)
    return events.select("*", F.greatest(F.col("start") - r, F.lit(1)).alias("first_line"), F.least(F.col("end") + r, F.lit(total)).alias("last_line"))


def split_by_lines(rows: DataFrame, per_part: int) -> DataFrame:
    """Adds part, 1-based, of per_part lines each."""
    if per_part < 1:
        raise ValueError("a part needs a line at least")
    return rows.withColumn("part", (F.floor((F.col("line_no") - 1) / per_part) + 1).cast("long"))


def part_name(file: str, part: int) -> str:
    return f"{file}.part{part:03d}"


def split_by_bytes(rows: DataFrame, limit: int, source: str = "source_id") -> DataFrame:
    """part of each line when parts are filled greedily to `limit` bytes; a longer line is a part by itself.

    What a part holds depends on all before it, so each source's lengths are folded in order; only
    (line_no, length) goes to the fold, in batches, and one source is one fold.
    """
    if limit < 1:
        raise ValueError("a part needs a byte at least")
    lengths = rows.select(F.col(source).alias("source_id"), "line_no", (F.octet_length("raw") + 1).cast("long").alias("n"))
    ordered = lengths.repartition("source_id").sortWithinPartitions("source_id", "line_no")

    def fold(batches):
        import pyarrow as pa

        source_id, part, filled = object(), 0, 0
        for batch in batches:
            parts = []
            for s, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != source_id:
                    source_id, part, filled = s, 1, 0
                if filled and filled + n > limit:
                    part, filled = part + 1, 0
                filled += n
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.int64())], names=["source_id", "line_no", "part"])

    kind = dict(rows.dtypes)[source]
    return ordered.mapInArrow(fold, f"source_id {kind}, line_no long, part long")
