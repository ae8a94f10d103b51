"""Timestamp segments: runs of lines whose clock can be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.functions.parsing import packed_timestamp, settle, timeline_ms

CLOCK_TOLERANCE_MS = 60_000
CHUNK = 1 << 18


def segments(rows: DataFrame, source: str | None = None) -> DataFrame:
    """Adds packed_ts, timeline_ms, segment and in_segment_ms; null on lines without a valid time.

    A segment begins where the line before had no valid time, the clock goes back, or the year's second
    month is left other than by its 29th day. Lines are compared within chunks of line numbers; one row a
    chunk says how it begins, ends and what it counts, and tells each chunk what the ones before it leave.
    """
    key = [source] if source else []
    rows = rows.withColumn("__part", F.floor(F.col("line_no") / CHUNK))
    if "timeline_ms" not in rows.columns:
        rows = settle(rows, {"packed_ts": packed_timestamp(F.col("date"), F.col("time")), "timeline_ms": timeline_ms(F.col("date"), F.col("time"))})
    inside = Window.partitionBy(*key, "__part").orderBy("line_no")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.struct(F.col("timeline_ms").alias("ms"), F.col("date").alias("day"))
    rows = rows.withColumn("__prev", F.lag(mark).over(inside)).withColumn("__head", F.row_number().over(inside) == 1)
    begins = F.col("timeline_ms").isNotNull() & _parted(F.col("__prev"), mark)
    rows = rows.withColumn("__new", ~F.col("__head") & begins)
    rows = rows.withColumn("__count", F.sum(F.col("__new").cast("long")).over(upto)).withColumn("__start", F.last(F.when(F.col("__new"), F.col("timeline_ms")), True).over(upto))
    chunk = rows.groupBy(*key, "__part").agg(F.min_by(mark, "line_no").alias("__first"), F.max_by(mark, "line_no").alias("__last"), F.sum(F.col("__new").cast("long")).alias("__n"), F.max_by("__start", "line_no").alias("__start_in"))
    chunks = Window.partitionBy(*key).orderBy("__part")
    chunk = chunk.withColumn("__before", F.lag("__last").over(chunks))
    chunk = chunk.withColumn("__opens", F.col("__first")["ms"].isNotNull() & _parted(F.col("__before"), F.col("__first")))
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("__opens"), F.col("__first")["ms"])
    chunk = chunk.withColumns({"__base": F.coalesce(F.sum(F.col("__n") + F.col("__opens").cast("long")).over(earlier), F.lit(0)) + F.col("__opens").cast("long"), "__origin": F.coalesce(opened, F.last(F.coalesce("__start_in", opened), True).over(earlier))})
    rows = rows.join(chunk.select(*key, "__part", "__base", "__origin"), [*key, "__part"])
    known = F.col("timeline_ms").isNotNull()
    rows = rows.withColumn("segment", F.when(known, F.col("__base") + F.col("__count") - 1)).withColumn("in_segment_ms", F.when(known, F.col("timeline_ms") - F.coalesce("__start", "__origin")))
    return rows.drop("__part", "__prev", "__head", "__new", "__count", "__start", "__base", "__origin")


def _begins(times: DataFrame, source: str) -> DataFrame:
    """Where segments begin: source, line_no, segment, __origin. A line is compared with the one before it within its chunk;
    chunks leave their first and last lines, and a first line is compared with the last one before it."""
    inside = Window.partitionBy(source, F.floor(F.col("line_no") / CHUNK)).orderBy("line_no")
    here = F.struct(F.col("timeline_ms").alias("ms"), F.col("date").alias("day"))
    before = F.struct(F.lag("timeline_ms").over(inside).alias("ms"), F.lag("date").over(inside).alias("day"))
    edge = [F.lag("line_no").over(inside).isNull().alias("__head"), F.lead("line_no").over(inside).isNull().alias("__tail")]
    opens = F.col("timeline_ms").isNotNull()
    few = times.select("*", before.alias("__before"), *edge).where(F.col("__head") | F.col("__tail") | (opens & _parted(F.col("__before"), here)))
    last = F.lag(here).over(Window.partitionBy(source).orderBy("line_no"))
    few = few.withColumn("__before", F.when(F.col("__head"), last).otherwise(F.col("__before"))).where(opens & _parted(F.col("__before"), here))
    return few.select(source, "line_no", (F.row_number().over(Window.partitionBy(source).orderBy("line_no")) - 1).cast("long").alias("segment"), F.col("timeline_ms").alias("__origin"))


def segments_of(kept: DataFrame, rows: DataFrame, source: str = "source_id") -> DataFrame:
    """`segments` of a few rows among many: of the others (source, line_no, date, timeline_ms) only where segments begin is kept."""
    begins = _begins(rows.select(source, "line_no", "date", "timeline_ms"), source)
    kept = settle(kept, {"packed_ts": packed_timestamp(F.col("date"), F.col("time")), "timeline_ms": timeline_ms(F.col("date"), F.col("time"))})
    part = F.floor(F.col("line_no") / CHUNK).alias("__part")
    mark = begins.select(source, "line_no", F.struct("segment", "__origin").alias("__at"))
    both = kept.withColumn("__row", F.lit(True)).unionByName(mark, allowMissingColumns=True).withColumn("__part", part)
    # a segment's first row stands after the mark of its line; what holds at the start of a chunk comes from those before it
    order = Window.partitionBy(source, "__part").orderBy("line_no", F.col("__row").asc_nulls_first())
    both = both.withColumn("__at", F.last("__at", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__row")
    last = mark.groupBy(source, part).agg(F.max_by("__at", "line_no").alias("__last"))
    earlier = Window.partitionBy(source).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.select(source, part).distinct().join(last, [source, "__part"], "left").select(source, "__part", F.last("__last", True).over(earlier).alias("__carried"))
    both = both.join(carried, [source, "__part"], "left").withColumn("__at", F.coalesce("__at", "__carried")).drop("__part", "__carried")
    known = F.col("timeline_ms").isNotNull()
    return both.withColumn("segment", F.when(known, F.col("__at.segment"))).withColumn("in_segment_ms", F.when(known, F.col("timeline_ms") - F.col("__at.__origin"))).drop("__row", "__at")


def _parted(before: Column, here: Column) -> Column:
    """Whether a line with a valid time opens a segment after the line before it (null: the source begins)."""
    month = lambda m: F.substring(m["day"], 1, 2).try_cast("int")
    leap = (month(before) <= 2) & (month(here) >= 3) & (before["day"] != "02-29")
    return before.isNull() | before["ms"].isNull() | (here["ms"] < before["ms"]) | leap


def clocks_agree(segment_a, ms_a, segment_b, ms_b):
    """Comparable clocks differ by a minute at most; others don't speak against each other."""
    return ~(segment_a.eqNullSafe(segment_b) & segment_a.isNotNull()) | (F.abs(ms_a - ms_b) <= CLOCK_TOLERANCE_MS)
