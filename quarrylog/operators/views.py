"""Row views, window reads, positional mapping and the density histogram.

Positions are counted in two steps, within chunks of line numbers and over the chunks' totals, so that
no task ever sorts a whole view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 18
MAX_WINDOW = 512


def with_position(rows: DataFrame, line: str = "line_no", chunk: int = CHUNK, total: str | None = None) -> DataFrame:
    """Adds `pos`, the 0-based place of each row in line order; with `total`, a column of that name with the number of rows."""
    rows = rows.withColumn("__part", F.floor(F.col(line) / chunk))
    totals = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # one row for each chunk of lines
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    every = [F.sum("__n").over(Window.partitionBy()).alias(total)] if total else []
    totals = totals.select("__part", F.coalesce(before, F.lit(0)).alias("__before"), *every)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(line))
    placed = rows.withColumn("__inside", inside).join(totals, "__part")
    return placed.withColumn("pos", (F.col("__before") + F.col("__inside") - 1).cast("long")).drop("__part", "__inside", "__before")


def view(rows: DataFrame, name: str, filtered: DataFrame | None = None, bookmarks: DataFrame | None = None) -> DataFrame:
    """all, filtered (all if no filter is active), bookmarks or errors (levels E and F)."""
    if name == "all":
        return rows
    if name == "filtered":
        return rows if filtered is None else filtered
    if name == "errors":
        return rows.where(F.col("level").isin("E", "F"))
    if name == "bookmarks":
        return rows.where(F.lit(False)) if bookmarks is None else rows.join(bookmarks.select("line_no"), "line_no", "left_semi")
    raise ValueError(f"unknown view: {name}")


def window(rows: DataFrame, start: int, count: int, dense: bool = False) -> DataFrame:
    """Rows start .. start + count of a view; at most 512. dense: line numbers have no gaps, as in the view of all."""
    if start < 0 or count < 0:
        raise ValueError("start and count can't be negative")
    count = min(count, MAX_WINDOW)
    if dense:
        return rows.where(F.col("line_no").between(start + 1, start + count))
    # the chunks that hold these places are found by counting; only their rows are put in order
    part = F.floor(F.col("line_no") / CHUNK)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("before", before)  # one row for each chunk
    held = totals.where((F.col("before") < start + count) & (F.col("before") + F.col("n") > start)).orderBy("part").collect()  # two for a window, if gaps are few
    if not held:
        return rows.where(F.lit(False))
    near = rows.where((F.col("line_no") >= held[0]["part"] * CHUNK) & (F.col("line_no") < (held[-1]["part"] + 1) * CHUNK))
    first = start - held[0]["before"]
    ordered = near.orderBy("line_no").limit(first + count)  # the best of each task are merged, nothing is gathered
    place = F.row_number().over(Window.orderBy("line_no"))
    return ordered.withColumn("__place", place).where(F.col("__place") > first).drop("__place") if first else ordered


def checked_window(rows: DataFrame, start: int, count: int, revision: int, current: int, dense: bool = False) -> DataFrame:
    """A window read that refuses bad counts and a revision that isn't current."""
    if not 0 < count <= MAX_WINDOW:
        raise ValueError("count must be 1 to 512")
    if revision != current:
        raise ValueError("the view has changed")
    return window(rows, start, count, dense)


def counts(rows: DataFrame, matches, bookmarks: DataFrame) -> DataFrame:
    """total, filtered, errors and bookmarks (within the source) in one pass."""
    marked = rows.select("line_no", matches.alias("__hit"), F.col("level").isin("E", "F").alias("__bad")).join(bookmarks.select("line_no", F.lit(True).alias("__mark")), "line_no", "left")
    return marked.agg(F.count("*").alias("total"), F.count_if("__hit").alias("filtered"), F.count_if("__bad").alias("errors"), F.count_if(F.coalesce("__mark", F.lit(False))).alias("bookmarks"))


def nearest(result: DataFrame, lines: DataFrame, total: int) -> DataFrame:
    """For each line_no of `lines` the closest row of a result with its position; ties go to the one before.

    A sorted union and two running values: linear, with the chunk edges carried over by broadcast-free joins.
    """
    asked = lines.where(F.col("line_no") > 0).select(F.col("line_no").alias("asked"), F.least(F.col("line_no"), F.lit(total)).alias("at")).where(F.col("at") > 0)
    placed = with_position(result.select("line_no")).select(F.col("line_no").alias("at"), "pos")
    rows = placed.select("at", F.struct("at", "pos").alias("hit"), F.lit(None).cast("long").alias("asked")).unionByName(asked.select("at", F.lit(None).cast("struct<at:bigint,pos:bigint>").alias("hit"), "asked"))
    rows = rows.withColumn("part", F.floor(F.col("at") / CHUNK))
    edge = rows.groupBy("part").agg(F.min("hit").alias("first_hit"), F.max("hit").alias("last_hit"))
    # what follows is looked up in falling order: Spark goes through a frame without an upper end anew for each row
    earlier, later = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("part"), F.desc("part")))
    edge = edge.select("part", F.last("last_hit", True).over(earlier).alias("from_before"), F.last("first_hit", True).over(later).alias("from_after"))
    upto, onward = (Window.partitionBy("part").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("at"), F.desc("at")))
    rows = rows.withColumn("b", F.last("hit", True).over(upto)).withColumn("a", F.last("hit", True).over(onward))
    rows = rows.where("asked is not null").join(edge, "part")
    b, a = F.coalesce("b", "from_before"), F.coalesce("a", "from_after")
    pick = F.when(b.isNull(), a).when(a.isNull(), b).when(F.col("at") - b["at"] <= a["at"] - F.col("at"), b).otherwise(a)
    return rows.select(F.col("asked").alias("line_no"), pick["at"].alias("target_line"), pick["pos"].alias("result_index")).where("target_line is not null")


def exact(result: DataFrame, lines: DataFrame) -> DataFrame:
    """Position of each line in a result; lines outside have none."""
    return lines.join(with_position(result.select("line_no")), "line_no", "left").select("line_no", F.col("pos").alias("result_index"))


def toggle_bookmark(bookmarks: DataFrame, line_no: int) -> DataFrame:
    """The bookmarks with a line added or, if it is there, taken out; line 0 is none."""
    if line_no <= 0:
        return bookmarks
    one = bookmarks.sparkSession.createDataFrame([(line_no,)], "line_no long")
    return bookmarks.select("line_no").where(F.col("line_no") != line_no).union(one.join(bookmarks.select("line_no"), "line_no", "left_anti"))


def bookmark_in_result(result: DataFrame, bookmarks: DataFrame, from_line: int, forward: bool = True) -> DataFrame:
    """The next (previous) bookmark by place in the result, around the end; from a line outside it, as from place 0."""
    placed = with_position(result.select("line_no"))
    here = placed.agg(F.coalesce(F.max(F.when(F.col("line_no") == from_line, F.col("pos"))), F.lit(0)).alias("here"))
    marks = placed.join(bookmarks.select("line_no").distinct(), "line_no", "left_semi").join(F.broadcast(here))  # `here` is one row
    item = F.struct("pos", "line_no")
    if forward:
        target = F.coalesce(F.min(F.when(F.col("pos") > F.col("here"), item)), F.min(item))
    else:
        target = F.coalesce(F.max(F.when(F.col("pos") < F.col("here"), item)), F.max(item))
    return marks.agg(target.alias("t")).select("t.line_no", F.col("t.pos").alias("result_index"))


def minimap(result: DataFrame, bookmarks: DataFrame, buckets: int) -> DataFrame:
    """Errors and whether a bookmark is there, for each of min(buckets, rows) buckets that has either."""
    placed = with_position(result.select("line_no", "level"), total="total")
    rows = placed.join(bookmarks.select("line_no", F.lit(1).alias("mark")).distinct(), "line_no", "left")
    bucket = F.expr(f"pos * least({int(buckets)}L, total) div total").cast("int")
    out = rows.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col("level").isin("E", "F")).alias("errors"), F.coalesce(F.max("mark"), F.lit(0)).alias("marked"))
    return out.where((F.col("errors") > 0) | (F.col("marked") > 0))


def minimap_ranges(buckets: DataFrame) -> DataFrame:
    """Adjacent buckets with errors as ranges; opacity follows the errors of the densest."""
    errors = buckets.where("errors > 0")
    order = Window.orderBy("bucket")  # as many rows as the map has buckets
    top = F.max("errors").over(Window.partitionBy())
    island = F.col("bucket") - F.row_number().over(order)
    rows = errors.select("bucket", "errors", island.alias("island"), top.alias("top"))
    return rows.groupBy("island").agg(F.min("bucket").alias("start"), F.max("bucket").alias("end"), F.sum("errors").alias("errors"), F.max(F.col("errors") / F.col("top")).alias("density")).select("start", "end", "errors", F.least(F.lit(1.0), 0.16 + 0.84 * F.least(F.lit(1.0), 6 * F.col("density"))).alias("opacity"))


def context(events: DataFrame, total: int, radius: int = 50) -> DataFrame:
    """first_line and last_line around each event's start, end and anchor: at most 512 lines, centred on the anchor."""
    lo, hi = F.greatest(F.col("start") - radius, F.lit(1)), F.least(F.col("end") + radius, F.lit(total))
    half = MAX_WINDOW // 2
    clipped = F.greatest(F.least(F.col("anchor") - half, hi - MAX_WINDOW + 1), lo)
    wide = hi - lo + 1 > MAX_WINDOW
    return events.select("*", F.when(wide, clipped).otherwise(lo).alias("first_line"), F.when(wide, clipped + MAX_WINDOW - 1).otherwise(hi).alias("last_line"))
