"""Batch recognition: parallel parse and selection, then folds of the few lines that matter, in stretches of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from quarrylog.functions.parsing import timeline_ms
from quarrylog.operators.timeline import segments_of

from . import gate, parts
from .fold import MAX_DEATHS, Line

#: Lines after an opener that may belong to it, and the runs of lines that are kept or left together.
HORIZON = 520
RUN = 64
REACH = -(-HORIZON // RUN)

EVENTS = (
    "source_id string, event_no int, kind int, start long, `end` long, anchor long, pid long, process string, quality int, fingerprint string, subject string, "
    "evidence int, outcome int, boundary int, anchor_ts long, origin string, instance int, facts_total int, "
    "facts array<struct<line:long,role:string,priority:int,code:string,rule:string,format:string,provenance:string>>"
)
_COLUMNS = ("line_no", "tag", "message", "level", "pid", "raw_len", "provenance", "buffer", "packed_ts", "segment", "in_segment_ms")


def _thin(rows: DataFrame, timed: bool) -> DataFrame:
    """Of every classified line what selection and clocks ask for, kept: the log is parsed once for it and once for the lines
    that are selected. Lines that open a report have `opens`, those of a tombstone `dump`, and these their pid."""
    opens = F.col("cand").bitwiseAND(gate.JAVA_FATAL | gate.NATIVE_CRASH | gate.KERNEL_OOM | gate.ANR) != 0
    dump = F.col("tag").isin("DEBUG", "debuggerd", "") & (F.col("cand").bitwiseAND(gate.NATIVE_CRASH) != 0)
    clock = [F.col("date"), timeline_ms(F.col("date"), F.col("time")).alias("timeline_ms")] if timed else []
    return rows.select("source_id", "line_no", opens.alias("opens"), dump.alias("dump"), F.when(dump, F.col("pid")).alias("pid"), *clock).persist()


def detail(rows: DataFrame, thin: DataFrame | None = None) -> DataFrame:
    """The lines the fold needs, or a few more: candidates, what follows an opener within the horizon, and, once a source has
    a tombstone, its untagged lines and those of tombstone producers.

    Openers name the short runs of lines that they reach into; lines are kept by equality with those. So lines are neither
    shuffled nor sorted, as long as the openers of a log fit a broadcast; else they are joined by run.
    """
    if thin is None:
        rows = gate.classify(rows)
        thin = _thin(rows, False)
    run = F.floor(F.col("line_no") / RUN)
    near = thin.where("opens").select("source_id", F.explode(F.sequence(run, run + REACH)).alias("__run")).distinct().withColumn("__near", F.lit(True))
    dumps = thin.where("dump").groupBy("source_id", "pid").agg(F.min("line_no").alias("__of_pid"))
    first = dumps.groupBy("source_id").agg(F.min("__of_pid").alias("__tomb"))
    late = (F.col("line_no") > F.col("__tomb")) & ((F.col("tag") == "") | F.col("__of_pid").isNotNull())
    own = F.col("cand").bitwiseAND(~gate.CONTINUATION) != 0
    found = rows.withColumn("__run", run).join(near, ["source_id", "__run"], "left").join(dumps, ["source_id", "pid"], "left").join(first, "source_id", "left")
    return found.where(own | F.col("__near") | F.coalesce(late, F.lit(False))).drop("__run", "__near", "__of_pid", "__tomb")


def _line(r: dict) -> Line:
    return Line(line=r["line_no"], tag=r["tag"], message=r["message"], level=r["level"], pid=r["pid"], raw_len=r["raw_len"] or 0, provenance=r["provenance"], buffer=r["buffer"], packed_ts=r["packed_ts"], segment=r["segment"], ms=r["in_segment_ms"])


def event_rows(source_id: str, events, first: int = 0) -> list[tuple]:
    return [
        (source_id, first + i, e.kind, e.start, e.end, e.anchor, e.pid, e.process, e.quality, e.fingerprint, e.subject, e.evidence, e.outcome, e.boundary, e.anchor_ts, e.source, e.instance, e.facts_total, [{k: getattr(f, k) for k in parts.FACT} for f in e.facts])
        for i, e in enumerate(events)
    ]


def _numbered(rows: DataFrame, line: str, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in its source, counted from 1 within stretches of lines and over their totals."""
    rows = rows.withColumn("__part", F.floor(F.col(line) / parts.LINES))
    totals = rows.groupBy("source_id", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("source_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("source_id", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("source_id", "__part").orderBy(*order))
    return rows.withColumn(name, inside).join(totals, ["source_id", "__part"]).withColumn(name, (F.col(name) + F.col("__before")).cast("int")).drop("__part", "__before")


def _steps(lines: DataFrame) -> DataFrame:
    """What lines say of reports and processes, read in stretches; sources whose stretches don't fit together in one."""
    run = lambda df, size: df.repartition("source_id", "part").sortWithinPartitions("source_id", "part", "line_no").mapInArrow(parts.stretches(_COLUMNS, size), parts.STEPS)
    part = F.floor(F.col("line_no") / parts.LINES)
    warm = F.col("line_no") % parts.LINES >= parts.LINES - parts.WARM
    found = run(lines.withColumn("part", F.explode(F.when(warm, F.array(part, part + 1)).otherwise(F.array(part)))), parts.LINES).persist(StorageLevel.DISK_ONLY)
    edges = found.where(F.col("what") == parts.PART).repartition("source_id").sortWithinPartitions("source_id", "part").mapInArrow(parts.stitch, parts.STEPS)
    steps = found.where(F.col("what") != parts.PART).unionByName(edges.where(F.col("what") != parts.DIFFERS))
    again = edges.where(F.col("what") == parts.DIFFERS).select("source_id")
    names = [r["source_id"] for r in again.collect()]
    if not names:
        return steps
    again = F.broadcast(lines.sparkSession.createDataFrame([(n,) for n in names], "source_id string"))
    whole = run(lines.join(again, "source_id", "left_semi").withColumn("part", F.lit(0).cast("long")), None).persist(StorageLevel.DISK_ONLY)
    ends = whole.where(F.col("what") == parts.PART).repartition("source_id").mapInArrow(parts.stitch, parts.STEPS)
    return steps.join(again, "source_id", "left_anti").unionByName(whole.where(F.col("what") != parts.PART)).unionByName(ends)


def _found(steps: DataFrame) -> DataFrame:
    """Events of steps, numbered in the order of their ends."""
    life = steps.where((F.col("what") == parts.START) | ((F.col("what") == parts.DEATH) & (F.col("uid") == 1)))
    life = life.repartition("source_id", "pid").sortWithinPartitions("source_id", "pid", "line", "seq").mapInArrow(parts.deaths, parts.STEPS)
    again = life.repartition("source_id").sortWithinPartitions("source_id", "line", "seq").mapInArrow(parts.restarts(MAX_DEATHS), parts.STEPS)
    low = F.min("low").over(Window.partitionBy("source_id", "pid").orderBy(F.desc("line"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0))
    every = steps.unionByName(again).withColumn("low", low).sortWithinPartitions("source_id", "pid", "line", "seq")
    found = every.mapInArrow(parts.processes, parts.FOUND).persist(StorageLevel.DISK_ONLY)
    events = _numbered(found.where("kind is not null"), "end", ["end", "start", "kind", "at", "no"], "event_no")
    begun = _numbered(found.where("kind is null").select("source_id", "at", "no"), "at", ["at", "no"], "instance")
    begun = begun.select("source_id", F.col("at").alias("of_line"), F.col("no").alias("of_seq"), "instance")
    events = events.join(begun, ["source_id", "of_line", "of_seq"], "left")
    names = [f.name for f in StructType.fromDDL(EVENTS)]
    return events.withColumn("instance", F.coalesce("instance", F.lit(0))).withColumn("event_no", F.col("event_no") - 1).select(*names)


def problems(rows: DataFrame) -> DataFrame:
    """Events of parsed rows (source_id, line_no, fields, raw_len, provenance, buffer).

    packed_ts, segment and in_segment_ms may be there already; else they are found for the kept lines only."""
    rows, timed = gate.classify(rows), "segment" not in rows.columns
    thin = _thin(rows, timed)
    lines = detail(rows, thin)
    if timed:
        lines = segments_of(lines, thin)
    lines = lines.select(F.col("source_id").cast("string").alias("source_id"), *_COLUMNS)
    return _found(_steps(lines))
