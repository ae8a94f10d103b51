"""Streams of log lines: stateless filters, and the fold as a stateful operator."""

from __future__ import annotations

import pickle
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylog.functions.parsing import packed_timestamp, parse, timeline_ms
from quarrylog.operators.filters import FilterSpec, apply_filter
from quarrylog.plans.problems.detect import EVENTS, event_rows
from quarrylog.plans.problems.fold import ATTACH_LINES, Fold, Line
from quarrylog.sources.lines import Coverage


SCHEMA = "source_id string, line_no long, raw string, buffer string, sealed boolean"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A growing capture as numbered chunks: files of source_id, line_no, raw, buffer (where the producer knows it) and
    sealed; a row with sealed = true ends its source, and its line_no is the number of lines and one."""
    return spark.readStream.schema(SCHEMA).json(path)


def filtered(stream: DataFrame, spec: FilterSpec) -> DataFrame:
    """New rows that meet the filter; append mode, no state."""
    return apply_filter(parse(stream.where("not sealed")), spec)


class Source:
    """The state of one source: its fold, the clock of its lines, and lines that came before those that precede them."""

    def __init__(self):
        self.fold, self.waiting, self.end = Fold(), {}, None
        self.segment, self.before, self.origin, self.settled = -1, None, None, 0

    def clock(self, line: dict) -> None:
        """The same segments as `timeline.segments`, line by line."""
        ms, day = line["ms"], line["day"]
        if ms is not None:
            prev_ms, prev_day = self.before or (None, "")
            leap = prev_ms is not None and int(prev_day[:2]) <= 2 and int(day[:2]) >= 3 and prev_day != "02-29"
            if prev_ms is None or ms < prev_ms or leap:
                self.segment, self.origin = self.segment + 1, ms
            line["line"].segment, line["line"].ms = self.segment, ms - self.origin
        self.before = None if ms is None else (ms, day)

    def take(self, at: int, line: dict | None) -> None:
        if line is None:
            self.end = at
        elif at > self.fold.at:
            self.waiting[at] = line
        while (x := self.waiting.pop(self.fold.at + 1, None)) is not None:
            self.clock(x)
            self.fold.observe(x["line"])

    def complete(self) -> bool:
        return self.end is not None and self.fold.at >= self.end - 1


def problems(stream: DataFrame, coverage: Coverage = Coverage()) -> DataFrame:
    """Events of each source: those that later lines can't change as soon as that is so, the others once it is sealed.

    The state holds open candidates, what may still be paired or attached, and lines that arrive before their
    predecessors; lines that were folded before are left out, so a chunk that is delivered again changes nothing.
    """
    rows = parse(stream, whole=True)
    rows = rows.withColumns({"packed_ts": packed_timestamp(F.col("date"), F.col("time")), "ms": timeline_ms(F.col("date"), F.col("time")), "raw_len": F.coalesce(F.octet_length("raw"), F.lit(0)) + 1})
    shape = F.col("tag").startswith("am_") & F.col("message").rlike(r"^\[.*\]$") if coverage.may_hold("events") else F.lit(False)
    own = F.col("buffer") if "buffer" in stream.columns else F.lit(None).cast("string")
    own = reduce(lambda c, b: F.when(c != b, c), [b for b in ("events", "kernel") if not coverage.may_hold(b)], own)
    rows = rows.withColumn("known", own).withColumn("provenance", F.when(F.col("known").isNotNull(), "known").when(shape, "inferred").otherwise("unknown"))
    rows = rows.withColumn("buffer", F.when(F.col("provenance") == "inferred", "events").otherwise(F.col("known")))
    rows = rows.select("source_id", "line_no", "sealed", "date", "level", "pid", "tag", "message", "packed_ts", "ms", "raw_len", "provenance", "buffer")
    names = T.StructType.fromDDL(EVENTS).names

    def fold(key, frames, state):
        import pandas as pd

        source = pickle.loads(state.get[0]) if state.exists else Source()
        number = lambda v: None if v is None or pd.isna(v) else int(v)
        parts = list(frames)
        batch = pd.concat(parts).sort_values("line_no") if parts else pd.DataFrame()
        for r in batch.itertuples():
            if r.sealed:
                source.take(int(r.line_no), None)
                continue
            line = Line(int(r.line_no), r.tag, r.message, r.level, r.pid, int(r.raw_len), r.provenance, r.buffer if isinstance(r.buffer, str) else None, number(r.packed_ts))
            source.take(line.line, {"line": line, "ms": number(r.ms), "day": r.date})
        f, done = source.fold, source.complete()
        events = []
        if done:
            events = f.finish()
        elif f.at - source.settled >= ATTACH_LINES:
            events, source.settled = f.settle(), f.at
        out = event_rows(key[0], events, f.numbered)
        f.numbered += len(out)
        if done and state.exists:
            state.remove()
        elif not done:
            state.update((pickle.dumps(source),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy("source_id").applyInPandasWithState(fold, EVENTS, T.StructType([T.StructField("fold", T.BinaryType())]), "append", "NoTimeout")
