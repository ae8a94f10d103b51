"""Groups of equal faults, their order, frozen pages, occurrences, details and counters."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE, DEFAULT_PAGE = 200, 100
# UTF-8 bytes of a process and of a signature that are shown.
PROCESS_BYTES, SIGNATURE_BYTES = 48, 80
KEY = ["kind", "quality", "identity", "fingerprint"]
SORTS = {"last": [("last_line", False), ("fingerprint", True)], "first": [("first_line", True), ("fingerprint", True)], "count": [("observed", False), ("last_line", False), ("fingerprint", True)]}


def cut_bytes(name: str, limit: int):
    """The longest beginning of a text that takes `limit` bytes of UTF-8 at most."""
    most = F.expr(f"left({name}, array_max(filter(sequence({limit // 4}, {limit}), k -> octet_length(left({name}, k)) <= {limit})))")
    return F.when(F.octet_length(name) <= limit, F.col(name)).otherwise(most)


def with_identity(events: DataFrame) -> DataFrame:
    return events.withColumn("identity", F.when(F.coalesce(F.trim("process"), F.lit("")) == "", 1).otherwise(0))


def groups(events: DataFrame) -> DataFrame:
    """One row a key: count, first and last by anchor line with their times, and the first event as representative."""
    place = F.struct("anchor", "start", "event_no")
    return with_identity(events).groupBy(*KEY).agg(
        F.count("*").alias("observed"),
        F.min("anchor").alias("first_line"),
        F.max("anchor").alias("last_line"),
        F.min_by("anchor_ts", place).alias("first_ts"),
        F.max_by("anchor_ts", place).alias("last_ts"),
        F.min_by(cut_bytes("process", PROCESS_BYTES), place).alias("process"),
        F.min_by(cut_bytes("subject", SIGNATURE_BYTES), place).alias("signature"),
    )


def listing(found: DataFrame, sort: str = "last", kind: int | None = None) -> DataFrame:
    rows = found if kind is None else found.where(F.col("kind") == kind)
    return rows.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in SORTS[sort]])


def snapshot(found: DataFrame, sort: str = "last", kind: int | None = None) -> DataFrame:
    """The listing numbered from 0, to be written or cached; pages are ranges of `rank`. There is a row a group, not an event."""
    rows = found if kind is None else found.where(F.col("kind") == kind)
    order = Window.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in SORTS[sort]])
    return rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def page(frozen: DataFrame, start: int, limit: int = DEFAULT_PAGE) -> DataFrame:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError("a page has 1 to 200 groups")
    return frozen.where((F.col("rank") >= start) & (F.col("rank") < start + limit))


def append_page(shown: DataFrame, more: DataFrame) -> DataFrame:
    """Pages of one snapshot put together; a group that is shown already isn't repeated."""
    return shown.unionByName(more.join(shown.select(*KEY), KEY, "left_anti"))


def occurrences(events: DataFrame, kind: int, fingerprint: str) -> DataFrame:
    return events.where((F.col("kind") == kind) & (F.col("fingerprint") == fingerprint)).orderBy("source_id", "event_no")


def details(events: DataFrame) -> DataFrame:
    """One row a fact of each event, eight at most, best first."""
    return events.select("source_id", "event_no", "kind", F.inline(F.slice("facts", 1, 8)))


def stats(events: DataFrame) -> DataFrame:
    return with_identity(events).agg(F.count("*").alias("observed"), F.count_distinct(*KEY).alias("groups"))


def counters(marked: DataFrame) -> DataFrame:
    """Of what `limited` marks: observed, stored and dropped events, their groups, and whether a capacity was reached."""
    out = with_identity(marked) if "identity" not in marked.columns else marked
    out = out.agg(F.count("*").alias("observed"), F.count_if("stored").alias("stored"), F.count_distinct(*KEY).alias("groups"))
    return out.select("*", (F.col("observed") - F.col("stored")).alias("dropped"), (F.col("observed") > F.col("stored")).alias("limited"))


def limited(events: DataFrame, max_events: int | None = None, max_groups: int | None = None) -> DataFrame:
    """Optional capacity: marks as `stored` the first events of the first groups by line; nothing is dropped."""
    from quarrylog.operators.views import with_position

    rows = with_identity(events)
    stored = F.lit(True)
    if max_groups is not None:
        firsts = rows.groupBy(*KEY).agg(F.min("anchor").alias("__first"))
        ranked = firsts.withColumn("__group", F.row_number().over(Window.orderBy("__first", "fingerprint")))  # a row a group
        rows = rows.join(ranked.select(*KEY, "__group"), KEY)
        stored = stored & (F.col("__group") <= max_groups)
    if max_events is not None:
        rows = with_position(rows, line="anchor")
        stored = stored & (F.col("pos") < max_events)
    return rows.withColumn("stored", stored).drop("__group", "pos")


@dataclass
class _Held:
    rows: DataFrame
    used: float


class Snapshots:
    """Frozen listings that pages are read from: eight at most, the one unused longest goes first, and none outlives five idle
    minutes. A page comes with the cursor of the next, which can be used once."""

    def __init__(self, most: int = 8, idle_seconds: float = 300.0, clock=time.monotonic):
        self.most, self.idle, self.clock = most, idle_seconds, clock
        self._held: dict[str, _Held] = {}
        self._cursors: dict[str, tuple[str, int, int]] = {}

    def _drop(self, name: str) -> None:
        self._held.pop(name).rows.unpersist()
        self._cursors = {c: at for c, at in self._cursors.items() if at[0] != name}

    def _expire(self) -> None:
        now = self.clock()
        for name in [n for n, h in self._held.items() if now - h.used >= self.idle]:
            self._drop(name)

    def open(self, found: DataFrame, sort: str = "last", kind: int | None = None, limit: int = DEFAULT_PAGE) -> tuple[str, str]:
        """Freezes a listing; its name, and the cursor of its first page."""
        self._expire()
        while len(self._held) >= self.most:
            self._drop(min(self._held, key=lambda n: self._held[n].used))
        name = uuid.uuid4().hex
        self._held[name] = _Held(snapshot(found, sort, kind).persist(), self.clock())
        return name, self._cursor(name, 0, limit)

    def _cursor(self, name: str, start: int, limit: int) -> str:
        cursor = uuid.uuid4().hex
        self._cursors[cursor] = (name, start, limit)
        return cursor

    def next(self, cursor: str) -> tuple[DataFrame, str | None]:
        """The page of a cursor, and the cursor of the next if there is one."""
        self._expire()
        if cursor not in self._cursors:
            raise KeyError("the cursor was used, or its snapshot is gone")
        name, start, limit = self._cursors.pop(cursor)
        held = self._held[name]
        held.used = self.clock()
        rows = page(held.rows, start, limit)
        more = held.rows.where(F.col("rank") >= start + limit).limit(1).count()
        return rows, self._cursor(name, start + limit, limit) if more else None

    def release(self, name: str) -> bool:
        if name not in self._held:
            return False
        self._drop(name)
        return True

    def __len__(self) -> int:
        self._expire()
        return len(self._held)
