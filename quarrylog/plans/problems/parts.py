"""A fold in parts: reports by stretches of lines, processes by pid, restarts by source.

A report is over some hundred lines after it began, so stretches of a source are read side by side, each from some lines
before its own. At its first own line a stretch says what is open, and at its end as well; where these differ between
neighbours the source is read again in one stretch. Only a tombstone may stay open for long: the stretches after it are
asked for the line that closes it. What a report or a record does to processes is a step.
Steps of a pid, in order, give instances, names, and what is paired and attached; only restarts look at several pids.
"""

from __future__ import annotations

import pickle

from . import rules as R
from .fold import ATTACH_LINES, TOMB_LINES, Event, Fold, Line, restart

EVENT, START, DEATH, KILL, RESTART, PART, DIFFERS, BEGIN = range(8)
#: Lines of a stretch, and lines that it reads before its own.
LINES, WARM = 1 << 18, 2048
#: Steps of a line that closes what the stretch before left come first, those of the end last.
EDGE = 1 << 40
#: The name of a process that only the steps of its pid can tell.
ASK = "\x00"

STEPS = "source_id string, part long, line long, seq long, what int, pid long, process string, uid long, user int, low long, body binary"
_NAMES = [x.split()[0] for x in STEPS.split(", ")]


class Recognizer(Fold):
    """Reports of a stretch, as steps; knows nothing of processes."""

    def __init__(self, seq: int = 0):
        super().__init__()
        self.steps: list[tuple] = []
        self.seq, self.on = seq, True

    def _step(self, what, pid, process, body, uid=None, user=None, low=None):
        if self.on:
            self.steps.append((self.at, self.seq, what, pid, process, uid, user, self.at if low is None else low, pickle.dumps(body, 5)))
            self.seq += 2

    def emit(self, **k):
        e = Event(**k)
        self._step(EVENT, e.pid, e.process, tuple(vars(e).values()), low=e.start)

    def _named(self, pid):
        return ASK

    def _start(self, x, pid, name, uid, user):
        self._step(START, pid, name, Line(x.line, x.tag, "", x.level, x.pid, 0, x.provenance, x.buffer, x.packed_ts, x.segment, x.ms), uid, user)

    def _kill(self, o):
        self._step(KILL, o["pid"], o["process"], o)

    def _death(self, x, pid, name, user, independent=True):
        self.observed, self.gone = [], {}
        super()._death(x, pid, name, user, False)
        format = "EventLogShapedText" if x.tag == "am_proc_died" else "AospText"
        fact = x.facts("ProcessRestartV1", format, "Death")[0]._replace(priority=2)
        dead = {"line": x.line, "pid": pid, "name": name, "fact": fact} if independent else None
        self._step(DEATH, pid, name, (self.observed.pop(), dead), int(independent), user)

    def held(self) -> tuple:
        return self.java, self.anr, self.kernel, self.tomb

    def hold(self, held: tuple) -> None:
        self.java, self.anr, self.kernel, self.tomb = held

    def seen(self) -> tuple[str, str]:
        """What is open, and the tombstone, as texts that are equal for equal states."""
        told = lambda held: repr([sorted(vars(p).items()) for p in held])
        return "|".join(map(told, (self.java, self.anr, self.kernel))), told([self.tomb] if self.tomb else [])

    def close_old_tomb(self, old, ends: Ends) -> bool:
        """A tombstone that is too long ago to get more lines is closed by the next line that it would look at."""
        line, boundary = ends.of(old.pid)
        if line is None:
            return False
        kept, self.tomb, self.at, seq, self.seq = self.tomb, old, line, self.seq, EDGE // 2
        self._close_tomb(boundary)
        self.tomb, self.seq = kept, seq
        return True


class Ends:
    """The lines of a stretch that close a tombstone of before: the first header, and the first of each pid and of none."""

    def __init__(self):
        self.header, self.plain, self.pids = None, None, {}

    def see(self, x: Line) -> None:
        if x.raw_len > R.MAX_LINE or (x.tag == "libc" and x.level == "F" and x.message.startswith("Fatal signal ")):
            return
        if x.tag in ("DEBUG", "debuggerd", "") and R.trim(x.message).startswith(R.STARS):
            self.header = x.line
        elif not x.tag:
            self.plain = self.plain or x.line
        else:
            self.pids.setdefault(x.pid, x.line)

    def of(self, pid: int) -> tuple[int | None, int]:
        own = [line for text, line in self.pids.items() if pid == 0 or R.pid_of(text) == pid]
        found = [(line, R.BY_LIMIT) for line in [*own, self.plain] if line] + ([(self.header, 0)] if self.header else [])
        return min(found, default=(None, 0))


def table(rows: list[tuple], schema):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _steps_schema():
    import pyarrow as pa

    kinds = [pa.string(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.schema(list(zip(_NAMES, kinds, strict=True)))


def stretches(columns: tuple, lines: int | None):
    """Of lines sorted by source, part and line: their steps, and a row a part that tells how it begins and ends. `lines`
    is the length of a part, or None where a source is one."""

    def run(batches):
        schema = _steps_schema()
        key, f, first, within, ends = None, None, None, None, None

        def end():
            rows = [(*key, *step) for step in f.steps]
            f.steps = []
            if first is not None:  # else all lines belong to the part before
                rows.append((*key, f.at, 0, PART, None, None, None, None, f.at, pickle.dumps((first, within, f.held(), ends), 5)))
            return table(rows, schema)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            for source, part, *fields in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("source_id", "part")], *cols, strict=True):
                if (source, part) != key:
                    if f is not None:
                        yield end()
                    key, f, first, within, ends = (source, part), Recognizer(), None, None, Ends()
                    f.on = False
                x = Line(*fields)
                x.raw_len = x.raw_len or 0
                if first is None and (not lines or x.line >= part * lines):
                    f.enter(x)
                    first, within, f.on = (x.line, x.raw_len), f.seen(), True
                    f.take(x)
                else:
                    f.observe(x)
                if first is not None and ends.header is None:
                    ends.see(x)
            if f is not None and f.steps:
                yield table([(*key, *step) for step in f.steps], schema)
                f.steps = []
        if f is not None:
            yield end()

    return run


def stitch(batches):
    """Of the PART rows sorted by source and part: steps of what closes between parts and at the end, and sources whose
    parts don't fit together."""
    schema = _steps_schema()
    source, f, good, out = None, None, True, []

    def end():
        f.seq = EDGE
        f._close_all()
        return [(source, -1, *step) for step in f.steps] if good else [(source, -1, 0, 0, DIFFERS, None, None, None, None, 0, None)]

    for batch in batches:
        for name, at, body in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("source_id", "line", "body")], strict=True):
            (line, size), (open_, tomb), held, ends = pickle.loads(body)
            if f is None or name != source:
                if f is not None:
                    out += end()
                source, f, good = name, Recognizer(-EDGE), True
            f.enter(Line(line, "", "", "", "", size))
            is_open, is_tomb = f.seen()
            old = f.tomb if is_tomb != tomb else None
            f.hold(held)
            if is_open != open_ or (is_tomb != tomb and (old is None or tomb != "[]" or line - old.start <= TOMB_LINES)):
                good = False
            elif old is not None and not f.close_old_tomb(old, ends):
                f.tomb = old
            f.at = at
        if len(out) > 10_000:
            yield table(out, schema)
            out = []
    if f is not None:
        out += end()
    yield table(out, schema)


# --------------------------------------------------------------------------- restarts


def deaths(batches):
    """Of starts and deaths sorted by source, pid, line and seq: starts as they are, and deaths of running processes with
    their user and uid."""
    schema = _steps_schema()
    key, active = None, None
    for batch in batches:
        rows = []
        for row in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _NAMES], strict=True):
            source, part, line, seq, what, pid, name, uid, user, low, body = row
            if (source, pid) != key:
                key, active = (source, pid), None
            if what == START:
                active = (name, uid, user)
                rows.append(row)
            elif active and active[0] == name:
                rows.append((source, part, line, seq, what, pid, name, active[1], active[2] if user is None else user, low, body))
                active = None
        yield table(rows, schema)


def restarts(most: int):
    """Of what `deaths` gives, sorted by source, line and seq: a step for each start that follows a death, at the death.
    The `most` deaths that came last wait for a start."""

    def run(batches):
        schema = _steps_schema()
        source, waiting, by = None, {}, {}
        for batch in batches:
            rows = []
            for name_of, _, line, seq, what, pid, name, uid, user, low, body in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _NAMES], strict=True):
                if name_of != source:
                    source, waiting, by = name_of, {}, {}
                same = by.get((name, uid))
                if what == DEATH:
                    at = (line, seq)
                    waiting[at] = (name, uid)
                    by.setdefault((name, uid), {})[at] = (user, pid, body)
                    if len(waiting) > most:
                        at = next(iter(waiting))
                        key = waiting.pop(at)
                        del by[key][at]
                        if not by[key]:
                            del by[key]
                elif same:
                    at = next((a for a, (u, _, _) in same.items() if user is None or u is None or u == user), None)
                    if at is not None:
                        _, dead, text = same.pop(at)
                        del waiting[at]
                        if not same:
                            del by[(name, uid)]
                        e = Event(**restart(pickle.loads(text)[1], pickle.loads(body)))
                        rows.append((source, -1, at[0], at[1] + 1, RESTART, dead, name, None, None, at[0], pickle.dumps((tuple(vars(e).values()), (line, seq + 1)), 5)))
            yield table(rows, schema)

    return run


# --------------------------------------------------------------------------- processes


class Processes(Fold):
    """Steps of one pid, in order: which process each event is of, what is paired and what is attached. An instance is named
    by the step that it began with."""

    def __init__(self, begun: list):
        super().__init__()
        self.begun, self.most, self.last, self.step = begun, -1, 0, (0, 0)

    def _begin(self, pid, name):
        self.instances[pid] = (name, self.step)
        self.begun.append(self.step)
        return self.step

    def _hold(self, e: Event, order: tuple):
        if not e.instance and e.pid and e.process:
            e.instance = self._instance(e.pid, e.process)
        e.order = order
        self.most = max(self.most, e.end)
        self.events.append(e)

    def give(self, line: int, seq: int, what: int, pid: int, name, uid, user, body: bytes):
        self.at, self.step = line, (line, seq)
        body = pickle.loads(body)
        if what == EVENT:
            e = Event(*body)
            if e.process == ASK:
                e.process = self._named(pid)
                if e.source == "direct" and not e.process:  # an exit of a process that nothing is known of
                    return
            self._hold(e, self.step)
        elif what == START:
            self.active[pid] = {"name": name}
            self._begin(pid, name)
            self.starts.append((line, pid))
        elif what == RESTART:
            e = Event(*body[0])
            e.instance = self.last
            self._hold(e, body[1])
        elif what == KILL:
            self.observed.append(body)
        else:
            self.observed.append(body[0])
            if uid and self.instances.get(pid, ("", 0))[0] == name:
                self.last = self.instances.pop(pid)[1]
                old = self.gone.get((pid, name), {})
                self.gone[(pid, name)] = {n: at for n, at in old.items() if line - at <= ATTACH_LINES} | {self.last: line}
                if (self.active.get(pid) or {}).get("name") == name:
                    del self.active[pid]
        self.most = max(self.most, line)

    def _merge(self, i, j):
        order = self.events[i].order
        super()._merge(i, j)
        self.events[i].order = order

    def done(self) -> list[Event]:
        """What is held; nothing that comes can touch it."""
        self._pair()
        self._attach()
        out = [e.close() for e in self.events]
        self.events, self.observed, self.starts, self.most = [], [], [], -1
        return out


FACT = ("line", "role", "priority", "code", "rule", "format", "provenance")
FOUND = (
    "source_id string, kind int, start long, `end` long, anchor long, pid long, process string, quality int, fingerprint string, subject string, "
    "evidence int, outcome int, boundary int, anchor_ts long, origin string, facts_total int, "
    "facts array<struct<line:long,role:string,priority:int,code:string,rule:string,format:string,provenance:string>>, at long, no long, of_line long, of_seq long"
)


def processes(batches):
    """Of all steps sorted by source, pid, line and seq, with `low`, the first line that this or a later one touches: events,
    and a row of kind null for each instance, at the step that it began with."""
    import pyarrow as pa

    fact = pa.struct([(k, pa.int64() if k == "line" else pa.int32() if k == "priority" else pa.string()) for k in FACT])
    i32, i64, text = pa.int32(), pa.int64(), pa.string()
    kinds = [text, i32, i64, i64, i64, i64, text, i32, text, text, i32, i32, i32, i64, text, i32, pa.list_(fact), i64, i64, i64, i64]
    names = ["source_id", "kind", "start", "end", "anchor", "pid", "process", "quality", "fingerprint", "subject", "evidence", "outcome", "boundary", "anchor_ts", "origin", "facts_total", "facts", "at", "no", "of_line", "of_seq"]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    key, p, begun, out = None, None, [], []

    def flush():
        for e in p.done():
            of = e.instance or (None, None)
            out.append((key[0], e.kind, e.start, e.end, e.anchor, e.pid, e.process, e.quality, e.fingerprint, e.subject, e.evidence, e.outcome, e.boundary, e.anchor_ts, e.source, e.facts_total, [{k: getattr(f, k) for k in FACT} for f in e.facts], *e.order, *of))
        out.extend((key[0], *[None] * 16, *step, None, None) for step in begun)
        begun.clear()

    columns = ("source_id", "pid", "line", "seq", "what", "process", "uid", "user", "low", "body")
    for batch in batches:
        for source, pid, line, seq, what, name, uid, user, low, body in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns], strict=True):
            if (source, pid) != key:
                if p is not None:
                    flush()
                key, p = (source, pid), Processes(begun)
            elif low > p.most + ATTACH_LINES and p.most >= 0:
                flush()
            p.give(line, seq, what, pid, name, uid, user, body)
            if len(out) > 5_000:
                yield table(out, schema)
                out.clear()
    if p is not None:
        flush()
    yield table(out, schema)
