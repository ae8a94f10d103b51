"""The ordered fold over one source's detail lines: recognizers, process identities, correlation.

Feed lines in order of line_no to `Fold.observe`; `Fold.finish` closes what is open and returns events.
The fold keeps only open candidates and recognised events, never lines, and is picklable, so the same
object is the state of the streaming operator.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import asdict, dataclass, field, replace
from typing import NamedTuple

from . import rules as R

JAVA_LINES, JAVA_BYTES, JAVA_ACTIVE, JAVA_UNMATCHED = 512, 128 << 10, 32, 32
ANR_LINES, ANR_BYTES, ANR_ACTIVE, ANR_UNMATCHED = 512, 256 << 10, 16, 16
TOMB_LINES, TOMB_BYTES, TOMB_LINE, TOMB_UNMATCHED = 256, 64 << 10, 16 << 10, 8
KERNEL_LINES, KERNEL_BYTES, KERNEL_ACTIVE, KERNEL_UNMATCHED = 512, 512 << 10, 8, 16
MAX_FRAMES, MAX_FACTS, MAX_DEATHS, ATTACH_LINES, CLOCK_MS = 3, 8, 64, 4096, 60_000
#: Lines after which nothing can change an event: what it is paired with, what is attached to it, and what those depend on.
HOLD_LINES = 4 * ATTACH_LINES + 512
PAIR_LINES = {R.JAVA_CRASH: 512, R.JAVA_OOM: 512, R.ANR: 512, R.NATIVE_CRASH: 4096}
#: Tags that each recognizer looks at; to others a line only counts as one that doesn't belong.
_LIFE_TAGS = frozenset(("ActivityManager", "am_proc_start", "am_proc_died", "am_kill", "Zygote"))
_KILL_TAGS = frozenset(("lmkd", "lowmemorykiller", "kernel", ""))
_JAVA_TAGS = frozenset(("AndroidRuntime", "art", "dalvikvm", "am_crash", ""))
_ANR_TAGS = frozenset(("ActivityManager", "am_anr", ""))
_NATIVE_TAGS = frozenset(("libc", "DEBUG", "debuggerd", ""))


class Fact(NamedTuple):
    """What a line is to an event: its role, and where the rule that found it read it."""

    line: int
    role: str
    priority: int
    rule: str
    format: str
    provenance: str

    @property
    def code(self) -> str:
        return R.fact_code(self.rule, self.role)


#: Priority of each role: grammar first, then outcomes, then what links accounts, then details.
PRIORITY = {"Primary": 0, "ProcessIdentity": 0, "ExceptionType": 0, "Signal": 0, "Recovery": 1, "KillIssued": 1, "KillRequest": 1, "Restart": 1}


@dataclass
class Line:
    line: int
    tag: str
    message: str
    level: str
    pid: str
    raw_len: int = 0
    provenance: str = "unknown"
    buffer: str | None = None
    packed_ts: int | None = None
    segment: int | None = None
    ms: int | None = None

    def known(self, buffer: str) -> bool:
        return self.provenance == "known" and self.buffer == buffer

    def origin(self) -> str:
        """Provenance in one word: Known(Main), Inferred(Events) or Unknown."""
        return "Unknown" if self.provenance == "unknown" or not self.buffer else f"{self.provenance.title()}({self.buffer.title()})"

    def facts(self, rule: str, format: str, *roles: str) -> list[Fact]:
        return [Fact(self.line, r, PRIORITY.get(r, 3), rule, format, self.origin()) for r in roles]


@dataclass
class Event:
    kind: int
    start: int
    end: int
    anchor: int
    pid: int
    process: str | None
    quality: int
    tokens: list
    source: str
    evidence: int = R.PRIMARY
    outcome: int = 0
    boundary: int = 0
    anchor_ts: int = 0
    segment: int | None = None
    ms: int | None = None
    subject: str | None = None
    facts: list = field(default_factory=list)
    fingerprint: str = ""
    instance: int = 0
    facts_total: int = 0

    def close(self) -> Event:
        """Keeps the eight best facts, by priority, line, rule and role, mere support last; a cut is marked at the boundary."""
        self.fingerprint = R.fingerprint(self.kind, self.quality, self.process, self.tokens)
        order = lambda f: (f.priority, f.role == "Supporting", f.line, R.RULES.index(f.rule), R.ROLES.index(f.role))
        self.facts = sorted(dict.fromkeys(self.facts), key=order)
        self.facts_total = len(self.facts)
        if self.facts_total > MAX_FACTS:
            self.boundary |= R.REFS_TRUNCATED
            self.facts = self.facts[:MAX_FACTS]
        return self


def _outcome(facts: list[Fact]) -> list[Fact]:
    """Facts that tell how an event ended."""
    return [f._replace(priority=1) for f in facts]


def restart(d: dict, x: Line) -> dict:
    """The event of a process that died and began again; `x` is the line of its start."""
    format = "EventLogShapedText" if x.tag == "am_proc_start" else "AospText"
    facts = [d["fact"], *x.facts("ProcessRestartV1", format, "Primary", "ProcessIdentity"), *(f._replace(priority=2) for f in x.facts("ProcessRestartV1", format, "Restart"))]
    records = "EventLogShapedText" in (format, d["fact"].format)
    return {"kind": R.PROCESS_RESTART, "start": d["line"], "end": x.line, "anchor": x.line, "pid": d["pid"], "process": d["name"], "quality": R.STRUCTURED_FIELDS, "tokens": [(R.RELATION, "start-after-death")], "source": "direct", "evidence": R.PRIMARY | R.CORRELATED | R.MULTILINE | (R.STRUCTURED if records else 0), "outcome": R.DEATH_OBSERVED | R.START_AFTER_DEATH, "anchor_ts": x.packed_ts or 0, "segment": x.segment, "ms": x.ms, "subject": "start-after-death", "facts": facts}


class Near:
    """Events by where they begin, so that those near a line are found without going through all."""

    def __init__(self, events, reach: int):
        pick = lambda short: sorted(((e.start, k) for k, e in enumerate(events) if (e.end - e.start <= reach) is short))
        self.short, self.long, self.reach = pick(True), [k for _, k in pick(False)], reach

    def of(self, start: int, end: int):
        """Places of the events that may be within reach of these lines."""
        lo = bisect_left(self.short, (start - 2 * self.reach, -1))
        hi = bisect_left(self.short, (end + self.reach + 1, -1))
        return [k for _, k in self.short[lo:hi]] + self.long


class Pending:
    """A multi-line candidate: where it began, what it has, and how long it may go on."""

    def __init__(self, x: Line, kind: str, pid: int, rule: str, format: str = "AospText"):
        self.rule, self.format = rule, format
        self.kind, self.pid, self.start, self.last, self.bytes, self.unmatched = kind, pid, x.line, x.line, x.raw_len, 0
        self.ts, self.segment, self.ms = x.packed_ts or 0, x.segment, x.ms
        self.facts = x.facts(rule, format, "Primary")
        self.data: dict = {"frames": []}

    def touch(self, x: Line):
        self.last, self.unmatched = x.line, 0

    def fact(self, x: Line, role: str):
        self.facts += x.facts(self.rule, self.format, role)


class Fold:
    def __init__(self):
        self.java: list[Pending] = []
        self.anr: list[Pending] = []
        self.kernel: list[Pending] = []
        self.tomb: Pending | None = None
        self.active: dict[int, dict] = {}
        self.deaths: list[dict] = []
        self.signals: list[dict] = []
        self.starts: list[tuple[int, int]] = []
        self.observed: list[dict] = []  # deaths and kill requests that may be attached
        self.events: list[Event] = []
        self.instances: dict[int, tuple[str, int]] = {}  # the process that a pid stands for, and its number
        self.gone: dict[tuple[int, str], dict[int, int]] = {}  # numbers of processes that died, and where
        self.started = 0
        self.at = 0
        self.given: tuple | None = None  # place in order of the last event given out
        self.numbered = 0

    # ---------------------------------------------------------------- events

    def emit(self, **k):
        e = Event(**k)
        if not e.instance and e.pid and e.process:
            e.instance = self._instance(e.pid, e.process)
        self.events.append(e)

    def _instance(self, pid: int, name: str) -> int:
        """The number of the process that runs, or ran, under this pid and name; a new one where nothing is known of the pid.

        0 where the pid now stands for another name, or several processes of that pid and name have died."""
        if pid in self.instances:
            known, number = self.instances[pid]
            return number if known == name else 0
        past = [n for n, line in self.gone.get((pid, name), {}).items() if self.at - line <= ATTACH_LINES]
        if past:
            return past[0] if len(past) == 1 else 0
        return self._begin(pid, name)

    def _begin(self, pid: int, name: str) -> int:
        self.started += 1
        self.instances[pid] = (name, self.started)
        return self.started

    # ---------------------------------------------------------------- the order of a line

    def observe(self, x: Line) -> None:
        if x.line <= self.at:
            raise ValueError("lines must come in order")
        self.enter(x)
        self.take(x)

    def enter(self, x: Line) -> None:
        """What a line closes by coming."""
        self.at = x.line
        self._expire(x)

    def take(self, x: Line) -> None:
        if x.raw_len > R.MAX_LINE:
            for p in (*self.java, *self.anr):
                p.unmatched += 1
            return
        tag = x.tag
        if tag in _LIFE_TAGS:
            self._lifecycle(x)
        elif tag in _KILL_TAGS and not self._kernel(x):
            self._lmk(x)
        if tag in _JAVA_TAGS:
            self._java(x)
        elif self.java:
            for p in self.java:
                p.unmatched += 1
            self._exhausted()
        if tag in _ANR_TAGS:
            self._anr(x)
        elif self.anr:
            for p in self.anr:
                p.unmatched += 1
            self._anr_exhausted()
        if tag in _NATIVE_TAGS or self.tomb is not None:
            self._native(x)

    def _expire(self, x: Line):
        for held, lines, size, close in ((self.java, JAVA_LINES, JAVA_BYTES, self._close_java), (self.anr, ANR_LINES, ANR_BYTES, self._close_anr)):
            for p in list(held):
                p.bytes += x.raw_len
                if x.line - p.start >= lines or p.bytes > size:
                    held.remove(p)
                    close(p, R.BY_LIMIT)
        for p in list(self.kernel):
            p.bytes += x.raw_len
            if x.line - p.start > KERNEL_LINES or p.bytes > KERNEL_BYTES:
                self.kernel.remove(p)

    def finish(self) -> list[Event]:
        """Closes what is open; the events that `settle` hasn't given out."""
        self._close_all()
        return self._give(None)

    def _close_all(self) -> None:
        for held, close in ((self.java, self._close_java), (self.anr, self._close_anr)):
            for p in sorted(held, key=lambda p: p.start):
                close(p, R.BY_INPUT)
            held.clear()
        if self.tomb is not None:
            self._close_tomb(R.BY_INPUT)
        self.kernel.clear()

    def settle(self) -> list[Event]:
        """Events that lines to come can't change any more; then forgets what only they needed. The rest waits for `finish`."""
        open_from = min([self.at, *(p.start for p in (*self.java, *self.anr, *self.kernel)), *([self.tomb.start] if self.tomb else [])])
        out = self._give(open_from - HOLD_LINES)
        old = open_from - 2 * HOLD_LINES
        self.events = [e for e in self.events if e.end >= old]
        self.observed = [o for o in self.observed if o["line"] >= old]
        self.starts = [(line, pid) for line, pid in self.starts if line >= old]
        return out

    def _give(self, before: int | None) -> list[Event]:
        """Events in order, paired and with what is attached, that end before a line and weren't given out yet."""
        kept = self.events
        self.events = [replace(e, facts=list(e.facts)) for e in kept]
        self._pair()
        self._attach()
        out = []
        for e in sorted(self.events, key=lambda e: (e.end, e.start, e.kind)):
            place = (e.end, e.start, e.kind)
            if (before is None or e.end < before) and (self.given is None or place > self.given):
                out.append(e.close())
        self.events = kept
        if out:
            self.given = (out[-1].end, out[-1].start, out[-1].kind)
        return out

    # ---------------------------------------------------------------- Java

    def _java(self, x: Line):
        r = self._record(x, "am_crash")
        if r is not None:
            self._crash_record(x, r)
            return
        m, pid = x.message, R.pid_of(x.pid)
        if x.tag in ("art", "dalvikvm") and pid and ("java.lang.OutOfMemoryError" in m or m.startswith(("Throwing OutOfMemoryError", "Out of memory on a "))):
            p = next((p for p in self.java if p.pid == pid), None)
            if p:
                p.fact(x, "Supporting")
                p.touch(x)
                return
        if x.tag == "AndroidRuntime" and x.level in ("E", "F") and pid:
            kind = "normal" if re.match(r"FATAL EXCEPTION: .", m) else "system" if re.match(r"\*\*\* FATAL EXCEPTION IN SYSTEM PROCESS: .", m) else None
            if kind:
                old = next((p for p in self.java if p.pid == pid), None)
                if old:
                    self.java.remove(old)
                    self._close_java(old, 0)
                elif len(self.java) == JAVA_ACTIVE:
                    old = min(self.java, key=lambda p: p.last)
                    self.java.remove(old)
                    self._close_java(old, R.BY_LIMIT)
                self.java.append(Pending(x, kind, pid, "JavaUncaughtV1"))
                return
        if x.tag == "AndroidRuntime" and pid:
            p = next((p for p in self.java if p.pid == pid), None)
            if p:
                if not self._java_line(p, x):
                    p.unmatched += 1
                self._exhausted()
                return
        elif not x.tag and (R.java_throwable(m) or R.java_frame(m) or self._elided(m) or self._process_line(m)):
            fits = [p for p in self.java if not (q := self._process_line(m)) or q[1] == p.pid]
            if len(fits) == 1:
                self._java_line(fits[0], x)
                return
        for p in self.java:
            p.unmatched += 1
        self._exhausted()

    def _exhausted(self):
        for p in [p for p in self.java if p.unmatched > JAVA_UNMATCHED]:
            self.java.remove(p)
            self._close_java(p, R.BY_LIMIT)

    @staticmethod
    def _elided(m: str) -> bool:
        return bool(re.fullmatch(r"\.\.\. [0-9]+ (?:more|common frames omitted)", R.trim(m)))

    @staticmethod
    def _process_line(m: str):
        g = re.fullmatch(r"Process: ([A-Za-z0-9._$:-]{1,256}), PID: ([0-9]+)", R.trim(m))
        return (g[1], int(g[2])) if g else None

    def _java_line(self, p: Pending, x: Line) -> bool:
        d, m = p.data, x.message
        if q := self._process_line(m):
            if p.kind == "normal":
                if q[1] != p.pid:
                    d["bad"] = True
                elif "process" not in d:
                    d["process"] = q[0]
                    p.fact(x, "ProcessIdentity")
            p.touch(x)
            return True
        name = R.java_throwable(m)
        if name:
            suppressed, cause = R.trim(m).startswith("Suppressed:"), R.trim(m).startswith("Caused by:")
            if not suppressed or "type" not in d:
                d["type"] = name
                d["oom"] = d.get("oom") or name.rsplit(".", 1)[-1] == "OutOfMemoryError"
                p.facts = [f for f in p.facts if f.role != "ExceptionType"]
                p.fact(x, "ExceptionType")
                if cause:
                    d["frames"] = []
                    p.facts = [f for f in p.facts if f.role != "StackFrame"]
            p.touch(x)
            return True
        frame = R.java_frame(m)
        if frame:
            if len(d["frames"]) < MAX_FRAMES:
                d["frames"].append(frame)
                p.fact(x, "StackFrame")
            p.touch(x)
            return True
        if self._elided(m):
            p.touch(x)
            return True
        return False

    def _close_java(self, p: Pending, boundary: int):
        d = p.data
        if "type" not in d or d.get("bad") or (p.kind == "normal" and "process" not in d):
            return
        frames, facts = d["frames"], p.facts
        if d.get("oom"):
            facts = [f._replace(rule="JavaOomV1") for f in facts]
        self.emit(kind=R.JAVA_OOM if d.get("oom") else R.JAVA_CRASH, start=p.start, end=p.last, anchor=p.start, pid=p.pid, process=d.get("process") if p.kind == "normal" else None, quality=R.FULL_STACK if frames else R.TYPE_ONLY, tokens=[(R.EXCEPTION_TYPE, d["type"]), *((R.FRAME, f) for f in frames)], source="body", evidence=R.PRIMARY | (R.MULTILINE if p.last > p.start else 0), boundary=boundary, anchor_ts=p.ts, segment=p.segment, ms=p.ms, subject=d["type"], facts=facts)

    # ---------------------------------------------------------------- structured records

    def _record(self, x: Line, tag: str) -> dict | None:
        return R.event_record(tag, x.message) if x.tag == tag and x.known("events") else None

    def _crash_record(self, x: Line, r: dict):
        native = r["exception"] == "Native crash"
        type_name = r["exception"]
        if native:
            kind, quality, tokens = R.NATIVE_CRASH, R.MINIMAL, [(R.FIELD, "native-crash")]
        else:
            if not R.java_throwable(type_name):
                return
            file = r["file"].rsplit("/", 1)[-1]
            kind = R.JAVA_OOM if type_name.rsplit(".", 1)[-1] == "OutOfMemoryError" else R.JAVA_CRASH
            quality, tokens = (R.TYPE_FILE if file else R.TYPE_ONLY), [(R.EXCEPTION_TYPE, type_name), *([(R.FIELD, file)] if file else [])]
        self.emit(kind=kind, start=x.line, end=x.line, anchor=x.line, pid=r["pid"], process=r["name"], quality=quality, tokens=tokens, source="structured", evidence=R.PRIMARY | R.STRUCTURED, outcome=R.RECOVERABLE if r["recoverable"] else 0, segment=x.segment, ms=x.ms, subject=None if native else type_name, facts=x.facts("ManagedAmCrashV1", "EventLogShapedText", "Primary", "ProcessIdentity"))

    # ---------------------------------------------------------------- unresponsive

    def _anr(self, x: Line):
        r = self._record(x, "am_anr")
        if r is not None:
            reason = R.anr_reason(r["reason"])
            self._emit_anr(x.line, x.line, x, r["pid"], r["name"], reason, "structured", 0, x.facts("AnrActivityManagerV1", "EventLogShapedText", "Primary", "ProcessIdentity", "Reason"))
            return
        m, pid = x.message, R.pid_of(x.pid)
        if x.tag == "ActivityManager" and pid and (g := re.match(r"ANR in\s+([A-Za-z0-9.:_-]+)(?=\s|$)", m, re.A)):
            old = next((p for p in self.anr if p.pid == pid), None)
            if old:
                self.anr.remove(old)
                self._close_anr(old, 0)
            elif len(self.anr) == ANR_ACTIVE:
                old = min(self.anr, key=lambda p: p.last)
                self.anr.remove(old)
                self._close_anr(old, R.BY_LIMIT)
            p = Pending(x, "anr", pid, "AnrActivityManagerV1")
            p.data["process"] = g[1]
            self.anr.append(p)
            return
        if x.tag == "ActivityManager" and pid:
            p = next((p for p in self.anr if p.pid == pid), None)
            if p:
                if not self._anr_line(p, x):
                    p.unmatched += 1
                self._anr_exhausted()
                return
        elif not x.tag and m.startswith(("PID: ", "Reason: ")):
            v = R.pid_of(R.trim(m[5:])) if m.startswith("PID: ") else None
            fits = [p for p in self.anr if v is None or p.data.get("victim") in (None, v)]
            if len(fits) == 1:
                self._anr_line(fits[0], x)
                return
        for p in self.anr:
            p.unmatched += 1
        self._anr_exhausted()

    def _anr_exhausted(self):
        for p in [p for p in self.anr if p.unmatched > ANR_UNMATCHED]:
            self.anr.remove(p)
            self._close_anr(p, R.BY_LIMIT)

    def _anr_line(self, p: Pending, x: Line) -> bool:
        m = x.message
        if m.startswith("PID: ") and (v := R.pid_of(R.trim(m[5:]))):
            if p.data.setdefault("victim", v) != v:
                p.data["bad"] = True
            else:
                p.fact(x, "ProcessIdentity")
            p.touch(x)
            return True
        if m.startswith("Reason: ") and R.trim(m[8:]):
            p.data["reason"] = R.anr_reason(m[8:])
            p.fact(x, "Reason")
            p.touch(x)
            return True
        return False

    def _close_anr(self, p: Pending, boundary: int):
        if "victim" in p.data and not p.data.get("bad"):
            self._emit_anr(p.start, p.last, p, p.data["victim"], p.data["process"], p.data.get("reason"), "body", boundary, p.facts)

    def _emit_anr(self, start, end, x, pid, process, reason, source, boundary, facts):
        tokens = [(R.FIELD, reason[0]), (R.FIELD, reason[1])] if reason else []
        ts = (x.ts if isinstance(x, Pending) else x.packed_ts) or 0
        flags = R.PRIMARY | (R.STRUCTURED if source == "structured" else 0) | (R.MULTILINE if end > start else 0)
        self.emit(kind=R.ANR, start=start, end=end, anchor=start, pid=pid, process=process, quality=R.STRUCTURED_FIELDS if reason else R.MINIMAL, tokens=tokens, source=source, evidence=flags, boundary=boundary, anchor_ts=ts, segment=x.segment, ms=x.ms, subject=reason[1] if reason else None, facts=facts)

    # ---------------------------------------------------------------- native

    def _native(self, x: Line):
        m = R.trim(x.message)
        if x.tag == "libc" and x.level == "F" and x.message.startswith("Fatal signal "):
            self._libc(x)
            return
        tomb_tag = x.tag in ("DEBUG", "debuggerd", "")
        if tomb_tag and m.startswith(R.STARS):
            if self.tomb is not None:
                self._close_tomb(0)
            self.tomb = Pending(x, "tombstone", R.pid_of(x.pid) or 0, "NativeTombstoneV1", "TombstoneShapedText")
            return
        p = self.tomb
        if p is None or not (not x.tag or p.pid == 0 or R.pid_of(x.pid) == p.pid):
            return
        p.bytes += x.raw_len
        if x.line - p.start > TOMB_LINES or p.bytes > TOMB_BYTES or x.raw_len > TOMB_LINE:
            self._close_tomb(R.BY_LIMIT)
            return
        if not self._tomb_line(p, x, m):
            p.unmatched += 1
            if p.data["frames"]:
                self._close_tomb(0)
            elif p.unmatched >= TOMB_UNMATCHED:
                self._close_tomb(R.BY_LIMIT)

    def _tomb_line(self, p: Pending, x: Line, m: str) -> bool:
        d, hit = p.data, False
        if "Requested dump" in m or "Signal Catcher" in m:
            d["bad"] = hit = True
        if g := re.match(r"pid: ([0-9]+), (?:ppid: [0-9]+, )?tid: ([0-9]+)", m):
            d["victim"], hit = int(g[1]), True
        name = (re.search(r">>> ([A-Za-z0-9._:/@-]{1,256}) <<<", m) or re.fullmatch(r"Cmdline: ([A-Za-z0-9._:/@-]{1,256})", m)) if m else None
        if name and re.search("[A-Za-z]", name[1]):
            if "process" not in d:
                d["process"] = name[1]
                p.fact(x, "ProcessIdentity")
            hit = True
        if m.startswith("signal "):
            s = R.fatal_signal(m)
            if s is None:
                d["bad"] = True
            else:
                d["signal"] = s
                d["anchor"] = x.line
                p.fact(x, "Signal")
            hit = True
        if m in ("recoverable: true", "Recoverable: true"):
            d["recoverable"] = hit = True
            p.fact(x, "Recovery")
        if m == "backtrace:":
            d["trace"] = hit = True
        elif d.get("trace") and (f := R.native_detail(m)):
            if len(d["frames"]) < MAX_FRAMES:
                d["frames"].append(f)
                p.fact(x, "BacktraceFrame")
            hit = True
        if hit:
            p.touch(x)
        return hit

    def _close_tomb(self, boundary: int):
        p, self.tomb = self.tomb, None
        d = p.data
        if d.get("bad") or not all(k in d for k in ("victim", "process", "signal")):
            return
        s = d["signal"]
        self.emit(kind=R.NATIVE_CRASH, start=p.start, end=p.last, anchor=d["anchor"], pid=d["victim"], process=d["process"], quality=R.FULL_STACK if d["frames"] else R.SIGNAL_ONLY, tokens=[(R.SIGNAL, s["signal"]), (R.FIELD, s["code"]), *((R.FRAME, f) for f in d["frames"])], source="body", evidence=R.PRIMARY | R.MULTILINE, outcome=R.RECOVERABLE if d.get("recoverable") else 0, boundary=boundary, segment=p.segment, ms=p.ms, subject=s["signal"], facts=p.facts)

    def _libc(self, x: Line):
        pid = R.pid_of(x.pid)
        s = R.fatal_signal("signal " + x.message[len("Fatal signal ") :])
        if not pid or s is None or (s["pid"] and s["pid"] != pid):
            return
        process = s["process"] or self._named(pid)
        facts = x.facts("NativeLibcSignalV1", "AospText", "Primary", "Signal", *(["ProcessIdentity"] if s["process"] else []))
        self.emit(kind=R.NATIVE_CRASH, start=x.line, end=x.line, anchor=x.line, pid=pid, process=process, quality=R.SIGNAL_ONLY, tokens=[(R.SIGNAL, s["signal"]), (R.FIELD, s["code"])], source="signal", anchor_ts=x.packed_ts or 0, segment=x.segment, ms=x.ms, subject=s["signal"], facts=facts)

    def _named(self, pid: int) -> str | None:
        return (self.active.get(pid) or {}).get("name")

    # ---------------------------------------------------------------- memory killers

    def _lmk(self, x: Line):
        m = R.trim(x.message)
        if x.tag == "lmkd":
            g = re.match(r"Kill '([A-Za-z0-9._$:-]{1,256})' \(([1-9][0-9]{0,9})\), uid ([0-9]+), oom_score_adj (-?[0-9]+) to free .+?; reason: (.*)", m, re.S)
            reason = R.lmk_reason(g[5]) if g else None
            mechanism = "userspace-lmkd"
        elif x.tag == "lowmemorykiller" and x.known("kernel"):
            g = re.match(r"Killing '([A-Za-z0-9._$:-]{1,256})' \(([1-9][0-9]{0,9})\), adj (-?[0-9]+).* to free", m, re.S)
            mechanism = reason = "legacy-kernel-lowmemorykiller"
        else:
            return
        if not g or not reason:
            return
        self.emit(kind=R.LMK_KILL, start=x.line, end=x.line, anchor=x.line, pid=int(g[2]), process=g[1], quality=R.STRUCTURED_FIELDS, tokens=[(R.MECHANISM, mechanism), (R.FIELD, reason)], source="direct", evidence=R.PRIMARY | R.STRUCTURED, outcome=R.KILL_ISSUED, anchor_ts=x.packed_ts or 0, segment=x.segment, ms=x.ms, subject=reason, facts=x.facts("LmkdKillV1", "AospText" if x.tag == "lmkd" else "KernelShapedText", "Primary", "ProcessIdentity", "KillIssued"))

    def _kernel(self, x: Line) -> bool:
        if x.tag not in ("kernel", "") or not x.known("kernel"):
            return False
        m = R.trim(x.message)
        victim = r"Killed process ([1-9][0-9]{0,9}) \(([^()]{1,256})\)"
        if g := re.match(rf"(?:Memory cgroup out of memory|Out of memory): {victim}", m):
            self._emit_kernel(x.line, x, g, R.kernel_mechanism(m))
            return True
        invoked, constraint = "invoked oom-killer:" in m, "oom-kill:constraint=" in m
        if invoked or constraint:
            mechanism = R.kernel_mechanism(m) or "global"
            if constraint and not invoked:
                for p in self.kernel:
                    if p.kind == "invoked" and p.last + 1 == x.line:
                        p.kind, p.data["mechanism"] = "both", mechanism
                        p.touch(x)
                        return True
            p = Pending(x, "invoked" if invoked else "constraint", 0, "KernelOomKillV1", "KernelShapedText")
            p.data["mechanism"] = mechanism
            if len(self.kernel) == KERNEL_ACTIVE:
                self.kernel.remove(min(self.kernel, key=lambda p: p.start))
            self.kernel.append(p)
            return True
        if g := re.match(victim, m):
            if len(self.kernel) == 1:
                p = self.kernel.pop()
                self._emit_kernel(p.start, x, g, p.data["mechanism"])
            return True
        for p in list(self.kernel):
            p.unmatched += 1
            if p.unmatched > KERNEL_UNMATCHED:
                self.kernel.remove(p)
        return False

    def _emit_kernel(self, start: int, x: Line, g, mechanism: str):
        facts = x.facts("KernelOomKillV1", "KernelShapedText", "Primary", "ProcessIdentity", "KillIssued")
        if start < x.line:  # the line that opened it is kept as evidence
            facts += [f._replace(line=start) for f in x.facts("KernelOomKillV1", "KernelShapedText", "Supporting")]
        self.emit(kind=R.KERNEL_OOM_KILL, start=start, end=x.line, anchor=x.line, pid=int(g[1]), process=g[2], quality=R.STRUCTURED_FIELDS, tokens=[(R.MECHANISM, mechanism)], source="direct", evidence=R.PRIMARY | R.STRUCTURED | (R.MULTILINE if x.line > start else 0), outcome=R.KILL_ISSUED, anchor_ts=x.packed_ts or 0, segment=x.segment, ms=x.ms, subject=mechanism, facts=facts)

    # ---------------------------------------------------------------- lifecycle

    def _lifecycle(self, x: Line):
        m = R.trim(x.message)
        if x.raw_len > 16 << 10:
            return
        if x.tag == "ActivityManager":
            if g := re.match(r"Start proc ([1-9][0-9]{0,9}):([A-Za-z0-9._$:-]{1,256})/u([0-9]+)([as])([0-9]+)\s+for ", m):
                user = int(g[3])
                self._start(x, int(g[1]), g[2], user * 100_000 + (10_000 if g[4] == "a" else 0) + int(g[5]), user)
            elif g := re.match(r"Process ([A-Za-z0-9._$:-]{1,256}) \(pid ([1-9][0-9]{0,9})\) has died(?::|$)", m):
                self._death(x, int(g[2]), g[1], None)
        elif x.tag in ("am_proc_start", "am_proc_died", "am_kill"):
            r = R.event_record(x.tag, x.message)
            if r is None or x.provenance == "unknown" or x.buffer != "events":
                return
            if x.tag == "am_kill":
                self._kill({"what": "kill", "fact": x.facts("AmKillRequestV1", "EventLogShapedText", "KillRequest")[0], "line": x.line, "pid": r["pid"], "process": r["name"], "segment": x.segment, "ms": x.ms})
            elif x.tag == "am_proc_died":
                self._death(x, r["pid"], r["name"], r["user"], independent=x.known("events"))
            elif x.known("events"):
                if r["user"] is None or r["uid"] // 100_000 == r["user"]:
                    self._start(x, r["pid"], r["name"], r["uid"], r["user"])
        elif x.tag == "Zygote" and (g := re.fullmatch(r"Process ([1-9][0-9]{0,9}) exited due to signal ([1-9][0-9]?) \(([A-Za-z0-9_-]+)\)", m)):
            if int(g[2]) <= 64 and (name := self._named(int(g[1]))):
                self.emit(kind=R.SIGNAL_EXIT, start=x.line, end=x.line, anchor=x.line, pid=int(g[1]), process=name, quality=R.STRUCTURED_FIELDS, tokens=[(R.RELATION, "signal-exit"), (R.FIELD, bytes([int(g[2])]))], source="direct", outcome=R.DEATH_OBSERVED, anchor_ts=x.packed_ts or 0, segment=x.segment, ms=x.ms, subject=g[3], facts=x.facts("SignalExitV1", "AospText", "Primary", "ProcessIdentity", "Signal") + _outcome(x.facts("SignalExitV1", "AospText", "Death")))

    def _start(self, x: Line, pid: int, name: str, uid: int, user: int | None):
        self.active[pid] = {"name": name, "uid": uid, "user": user}
        self._begin(pid, name)
        self.starts.append((x.line, pid))
        for d in self.deaths:
            if d["name"] == name and d["uid"] == uid and (user is None or d["user"] is None or d["user"] == user):
                self.deaths.remove(d)
                self.emit(**restart(d, x), instance=d["instance"])
                break

    def _kill(self, o: dict):
        self.observed.append(o)

    def _death(self, x: Line, pid: int, name: str, user: int | None, independent: bool = True):
        """A record that is only inferred to be one may support a fault, but ends no process."""
        format = "EventLogShapedText" if x.tag == "am_proc_died" else "AospText"
        self.observed.append({"what": "death", "fact": _outcome(x.facts("ProcessDiedV1", format, "Death"))[0], "line": x.line, "pid": pid, "process": name, "segment": x.segment, "ms": x.ms})
        if not independent:
            return
        if self.instances.get(pid, ("", 0))[0] == name:
            self.gone = {k: v for k, v in self.gone.items() if self.at - max(v.values()) <= ATTACH_LINES} if len(self.gone) > 256 else self.gone
            self.gone.setdefault((pid, name), {})[self.instances[pid][1]] = x.line
        who = self.active.get(pid)
        if who and who["name"] == name:
            del self.active[pid]
            self.deaths.append({"line": x.line, "pid": pid, "fact": x.facts("ProcessRestartV1", format, "Death")[0]._replace(priority=2), "instance": self.instances.get(pid, ("", 0))[1], "name": name, "uid": who["uid"], "user": who["user"] if user is None else user})
            if len(self.deaths) > MAX_DEATHS:
                self.deaths.pop(0)
        if self.instances.get(pid, ("", 0))[0] == name:
            del self.instances[pid]

    # ---------------------------------------------------------------- correlation

    @staticmethod
    def _clock(a, b) -> bool:
        seg = lambda v: v["segment"] if isinstance(v, dict) else v.segment
        ms = lambda v: v["ms"] if isinstance(v, dict) else v.ms
        return seg(a) is None or seg(a) != seg(b) or abs(ms(a) - ms(b)) <= CLOCK_MS

    def _pair(self):
        """Two sources' accounts of one fault become one event: each must be the other's only nearest."""
        by_key: dict = {}
        for i, e in enumerate(self.events):
            if e.kind in PAIR_LINES and e.process:
                by_key.setdefault((e.kind, e.pid, e.process), []).append(i)
        starts: dict[int, list[int]] = {}
        for line, pid in self.starts:
            starts.setdefault(pid, []).append(line)
        merged: set[int] = set()
        for (kind, pid, _), members in by_key.items():
            if len({self.events[i].source for i in members}) < 2:
                continue
            near: dict[int, int | None] = {}
            index, begun = Near([self.events[i] for i in members], PAIR_LINES[kind]), sorted(starts.get(pid, ()))
            for i in members:
                a, found = self.events[i], []
                for k in index.of(a.start, a.end):
                    j, b = members[k], self.events[members[k]]
                    if i == j or a.source == b.source or (a.subject and b.subject and a.subject != b.subject) or not self._clock(a, b):
                        continue
                    gap = max(0, max(a.start, b.start) - min(a.end, b.end))
                    after = bisect_right(begun, min(a.end, b.end))
                    if gap > PAIR_LINES[kind] or (after < len(begun) and begun[after] < max(a.start, b.start)):
                        continue
                    found.append((gap, j))
                found.sort()
                near[i] = found[0][1] if found and (len(found) == 1 or found[0][0] < found[1][0]) else None
            for i in members:
                j = near[i]
                if j is not None and i < j and near[j] == i:
                    self._merge(i, j)
                    merged.add(j)
        self.events = [e for i, e in enumerate(self.events) if i not in merged]

    def _merge(self, i: int, j: int):
        a, b = self.events[i], self.events[j]
        fp = lambda e: (e.quality, R.fingerprint(e.kind, e.quality, e.process, e.tokens))
        best, other = (a, b) if fp(a) <= fp(b) else (b, a)
        best.start, best.end = min(a.start, b.start), max(a.end, b.end)
        best.evidence |= other.evidence | R.CORRELATED
        best.outcome |= other.outcome
        best.boundary |= other.boundary
        best.anchor_ts = best.anchor_ts or other.anchor_ts
        best.instance = best.instance or other.instance
        best.facts = a.facts + b.facts
        self.events[i] = best

    def _attach(self):
        """Deaths at or after a fault and kill requests around it, within 4096 lines, each to its one nearest."""
        by_key: dict = {}
        for e in self.events if self.observed else ():
            by_key.setdefault((e.pid, e.process), []).append(e)
        near: dict = {}
        for o in self.observed:
            found, key = [], (o["pid"], o["process"])
            if key not in by_key:
                continue
            if key not in near:
                near[key] = Near(by_key[key], ATTACH_LINES)
            for k in near[key].of(o["line"], o["line"]):
                e = by_key[key][k]
                if not self._clock(e, o):
                    continue
                if o["what"] == "death":
                    if e.kind in (R.PROCESS_RESTART, R.SIGNAL_EXIT, R.ANR) or o["line"] < e.start or o["line"] > e.end + ATTACH_LINES:
                        continue
                gap = max(0, o["line"] - e.end, e.start - o["line"])
                if gap <= ATTACH_LINES:
                    found.append((gap, e))
            found.sort(key=lambda t: t[0])
            if not found or (len(found) > 1 and found[0][0] == found[1][0]):
                continue
            e = found[0][1]
            if o["what"] == "death":
                e.outcome |= R.DEATH_OBSERVED | (R.CONFLICT if e.outcome & R.RECOVERABLE else 0)
                e.facts.append(o["fact"])
            else:
                e.outcome |= R.KILL_REQUESTED
                e.facts.append(o["fact"])
            e.evidence |= R.CORRELATED


def fold_lines(lines) -> list[dict]:
    """Events of one source's lines, given in order, as dictionaries."""
    f = Fold()
    for x in lines:
        f.observe(x)
    return [asdict(e) for e in f.finish()]
