"""Logs of our own in the shapes that matter, and every field of the events and facts they must give.

A log is text with the buffer of each line before a bar (a dot: unknown). Expected lines are
`kind start-end anchor pid instance evidence/outcome/boundary process subject`, then the facts by line.
"""

import random
import re

import pytest

from quarrylog.plans.problems import rules as R
from quarrylog.plans.problems.detect import event_rows
from quarrylog.plans.problems.fold import Fold, Line

THREAD = re.compile(r"(\d\d-\d\d) (\d\d:\d\d:\d\d\.\d{3}) +(\d+) +(\d+) ([VDIWEF]) ([^:]*?) *: ?(.*)")
STAR = " ".join(["***"] * 16)

LOGS = {
    "java": f"""
main|03-04 05:06:07.000  71  71 E AndroidRuntime: FATAL EXCEPTION: pool-1
main|03-04 05:06:07.001  71  71 E AndroidRuntime: Process: org.sample.mail, PID: 71
main|03-04 05:06:07.002  71  71 E AndroidRuntime: org.sample.mail.SyncException: quota
main|03-04 05:06:07.003  71  71 E AndroidRuntime: 	at org.sample.mail.Sync$2.call(Sync.java:9)
main|03-04 05:06:07.004  71  71 E AndroidRuntime: Caused by: java.lang.IllegalStateException: closed
main|03-04 05:06:07.005  71  71 E AndroidRuntime: 	at org.sample.mail.Box.<init>(Box.java:1)
main|03-04 05:06:07.006  71  71 E AndroidRuntime: 	... 4 more
main|03-04 05:06:08.000   1   1 I Other: between
main|03-04 05:06:09.000  72  72 E AndroidRuntime: *** FATAL EXCEPTION IN SYSTEM PROCESS: main
main|03-04 05:06:09.001  72  72 E AndroidRuntime: java.lang.OutOfMemoryError: no room
""",
    "records": """
events|03-04 05:06:07.000  9  9 I am_crash: [0,81,org.sample.news,0,org.sample.news.FeedException,late,Feed.java,12]
events|03-04 05:06:07.100  9  9 I am_crash: [0,82,org.sample.news,0,Native crash,signal,lib.so,0]
events|03-04 05:06:07.200  9  9 I am_anr: [0,83,org.sample.maps,0,Input dispatching timed out]
main|03-04 05:06:07.300  9  9 I am_crash: [0,84,org.sample.news,0,org.sample.news.FeedException,late,Feed.java,12]
.|03-04 05:06:07.400  9  9 I am_anr: [0,85,org.sample.maps,0,Input dispatching timed out]
""",
    "anr": """
system|03-04 05:06:07.000  5  6 E ActivityManager: ANR in org.sample.maps (org.sample.maps/.Main)
system|03-04 05:06:07.001  5  6 E ActivityManager: PID: 93
system|03-04 05:06:07.002  5  6 E ActivityManager: Reason: executing service org.sample.maps/.Tiles
events|03-04 05:06:07.003  9  9 I am_anr: [0,93,org.sample.maps,0,executing service org.sample.maps/.Tiles]
events|03-04 05:06:09.003  9  9 I am_kill: [0,93,org.sample.maps,0,bg anr]
""",
    "native": f"""
crash|03-04 05:06:07.000  40  40 F DEBUG: {STAR}
crash|03-04 05:06:07.001  40  40 F DEBUG: pid: 55, tid: 56, name: render  >>> org.sample.game <<<
crash|03-04 05:06:07.002  40  40 F DEBUG: signal 6 (SIGABRT), code -1 (SI_QUEUE), fault addr --------
crash|03-04 05:06:07.003  40  40 F DEBUG: backtrace:
crash|03-04 05:06:07.004  40  40 F DEBUG: #00 pc 00000000000004a0  [anon:scudo] (offset 0x2000) (spin+0x1c) (BuildId: 00ff)
crash|03-04 05:06:07.005  40  40 F DEBUG: #01 pc 0000beef  /apex/lib/libgame.so (BuildId: AA01)
crash|03-04 05:06:07.006  40  40 F DEBUG: #02 pc 00000010  /apex/lib/libgame.so (??) (BuildId: AA01)
crash|03-04 05:06:07.007  40  40 F DEBUG: #03 pc 00000011  /apex/lib/libgame.so (more+1)
main|03-04 05:06:08.000  41  41 F libc    : Fatal signal 11 (SIGSEGV), code 1 (SEGV_MAPERR), fault addr 0x8 in tid 58 (io), pid 41 (org.sample.radio)
""",
    "lifecycle": """
system|03-04 05:06:07.000  5  5 I ActivityManager: Start proc 61:org.sample.clock/u0a7 for service
system|03-04 05:06:08.000  5  5 I ActivityManager: Process org.sample.clock (pid 61) has died: cch
system|03-04 05:06:09.000  5  5 I ActivityManager: Start proc 62:org.sample.clock/u0a7 for service
main|03-04 05:06:10.000  3  3 I Zygote: Process 62 exited due to signal 9 (Killed)
events|03-04 05:06:11.000  9  9 I am_proc_start: [0,63,10009,org.sample.notes,service,x/y]
events|03-04 05:06:12.000  9  9 I am_proc_died: [0,63,org.sample.notes]
events|03-04 05:06:13.000  9  9 I am_proc_start: [0,64,10009,org.sample.notes,service,x/y]
.|03-04 05:06:14.000  9  9 I am_proc_died: [0,64,org.sample.notes]
""",
    "memory": """
main|03-04 05:06:07.000  2  2 I lmkd: Kill 'org.sample.cam' (33), uid 10003, oom_score_adj 900 to free 5kB rss; reason: psi
system|03-04 05:06:07.100  5  5 I ActivityManager: Process org.sample.cam (pid 33) has died: cch
kernel|03-04 05:06:07.200  0  0 I lowmemorykiller: Killing 'org.sample.cam' (34), adj 900, to free 10kB
main|03-04 05:06:07.300  0  0 I lowmemorykiller: Killing 'org.sample.cam' (35), adj 900, to free 10kB
kernel|03-04 05:06:08.000  0  0 W kernel: worker invoked oom-killer: gfp_mask=0x1
kernel|03-04 05:06:08.001  0  0 W kernel: oom-kill:constraint=CONSTRAINT_MEMCG,task=x
kernel|03-04 05:06:08.002  0  0 E kernel: Killed process 36 (org.sample.tv) total-vm:1kB
kernel|03-04 05:06:09.000  0  0 E kernel: Out of memory: Killed process 37 (org.sample.tv) total-vm:1kB
""",
    "java-oom": """
main|03-04 05:06:07.000  71  71 E AndroidRuntime: FATAL EXCEPTION: main
main|03-04 05:06:07.001  71  71 E AndroidRuntime: Process: org.sample.pics, PID: 71
main|03-04 05:06:07.002  71  71 I art: Throwing OutOfMemoryError "failed"
main|03-04 05:06:07.003  71  71 E AndroidRuntime: java.lang.OutOfMemoryError: failed
main|03-04 05:06:07.004  71  71 E AndroidRuntime: 	at org.sample.pics.Cache.put(Cache.java:3)
""",
    "alike": """
main|03-04 05:06:07.000  71  71 E Runtime: FATAL EXCEPTION: main
main|03-04 05:06:07.001  71  71 I AndroidRuntime: FATAL EXCEPTION: main
main|03-04 05:06:07.002  71  71 E AndroidRuntime: FATAL EXCEPTION: main
main|03-04 05:06:07.003  71  71 E AndroidRuntime: Process: org.sample.mail, PID: 72
main|03-04 05:06:07.004  71  71 E AndroidRuntime: org.sample.mail.SyncException: x
main|03-04 05:06:07.005  5  5 E ActivityManager: ANR in org.sample.maps
main|03-04 05:06:07.006  2  2 I lmkd: Kill 'org.sample.cam' (33), uid 1, oom_score_adj 900 to free 5kB rss; reason: psychic
main|03-04 05:06:07.007  0  0 E kernel: Out of memory: Killed process 37 (org.sample.tv) total-vm:1kB
""",
    "interleaved": """
.|03-04 05:06:07.000  11  11 E AndroidRuntime: FATAL EXCEPTION: a
.|03-04 05:06:07.001  12  12 E AndroidRuntime: FATAL EXCEPTION: b
.|03-04 05:06:07.002  12  12 E AndroidRuntime: Process: org.sample.b, PID: 12
.|03-04 05:06:07.003  11  11 E AndroidRuntime: Process: org.sample.a, PID: 11
.|03-04 05:06:07.004  11  11 E AndroidRuntime: org.sample.a.OneException
.|java.lang.Error: whose
.|03-04 05:06:07.005  12  12 E AndroidRuntime: org.sample.b.TwoException
.|03-04 05:06:07.006  12  12 E AndroidRuntime: at org.sample.b.X.y(X.java)
.|03-04 05:06:07.007  11  11 E AndroidRuntime: FATAL EXCEPTION: again
""",
    "paired": """
main|03-04 05:06:07.000  71  71 E AndroidRuntime: FATAL EXCEPTION: main
main|03-04 05:06:07.001  71  71 E AndroidRuntime: Process: org.sample.mail, PID: 71
main|03-04 05:06:07.002  71  71 E AndroidRuntime: org.sample.mail.SyncException: x
events|03-04 05:06:07.003  9  9 I am_crash: [0,71,org.sample.mail,0,org.sample.mail.SyncException,x,Sync.java,3,1]
events|03-04 05:06:07.004  9  9 I am_proc_died: [0,71,org.sample.mail]
""",
}

EXPECTED = """
# java
JavaCrash 1-7 1 71 1 5/0/1 org.sample.mail java.lang.IllegalStateException 0 18367001
  1 JavaUncaughtException JavaUncaughtV1 Primary AospText Known(Main)
  2 ProcessIdentityRecorded JavaUncaughtV1 ProcessIdentity AospText Known(Main)
  5 ExceptionTypeRecorded JavaUncaughtV1 ExceptionType AospText Known(Main)
  6 StackFrameRecorded JavaUncaughtV1 StackFrame AospText Known(Main)
JavaOom 9-10 9 72 0 5/0/1 None java.lang.OutOfMemoryError 2 18369001
  9 JavaOutOfMemoryError JavaOomV1 Primary AospText Known(Main)
  10 ExceptionTypeRecorded JavaOomV1 ExceptionType AospText Known(Main)
# records
JavaCrash 1-1 1 81 1 3/0/0 org.sample.news org.sample.news.FeedException 1 0
  1 ManagedCrashRecord ManagedAmCrashV1 Primary EventLogShapedText Known(Events)
  1 ProcessIdentityRecorded ManagedAmCrashV1 ProcessIdentity EventLogShapedText Known(Events)
NativeCrash 2-2 2 82 2 3/0/0 org.sample.news None 5 0
  2 ManagedCrashRecord ManagedAmCrashV1 Primary EventLogShapedText Known(Events)
  2 ProcessIdentityRecorded ManagedAmCrashV1 ProcessIdentity EventLogShapedText Known(Events)
Anr 3-3 3 83 3 3/0/0 org.sample.maps input-dispatch-timeout 4 18367201
  3 AnrDetected AnrActivityManagerV1 Primary EventLogShapedText Known(Events)
  3 ProcessIdentityRecorded AnrActivityManagerV1 ProcessIdentity EventLogShapedText Known(Events)
  3 AnrReasonRecorded AnrActivityManagerV1 Reason EventLogShapedText Known(Events)
# anr
Anr 1-4 4 93 1 15/1/1 org.sample.maps service:org.sample.maps/.Tiles 4 18367004
  1 AnrDetected AnrActivityManagerV1 Primary AospText Known(System)
  2 ProcessIdentityRecorded AnrActivityManagerV1 ProcessIdentity AospText Known(System)
  4 AnrDetected AnrActivityManagerV1 Primary EventLogShapedText Known(Events)
  4 ProcessIdentityRecorded AnrActivityManagerV1 ProcessIdentity EventLogShapedText Known(Events)
  5 KillRequested AmKillRequestV1 KillRequest EventLogShapedText Known(Events)
  3 AnrReasonRecorded AnrActivityManagerV1 Reason AospText Known(System)
  4 AnrReasonRecorded AnrActivityManagerV1 Reason EventLogShapedText Known(Events)
# native
NativeCrash 1-8 3 55 2 5/0/1 org.sample.game SIGABRT 0 0
  1 NativeCrashDetected NativeTombstoneV1 Primary TombstoneShapedText Known(Crash)
  2 ProcessIdentityRecorded NativeTombstoneV1 ProcessIdentity TombstoneShapedText Known(Crash)
  3 FatalSignalRecorded NativeTombstoneV1 Signal TombstoneShapedText Known(Crash)
  5 NativeFrameRecorded NativeTombstoneV1 BacktraceFrame TombstoneShapedText Known(Crash)
  6 NativeFrameRecorded NativeTombstoneV1 BacktraceFrame TombstoneShapedText Known(Crash)
  7 NativeFrameRecorded NativeTombstoneV1 BacktraceFrame TombstoneShapedText Known(Crash)
NativeCrash 9-9 9 41 1 1/0/0 org.sample.radio SIGSEGV 3 18368001
  9 SignalExitDetected NativeLibcSignalV1 Primary AospText Known(Main)
  9 ProcessIdentityRecorded NativeLibcSignalV1 ProcessIdentity AospText Known(Main)
  9 FatalSignalRecorded NativeLibcSignalV1 Signal AospText Known(Main)
# lifecycle
ProcessRestart 2-3 3 61 1 13/12/0 org.sample.clock start-after-death 4 18369001
  3 ProcessRestarted ProcessRestartV1 Primary AospText Known(System)
  3 ProcessIdentityRecorded ProcessRestartV1 ProcessIdentity AospText Known(System)
  2 ProcessDeathObserved ProcessRestartV1 Death AospText Known(System)
  3 StartAfterDeathObserved ProcessRestartV1 Restart AospText Known(System)
SignalExit 4-4 4 62 2 1/4/0 org.sample.clock Killed 4 18370001
  4 SignalExitDetected SignalExitV1 Primary AospText Known(Main)
  4 ProcessIdentityRecorded SignalExitV1 ProcessIdentity AospText Known(Main)
  4 FatalSignalRecorded SignalExitV1 Signal AospText Known(Main)
  4 ProcessDeathObserved SignalExitV1 Death AospText Known(Main)
ProcessRestart 6-7 7 63 3 15/12/0 org.sample.notes start-after-death 4 18373001
  7 ProcessRestarted ProcessRestartV1 Primary EventLogShapedText Known(Events)
  7 ProcessIdentityRecorded ProcessRestartV1 ProcessIdentity EventLogShapedText Known(Events)
  6 ProcessDeathObserved ProcessRestartV1 Death EventLogShapedText Known(Events)
  7 StartAfterDeathObserved ProcessRestartV1 Restart EventLogShapedText Known(Events)
# memory
LmkKill 1-1 1 33 1 11/6/0 org.sample.cam memory-pressure 4 18367001
  1 LmkKillIssued LmkdKillV1 Primary AospText Known(Main)
  1 ProcessIdentityRecorded LmkdKillV1 ProcessIdentity AospText Known(Main)
  1 LmkKillIssued LmkdKillV1 KillIssued AospText Known(Main)
  2 ProcessDeathObserved ProcessDiedV1 Death AospText Known(System)
LmkKill 3-3 3 34 2 3/2/0 org.sample.cam legacy-kernel-lowmemorykiller 4 18367201
  3 LmkKillIssued LmkdKillV1 Primary KernelShapedText Known(Kernel)
  3 ProcessIdentityRecorded LmkdKillV1 ProcessIdentity KernelShapedText Known(Kernel)
  3 LmkKillIssued LmkdKillV1 KillIssued KernelShapedText Known(Kernel)
KernelOomKill 5-7 7 36 3 7/2/0 org.sample.tv memcg 4 18368003
  7 KernelOomKillIssued KernelOomKillV1 Primary KernelShapedText Known(Kernel)
  7 ProcessIdentityRecorded KernelOomKillV1 ProcessIdentity KernelShapedText Known(Kernel)
  7 KernelOomKillIssued KernelOomKillV1 KillIssued KernelShapedText Known(Kernel)
  5 SupportingEvidenceRecorded KernelOomKillV1 Supporting KernelShapedText Known(Kernel)
KernelOomKill 8-8 8 37 4 3/2/0 org.sample.tv global 4 18369001
  8 KernelOomKillIssued KernelOomKillV1 Primary KernelShapedText Known(Kernel)
  8 ProcessIdentityRecorded KernelOomKillV1 ProcessIdentity KernelShapedText Known(Kernel)
  8 KernelOomKillIssued KernelOomKillV1 KillIssued KernelShapedText Known(Kernel)
# java-oom
JavaOom 1-5 1 71 1 5/0/1 org.sample.pics java.lang.OutOfMemoryError 0 18367001
  1 JavaOutOfMemoryError JavaOomV1 Primary AospText Known(Main)
  2 ProcessIdentityRecorded JavaOomV1 ProcessIdentity AospText Known(Main)
  4 ExceptionTypeRecorded JavaOomV1 ExceptionType AospText Known(Main)
  5 StackFrameRecorded JavaOomV1 StackFrame AospText Known(Main)
  3 SupportingEvidenceRecorded JavaOomV1 Supporting AospText Known(Main)
# alike
# interleaved
JavaCrash 1-5 1 11 1 5/0/0 org.sample.a org.sample.a.OneException 2 18367001
  1 JavaUncaughtException JavaUncaughtV1 Primary AospText Unknown
  4 ProcessIdentityRecorded JavaUncaughtV1 ProcessIdentity AospText Unknown
  5 ExceptionTypeRecorded JavaUncaughtV1 ExceptionType AospText Unknown
JavaCrash 2-8 2 12 2 5/0/1 org.sample.b org.sample.b.TwoException 0 18367002
  2 JavaUncaughtException JavaUncaughtV1 Primary AospText Unknown
  3 ProcessIdentityRecorded JavaUncaughtV1 ProcessIdentity AospText Unknown
  7 ExceptionTypeRecorded JavaUncaughtV1 ExceptionType AospText Unknown
  8 StackFrameRecorded JavaUncaughtV1 StackFrame AospText Unknown
# paired
JavaCrash 1-4 4 71 1 15/52/1 org.sample.mail org.sample.mail.SyncException 1 18367001
  1 JavaUncaughtException JavaUncaughtV1 Primary AospText Known(Main)
  2 ProcessIdentityRecorded JavaUncaughtV1 ProcessIdentity AospText Known(Main)
  3 ExceptionTypeRecorded JavaUncaughtV1 ExceptionType AospText Known(Main)
  4 ManagedCrashRecord ManagedAmCrashV1 Primary EventLogShapedText Known(Events)
  4 ProcessIdentityRecorded ManagedAmCrashV1 ProcessIdentity EventLogShapedText Known(Events)
  5 ProcessDeathObserved ProcessDiedV1 Death EventLogShapedText Known(Events)
"""


def parsed(text):
    for n, whole in enumerate(text.strip("\n").split("\n"), 1):
        buffer, raw = whole.split("|", 1)
        m = THREAD.fullmatch(raw)
        date, time, pid, _, level, tag, message = m.groups() if m else ("", "", "", "", "", "", raw)
        known = buffer != "."
        shaped = tag.startswith("am_") and message.startswith("[")
        ts = ms = None
        if date:
            (month, day), (h, mi, s) = map(int, date.split("-")), time.split(":")
            sec, milli = map(int, s.split("."))
            ms = ((int(h) * 60 + int(mi)) * 60 + sec) * 1000 + milli
            ts = (month * 32 + day) * 86_400_000 + ms + 1
        yield Line(n, tag, message, level, pid, len(raw.encode()) + 1, "known" if known else "inferred" if shaped else "unknown", buffer if known else "events" if shaped else None, ts, None if ms is None else 0, ms)


def fold(text):
    f = Fold()
    for x in parsed(text):
        f.observe(x)
    return f.finish()


def told(name):
    out = [f"# {name}"]
    for e in fold(LOGS[name]):
        out.append(f"{R.KINDS[e.kind]} {e.start}-{e.end} {e.anchor} {e.pid} {e.instance} {e.evidence}/{e.outcome}/{e.boundary} {e.process} {e.subject} {e.quality} {e.anchor_ts % 86_400_000}")
        out += [f"  {f.line} {f.code} {f.rule} {f.role} {f.format} {f.provenance}" for f in e.facts]
    return out


@pytest.mark.parametrize("name", LOGS)
def test_events_and_facts(name):
    at = EXPECTED.index(f"# {name}\n")
    end = EXPECTED.find("\n# ", at)
    assert told(name) == EXPECTED[at : end if end > 0 else None].rstrip("\n").split("\n")


def test_batch_gives_the_same(spark):
    from quarrylog.plans.problems import detect

    fields = ("line", "tag", "message", "level", "pid", "raw_len", "provenance", "buffer", "packed_ts", "segment", "ms")
    rows = [(name, *(getattr(x, k) for k in fields)) for name, text in LOGS.items() for x in parsed(text)]
    df = spark.createDataFrame(rows, "source_id string, line_no long, tag string, message string, level string, pid string, raw_len long, provenance string, buffer string, packed_ts long, segment long, in_segment_ms long")
    got = sorted((tuple(r)[:-1], [tuple(f) for f in r.facts]) for r in detect.problems(df.repartition(3)).collect())
    want = sorted((r[:-1], [tuple(f.values()) for f in r[-1]]) for name in LOGS for r in event_rows(name, fold(LOGS[name])))
    assert got == want and len(got) > 15


def long_log(rnd, n):
    """Faults of a few processes with idle stretches between them, as parsed lines."""
    bodies = [[line for line in parsed(text)] for text in LOGS.values()]
    at, ms, out = 0, 0, []
    while at < n:
        for x in rnd.choice(bodies):
            at, ms = at + 1, ms + rnd.choice([0, 1, 50])
            out.append(Line(at, x.tag, x.message, x.level, x.pid, x.raw_len, x.provenance, x.buffer, x.packed_ts, 0, ms))
        at, ms = at + rnd.choice([1, 5, 40, 600, 5000]), ms + rnd.choice([1, 1000, 70_000])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_events_that_settle_are_those_of_a_whole_run(seed):
    rnd = random.Random(seed)
    lines = long_log(rnd, 150_000)
    whole, parts = Fold(), Fold()
    got, most = [], 0
    for k, x in enumerate(lines):
        whole.observe(x)
        parts.observe(x)
        if k % rnd.choice([17, 200]) == 0:
            got += parts.settle()
            most = max(most, len(parts.events) + len(parts.observed) + len(parts.starts))
    early = len(got)
    got += parts.finish()
    want = whole.finish()
    assert event_rows("s", got) == event_rows("s", want) and len(want) > 50
    assert early > len(want) / 2 and most < 2000


@pytest.mark.parametrize("size, warm", [(8192, 2048), (128, 64), (64, 0)])
def test_stretches_of_a_source_give_what_a_whole_run_gives(spark, monkeypatch, size, warm):
    """Reports that reach over the ends of stretches, processes of many stretches, and stretches that don't fit together."""
    from quarrylog.plans.problems import detect, parts

    monkeypatch.setattr(parts, "LINES", size)
    monkeypatch.setattr(parts, "WARM", warm)
    logs = {f"s{seed}": long_log(random.Random(seed), 40_000) for seed in (1, 2)}
    fields = ("line", "tag", "message", "level", "pid", "raw_len", "provenance", "buffer", "packed_ts", "segment", "ms")
    rows = [(name, *(getattr(x, k) for k in fields)) for name, lines in logs.items() for x in lines]
    df = spark.createDataFrame(rows, "source_id string, line_no long, tag string, message string, level string, pid string, raw_len long, provenance string, buffer string, packed_ts long, segment long, in_segment_ms long")
    got = sorted((tuple(r)[:-1], [tuple(f) for f in r.facts]) for r in detect.problems(df).collect())
    want = []
    for name, lines in logs.items():
        f = Fold()
        for x in lines:
            f.observe(x)
        want += [(r[:-1], [tuple(v.values()) for v in r[-1]]) for r in event_rows(name, f.finish())]
    assert got == sorted(want) and len(want) > 100
    # no task reads a whole source, but where stretches don't fit together
    found = detect._steps(df).where(f"what <> {parts.PART}").groupBy("source_id", "part").count().count()
    assert found > 8 if size == 8192 else found >= 2


def test_long_restarts_and_pairs_are_not_gone_through_for_each_other():
    """Ten thousand faults of one process, with records beside them: each looks at its neighbours only."""
    import time

    f, began = Fold(), time.process_time()
    for k in range(10_000):
        at = k * 600
        for j, (tag, m) in enumerate((("AndroidRuntime", "FATAL EXCEPTION: main"), ("AndroidRuntime", "Process: a.b, PID: 7"), ("AndroidRuntime", "a.b.FooException: x"))):
            f.observe(Line(at + j + 1, tag, m, "E", "7", 60, "known", "main"))
        f.observe(Line(at + 9, "am_crash", "[0,7,a.b,0,a.b.FooException,msg,Foo.java,12]", "I", "1", 60, "known", "events"))
    got = f.finish()
    assert len(got) == 10_000 and all(e.end - e.start == 8 for e in got)
    assert time.process_time() - began < 30  # minutes where each is held against all


def test_a_source_takes_lines_in_any_order():
    from quarrylog.streaming.capture import Source

    rnd = random.Random(2)
    lines = list(parsed(LOGS["memory"]))
    want = event_rows("s", fold(LOGS["memory"]))
    for _ in range(20):
        source, order = Source(), [*range(len(lines)), *rnd.sample(range(len(lines)), 3)]
        rnd.shuffle(order)
        source.take(len(lines) + 1, None)
        for k in order:
            assert not source.complete() or source.fold.at == len(lines)
            x = lines[k]
            source.take(x.line, {"line": Line(**{**x.__dict__, "segment": None, "ms": None}), "ms": x.ms, "day": "03-04"})
        assert source.complete() and not source.waiting and event_rows("s", source.fold.finish()) == want


@pytest.mark.parametrize(("text", "plain", "detail"), [
    ("#00 pc 0001 /lib/libx.so (foo+4)", "libx.so#foo", "/lib/libx.so#foo"),
    ("#00 pc 0001 /lib/libx.so (foo+0x1c)", "libx.so#foo", "/lib/libx.so#foo"),
    ("#00 pc 00a1 /lib/libx.so (offset 0x1000) (foo+4) (BuildId: 0F)", "0f+libx.so+a1", "/lib/libx.so#foo"),
    ("#00 pc 00a1 /lib/libx.so (offset 0x1000) (BuildId: 0F)", "0f+libx.so+a1", "0f+/lib/libx.so+a1"),
    ("#00 pc 00a1 /lib/libx.so (??) (BuildId: 0F)", "0f+libx.so+a1", "/lib/libx.so#??"),
    ("#00 pc 00a1 /lib/libx.so (0xdead) (BuildId: 0F)", "0f+libx.so+a1", "/lib/libx.so#0xdead"),
    ("#00 pc 00a1 [anon:x] (foo+4)", None, "[anon:x]#foo"),
    ("#0 pc 00a1 /lib/libx.so (foo+4)", "libx.so#foo", None),
    ("#00 pc 00a1 (foo+4)", None, None),
])
def test_native_frames(text, plain, detail):
    assert R.native_frame(text) == plain
    assert R.native_detail(text) == detail


def test_names_are_cut_at_bytes(spark):
    from quarrylog.plans.problems.groups import cut_bytes

    names = ["a" * 60, "é" * 30, "中" * 20, "🙂" * 13, "short", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "name string").select(cut_bytes("name", 48)).collect()]
    assert got == [None if n is None else n.encode()[:48].decode("utf-8", "ignore") for n in names]


if __name__ == "__main__":
    print("\n".join(line for name in LOGS for line in told(name)))
