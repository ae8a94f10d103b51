from pyspark.sql import functions as F

from quarrylog.functions.blake3 import derive
from quarrylog.plans.problems import rules as R
from quarrylog.plans.problems.fold import Fold, Line


def fold(texts, buffer=None):
    """texts: (tag, message, level, pid); all lines of one buffer, if it is named."""
    f = Fold()
    for i, (tag, message, level, pid) in enumerate(texts):
        f.observe(Line(i + 1, tag, message, level, pid, len(message) + 40, "known" if buffer else "unknown", buffer))
    return f.finish()


CRASH = [("AndroidRuntime", "FATAL EXCEPTION: main", "E", "7"), ("AndroidRuntime", "Process: a.b, PID: 7", "E", "7"), ("AndroidRuntime", "a.b.FooException: x", "E", "7"), ("AndroidRuntime", "\tat a.b.C$1.d(C.java:3)", "E", "7")]


def test_derive_key_is_stable_and_long_inputs_work():
    assert len(derive("x", b"")) == 32 and derive("x", b"a" * 5000) != derive("x", b"a" * 5001)


def test_java_crash():
    (e,) = fold(CRASH)
    assert (e.kind, e.process, e.pid, e.start, e.end, e.quality, e.subject) == (R.JAVA_CRASH, "a.b", 7, 1, 4, R.FULL_STACK, "a.b.FooException")
    assert e.tokens == [(R.EXCEPTION_TYPE, "a.b.FooException"), (R.FRAME, "a.b.C$*#d")]


def test_cause_replaces_and_oom_is_told():
    (e,) = fold([*CRASH, ("AndroidRuntime", "Caused by: java.lang.OutOfMemoryError: y", "E", "7"), ("AndroidRuntime", "at q.R.s(R.java)", "E", "7"), ("AndroidRuntime", "Suppressed: z.OtherException", "E", "7")])
    assert e.kind == R.JAVA_OOM and e.tokens == [(R.EXCEPTION_TYPE, "java.lang.OutOfMemoryError"), (R.FRAME, "q.R#s")]


def test_mismatching_pid_or_missing_type_is_no_crash():
    assert fold([CRASH[0], ("AndroidRuntime", "Process: a.b, PID: 8", "E", "7"), *CRASH[2:]]) == []
    assert fold(CRASH[:2]) == []
    assert fold([("Other", m, lv, p) for _, m, lv, p in CRASH]) == []


def test_raw_continuation_needs_one_candidate():
    two = [CRASH[0], ("AndroidRuntime", "FATAL EXCEPTION: w", "E", "9"), CRASH[1], ("AndroidRuntime", "Process: c.d, PID: 9", "E", "9")]
    assert fold([*two, ("", "a.b.FooException: x", "", "")]) == []
    assert len(fold([CRASH[0], CRASH[1], ("", "a.b.FooException: x", "", "")])) == 1


def test_anr():
    (e,) = fold([("ActivityManager", "ANR in a.b (a.b/.Main)", "E", "1"), ("ActivityManager", "PID: 77", "E", "1"), ("ActivityManager", "Reason: Input dispatching timed out (x)", "E", "1")])
    assert (e.kind, e.pid, e.process, e.subject) == (R.ANR, 77, "a.b", "input-dispatch-timeout")
    assert fold([("ActivityManager", "ANR in a.b", "E", "1"), ("ActivityManager", "PID: 7", "E", "1"), ("ActivityManager", "PID: 8", "E", "1")]) == []


def test_records_commit_only_where_the_buffer_is_known():
    text = ("am_crash", "[0,7,a.b,0,a.b.FooException,msg,Foo.java,12]", "I", "1")
    assert fold([text]) == []
    (e,) = fold([text], "events")
    assert (e.kind, e.quality, e.anchor_ts) == (R.JAVA_CRASH, R.TYPE_FILE, 0)


def test_native():
    star = " ".join(["***"] * 16)
    lines = [star, "pid: 5, tid: 6, name: x  >>> com.a <<<", "signal 11 (SIGSEGV), code 1 (SEGV_MAPERR), fault addr 0x10", "backtrace:", "#00 pc 0001 /lib/libx.so (foo+4)", "other"]
    (e,) = fold([("DEBUG", m, "F", "9") for m in lines])
    assert (e.kind, e.pid, e.process, e.anchor, e.tokens[-1]) == (R.NATIVE_CRASH, 5, "com.a", 3, (R.FRAME, "/lib/libx.so#foo"))
    assert fold([("DEBUG", m, "F", "9") for m in [*lines[:2], "signal 11 (SIGBUS), code 1 (SEGV_MAPERR)", *lines[3:]]]) == []
    assert len(fold([("libc", "Fatal signal 6 (SIGABRT), code -6 (SI_TKILL) in tid 5 (main), pid 5 (com.a)", "F", "5")])) == 1
    assert fold([("libc", "Fatal signal 6 (SIGABRT), code -6 (SI_TKILL) in tid 5 (main), pid 6 (com.a)", "F", "5")]) == []


def test_kills():
    (e,) = fold([("lmkd", "Kill 'a.b' (7), uid 10001, oom_score_adj 900 to free 1kB rss; reason: psi is high", "I", "1")])
    assert (e.kind, e.subject, e.outcome) == (R.LMK_KILL, "memory-pressure", R.KILL_ISSUED)
    assert fold([("lmkd", "Kill 'a.b' (7), uid 1, oom_score_adj 900 to free 1kB rss; reason: lowered", "I", "1")]) == []
    text = [("kernel", "a invoked oom-killer: gfp", "W", "0"), ("kernel", "oom-kill:constraint=CONSTRAINT_MEMCG,x", "W", "0"), ("kernel", "Killed process 9 (a.b) total", "W", "0")]
    assert fold(text) == []
    (e,) = fold(text, "kernel")
    assert (e.kind, e.start, e.end, e.subject) == (R.KERNEL_OOM_KILL, 1, 3, "memcg")


def test_restart_signal_exit_and_attachment():
    am = "ActivityManager"
    start = lambda pid: (am, f"Start proc {pid}:a.b/u0a5 for activity", "I", "1")
    got = fold([start(7), ("lmkd", "Kill 'a.b' (7), uid 10005, oom_score_adj 900 to free 1kB; reason: thrashing", "I", "2"), (am, "Process a.b (pid 7) has died: x", "I", "1"), start(8), ("Zygote", "Process 8 exited due to signal 9 (Killed)", "I", "3")])
    assert [e.kind for e in got] == [R.LMK_KILL, R.PROCESS_RESTART, R.SIGNAL_EXIT]
    assert got[0].outcome == R.KILL_ISSUED | R.DEATH_OBSERVED


def test_two_accounts_become_one():
    f = Fold()
    for i, (tag, m, lv, p) in enumerate(CRASH):
        f.observe(Line(i + 1, tag, m, lv, p, 60, "known", "main"))
    f.observe(Line(6, "am_crash", "[0,7,a.b,0,a.b.FooException,msg,Foo.java,12]", "I", "1", 60, "known", "events"))
    (e,) = f.finish()
    assert e.evidence & R.CORRELATED and (e.start, e.end, e.quality) == (1, 6, R.FULL_STACK)


def test_sparse_equals_dense(spark):
    """The selected lines give the events that all lines give."""
    import random

    from quarrylog.functions.parsing import parse
    from quarrylog.operators.timeline import segments
    from quarrylog.plans.problems import detect
    from pyspark.sql import functions as F

    rnd, raw = random.Random(4), []
    star = " ".join(["***"] * 16)
    blocks = [[f"E AndroidRuntime: {m}" for _, m, _, _ in CRASH], ["E ActivityManager: ANR in a.b", "E ActivityManager: PID: 7", "E ActivityManager: Reason: ContentProvider not responding"], [f"F DEBUG   : {star}", "F DEBUG   : pid: 5, tid: 6 >>> a.b <<<", "F DEBUG   : signal 11 (SIGSEGV), code 1 (SEGV_MAPERR), fault addr 0x10", "F DEBUG   : backtrace:", "F DEBUG   : #00 pc 0001 /lib/libx.so (foo+4)"], ["I lmkd: Kill 'a.b' (7), uid 10005, oom_score_adj 900 to free 1kB; reason: thrashing"], ["I ActivityManager: Start proc 7:a.b/u0a5 for x"], ["I ActivityManager: Process a.b (pid 7) has died"]]
    for i in range(60):
        for k in range(rnd.choice([0, 1, 3, 30, 600])):
            raw.append(f"01-01 00:00:{i:02d}.000  9  9 D Ui: idle {k}")
        raw += [f"01-01 00:00:{i:02d}.000  7  7 {x}" for x in rnd.choice(blocks)]
    df = spark.createDataFrame([("s", n + 1, r) for n, r in enumerate(raw)], "source_id string, line_no long, raw string")
    rows = parse(df, whole=True).withColumns({"raw_len": F.lit(60).cast("long"), "provenance": F.lit("unknown"), "buffer": F.lit(None).cast("string")})
    rows = segments(rows, "source_id").persist()
    sparse = [(r.kind, r.start, r.end, r.process, r.outcome) for r in detect.problems(rows).collect()]
    f = Fold()
    for r in rows.orderBy("line_no").toLocalIterator():
        f.observe(detect._line(r.asDict()))
    dense = [(e.kind, e.start, e.end, e.process, e.outcome) for e in f.finish()]
    assert sorted(sparse) == sorted(dense) and len(dense) > 20


def test_stream_equals_batch(spark, tmp_path):
    from quarrylog.streaming import capture

    out = {}
    raw = [f"01-01 00:00:01.000  7  7 E AndroidRuntime: {m}" for _, m, _, _ in CRASH] + ["plain"] * 5 + ["01-01 00:00:02.000  1  1 I lmkd: Kill 'a.b' (7), uid 10005, oom_score_adj 900 to free 1kB; reason: thrashing"]
    import json

    for size in (1, 3, 100):
        src, name = tmp_path / f"in{size}", f"events_{size}"
        src.mkdir()
        for k in range(0, len(raw), size):
            rows = [{"source_id": "s", "line_no": k + j + 1, "raw": r, "sealed": False} for j, r in enumerate(raw[k : k + size])]
            if k + size >= len(raw):
                rows.append({"source_id": "s", "line_no": len(raw) + 1, "raw": "", "sealed": True})
            (src / f"{k:04d}.json").write_text("\n".join(map(json.dumps, rows)))
        q = capture.problems(capture.lines(spark, str(src))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp{size}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        out[size] = [(r.kind, r.start, r.end, r.fingerprint) for r in spark.table(name).collect()]
    assert out[1] == out[3] == out[100] and len(out[1]) == 2


def test_snapshots_are_few_and_cursors_serve_once(spark):
    import pytest

    from quarrylog.plans.problems import groups

    now = [0.0]
    store = groups.Snapshots(most=2, idle_seconds=10, clock=lambda: now[0])
    found = spark.range(5).select(F.col("id").alias("last_line"), F.col("id").cast("string").alias("fingerprint"), F.lit(0).alias("kind"))
    a, first = store.open(found, limit=3)
    rows, then = store.next(first)
    assert [r.last_line for r in rows.orderBy("rank").collect()] == [4, 3, 2]
    with pytest.raises(KeyError):
        store.next(first)
    rows, end = store.next(then)
    assert [r.last_line for r in rows.orderBy("rank").collect()] == [1, 0] and end is None
    now[0] = 1
    b, _ = store.open(found)
    now[0] = 2
    c, at_c = store.open(found)  # the one unused longest makes room
    assert len(store) == 2 and not store.release(a) and store.release(b)
    now[0] = 12
    assert len(store) == 0 and not store.release(c)
    with pytest.raises(KeyError):
        store.next(at_c)


def test_inferred_records_support_and_coverage_limits(spark):
    from quarrylog.sources.lines import Coverage, with_provenance

    rows = spark.createDataFrame([(1, "am_kill", "[0,7,a.b,0,x]"), (2, "Tag", "[1]"), (3, "am_anr", "[1]"), (4, "kernel", "k"), (600_000, "Tag", "x")], "line_no long, tag string, message string")
    spans = spark.createDataFrame([(3, 3, "events"), (4, 4, "kernel"), (5, 700_000, "main")], "start_line long, end_line long, buffer string")
    told = lambda c: [(r.provenance, r.buffer) for r in with_provenance(rows, spans, c).orderBy("line_no").collect()]
    assert told(Coverage.static()) == [("inferred", "events"), ("unknown", None), ("known", "events"), ("known", "kernel"), ("known", "main")]
    assert told(Coverage.live(["main"])) == [("unknown", None), ("unknown", None), ("unknown", None), ("unknown", None), ("known", "main")]
    crash = [Line(i + 1, t, m, lv, p, 60, "known", "main") for i, (t, m, lv, p) in enumerate(CRASH)]
    for provenance, outcome in (("inferred", R.DEATH_OBSERVED), ("unknown", 0)):
        f = Fold()
        for x in [*crash, Line(5, "am_proc_died", "[0,7,a.b]", "I", "1", 60, provenance, "events" if provenance == "inferred" else None)]:
            f.observe(x)
        assert [e.outcome for e in f.finish()] == [outcome]


def test_streamed_filter_and_search(spark, tmp_path):
    import json

    from quarrylog.operators import filters, search
    from quarrylog.functions.parsing import parse
    from quarrylog.streaming import capture

    src = tmp_path / "in"
    src.mkdir()
    raw = [f"01-01 00:00:{i:02d}.000  7  7 {'E' if i % 4 == 0 else 'I'} Tag{i % 3}: message {i}" for i in range(30)]
    for k in range(0, 30, 7):
        (src / f"{k:02d}.json").write_text("\n".join(json.dumps({"source_id": "s", "line_no": k + j + 1, "raw": r, "sealed": False}) for j, r in enumerate(raw[k : k + 7])))
    stream = capture.lines(spark, str(src))
    for name, made in (("f", capture.filtered(stream, filters.FilterSpec(levels=filters.level_mask("E")))), ("q", search.search(parse(stream), search.SearchSpec("TAG2")))):
        q = made.writeStream.format("memory").queryName(f"stream_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r.line_no for r in spark.table("stream_f").collect()) == [i + 1 for i in range(0, 30, 4)]
    assert sorted(r.line_no for r in spark.table("stream_q").collect()) == [i + 1 for i in range(2, 30, 3)]
