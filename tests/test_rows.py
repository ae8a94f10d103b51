import pytest
from pyspark.sql import functions as F

from quarrylog.functions import parsing, patterns
from quarrylog.operators import filters, search, timeline, views
from quarrylog.operators.filters import FilterField, FilterSpec
from quarrylog.sources import capture, lines

ROWS = [
    ("01-02 03:04:05.006  10  20 E Tag   : hello: x", ("01-02", "03:04:05.006", "E", "10", "20", "Tag", "hello: x")),
    ("01-02 03:04:05.006 10 20 W Tag message here", ("01-02", "03:04:05.006", "W", "10", "20", "Tag", "message here")),
    ("a b 1 2 E x", ("a", "b", "E", "1", "2", "x", "")),
    ("01-02 03:04:05.006 D/My Tag( 12 ):: text\r\n", ("01-02", "03:04:05.006", "D", "12", "", "My Tag", "text")),
    ("--------- beginning of main", ("", "", "", "", "", "", "--------- beginning of main")),
    ("01-02 03:04:05.006 10 2x E Tag: x", ("", "", "", "", "", "", "01-02 03:04:05.006 10 2x E Tag: x")),
    ("01-02 03:04:05.006 10 20 Q Tag: x", ("", "", "", "", "", "", "01-02 03:04:05.006 10 20 Q Tag: x")),
    ("", ("", "", "", "", "", "", "")),
    (None, ("", "", "", "", "", "", "")),
    ("  01-02　03:04:05.006 1 2 I 标签: 　m", ("01-02", "03:04:05.006", "I", "1", "2", "标签", "m")),
]


def test_rows(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(ROWS)], "line_no long, raw string")
    for whole in (False, True):
        got = parsing.parse(df, whole=whole).orderBy("line_no").select(*parsing.FIELDS).collect()
        assert [tuple(r) for r in got] == [w for _, w in ROWS]


def test_numbering_over_splits(spark, tmp_path):
    body = "".join(f"line {i}\r middle\n" for i in range(5000)) + "last"
    (tmp_path / "a.log").write_text(body)
    (tmp_path / "b.log").write_text("one\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = lines.read_lines(spark, str(tmp_path)).orderBy("source_id", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = [r for r in got if r.source_id.endswith("a.log")]
    assert [r.line_no for r in a] == list(range(1, 5002))
    assert a[17].raw == b"line 17\r middle" and a[-1].raw == b"last"
    assert [r.line_no for r in got if r.source_id.endswith("b.log")] == [1]


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray("中文".encode("gbk")),), (bytearray(b"ok\xff"),)], "raw binary")
    assert lines.decode(df.limit(1), lines.charset_for("zh_CN.GBK")).first().text == "中文"
    assert lines.decode(df, "UTF-8").collect()[1].text == "ok�"


def test_strict_time(spark):
    df = spark.createDataFrame([("02-29", "00:00:00.000"), ("02-30", "00:00:00.000"), ("13-01", "00:00:00.000"), ("01-01", "24:00:00.000"), ("1-1", "0:0:0.0"), ("", "")], "date string, time string")
    got = [r[0] for r in df.select(parsing.packed_timestamp(F.col("date"), F.col("time"))).collect()]
    assert got == [((2 * 32 + 29) * 24) * 3_600_000 + 1, None, None, None, None, None]


def test_segments(spark):
    times = [("01-01", "00:00:01.000"), ("01-01", "00:00:02.000"), ("", ""), ("01-01", "00:00:03.000"), ("01-01", "00:00:01.000"), ("02-28", "00:00:00.000"), ("03-01", "00:00:00.000"), ("03-02", "00:00:00.000")]
    df = spark.createDataFrame([(i + 1, d, t) for i, (d, t) in enumerate(times)], "line_no long, date string, time string")
    got = [r.segment for r in timeline.segments(df).orderBy("line_no").collect()]
    assert got == [0, 0, None, 1, 2, 2, 3, 3]


def test_segments_of_a_few_lines(spark, monkeypatch):
    import random

    monkeypatch.setattr(timeline, "CHUNK", 16)
    rnd = random.Random(5)
    days = ["01-01", "02-28", "02-29", "03-01", "12-31", ""]
    rows = [(s, n, rnd.choice(days), f"0{rnd.randint(0, 2)}:00:00.{rnd.randint(0, 999):03d}" if rnd.random() < 0.8 else "x") for s in "ab" for n in rnd.sample(range(1, 300), 150)]
    df = spark.createDataFrame(rows, "source_id string, line_no long, date string, time string")
    whole = {(r.source_id, r.line_no): (r.segment, r.in_segment_ms) for r in timeline.segments(df, "source_id").collect()}
    times = df.withColumn("timeline_ms", parsing.timeline_ms(F.col("date"), F.col("time")))
    few = timeline.segments_of(df.where("line_no % 7 = 0"), times).collect()
    assert len(few) > 30 and all(whole[r.source_id, r.line_no] == (r.segment, r.in_segment_ms) for r in few)


def test_patterns(spark):
    assert patterns.to_java(spark, r"(?P<n>a)") == "(?<n>a)"
    assert patterns.to_java(spark, r"\p{Greek}") == r"\p{IsGreek}"
    for bad in ("(?=a)b", r"(a)\1", "a(", "a++"):
        with pytest.raises(patterns.PatternError):
            patterns.to_java(spark, bad)


def test_filter_spec(spark):
    assert not FilterSpec().is_active()
    assert FilterSpec(word_include=FilterField("|")).is_active()
    assert FilterField(" a | |b ").values() == ["a", "b"]
    spec = FilterSpec(levels=3, pid=FilterField("1", regex=True))
    assert FilterSpec.from_json(spec.to_json()) == spec
    with pytest.raises(patterns.PatternError):
        filters.compile_filter(spark, FilterSpec(word_include=FilterField("conn.*(timeout|reset)", regex=True)))


def test_search_is_literal_and_folds_case(spark):
    df = spark.createDataFrame([(1, "a.b*"), (2, "A.B*"), (3, "axb"), (4, "ÉTÉ")], "line_no long, message string")
    for f in parsing.FIELDS[:-1]:
        df = df.withColumn(f, F.lit(""))
    hits = lambda *a, **k: sorted(r.line_no for r in search.search(df, search.SearchSpec(*a, **k)).collect())
    assert hits("a.b*") == [1, 2] and hits("a.b*", case_sensitive=True) == [1] and hits("été") == [4] and hits("a.b", regex=True) == [1, 2, 3] and hits("") == []


def test_nearest_ties_and_edges(spark):
    result = spark.createDataFrame([(10,), (20,), (700_000,)], "line_no long")
    asked = spark.createDataFrame([(0,), (1,), (10,), (15,), (16,), (360_000,), (350_010,), (350_011,), (900_000,)], "line_no long")
    got = {r.line_no: (r.target_line, r.result_index) for r in views.nearest(result, asked, 800_000).collect()}
    assert got == {1: (10, 0), 10: (10, 0), 15: (10, 0), 16: (20, 1), 360_000: (700_000, 2), 350_010: (20, 1), 350_011: (700_000, 2), 900_000: (700_000, 2)}


def test_nearest_is_linear(spark):
    """No frame without an upper end, which Spark goes through anew for each row; many rows of one chunk against a search."""
    import bisect

    result, asked = spark.range(3, 90_000, 3).toDF("line_no"), spark.range(1, 120_000, 7).toDF("line_no")
    found = views.nearest(result, asked, 100_000)
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    lines = list(range(3, 90_000, 3))

    def want(q):
        at = min(q, 100_000)
        k = bisect.bisect_left(lines, at)
        return min(((abs(lines[i] - at), lines[i], i) for i in (k - 1, k) if 0 <= i < len(lines)))[1:]

    assert {r.line_no: (r.target_line, r.result_index) for r in found.collect()} == {q: want(q) for q in range(1, 120_000, 7)}


def test_capture():
    assert capture.CaptureSpec.parse("logcat -v threadtime").buffers == ("main", "system", "crash")
    assert capture.CaptureSpec.parse("logcat -b main -v threadtime -b main").normalized() == "logcat -v threadtime -b main"
    for bad in ("logcat", "logcat -v brief", "logcat -v threadtime -b kernel", "logcat -v threadtime | x", "adb logcat", "logcat -v threadtime -d"):
        with pytest.raises(capture.CaptureError):
            capture.CaptureSpec.parse(bad)
    assert capture.transition(capture.State.GROWING, "pause") is capture.State.PAUSED
    with pytest.raises(capture.CaptureError):
        capture.transition(capture.State.SEALED, "resume")
    assert capture.retained([f"logcat-{i}.log" for i in range(12)] + ["other"]) == ["logcat-0.log", "logcat-1.log"]


def test_devices(spark):
    df = spark.createDataFrame([("List of devices attached",), ("",), ("abc device product:p model:M transport_id:3",), ("def offline",)], "value string")
    got = [tuple(r) for r in capture.devices(df).collect()]
    assert got == [("abc", "device", "M", "p", "3", True), ("def", "offline", None, None, None, False)]
    assert capture.select_device(capture.devices(df)) == "abc"


def test_highlight():
    from quarrylog.functions.highlight import Rule, tokens

    cut = lambda *a, **k: [(t["text"], t["kind"], t["color"]) for t in tokens(*a, **k)]
    assert cut("abcdef", [Rule("bcd", color="red"), Rule("de", color="blue")], Rule("C")) == [("a", "text", None), ("b", "highlight", "red"), ("c", "search", None), ("d", "highlight", "red"), ("e", "highlight", "blue"), ("f", "text", None)]
    assert cut("a(b", [Rule("(", regex=True)]) == [("a(b", "text", None)] and cut("", []) == [("", "text", None)]


def test_settings():
    from quarrylog.sources import settings

    s = settings.Settings(font_size=99, width=1, command="rm -rf", recent_files=("a", "", "a", *map(str, range(20))), last_filter=FilterSpec(levels=3, pid=FilterField("7", regex=True)))
    n = s.normalized()
    assert (n.font_size, n.width, n.command, len(n.recent_files)) == (20, 960, settings.DEFAULT_COMMAND, 10)
    assert settings.loads(settings.dumps(n)) == n
    assert settings.load_bookmarks(settings.bookmarks_toml([5, 0, 3, 5])) == [3, 5]
