from quarrylog.operators.filters import FilterField, FilterSpec, level_mask
from quarrylog.operators.search import SearchSpec
from quarrylog.session import Log
from quarrylog.streaming.tail import TailReader

TEXT = "".join(f"01-01 00:00:{i:02d}.000  7  7 {'E' if i % 4 == 0 else 'I'} Tag{i % 3}: message {i}\n" for i in range(20))


def test_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(TEXT)
    log = Log.open(spark, str(tmp_path / "a.log"), bookmarks=[3, 9]).materialize(str(tmp_path / "rows"))
    assert log.set_filter(FilterSpec(levels=level_mask("E"))) == 1
    assert log.status() == {"total": 20, "filtered": 5, "errors": 5, "bookmarks": 2, "revision": 1}
    assert [r.line_no for r in log.get_rows("filtered", 1, 2, revision=1).orderBy("line_no").collect()] == [5, 9]
    assert log.search(SearchSpec("message 1")) == (11, 2) and log.search_next(SearchSpec("message 1"), 20) == 2
    assert log.map_source_line(7) == (5, 1) and log.line_to_result_index(9) == 2 and log.line_to_result_index(10) is None
    assert log.next_bookmark(1) == (9, 2) and log.toggle_bookmark(9) is False and log.toggle_bookmark(9) is True
    assert log.export("errors", str(tmp_path / "out"))["lines"] == 5
    out = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert out == "".join(x + "\n" for i, x in enumerate(TEXT.splitlines()) if i % 4 == 0)


def test_exports_are_the_bytes_of_the_file(spark, tmp_path):
    head = "01-01 00:00:00.000  7  7 E Tag: "
    for name, charset, body in (("utf8", "UTF-8", b"bad \xff\xfe byte"), ("gbk", "GBK", "中文".encode("gbk")), ("cr", "UTF-8", b"text\r")):
        (tmp_path / name).write_bytes(head.encode() + body + b"\nplain\n")
        log = Log.open(spark, str(tmp_path / name), charset=charset)
        assert log.search(SearchSpec("中文"))[0] == (name == "gbk")
        log.export("errors", str(tmp_path / f"{name}-out"))
        assert b"".join(p.read_bytes() for p in sorted((tmp_path / f"{name}-out").glob("part-*"))) == head.encode() + body + b"\n"


def test_tail(tmp_path):
    path = tmp_path / "grow.log"
    reader = TailReader(str(path))
    at = reader.initialOffset()
    assert list(reader.read(at)[0]) == []
    path.write_bytes(b"one\ntwo\nthr")
    rows, end = reader.read(at)
    assert [r[1:3] for r in rows] == [(1, "one"), (2, "two")] and end["byte"] == 8
    path.write_bytes(b"one\ntwo\nthree\n")
    rows, last = reader.read(end)
    assert [r[1:3] for r in rows] == [(3, "three")] and [r[2] for r in reader.readBetweenOffsets(at, last)] == ["one", "two", "three"]
    path.write_bytes(b"new\n")
    rows, again = reader.read(last)
    assert [r[:3] for r in rows] == [(f"{path}#1", 1, "new")] and again["generation"] == 1


def test_tail_ends_with_its_seal(tmp_path):
    path = tmp_path / "grow.log"
    path.write_bytes(b"one\ntw")
    reader = TailReader(str(path), "main")
    rows, at = reader.read(reader.initialOffset())
    assert [r[1:] for r in rows] == [(1, "one", "main", False)]
    path.write_bytes(b"one\ntwo")
    (tmp_path / "grow.log.sealed").touch()
    rows, end = reader.read(at)
    assert [r[1:] for r in rows] == [(2, "two", "main", False), (3, "", None, True)]
    assert [r[1] for r in reader.readBetweenOffsets(at, end)] == [2, 3]
    assert list(reader.read(end)[0]) == [] and reader.read(end)[1] == end


def test_sealed_tail_gives_events(spark, tmp_path):
    from quarrylog.streaming import capture
    from quarrylog.streaming.tail import TailSource

    path = tmp_path / "a.log"
    path.write_text("01-01 00:00:01.000  7  7 E AndroidRuntime: FATAL EXCEPTION: main\n01-01 00:00:01.001  7  7 E AndroidRuntime: Process: a.b, PID: 7\n01-01 00:00:01.002  7  7 E AndroidRuntime: a.b.FooException: x")
    (tmp_path / "a.log.sealed").touch()
    spark.dataSource.register(TailSource)
    q = capture.problems(spark.readStream.format("tail").option("buffer", "main").load(str(path))).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    (e,) = spark.table("tailed").collect()
    assert (e.start, e.end, e.process, e.facts[0].provenance) == (1, 3, "a.b", "Known(Main)")
