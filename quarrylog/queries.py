"""Registered queries over the test tables, each through rendered text, and DuckDB SQL straight from the columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions import highlight, normalizers, parsing
from quarrylog.operators import filters, search, sinks, timeline, views
from quarrylog.operators.filters import FilterField, FilterSpec
from quarrylog.plans.problems import detect, gate, groups
from quarrylog.sources import lines as source
from quarrylog.sources import rendering
from quarrylog.sources.capture import resume_timestamp

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_L = """
L AS (SELECT event_id + 1 AS line_no, strftime(ts, '%m-%d') AS date, strftime(ts, '%H:%M:%S.%g') AS time,
  CASE event_type WHEN 'click' THEN 'I' WHEN 'view' THEN 'D' WHEN 'signup' THEN 'W' WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'F' END AS level,
  CAST(user_id + 1000 AS VARCHAR) AS pid, CAST(user_id + 2000 AS VARCHAR) AS tid,
  upper(event_type[1]) || event_type[2:] || 'Service' AS tag, props AS message, event_id, user_id, event_type, ts FROM events),
R AS (SELECT *, date || ' ' || time || '  ' || pid || '  ' || tid || ' ' || level || ' ' || tag || ': ' || message AS raw FROM L),
B AS (SELECT line_no FROM L WHERE event_id % 97 = 0)
"""
_ROW = "line_no, date, time, level, pid, tid, tag, message"


def _rows(spark: SparkSession, sf_dir: str, style: str = "threadtime") -> DataFrame:
    return parsing.parse(rendering.events_as_lines(spark.read.parquet(f"{sf_dir}/events.parquet"), style))


def _bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 97 = 0").select((F.col("event_id") + 1).alias("line_no"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {_L.strip()} {sql}" if not sql.lstrip().startswith("WITH") else sql
        return f

    return add


def _fields(df: DataFrame) -> DataFrame:
    return df.select("line_no", *parsing.FIELDS)


# --------------------------------------------------------------------------- rows


@query(f"SELECT {_ROW} FROM R")
def parse_threadtime(spark, sf_dir):
    return _fields(_rows(spark, sf_dir))


@query("SELECT line_no, date, time, level, pid, '' AS tid, tag, message FROM R")
def parse_time(spark, sf_dir):
    return _fields(_rows(spark, sf_dir, "time"))


@query(r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM documents),
x AS (SELECT doc_id AS source_id, generate_subscripts(xs, 1) AS line_no, unnest(xs) AS raw FROM d)
SELECT CAST(source_id AS BIGINT) AS source_id, CAST(line_no AS BIGINT) AS line_no, level, message FROM (SELECT source_id, line_no, '' AS level, rtrim(raw, chr(13) || chr(10)) AS message FROM x)""")
def parse_raw_fallback(spark, sf_dir):
    lines = rendering.documents_as_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return parsing.parse(lines).select("source_id", "line_no", "level", "message")


@query("SELECT CASE line_no % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'threadtime' ELSE 'time' END AS format, count(*) AS n FROM R GROUP BY 1")
def parse_mixed_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = rendering.events_as_lines(events).where("line_no % 3 = 1")
    b = rendering.events_as_lines(events, "time").where("line_no % 3 = 2")
    c = rendering.events_as_lines(events).where("line_no % 3 = 0").select("line_no", F.concat(F.lit("--- "), "raw").alias("raw"))
    return parsing.formats(a.unionByName(b).unionByName(c)).groupBy("format").agg(F.count("*").alias("n"))


@query("""SELECT line_no, CAST(((((month(ts) * 32 + day(ts)) * 24 + hour(ts)) * 60 + minute(ts)) * 60 + second(ts)) * 1000 + (millisecond(ts) % 1000) + 1 AS BIGINT) AS packed_ts FROM L""")
def strict_timestamp(spark, sf_dir):
    return _rows(spark, sf_dir).select("line_no", parsing.packed_timestamp(F.col("date"), F.col("time")).alias("packed_ts"))


# --------------------------------------------------------------------------- filters


def _filter(name: str, spec: FilterSpec, where: str, marked: bool = False):
    def run(spark, sf_dir):
        return _fields(filters.apply_filter(_rows(spark, sf_dir), spec, _bookmarks(spark, sf_dir) if marked else None))

    run.__name__ = name
    query(f"SELECT {_ROW} FROM R WHERE {where}")(run)


_filter("filter_level", FilterSpec(levels=filters.level_mask("EF")), "level IN ('E', 'F')")
_filter("filter_level_empty", FilterSpec(levels=0), "false")
_filter("filter_pid", FilterSpec(pid=FilterField("1007 | 1011|")), "pid IN ('1007', '1011')")
_filter("filter_tid", FilterSpec(tid=FilterField("2042")), "tid = '2042'")
_filter("filter_pid_regex", FilterSpec(pid=FilterField("^10[0-2]|9$", regex=True)), "regexp_matches(pid, '^10[0-2]') OR regexp_matches(pid, '9$')")
_filter("filter_tag_include", FilterSpec(tag_include=FilterField("Error|Sign")), "contains(tag, 'Error') OR contains(tag, 'Sign')")
_filter("filter_tag_exclude", FilterSpec(tag_exclude=FilterField("Click|View")), "NOT (contains(tag, 'Click') OR contains(tag, 'View'))")
_filter("filter_word_include", FilterSpec(word_include=FilterField("7")), "contains(message, '7')")
_filter("filter_word_exclude", FilterSpec(word_exclude=FilterField("1|2")), "NOT (contains(message, '1') OR contains(message, '2'))")
_filter("filter_word_regex", FilterSpec(word_include=FilterField(r"[0-9]{2}.*3|[^0-9]5[^0-9]", regex=True)), "regexp_matches(message, '[0-9]{2}.*3') OR regexp_matches(message, '[^0-9]5[^0-9]')")
_filter("filter_bar_only", FilterSpec(word_include=FilterField("|")), "true")
_filter("filter_marked", FilterSpec(marked_only=True), "line_no IN (FROM B)", marked=True)
_filter("filter_combined", FilterSpec(levels=filters.level_mask("WEF"), pid=FilterField("^10", regex=True), tag_exclude=FilterField("Purchase"), word_include=FilterField("1|3")), "level IN ('W', 'E', 'F') AND regexp_matches(pid, '^10') AND NOT contains(tag, 'Purchase') AND (contains(message, '1') OR contains(message, '3'))")


@query("""WITH x AS (SELECT doc_id AS source_id, unnest(string_split(text, chr(10))) AS raw FROM documents)
SELECT source_id, count(*) AS n FROM x WHERE contains(raw, 'icense') GROUP BY 1""")
def filter_level_raw_kept(spark, sf_dir):
    rows = parsing.parse(rendering.documents_as_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return filters.apply_filter(rows, FilterSpec(word_include=FilterField("icense"))).groupBy("source_id").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- search


_HIT = {
    "search_plain": (search.SearchSpec("Error", case_sensitive=True), "contains(tag, 'Error') OR contains(message, 'Error')"),
    "search_case_insensitive": (search.SearchSpec("eRRorsERV"), "contains(lower(tag), 'errorserv')"),
    "search_regex": (search.SearchSpec(r"^10[0-4][0-9]$|service$", regex=True), "regexp_matches(pid, '^10[0-4][0-9]$') OR regexp_matches(lower(tag), 'service$')"),
    "search_empty": (search.SearchSpec(""), "false"),
}


def _search(name, spec, where):
    def run(spark, sf_dir):
        return _fields(search.search(_rows(spark, sf_dir), spec))

    run.__name__ = name
    query(f"SELECT {_ROW} FROM R WHERE {where}")(run)


for _name, (_spec, _where) in _HIT.items():
    _search(_name, _spec, _where)


@query("SELECT count(*) AS matches, min(line_no) AS first_line FROM R WHERE contains(lower(tag), 'purchase')")
def search_summary(spark, sf_dir):
    return search.summary(search.search(_rows(spark, sf_dir), search.SearchSpec("PURCHASE")))


def _navigate(name, spec, where, from_line, forward):
    def run(spark, sf_dir):
        return search.navigate(search.search(_rows(spark, sf_dir), spec), from_line, forward)

    run.__name__ = name
    target = f"coalesce(min(line_no) FILTER (line_no > {from_line}), min(line_no))" if forward else f"coalesce(max(line_no) FILTER (line_no < {from_line}), max(line_no))"
    query(f"SELECT {target} AS line_no FROM R WHERE {where}")(run)


_PURCHASE = (search.SearchSpec("PurchaseService", case_sensitive=True), "tag = 'PurchaseService'")
_navigate("search_next", *_PURCHASE, 500, True)
_navigate("search_next_wrap", *_PURCHASE, 10_000_000, True)
_navigate("search_prev", *_PURCHASE, 500, False)
_navigate("search_prev_wrap", *_PURCHASE, 1, False)


# --------------------------------------------------------------------------- views

_ERRORS = FilterSpec(levels=filters.level_mask("EF"))
_TAGS = FilterSpec(tag_include=FilterField("Error|Click"))
_TAGS_SQL = "tag IN ('ErrorService', 'ClickService')"


@query(f"SELECT {_ROW} FROM R WHERE line_no BETWEEN 101 AND 300")
def view_all_window(spark, sf_dir):
    return _fields(views.window(_rows(spark, sf_dir), 100, 200, dense=True))


@query(f"SELECT {_ROW} FROM (SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS pos FROM R WHERE {_TAGS_SQL}) WHERE pos >= 50 AND pos < 250")
def view_filtered_window(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return _fields(views.window(views.view(rows, "filtered", filtered=filters.apply_filter(rows, _TAGS)), 50, 200))


@query(f"SELECT {_ROW} FROM (SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS pos FROM R WHERE level IN ('E', 'F')) WHERE pos >= 10 AND pos < 522")
def view_errors_window(spark, sf_dir):
    return _fields(views.window(views.view(_rows(spark, sf_dir), "errors"), 10, 600))


@query(f"SELECT {_ROW} FROM (SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS pos FROM R WHERE line_no IN (FROM B)) WHERE pos < 20")
def view_bookmarks_window(spark, sf_dir):
    return _fields(views.window(views.view(_rows(spark, sf_dir), "bookmarks", bookmarks=_bookmarks(spark, sf_dir)), 0, 20))


@query(f"SELECT count(*) AS total, count(*) FILTER ({_TAGS_SQL}) AS filtered, count(*) FILTER (level IN ('E', 'F')) AS errors, count(*) FILTER (line_no IN (FROM B)) AS bookmarks FROM R")
def view_counts(spark, sf_dir):
    return views.counts(_rows(spark, sf_dir), filters.compile_filter(spark, _TAGS), _bookmarks(spark, sf_dir))


@query(f"SELECT b.line_no, pos AS result_index FROM B b LEFT JOIN (SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS pos FROM R WHERE {_TAGS_SQL}) f USING (line_no)")
def map_exact(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return views.exact(filters.apply_filter(rows, _TAGS), _bookmarks(spark, sf_dir))


@query(f"""SELECT line_no, t.line_no2 AS target_line, t.pos AS result_index FROM B, LATERAL (SELECT f.line_no AS line_no2, f.pos FROM (SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS pos FROM R WHERE {_TAGS_SQL}) f ORDER BY abs(f.line_no - B.line_no), f.line_no LIMIT 1) t""")
def map_nearest(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    total = rows.agg(F.max("line_no")).first()[0] or 0
    return views.nearest(filters.apply_filter(rows, _TAGS), _bookmarks(spark, sf_dir), total)


@query("SELECT coalesce(min(line_no) FILTER (line_no > 500), min(line_no)) AS line_no FROM B")
def bookmark_next(spark, sf_dir):
    return search.navigate(_bookmarks(spark, sf_dir), 500)


_MARKS = f"""SELECT coalesce(min((pos, line_no)) FILTER (pos > here), min((pos, line_no))) AS t FROM (SELECT line_no, pos, coalesce((SELECT max(pos) FROM F WHERE line_no = 389), 0) AS here FROM F WHERE line_no IN (FROM B))"""


@query(f"WITH {_L.strip()}, F AS (SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS pos FROM R WHERE {_TAGS_SQL}) SELECT t[2] AS line_no, t[1] AS result_index FROM ({_MARKS})")
def bookmark_next_in_result(spark, sf_dir):
    return views.bookmark_in_result(filters.apply_filter(_rows(spark, sf_dir), _TAGS), _bookmarks(spark, sf_dir), 389)


def _minimap_sql(where: str, buckets: int) -> str:
    return f"""SELECT CAST(pos * least({buckets}, total) // total AS INTEGER) AS bucket, count(*) FILTER (level IN ('E', 'F')) AS errors, CAST(max(CASE WHEN line_no IN (FROM B) THEN 1 ELSE 0 END) AS INTEGER) AS marked
FROM (SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS pos, count(*) OVER () AS total FROM R WHERE {where}) GROUP BY 1 HAVING errors > 0 OR marked > 0"""


@query(_minimap_sql("true", 240))
def minimap_all(spark, sf_dir):
    return views.minimap(_rows(spark, sf_dir), _bookmarks(spark, sf_dir), 240)


@query(_minimap_sql(_TAGS_SQL, 240))
def minimap_filtered(spark, sf_dir):
    return views.minimap(filters.apply_filter(_rows(spark, sf_dir), _TAGS), _bookmarks(spark, sf_dir), 240)


@query(f"""WITH {_L.strip()}, M AS (SELECT bucket, errors FROM ({_minimap_sql("true", 5000)}) WHERE errors > 0), I AS (SELECT *, bucket - row_number() OVER (ORDER BY bucket) AS island, max(errors) OVER () AS top FROM M)
SELECT min(bucket) AS start, max(bucket) AS "end", CAST(sum(errors) AS BIGINT) AS errors, round(least(1.0, 0.16 + 0.84 * least(1.0, 6 * max(CAST(errors AS DOUBLE) / top))), 9) AS opacity FROM I GROUP BY island""")
def minimap_ranges(spark, sf_dir):
    return views.minimap_ranges(views.minimap(_rows(spark, sf_dir), _bookmarks(spark, sf_dir), 5000)).withColumn("opacity", F.round("opacity", 9))


# --------------------------------------------------------------------------- sinks


@query("SELECT line_no, raw FROM R WHERE level IN ('E', 'F')")
def export_filtered(spark, sf_dir):
    return filters.apply_filter(_rows(spark, sf_dir), _ERRORS).select("line_no", "raw")


@query("SELECT line_no, raw FROM R WHERE line_no BETWEEN 7 AND 77")
def export_range(spark, sf_dir):
    return sinks.export_range(_rows(spark, sf_dir), 7, 77)


@query("SELECT count(*) AS lines, CAST(sum(strlen(raw) + 1) AS BIGINT) AS bytes FROM R WHERE level IN ('E', 'F')")
def export_summary(spark, sf_dir):
    return sinks.summary(filters.apply_filter(_rows(spark, sf_dir), _ERRORS))


@query("SELECT part, count(*) AS n, min(line_no) AS first_line FROM (SELECT line_no, (line_no - 1) // 300 + 1 AS part FROM R) GROUP BY 1")
def split_lines(spark, sf_dir):
    return sinks.split_by_lines(_rows(spark, sf_dir), 300).groupBy("part").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@query()
def split_bytes(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("source_id", F.lit("events"))
    return sinks.split_by_bytes(rows, 10_000).groupBy("part").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


# --------------------------------------------------------------------------- provenance, time


@query("SELECT line_no, CASE WHEN line_no BETWEEN 1 AND 100 THEN 'main' WHEN line_no BETWEEN 201 AND 350 THEN 'events' END AS buffer, CASE WHEN line_no BETWEEN 1 AND 100 OR line_no BETWEEN 201 AND 350 THEN 'known' ELSE 'unknown' END AS provenance FROM R")
def spans_provenance(spark, sf_dir):
    spans = spark.createDataFrame(source.check_spans([(201, 350, "events"), (1, 100, "main")]), "start_line long, end_line long, buffer string")
    return source.with_provenance(_rows(spark, sf_dir), F.broadcast(spans)).select("line_no", "buffer", "provenance")


@query("SELECT arg_max(date || ' ' || time, line_no) AS resume_from FROM R")
def resume_point(spark, sf_dir):
    return resume_timestamp(_rows(spark, sf_dir))


@query("""SELECT line_no, CAST(sum(new) OVER (ORDER BY line_no) - 1 AS BIGINT) AS segment FROM (SELECT line_no, CASE WHEN lag(ms) OVER w IS NULL OR ms < lag(ms) OVER w THEN 1 ELSE 0 END AS new FROM (SELECT line_no, CASE WHEN event_id % 50 = 0 THEN 0 ELSE epoch_ms(ts) END AS ms FROM L) WINDOW w AS (ORDER BY line_no))""")
def time_segments(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    back = (F.col("line_no") - 1) % 50 == 0
    rows = rows.withColumns({"date": F.when(back, "01-01").otherwise(F.col("date")), "time": F.when(back, "00:00:00.000").otherwise(F.col("time"))})
    return timeline.segments(rows).select("line_no", "segment")


_TIMES = """WITH t AS (SELECT event_id + 1 AS line_no, CASE WHEN event_id % 50 = 0 THEN 0 ELSE (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 END AS ms FROM events),
s AS (SELECT *, sum(new) OVER (ORDER BY line_no) - 1 AS segment FROM (SELECT *, CASE WHEN lag(ms) OVER w IS NULL OR ms < lag(ms) OVER w THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (ORDER BY line_no)))
SELECT line_no, CAST(segment AS BIGINT) AS segment, ms - first_value(ms) OVER (PARTITION BY segment ORDER BY line_no) AS in_segment_ms FROM s"""


@query(_TIMES)
def time_deltas(spark, sf_dir):
    """Segments, and the time of each line since its segment began; every 50th line's clock is set back."""
    rows = _rows(spark, sf_dir)
    back = (F.col("line_no") - 1) % 50 == 0
    rows = rows.withColumns({"date": F.when(back, "01-01").otherwise(F.col("date")), "time": F.when(back, "00:00:00.000").otherwise(F.col("time"))})
    return timeline.segments(rows).select("line_no", "segment", "in_segment_ms")


@query(f"SELECT {_ROW}, CAST(strlen(raw) + 1 AS BIGINT) AS raw_len FROM R")
def read_text_lines(spark, sf_dir):
    """The log as a text file: written once, then split, numbered and parsed."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarrylog-")
    path = f"{base.rstrip('/')}/log-{uuid.uuid4().hex}"
    log = rendering.events_as_lines(spark.read.parquet(f"{sf_dir}/events.parquet"))
    log.coalesce(1).sortWithinPartitions("line_no").select("raw").write.option("lineSep", "\n").text(path)
    return parsing.parse(source.read_lines(spark, path)).select("line_no", *parsing.FIELDS, "raw_len")


# --------------------------------------------------------------------------- faults


def _problem_rows(spark, sf_dir) -> DataFrame:
    rows = parsing.parse(rendering.events_as_problems(spark.read.parquet(f"{sf_dir}/events.parquet")), whole=True)
    return rows.withColumns({"source_id": F.lit("events"), "raw_len": (F.octet_length("raw") + 1).cast("long"), "provenance": F.lit("unknown"), "buffer": F.lit(None).cast("string")})


_EVENTS = """E AS (SELECT CASE event_type WHEN 'error' THEN 0 ELSE 6 END AS kind, event_id * 8 + 1 AS start, event_id * 8 + CASE event_type WHEN 'error' THEN 4 ELSE 1 END AS "end", user_id + 1000 AS pid, 'com.example.u' || (user_id % 10) AS process,
  CASE event_type WHEN 'error' THEN 'com.example.Fault' || (user_id % 5) || 'Exception' ELSE 'low-watermark' END AS subject FROM events WHERE event_type IN ('error', 'purchase'))"""


@query("""SELECT CASE event_type WHEN 'error' THEN 'fatal' WHEN 'purchase' THEN 'lmk' ELSE 'none' END AS class, count(*) AS n FROM events GROUP BY 1""")
def gate_candidates(spark, sf_dir):
    rows = gate.classify(parsing.parse(rendering.events_as_problems(spark.read.parquet(f"{sf_dir}/events.parquet")), whole=True))
    # the SQL counts events, so an event has the class of all its lines; gate_lines counts lines
    own = F.when(F.col("cand") == gate.CONTINUATION, 0).otherwise(F.col("cand"))
    rows = rows.groupBy(F.expr("(line_no - 1) div 8").alias("event")).agg(F.bit_or(own).alias("cand"))
    kind = F.when(F.col("cand") == gate.JAVA_FATAL, "fatal").when(F.col("cand") == gate.LMK, "lmk").when(F.col("cand") == 0, "none").otherwise("other")
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT class, passes, count(*) AS n FROM (SELECT unnest(CASE event_type WHEN 'error' THEN ['fatal', 'continuation', 'none', 'continuation'] WHEN 'purchase' THEN ['lmk'] ELSE ['none'] END) AS class, event_type IN ('error', 'purchase') AS passes FROM events) GROUP BY 1, 2""")
def gate_lines(spark, sf_dir):
    """Every line's class, and whether the gate lets it through; the exception of an own package begins with no fixed text."""
    rows = gate.classify(parsing.parse(rendering.events_as_problems(spark.read.parquet(f"{sf_dir}/events.parquet")), whole=True))
    kind = F.when(F.col("cand") == gate.JAVA_FATAL, "fatal").when(F.col("cand") == gate.LMK, "lmk").when(F.col("cand") == gate.CONTINUATION, "continuation").when(F.col("cand") == 0, "none").otherwise("other")
    return rows.groupBy(kind.alias("class"), gate.gate(F.col("tag"), F.col("message")).alias("passes")).agg(F.count("*").alias("n"))


@query(f"""WITH {_EVENTS} SELECT kind, start, "end", CAST(pid AS BIGINT) AS pid, process, subject FROM E""")
def problems_occurrences(spark, sf_dir):
    return detect.problems(_problem_rows(spark, sf_dir)).select("kind", "start", "end", "pid", "process", "subject")


@query(f"""WITH {_EVENTS} SELECT kind, process, subject AS signature, count(*) AS observed, min(start) AS first_line, max(start) AS last_line FROM E GROUP BY 1, 2, 3""")
def problems_groups(spark, sf_dir):
    return groups.groups(detect.problems(_problem_rows(spark, sf_dir))).select("kind", "process", "signature", "observed", "first_line", "last_line")


@query(f"""WITH {_EVENTS}, G AS (SELECT kind, process, subject AS signature, count(*) AS observed, max(start) AS last_line FROM E GROUP BY 1, 2, 3) SELECT row_number() OVER (ORDER BY observed DESC, last_line DESC) - 1 AS rank, kind, process, signature, observed FROM G ORDER BY observed DESC, last_line DESC LIMIT 10""")
def problems_top_by_count(spark, sf_dir):
    frozen = groups.snapshot(groups.groups(detect.problems(_problem_rows(spark, sf_dir))), "count")
    return groups.page(frozen, 0, 10).select("rank", "kind", "process", "signature", "observed")


@query(f"""WITH {_EVENTS}, G AS (SELECT kind, process, subject AS signature, max(start) AS last_line FROM E WHERE kind = 0 GROUP BY 1, 2, 3), N AS (SELECT *, row_number() OVER (ORDER BY last_line DESC) - 1 AS rank FROM G) SELECT rank, kind, process, signature FROM N WHERE rank BETWEEN 3 AND 7""")
def problems_page(spark, sf_dir):
    frozen = groups.snapshot(groups.groups(detect.problems(_problem_rows(spark, sf_dir))), "last", kind=0)
    return groups.page(frozen, 3, 5).select("rank", "kind", "process", "signature")


@query(f"""WITH {_EVENTS}, T AS (SELECT max(event_id * 8 + 8) AS total FROM events) SELECT start, greatest(start - 50, 1) AS first_line, least("end" + 50, total) AS last_line FROM E, T""")
def problems_export_range(spark, sf_dir):
    total = (spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0) * 8 + 8
    return sinks.problem_bounds(detect.problems(_problem_rows(spark, sf_dir)), total, 50).select("start", "first_line", "last_line")


@query(f"""WITH {_EVENTS}, T AS (SELECT max(event_id * 8 + 8) AS total FROM events) SELECT start, greatest(start - 50, 1) AS first_line, least("end" + 50, total) AS last_line FROM E, T""")
def context_window(spark, sf_dir):
    total = (spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0) * 8 + 8
    return views.context(detect.problems(_problem_rows(spark, sf_dir)), total, 50).select("start", "first_line", "last_line")


@query(f"""WITH {_EVENTS} SELECT count(*) AS observed, count(DISTINCT (kind, process, subject)) AS groups FROM E""")
def problems_stats(spark, sf_dir):
    return groups.stats(detect.problems(_problem_rows(spark, sf_dir)))


@query(f"""WITH {_EVENTS} SELECT kind, count(*) AS n FROM (SELECT kind, unnest(range(CASE kind WHEN 0 THEN 4 ELSE 2 END)) FROM E) GROUP BY 1""")
def problems_details(spark, sf_dir):
    facts = groups.details(detect.problems(_problem_rows(spark, sf_dir)))
    return facts.where("role <> 'KillIssued'").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {_EVENTS}, F AS (SELECT kind, unnest(CASE kind WHEN 0 THEN ['JavaUncaughtException', 'ProcessIdentityRecorded', 'ExceptionTypeRecorded', 'StackFrameRecorded'] ELSE ['LmkKillIssued', 'ProcessIdentityRecorded', 'LmkKillIssued'] END) AS code FROM E)
SELECT kind, code, CASE kind WHEN 0 THEN 'JavaUncaughtV1' ELSE 'LmkdKillV1' END AS rule, 'AospText' AS format, 'Unknown' AS provenance, count(*) AS n FROM F GROUP BY 1, 2""")
def problems_facts(spark, sf_dir):
    facts = groups.details(detect.problems(_problem_rows(spark, sf_dir)))
    return facts.groupBy("kind", "code", "rule", "format", "provenance").agg(F.count("*").alias("n"))


@query(f"""WITH {_EVENTS} SELECT start, pid FROM E WHERE kind = 0 AND process = 'com.example.u3' AND subject = 'com.example.Fault3Exception'""")
def problems_of_a_group(spark, sf_dir):
    events = detect.problems(_problem_rows(spark, sf_dir))
    key = groups.groups(events).where("kind = 0 and process = 'com.example.u3' and signature = 'com.example.Fault3Exception'").first()
    return groups.occurrences(events, key["kind"], key["fingerprint"]).select("start", "pid")


@query(f"""WITH {_EVENTS}, G AS (SELECT kind, process, subject AS signature, max(start) AS last_line FROM E GROUP BY 1, 2, 3), N AS (SELECT *, row_number() OVER (ORDER BY last_line DESC) - 1 AS rank FROM G) SELECT rank, kind, process, signature FROM N WHERE rank < 15""")
def problems_pages_appended(spark, sf_dir):
    frozen = groups.snapshot(groups.groups(detect.problems(_problem_rows(spark, sf_dir))), "last")
    return groups.append_page(groups.page(frozen, 0, 10), groups.page(frozen, 5, 10)).select("rank", "kind", "process", "signature")


@query(f"""WITH {_EVENTS}, G AS (SELECT kind, process, subject, row_number() OVER (ORDER BY min(start)) AS g FROM E GROUP BY 1, 2, 3), M AS (SELECT *, row_number() OVER (ORDER BY start) <= 300 AND g <= 12 AS stored FROM E JOIN G USING (kind, process, subject))
SELECT count(*) AS observed, count(*) FILTER (stored) AS stored, count(DISTINCT (kind, process, subject)) AS groups, count(*) FILTER (NOT stored) AS dropped, count(*) FILTER (NOT stored) > 0 AS limited FROM M""")
def problems_counters(spark, sf_dir):
    return groups.counters(groups.limited(detect.problems(_problem_rows(spark, sf_dir)), max_events=300, max_groups=12))


@query(f"""WITH {_EVENTS}, T AS (SELECT max(event_id * 8 + 8) AS total FROM events), W AS (SELECT start, greatest(start - 400, 1) AS lo, least("end" + 400, total) AS hi FROM E, T)
SELECT start, CASE WHEN hi - lo >= 512 THEN greatest(least(start - 256, hi - 511), lo) ELSE lo END AS first_line, CASE WHEN hi - lo >= 512 THEN greatest(least(start - 256, hi - 511), lo) + 511 ELSE hi END AS last_line FROM W""")
def context_wide(spark, sf_dir):
    """Ranges of 801 lines and more, cut to 512 around the anchor."""
    total = (spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] or 0) * 8 + 8
    return views.context(detect.problems(_problem_rows(spark, sf_dir)), total, 400).select("start", "first_line", "last_line")


# --------------------------------------------------------------------------- normalised tokens


def _norm(name, make, text, want):
    """make: column of tokens from a text column; text and want: the same text and its token in SQL over events."""

    def run(spark, sf_dir):
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(text[0]).alias("text"))
        return events.select("event_id", make(F.col("text")).alias("token"))

    run.__name__ = name
    query(f"WITH x AS (SELECT * FROM events) SELECT event_id, {want} AS token FROM x")(run)


_norm(
    "norm_java_throwable",
    normalizers.java_throwable,
    ["CASE event_id % 4 WHEN 0 THEN concat('Caused by: com.example.F', user_id, 'Exception: boom') WHEN 1 THEN concat('  java.lang.E', user_id, 'Error') WHEN 2 THEN concat('java.lang.String', user_id, ': x') ELSE 'Exception: x' END"],
    "CASE event_id % 4 WHEN 0 THEN 'com.example.F' || user_id || 'Exception' WHEN 1 THEN 'java.lang.E' || user_id || 'Error' END",
)
_norm(
    "norm_java_frame",
    normalizers.java_frame,
    ["CASE event_id % 3 WHEN 0 THEN concat('\tat com.example.W$', user_id, '.run(W.kt:', event_id, ')') WHEN 1 THEN 'at a.B.<init>(B.java)' ELSE 'at broken' END"],
    "CASE event_id % 3 WHEN 0 THEN 'com.example.W$*#run' WHEN 1 THEN 'a.B#<init>' END",
)
_norm(
    "norm_anr_reason",
    lambda c: normalizers.anr_reason(c)["canonical"],
    ["CASE event_id % 5 WHEN 0 THEN 'Input dispatching timed out (x)' WHEN 1 THEN concat('Broadcast of Intent { act=a.B', user_id, ' flg=1 }') WHEN 2 THEN concat('executing service p/c', user_id) WHEN 3 THEN 'ContentProvider not responding' ELSE 'Input dispatching timed outx' END"],
    "CASE event_id % 5 WHEN 0 THEN 'input-dispatch-timeout' WHEN 1 THEN 'broadcast:a.B' || user_id WHEN 2 THEN 'service:p/c' || user_id WHEN 3 THEN 'content-provider-timeout' END",
)
_norm(
    "norm_lmk_reason",
    normalizers.lmk_reason,
    ["CASE event_id % 5 WHEN 0 THEN 'x; reason: low watermark is breached' WHEN 1 THEN 'x; reason: psi' WHEN 2 THEN 'x; reason: lowered' WHEN 3 THEN 'x; reason: swap is low' ELSE 'none' END"],
    "CASE event_id % 5 WHEN 0 THEN 'lmkd:low-watermark' WHEN 1 THEN 'lmkd:memory-pressure' WHEN 3 THEN 'lmkd:swap-low' END",
)
_norm(
    "norm_kernel_mechanism",
    normalizers.kernel_mechanism,
    ["CASE event_id % 3 WHEN 0 THEN 'oom-kill:constraint=CONSTRAINT_MEMCG,x' WHEN 1 THEN 'Out of memory: Killed process 3 (a)' ELSE 'constraint=CONSTRAINT_NONEX' END"],
    "CASE event_id % 3 WHEN 0 THEN 'memcg' WHEN 1 THEN 'global' END",
)


@query("WITH x AS (SELECT * FROM events) SELECT event_id, CAST(CASE WHEN event_id % 3 < 2 THEN user_id + 1 END AS INTEGER) AS pid, CASE WHEN event_id % 3 < 2 THEN 'com.example.a' END AS name, CAST(CASE WHEN event_id % 3 = 1 THEN 10000 + user_id END AS INTEGER) AS uid FROM x")
def eventlog_parse(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_id") % 3
    tag = F.when(kind == 0, "am_proc_died").when(kind == 1, "am_proc_start").otherwise("am_anr")
    text = F.when(kind == 0, F.expr("concat('[0,', user_id + 1, ',com.example.a]')")).when(kind == 1, F.expr("concat('[0,', user_id + 1, ',', 10000 + user_id, ',com.example.a,activity,x/y]')")).otherwise(F.lit("[1,2]"))
    return events.select("event_id", normalizers.event_record(tag, text).alias("r")).select("event_id", "r.pid", "r.name", "r.uid")


@query("WITH x AS (SELECT * FROM events) SELECT event_id, CASE event_type WHEN 'error' THEN 3 ELSE 2 END AS n_tokens FROM x WHERE event_type IN ('error', 'click')")
def highlight_tokens(spark, sf_dir):
    return _highlighted(spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('error', 'click')"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 3 ELSE 2 END AS n_tokens FROM events")
def highlight_tokens_all(spark, sf_dir):
    return _highlighted(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _highlighted(events: DataFrame) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "an error here").otherwise("here")
    cut = highlight.highlight(text, [highlight.Rule("ERROR"), highlight.Rule("h.re", regex=True)], highlight.Rule("re"))
    return events.select("event_id", (F.size(cut) - F.when(F.col("event_type") == "error", 2).otherwise(0)).alias("n_tokens"))


@query("SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(props, '{\"k: }0123456789', 'TTTTTTRRRRRTYTTS'), 'T+', 'T', 'g'), 'S+', 'S', 'g'), 'Y+', 'Y', 'g'), 'R+', 'R', 'g') AS kinds FROM events")
def highlight_kinds(spark, sf_dir):
    """Every event's text cut into plain pieces (T), two highlights (Y, R) and search hits (S)."""
    cut = highlight.highlight(F.col("props"), [highlight.Rule("6"), highlight.Rule("[0-4]", regex=True, color="red")], highlight.Rule("9"))
    letter = lambda t: F.when(t["kind"] == "search", "S").when(t["color"] == "yellow", "Y").when(t["color"] == "red", "R").otherwise("T")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(F.transform(cut, letter), "").alias("kinds"))


# --------------------------------------------------------------------------- lifecycle


def _lifecycle_rows(spark, sf_dir) -> DataFrame:
    """Each signup is a start, a kill by the low-memory killer, a death and a start again, ten lines apart from the next."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'")
    head = F.concat(F.date_format("ts", "MM-dd HH:mm:ss.SSS"), F.lit("  1  1 I "))
    pid, name = (F.col("event_id") * 2 + 10).cast("string"), F.concat(F.lit("com.example.p"), F.col("event_id").cast("string"))
    am = lambda *x: F.concat(head, F.lit("ActivityManager: "), *x)
    start = lambda p: am(F.lit("Start proc "), p, F.lit(":"), name, F.lit("/u0a5 for service"))
    kill = F.concat(head, F.lit("lmkd: Kill '"), name, F.lit("' ("), pid, F.lit("), uid 10005, oom_score_adj 900 to free 1kB; reason: thrashing"))
    lines = F.array(start(pid), kill, am(F.lit("Process "), name, F.lit(" (pid "), pid, F.lit(") has died: cch")), start((F.col("event_id") * 2 + 11).cast("string")))
    raw = events.select("event_id", F.posexplode(lines).alias("j", "raw")).select((F.col("event_id") * 10 + F.col("j") + 1).alias("line_no"), "raw")
    rows = parsing.parse(raw, whole=True).withColumns({"source_id": F.lit("events"), "raw_len": (F.octet_length("raw") + 1).cast("long"), "provenance": F.lit("unknown"), "buffer": F.lit(None).cast("string")})
    return rows


@query("WITH x AS (SELECT * FROM events WHERE event_type = 'signup') SELECT event_id * 10 + 3 AS start, event_id * 10 + 4 AS \"end\", 'com.example.p' || event_id AS process FROM x")
def problems_restart(spark, sf_dir):
    return detect.problems(_lifecycle_rows(spark, sf_dir)).where("kind = 4").select("start", "end", "process")


@query("WITH x AS (SELECT * FROM events WHERE event_type = 'signup') SELECT event_id * 10 + 2 AS anchor, 6 AS outcome FROM x")
def problems_attached_deaths(spark, sf_dir):
    return detect.problems(_lifecycle_rows(spark, sf_dir)).where("kind = 6").select("anchor", "outcome")
