"""One opened log, with the calls a viewer makes: rows, filter, search, bookmarks, map, export, split, faults.

Results are lazy DataFrames; small answers (a count, a line, a position) are plain values. Rows read many
times can be kept with `materialize`, which writes them once, clustered by line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions import parsing
from quarrylog.operators import filters, search, sinks, views
from quarrylog.plans.problems import detect, groups
from quarrylog.sources import lines as source


class Log:
    def __init__(self, spark: SparkSession, rows: DataFrame, bookmarks: list[int] | None = None, spans: list[tuple[int, int, str]] | None = None, coverage: source.Coverage = source.Coverage()):
        self.spark, self.rows = spark, rows
        self.marked = set(bookmarks or ())
        self.spans, self.coverage = source.check_spans(spans or []), coverage
        self.filter, self.revision = filters.FilterSpec(), 0
        self._frozen: DataFrame | None = None

    @staticmethod
    def open(spark: SparkSession, path: str, charset: str = "UTF-8", **kw) -> Log:
        """Fields come from the decoded text; `raw` stays the file's own bytes, which exports write."""
        text = source.decode(source.read_lines(spark, path), charset)
        return Log(spark, parsing.parse(text, raw="text", whole=True).drop("text"), **kw)

    def materialize(self, path: str) -> Log:
        self.rows.repartitionByRange("line_no").sortWithinPartitions("line_no").write.mode("overwrite").parquet(path)
        self.rows = self.spark.read.parquet(path)
        return self

    # rows

    def bookmarks(self) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in sorted(self.marked)], "line_no long")

    def filtered(self) -> DataFrame:
        return filters.apply_filter(self.rows, self.filter, self.bookmarks()) if self.filter.is_active() else self.rows

    def view(self, name: str) -> DataFrame:
        return views.view(self.rows, name, self.filtered(), self.bookmarks())

    def get_rows(self, name: str, start: int, count: int, revision: int | None = None) -> DataFrame:
        dense = name == "all" or (name == "filtered" and not self.filter.is_active())
        if revision is not None:
            return views.checked_window(self.view(name), start, count, revision, self.revision, dense)
        return views.window(self.view(name), start, count, dense)

    def status(self) -> dict:
        row = views.counts(self.rows, filters.compile_filter(self.spark, self.filter), self.bookmarks()).first().asDict()
        return row | {"revision": self.revision}

    # filter and search

    def set_filter(self, spec: filters.FilterSpec) -> int:
        """A pattern that doesn't compile raises and leaves the filter as it was."""
        filters.compile_filter(self.spark, spec)
        self.filter, self.revision = spec, self.revision + 1
        return self.revision

    def search(self, spec: search.SearchSpec) -> tuple[int, int | None]:
        row = search.summary(search.search(self.rows, spec)).first()
        return row["matches"], row["first_line"]

    def search_next(self, spec: search.SearchSpec, from_line: int, forward: bool = True) -> int | None:
        return search.navigate(search.search(self.rows, spec), from_line, forward).first()["line_no"]

    # bookmarks and positions

    def toggle_bookmark(self, line_no: int) -> bool:
        if line_no <= 0:
            return False
        self.marked ^= {line_no}
        return line_no in self.marked

    def next_bookmark(self, from_line: int, forward: bool = True) -> tuple[int, int] | None:
        row = views.bookmark_in_result(self.filtered(), self.bookmarks(), from_line, forward).first()
        return None if row is None or row["line_no"] is None else (row["line_no"], row["result_index"])

    def line_to_result_index(self, line_no: int) -> int | None:
        return views.exact(self.filtered(), self.spark.createDataFrame([(line_no,)], "line_no long")).first()["result_index"]

    def map_source_line(self, line_no: int) -> tuple[int, int] | None:
        total = self.rows.agg(F.max("line_no")).first()[0] or 0
        row = views.nearest(self.filtered(), self.spark.createDataFrame([(line_no,)], "line_no long"), total).first()
        return None if row is None else (row["target_line"], row["result_index"])

    def minimap(self, buckets: int) -> DataFrame:
        return views.minimap(self.filtered(), self.bookmarks(), buckets)

    # files

    def export(self, name: str, path: str) -> dict:
        out = self.view(name)
        sinks.export(out, path)
        return sinks.summary(out).first().asDict()

    def export_range(self, start: int, end: int, path: str) -> dict:
        out = sinks.export_range(self.rows, start, end)
        sinks.export(out, path)
        return sinks.summary(out).first().asDict()

    def split_by_lines(self, per_part: int) -> DataFrame:
        return sinks.split_by_lines(self.rows, per_part)

    def split_by_bytes(self, limit: int) -> DataFrame:
        return sinks.split_by_bytes(self.rows, limit)

    # faults

    def problems(self) -> DataFrame:
        spans = self.spark.createDataFrame(self.spans, "start_line long, end_line long, buffer string")
        return detect.problems(source.with_provenance(self.rows, spans, self.coverage))

    def problem_groups(self, sort: str = "last", kind: int | None = None, start: int = 0, limit: int = groups.DEFAULT_PAGE, keep: bool = False) -> DataFrame:
        """A page of groups; with keep, of the snapshot that the call before froze."""
        if not keep or self._frozen is None:
            self._frozen = groups.snapshot(groups.groups(self.problems()), sort, kind).persist()
        return groups.page(self._frozen, start, limit)

    def release_problem_snapshot(self) -> bool:
        had = self._frozen is not None
        if had:
            self._frozen.unpersist()
            self._frozen = None
        return had

    def problem_occurrences(self, kind: int, fingerprint: str) -> DataFrame:
        return groups.occurrences(self.problems(), kind, fingerprint)

    def problem_detail(self) -> DataFrame:
        return groups.details(self.problems())
