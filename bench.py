"""Headline operations, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.

The published figures are those of an engine over one log file that it has indexed. So the tables are rendered as a log once,
as text files of about equal size, and indexed; then each operation reads and parses the text files again, in three runs, of
which the first isn't counted. `index` is the time of indexing alone. Lines a second follow from `lines`.
"""

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions.parsing import FIELDS, parse
from quarrylog.operators import filters, search, sinks, views
from quarrylog.operators.filters import FilterField, FilterSpec
from quarrylog.plans.problems import detect, groups
from quarrylog.sources import lines as source
from quarrylog.sources import rendering


def operations(spark: SparkSession, path: str, storm: str, index: DataFrame, storm_index: DataFrame, out: str) -> dict:
    rows = lambda **k: parse(source.read_lines(spark, path, index), **k)
    fields = ["line_no", *FIELDS]
    errors, tags = FilterSpec(levels=filters.level_mask("EF")), FilterSpec(tag_include=FilterField("Order|Ui"))
    marks = spark.createDataFrame([(k * 997 + 1,) for k in range(50)], "line_no long")
    hits = lambda spec: filters.apply_filter(rows(), spec).select("line_no")

    def faults(of: str, at: DataFrame) -> DataFrame:
        known = parse(source.read_lines(spark, of, at), whole=True).withColumns({"provenance": F.lit("unknown"), "buffer": F.lit(None).cast("string")})
        return groups.groups(detect.problems(known))

    def exported():
        shutil.rmtree(f"{out}/export", ignore_errors=True)
        sinks.export(filters.apply_filter(rows(), errors), f"{out}/export")

    return {
        "index": lambda: source.index_lines(spark, path),
        "parse_threadtime": lambda: rows().select(*fields),
        "filter_level": lambda: hits(errors),
        "filter_tag_include": lambda: hits(tags),
        "filter_word_include": lambda: hits(FilterSpec(word_include=FilterField("connection"))),
        "filter_word_regex": lambda: hits(FilterSpec(word_include=FilterField("conn.*timeout|conn.*reset", regex=True))),
        "search_case_insensitive": lambda: search.search(rows(), search.SearchSpec("eRRorsERV")).select("line_no"),
        "view_all_window": lambda: views.window(rows().select(*fields), 100, 200, dense=True),
        "view_filtered_window": lambda: views.window(filters.apply_filter(rows(), tags).select(*fields), 50, 200),
        "export_filtered": exported,
        "minimap_all": lambda: views.minimap(rows(), marks, 240),
        "problems_groups": lambda: faults(path, index),
        "problems_storm": lambda: faults(storm, storm_index),
    }


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = tempfile.mkdtemp(prefix="bench-")
    try:
        parts = int(cpus)
        rendering.tables_as_lines(table("events"), table("orders"), table("lineitem")).repartition(parts).write.option("lineSep", "\n").text(f"{out}/log")
        rendering.events_as_problems(table("events")).select("raw").coalesce(1).write.option("lineSep", "\n").text(f"{out}/storm")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        index, storm_index = (source.index_lines(spark, f"{out}/{x}").persist() for x in ("log", "storm"))
        counted = {"lines": source.read_lines(spark, f"{out}/log", index).count(), "storm_lines": source.read_lines(spark, f"{out}/storm", storm_index).count()}
        size = sum(os.path.getsize(f"{out}/log/{f}") for f in os.listdir(f"{out}/log"))
        took = {}
        for name, run in operations(spark, f"{out}/log", f"{out}/storm", index, storm_index, out).items():
            runs = []
            for k in range(4):
                began = time.time()
                found = run()
                if found is not None:
                    found.write.format("noop").mode("overwrite").save()
                if k:
                    runs.append(time.time() - began)
            took[name] = round(statistics.median(runs), 3)
        print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, **counted, "log_mb": round(size / 1e6, 1), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    finally:
        spark.stop()
        shutil.rmtree(out, ignore_errors=True)


if __name__ == "__main__":
    main()
