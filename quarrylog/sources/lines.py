"""Text files to numbered lines; only \\n ends a line, and bytes are kept as they are."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    block = [F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("__block")]
    return text.select(F.col("value").cast("binary").alias("raw"), *block, F.monotonically_increasing_id().alias("__id"))


def index_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The index of text files: one row a file split, with the lines before it. Keep it (persist) to read the files many times.

    It holds for reads of the same files with the same split sizes, so for the session that made it.
    """
    blocks = _scan(spark, path).groupBy("source_id", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("source_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.select("source_id", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__before"))


def read_lines(spark: SparkSession, path: str | list[str], index: DataFrame | None = None) -> DataFrame:
    """source_id (file), line_no (1-based), raw (bytes without the \\n), raw_len (with it, as if present).

    Lines are numbered within each file split by their order of reading, and each split starts after the
    lines of those before it; nothing but one count for each split is shuffled.
    """
    out = _scan(spark, path).join(index_lines(spark, path) if index is None else index, ["source_id", "__block"])
    return out.select("source_id", (F.col("__before") + F.col("__id") - F.col("__first") + 1).alias("line_no"), "raw", (F.length("raw") + 1).cast("long").alias("raw_len"))


# Charsets by code page.
CODE_PAGES = {936: "GBK", 950: "Big5", 932: "Shift_JIS", 949: "EUC-KR", 1250: "windows-1250", 1251: "windows-1251", 1252: "windows-1252", 1253: "windows-1253", 1254: "windows-1254", 1255: "windows-1255", 1256: "windows-1256", 1257: "windows-1257", 1258: "windows-1258", 874: "windows-874", 65001: "UTF-8"}
# Charsets by language of a locale.
LANGUAGES = {"zh_CN": "GBK", "zh_SG": "GBK", "zh_TW": "Big5", "zh_HK": "Big5", "ja": "Shift_JIS", "ko": "EUC-KR", "ru": "windows-1251", "el": "windows-1253", "tr": "windows-1254", "he": "windows-1255", "ar": "windows-1256", "th": "windows-874", "vi": "windows-1258"}


def charset_for(locale: str | None = None, code_page: int | None = None) -> str:
    """The charset of `Local` text by code page, else by locale, else windows-1252; a UTF-8 locale is UTF-8."""
    if code_page is not None:
        return CODE_PAGES.get(code_page, "windows-1252")
    locale = locale or ""
    if "utf-8" in locale.lower() or "utf8" in locale.lower():
        return "UTF-8"
    name = locale.split(".")[0].replace("-", "_")
    return LANGUAGES.get(name) or LANGUAGES.get(name.split("_")[0]) or "windows-1252"


def decode(lines: DataFrame, charset: str = "UTF-8", raw: str = "raw") -> DataFrame:
    """Adds `text`. Bytes that are no UTF-8 become U+FFFD; other charsets go through Arrow in batches, replacing what they can't read."""
    if charset.upper() in ("UTF-8", "UTF8"):
        return lines.withColumn("text", F.make_valid_utf8(F.col(raw).cast("string")))
    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(charset, "replace"))

    return lines.withColumn("text", read(F.col(raw)))


# --------------------------------------------------------------------------- provenance

# Log buffers.
BUFFERS = ("main", "system", "radio", "events", "crash", "kernel")


#: Lines for which spans are looked up together.
SPAN_CHUNK = 1 << 18


@dataclass(frozen=True)
class Coverage:
    """What is known of an input as a whole: of a live capture the buffers it asked for, of a file nothing."""

    buffers: frozenset[str] | None = None
    start_truncated: bool = False

    @staticmethod
    def static() -> Coverage:
        return Coverage()

    @staticmethod
    def live(buffers, start_truncated: bool = True) -> Coverage:
        unknown = set(buffers) - set(BUFFERS)
        if unknown:
            raise ValueError(f"no such buffers: {sorted(unknown)}")
        return Coverage(frozenset(buffers), start_truncated)

    def may_hold(self, buffer: str) -> bool:
        return self.buffers is None or buffer in self.buffers


def with_provenance(lines: DataFrame, spans: DataFrame, coverage: Coverage = Coverage()) -> DataFrame:
    """Adds `buffer` and `provenance` (known, inferred, unknown) from spans (start_line, end_line, buffer; inclusive).

    Spans don't overlap, so each line has one at most; both sides are cut into chunks of lines and joined by those. A line
    outside spans is inferred to be of `events` when it has the shape of a structured record and the input may hold that
    buffer, else it is unknown; text of dividers proves nothing. Events and kernel lines of a live capture that didn't ask
    for their buffer are unknown, whatever a span says.
    """
    chunk = lambda c: F.floor(F.col(c) / SPAN_CHUNK)
    cut = spans.select("start_line", "end_line", "buffer", F.explode(F.sequence(chunk("start_line"), chunk("end_line"))).alias("__chunk"))
    inside = F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    rows = lines.withColumn("__chunk", chunk("line_no")).alias("l").join(cut.alias("s"), (F.col("l.__chunk") == F.col("s.__chunk")) & inside, "left").select("l.*", "s.buffer").drop("__chunk")
    refused = [b for b in ("events", "kernel") if not coverage.may_hold(b)]
    rows = rows.withColumn("buffer", F.when(~F.col("buffer").isin(*refused), F.col("buffer"))) if refused else rows
    shape = F.col("tag").startswith("am_") & F.col("message").rlike(r"^\[.*\]$") if "tag" in lines.columns and coverage.may_hold("events") else F.lit(False)
    shape = shape & F.col("buffer").isNull()
    provenance = F.when(F.col("buffer").isNotNull(), "known").when(shape, "inferred").otherwise("unknown")
    return rows.select(*lines.columns, F.when(shape, "events").otherwise(F.col("buffer")).alias("buffer"), provenance.alias("provenance"))


def check_spans(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Sorted spans; raises where they overlap, end before they start or name no buffer."""
    out = sorted(spans)
    for a, b, name in out:
        if a < 1 or b < a or name not in BUFFERS:
            raise ValueError(f"bad span: {(a, b, name)}")
    for (_, end, _), (start, _, _) in zip(out, out[1:], strict=False):
        if start <= end:
            raise ValueError("spans overlap")
    return out
