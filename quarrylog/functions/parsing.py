"""Line to row: column expressions only, so unused fields cost nothing and no Python runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as the row grammar splits and trims by it.
WS = r"(?U)\s"
LEVELS = ("V", "D", "I", "W", "E", "F")
FIELDS = ("date", "time", "level", "pid", "tid", "tag", "message")

_DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
_BEFORE = (0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)


#: White space of ASCII, and a character that parts words once they are found.
_BLANKS, _PART = " \t\n\x0b\f\r", "\x01"


def ltrim(c: Column, ascii: Column | None = None) -> Column:
    """Without leading white space; `ascii` says where that can only be ASCII's, which needs no pattern."""
    slow = F.regexp_replace(c, rf"^{WS}+", "")
    return slow if ascii is None else F.when(ascii, F.ltrim(c, F.lit(_BLANKS))).otherwise(slow)


def rtrim(c: Column, ascii: Column | None = None) -> Column:
    slow = F.regexp_replace(c, rf"{WS}+$", "")
    return slow if ascii is None else F.when(ascii, F.rtrim(c, F.lit(_BLANKS))).otherwise(slow)


def _words(line: Column, ascii: Column, n: int) -> Column:
    """The first n - 1 words of a line and the rest; fewer parts where there are fewer words.

    One pattern, compiled once, marks where the words end, and a single character then parts them. A line that has that
    character is split by white space, for which Spark compiles a pattern a row."""
    marked = lambda flag: F.regexp_replace(line, "(?s" + flag + r")\A\s*" + r"(\S+)\s+" * (n - 1) + r"(\S.*)\z", _PART.join(f"${k + 1}" for k in range(n)))
    slow = F.split(ltrim(line), rf"{WS}+", n)
    return F.when(line.contains(_PART), slow).otherwise(F.split(F.when(ascii, marked("")).otherwise(marked("U")), _PART, n))


def strip_newlines(raw: Column) -> Column:
    return F.rtrim(raw, F.lit("\r\n"))


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once a row: a generator of one row keeps the optimizer from putting their
    expressions into every place that uses them."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _at(parts: Column, i: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(i)), F.lit(""))


def threadtime(parts: Column, ascii: Column | None = None) -> tuple[Column, dict[str, Column]]:
    """Of a line's first five words and the rest: whether it is `date time pid tid level tail`, and its fields."""
    date, time, pid, tid, level, tail = (_at(parts, i) for i in range(6))
    ok = (tail != "") & level.isin(*LEVELS) & pid.rlike("^[0-9]+$") & tid.rlike("^[0-9]+$")
    colon = F.instr(tail, ":")
    pair = F.split(tail, rf"{WS}+", 2)
    tag = F.when(colon > 0, rtrim(F.substring_index(tail, ":", 1), ascii)).otherwise(_at(pair, 0))
    message = F.when(colon > 0, ltrim(F.substr(tail, colon + 1), ascii)).otherwise(_at(pair, 1))
    return ok, {"date": date, "time": time, "level": level, "pid": pid, "tid": tid, "tag": tag, "message": message}


def time_format(parts: Column, ascii: Column | None = None) -> tuple[Column, dict[str, Column]]:
    """Of a line's first two words and the rest: whether it is `date time L/tag( pid): message`, and its fields."""
    date, time, rest = (_at(parts, i) for i in range(3))
    after = F.substr(rest, F.lit(3))
    opens, closes = F.instr(after, "("), F.instr(after, ")")
    ok = rest.rlike("^[VDIWEF]/") & (opens > 0) & (closes > opens)
    pid = rtrim(ltrim(F.substr(after, opens + 1, F.greatest(closes - opens - 1, F.lit(0))), ascii), ascii)
    message = ltrim(F.ltrim(F.substr(after, closes + 1), F.lit(":")), ascii)
    fields = {"date": date, "time": time, "level": F.substr(rest, F.lit(1), F.lit(1)), "pid": pid, "tid": F.lit(""), "tag": F.substr(after, F.lit(1), F.greatest(opens - 1, F.lit(0))), "message": message}
    return ok, fields


def _split(lines: DataFrame, raw: str) -> DataFrame:
    lines = settle(lines, {"__line": strip_newlines(F.coalesce(F.col(raw).cast("string"), F.lit("")))})
    line, ascii = F.col("__line"), F.col("__ascii")
    lines = settle(lines, {"__ascii": F.octet_length("__line") == F.length("__line")})
    lines = settle(lines, {"__six": _words(line, ascii, 6)})
    lines = settle(lines, {"__whole": threadtime(F.col("__six"), ascii)[0]})
    lines = settle(lines, {"__three": F.when(~F.col("__whole"), _words(line, ascii, 3))})
    return settle(lines, {"__kind": F.when(F.col("__whole"), 1).when(time_format(F.col("__three"), ascii)[0], 2).otherwise(0)})


_HELD = ("__line", "__ascii", "__six", "__whole", "__three", "__kind")


def parse(lines: DataFrame, raw: str = "raw", whole: bool = False) -> DataFrame:
    """Adds the seven fields, never null: threadtime, else time format, else the whole line as message.

    A line is split once; fields that aren't used cost nothing. whole: all fields are used, many times each.
    """
    lines = _split(lines, raw)
    a, b = threadtime(F.col("__six"), F.col("__ascii"))[1], time_format(F.col("__three"), F.col("__ascii"))[1]
    kind = F.col("__kind")
    other = {f: F.lit("") for f in FIELDS} | {"message": F.col("__line")}
    fields = {f: F.when(kind == 1, a[f]).when(kind == 2, b[f]).otherwise(other[f]) for f in FIELDS}
    out = settle(lines, fields) if whole else lines.withColumns(fields)
    return out.drop(*_HELD)


def formats(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `format`: threadtime, time or raw."""
    kind = F.col("__kind")
    return _split(lines, raw).withColumn("format", F.when(kind == 1, "threadtime").when(kind == 2, "time").otherwise("raw")).drop(*_HELD)


# --------------------------------------------------------------------------- time


def has_time_shape(date: Column, time: Column) -> Column:
    return date.rlike("^[0-9]{2}-[0-9]{2}$") & time.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}$")


def _pick(month: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.greatest(F.least(month, F.lit(12)), F.lit(1)))


def _clock(date: Column, time: Column):
    num = lambda c, at, n: F.substring(c, at, n).try_cast("long")
    month, day = num(date, 1, 2), num(date, 4, 2)
    hour, minute, second, ms = num(time, 1, 2), num(time, 4, 2), num(time, 7, 2), num(time, 10, 3)
    ok = has_time_shape(date, time) & month.between(1, 12) & (day >= 1) & (day <= _pick(month.cast("int"), _DAYS)) & (hour < 24) & (minute < 60) & (second < 60)
    return ok, month, day, hour, minute, second, ms


def packed_timestamp(date: Column, time: Column) -> Column:
    """Strict MM-DD HH:MM:SS.mmm as one number, 1 added; null where unknown. February has 29 days."""
    ok, month, day, hour, minute, second, ms = _clock(date, time)
    return F.when(ok, ((((month * 32 + day) * 24 + hour) * 60 + minute) * 60 + second) * 1000 + ms + 1)


def timeline_ms(date: Column, time: Column) -> Column:
    """Milliseconds since the start of a year of 366 days; null where unknown."""
    ok, month, day, hour, minute, second, ms = _clock(date, time)
    days = _pick(month.cast("int"), _BEFORE) + day - 1
    return F.when(ok, (((days * 24 + hour) * 60 + minute) * 60 + second) * 1000 + ms)
