"""Normalised fault tokens as column expressions; the fold uses the same rules on single lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylog.plans.problems import rules

_CLASS = r"(?:[A-Za-z_$][A-Za-z0-9_$]*\.)+[A-Za-z_$][A-Za-z0-9_$]*"
_END = r"(?![A-Za-z0-9_])"


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def java_throwable(c: Column) -> Column:
    name = F.regexp_extract(c, rf"^\s*(?:(?:Caused by|Suppressed):\s*)?({_CLASS})(?=[\s:]|$)", 1)
    return F.when(name.rlike("(Exception|Error|Throwable)$") & (F.length(name) <= rules.MAX_TOKEN), name)


def java_frame(c: Column) -> Column:
    shape = rf"^\s*at\s+({_CLASS})\.(<init>|<clinit>|[A-Za-z_$][A-Za-z0-9_$]*)\s*\("
    star = lambda x: F.regexp_replace(x, r"\$[0-9]+", r"\$*")
    name, method = F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)
    return F.when(name != "", F.concat(star(name), F.lit("#"), star(method)))


def anr_reason(c: Column) -> Column:
    """category and canonical; null where the reason is of no known shape."""
    text = F.trim(c)
    action = F.regexp_extract(text, r"^Broadcast of Intent \{.*?(?<![A-Za-z0-9_])act=([A-Za-z][A-Za-z0-9._$-]*)", 1)
    service = F.regexp_extract(text, r"^executing service ([A-Za-z0-9._$/-]*)", 1)
    pair = lambda category, canonical: F.struct(F.lit(category).alias("category"), canonical.alias("canonical"))
    return (
        F.when(text.rlike(f"^Input dispatching timed out{_END}"), pair("input-dispatch-timeout", F.lit("input-dispatch-timeout")))
        .when(action != "", pair("broadcast-timeout", F.concat(F.lit("broadcast:"), action)))
        .when(service.contains("/"), pair("service-timeout", F.concat(F.lit("service:"), service)))
        .when(text.startswith("Context.startForegroundService() did not then call Service.startForeground()"), pair("service-timeout", F.lit("foreground-service-start-timeout")))
        .when(text.rlike(f"^ContentProvider not responding{_END}"), pair("content-provider-timeout", F.lit("content-provider-timeout")))
    )


def lmk_reason(c: Column) -> Column:
    text = F.regexp_extract(c, r"reason:\s*(.*)$", 1)
    out = F.when(F.trim(c).startswith("lowmemorykiller: Killing "), "legacy-lowmemorykiller")
    for prefix, token in rules.LMK_REASONS:
        out = out.when(text.rlike(f"^{prefix}{_END}"), f"lmkd:{token}")
    return out


def kernel_mechanism(c: Column) -> Column:
    text = F.trim(c)
    memcg = text.startswith("Memory cgroup out of memory: Killed process ") | text.rlike(f"constraint=CONSTRAINT_MEMCG{_END}")
    every = text.startswith("Out of memory: Killed process ") | text.rlike(f"constraint=CONSTRAINT_NONE{_END}")
    return F.when(memcg, "memcg").when(every, "global")


def native_frame(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else rules.native_frame(x))

    return run(c)


def event_record(tag: Column, message: Column):
    """The record's fields where exactly one schema of its tag fits, else null; run it on candidate lines only."""

    @F.pandas_udf("user int, pid int, uid int, name string, reason string, exception string, file string, recoverable boolean")
    def run(tags: pd.Series, messages: pd.Series) -> pd.DataFrame:
        names = ("user", "pid", "uid", "name", "reason", "exception", "file", "recoverable")
        found = [rules.event_record(t or "", m or "") or {} for t, m in zip(tags, messages, strict=True)]
        kinds = {"user": "Int32", "pid": "Int32", "uid": "Int32", "recoverable": "boolean"}
        return pd.DataFrame({n: pd.Series([r.get(n) for r in found], dtype=kinds.get(n, "object")) for n in names})

    return run(tag, message)
