"""Gate and candidate classes of lines, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.functions.parsing import settle

from .rules import STARS

# Bits of the candidate mask.
JAVA_FATAL, JAVA_OOM, ANR, LIFECYCLE, EVENT_LOG, NATIVE_CRASH, LMK, KERNEL_OOM, CONTINUATION = (1 << k for k in range(9))
# Tags that may carry evidence.
TAGS = ("AndroidRuntime", "art", "dalvikvm", "ActivityManager", "am_crash", "am_anr", "am_proc_start", "am_proc_died", "am_kill", "Zygote", "libc", "DEBUG", "debuggerd", "lmkd", "lowmemorykiller", "kernel")
# Beginnings of lines that may continue a report.
CONTINUATIONS = ("at ", "Caused by: ", "Suppressed: ", "... ", "Process: ", "PID: ", "pid: ", "Reason: ", "Subject: ", "Cmdline: ", "Abort message: ", "signal ", "backtrace:", ">>> ", "java.", "javax.", "kotlin.", "android.")
# Texts of the kernel's out-of-memory killer.
KERNEL_TEXTS = ("invoked oom-killer:", "oom-kill:constraint=", "Out of memory: Killed process ", "Memory cgroup out of memory: Killed process ")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def begins(c: Column, prefix: str) -> Column:
    """The prefix and a byte more at least."""
    return c.startswith(prefix) & (F.length(c) > len(prefix))


def gate(tag: Column, message: Column) -> Column:
    """Lines that can matter at all: an allowed tag, or the raw text of a tombstone or a kernel kill."""
    return tag.isin(*TAGS) | ((tag == "") & (message.startswith(STARS) | _any([message.contains(t) for t in KERNEL_TEXTS]) | message.contains("lowmemorykiller: Killing '")))


def candidates(tag: Column, message: Column, level: Column) -> Column:
    """The mask of candidate classes; continuation only where there is no other."""
    bit = lambda test, value: F.when(test, value).otherwise(0)
    fatal = (tag == "AndroidRuntime") & level.isin("E", "F") & (begins(message, "FATAL EXCEPTION:") | begins(message, "*** FATAL EXCEPTION IN SYSTEM PROCESS:"))
    oom = tag.isin("AndroidRuntime", "art", "dalvikvm") & (message.contains("java.lang.OutOfMemoryError") | begins(message, "Throwing OutOfMemoryError") | begins(message, "Out of memory on a "))
    anr = (tag == "ActivityManager") & begins(message, "ANR in ") | (tag == "am_anr")
    life = (tag == "ActivityManager") & (begins(message, "Process ") & message.contains(" has died") | begins(message, "Start proc ")) | tag.isin("am_proc_start", "am_proc_died", "am_kill") | (tag == "Zygote") & begins(message, "Process ") & message.contains(" exited due to signal ")
    record = tag.isin("am_crash", "am_anr", "am_proc_start", "am_proc_died", "am_kill")
    native = (tag == "libc") & begins(message, "Fatal signal ") | tag.isin("DEBUG", "debuggerd", "") & message.startswith(STARS)
    kernel_tag = tag.isin("kernel", "")
    lmk = (tag == "lmkd") & begins(message, "Kill '") | (tag == "lowmemorykiller") & (begins(message, "Kill '") | begins(message, "Killing '")) | kernel_tag & message.contains("lowmemorykiller: Killing '")
    kernel = kernel_tag & _any([message.contains(t) for t in KERNEL_TEXTS])
    mask = bit(fatal, JAVA_FATAL).bitwiseOR(bit(oom, JAVA_OOM)).bitwiseOR(bit(anr, ANR)).bitwiseOR(bit(life, LIFECYCLE)).bitwiseOR(bit(record, EVENT_LOG)).bitwiseOR(bit(native, NATIVE_CRASH)).bitwiseOR(bit(lmk, LMK)).bitwiseOR(bit(kernel, KERNEL_OOM))
    left = F.ltrim(message)
    more = tag.isin("AndroidRuntime", "ActivityManager", "libc", "DEBUG", "debuggerd", "") & (_any([left.startswith(p) for p in CONTINUATIONS]) | left.rlike("^#[0-9]{2} "))
    return F.when(mask != 0, mask).when(more, CONTINUATION).otherwise(0)


def classify(rows: DataFrame) -> DataFrame:
    """Adds `cand`. All classes ask for an allowed tag or none, so most lines of a log are told by their tag alone."""
    tag = F.col("tag")
    return settle(rows, {"cand": F.when(tag.isin("", *TAGS), candidates(tag, F.col("message"), F.col("level"))).otherwise(0)})
