"""User patterns: a linear-time regex dialect, checked on the driver before any task runs."""

from __future__ import annotations

import re


class PatternError(ValueError):
    pass


def to_java(spark, pattern: str) -> str:
    """The pattern for Java's engine; raises PatternError for what the dialect doesn't have."""
    stripped = re.sub(r"\\.", "", pattern)
    if re.search(r"\(\?(?:[=!>]|<[=!])", stripped):
        raise PatternError("look-around and atomic groups are not supported")
    if re.search(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|k)", pattern):
        raise PatternError("back-references are not supported")
    if re.search(r"[*+?}]\+", stripped):
        raise PatternError("possessive quantifiers are not supported")
    java = pattern.replace("(?P<", "(?<")
    java = re.sub(r"\\([pP])\{(?!Is|In|L|M|N|P|S|Z|C)(\w+)\}", r"\\\1{Is\2}", java)
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:  # the JVM's PatternSyntaxException
        raise PatternError(str(e).splitlines()[0]) from None
    return java


def quote(text: str) -> str:
    """A literal for Java's engine."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", text)
