"""Highlight tokens: a text cut at every edge of a match, each piece plain, highlighted or a search hit."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    query: str
    regex: bool = False
    case_sensitive: bool = False
    color: str = "yellow"


def spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Non-empty matches; a pattern that doesn't compile has none."""
    if not rule.query:
        return []
    try:
        found = re.compile(rule.query if rule.regex else re.escape(rule.query), 0 if rule.case_sensitive else re.IGNORECASE)
    except re.error:
        return []
    return [m.span() for m in found.finditer(text) if m.end() > m.start()]


def tokens(text: str, rules: list[Rule], search: Rule | None = None) -> list[dict]:
    """A search hit wins; among highlights the one that starts first, then the earlier rule. Equal neighbours are one token."""
    marked = sorted(((a, k, b, r.color) for k, r in enumerate(rules) for a, b in spans(text, r)), key=lambda x: x[:2])
    hits = spans(text, search) if search else []
    if not marked and not hits:
        return [{"text": text, "kind": "text", "color": None}]
    edges = sorted({0, len(text), *(e for a, _, b, _ in marked for e in (a, b)), *(e for h in hits for e in h)})
    out: list[dict] = []
    for start, end in zip(edges, edges[1:], strict=False):
        if any(a <= start and end <= b for a, b in hits):
            kind, color = "search", None
        else:
            color = next((c for a, _, b, c in marked if a <= start and end <= b), None)
            kind = "text" if color is None else "highlight"
        if out and out[-1]["kind"] == kind and out[-1]["color"] == color:
            out[-1]["text"] += text[start:end]
        else:
            out.append({"text": text[start:end], "kind": kind, "color": color})
    return out


def highlight(column, rules: list[Rule], search: Rule | None = None):
    """The tokens of a column, in Arrow batches."""

    @F.pandas_udf("array<struct<text:string,kind:string,color:string>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else tokens(t, rules, search))

    return run(column)
