"""DuckDB SQL for the queries that SQL can express, written from the contracts and not from the operators.

The byte-level suffix query has none: DuckDB needs minutes for it on the small tables, so it is tested by brute force.
"""

from __future__ import annotations

import re

from .licenses import BASE, TEMPLATES
from .line_dedup import MIN_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str = _ALNUM) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def _template_regex(markup: str) -> str:
    """Markup as a regular expression over words that are each followed by a blank."""
    out, at = [], 0
    for m in [*re.finditer(r"<<(.*?)>>", markup), None]:
        out += [w + " " for w in re.findall(r"[a-z0-9]+", markup[at : m.start() if m else len(markup)])]
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            out.append("(?:")
        elif m[1] == "endOptional":
            out.append(")?")
        else:
            f = dict(x.split("=") for x in m[1].split(";")[1:])
            out.append(f"(?:[^ ]+ ){{{f['min']},{f['max']}}}")
    return " " + "".join(out)


def _licenses() -> str:
    places = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM p WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in BASE.items())
    matches = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS label FROM j WHERE regexp_matches(s, '{_template_regex(markup)}')" for name, markup in TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
j AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM d),
b AS ({places}), m AS ({matches}),
bb AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
mm AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, bool_or(whole) AS whole FROM (SELECT doc_id, label, false AS whole FROM b UNION ALL SELECT doc_id, label, true FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN whole THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN mm USING (doc_id)
"""


_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, len(g) AS m, array_to_string(g, ' ') AS g FROM (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS g FROM b)),
lens AS (SELECT DISTINCT m FROM q),
p AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens)),
h AS (SELECT p.doc_id, p.i, p.m, q.item_id FROM p JOIN q ON p.m = q.m AND p.g = q.g),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", r"[^\x20\x09-\x0D]+")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(g, ' ') AS g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2
"""

# A line goes if it stands in a run of MIN_WORDS words or more that begins with a word and also begins earlier. Any such run is
# covered by the shortest that begin at one of its lines, and those that end at one; all copies of these are such runs as well.
_LINES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS xs FROM documents),
l AS (SELECT doc_id, i, x, len(regexp_extract_all(x, '[^ \\t\\r]+')) AS n FROM (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM d WHERE length(text) > 0)),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
k AS (SELECT a.doc_id, a.i, b.i AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {MIN_WORDS} WHERE a.n > 0),
q AS (SELECT doc_id, i, min(j) AS j FROM k GROUP BY 1, 2 UNION SELECT doc_id, max(i) AS i, j FROM k GROUP BY 1, 3),
r AS (SELECT q.doc_id, q.i, q.j, array_to_string(d.xs[q.i:q.j], chr(10)) AS run FROM q JOIN d USING (doc_id)),
o AS (SELECT *, first_value(doc_id) OVER w AS od, first_value(i) OVER w AS oi FROM r WINDOW w AS (PARTITION BY run ORDER BY doc_id, i)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM o WHERE (doc_id, i) <> (od, oi)),
m AS (SELECT l.doc_id, l.i, l.x, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM m)
SELECT d.doc_id, coalesce(count(*) FILTER (gone), 0) AS n_removed_lines, coalesce(count(*) FILTER (begins), 0) AS n_runs, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id
"""

_EXACT = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k FROM documents),
o AS (SELECT doc_id, sha256(k) AS text_sha256, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM o
"""

ORACLES = {
    "op4_licenses": _licenses(),
    "op5_decontaminate": _DECONTAMINATION,
    "op7_jaccard_join": _JACCARD,
    "op9_exact_dedup": _EXACT,
    "op10_line_dedup": _LINES,
}
