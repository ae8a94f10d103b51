"""License scans by template-markup matching.

A template is wording with marked regions: `<<beginOptional>> ... <<endOptional>>` may be absent, and
`<<var;name=...;min=a;max=b>>` stands for a to b arbitrary words. Templates are compiled to automata
over words, run over the text's words from every place where the first mandatory word stands; a
template is accepted only if all mandatory wording occurs in order, exactly, with nothing between but
what the markup allows. Licences (-text, -clause) and file headers (-header) need their whole wording;
a -notice is one line that names a licence, and says no more than that.

Words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Nulls and
empty texts have no words, no label and score 0. Overlapping places all count. Repeated rows are
scanned one by one. Columns other than doc_id and text are ignored.

The score is 1 where a template is accepted, 0.5 where only a base phrase occurs, else 0.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, span_hashes, text_slices, words_of

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Labels and mandatory wording of whole licences, of the notices that stand in files, and of one-line notices.
TEMPLATES = {
    "mit-text": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the <<var;name=term;min=1;max=2>> to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<beginOptional>>including the next paragraph <<endOptional>>shall be included in all copies or substantial portions of the
        software the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        <<var;name=holder;min=1;max=12>> be liable for any claim damages or other liability whether in an action of contract tort or
        otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "bsd-2-clause": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met <<beginOptional>>1 <<endOptional>>redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer <<beginOptional>>2 <<endOptional>>redistributions in binary form must
        reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution this software is provided by <<var;name=holder;min=1;max=12>> as is and any express
        or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed in no event shall <<var;name=holder;min=1;max=12>> be liable for any direct indirect incidental
        special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of
        use data or profits or business interruption however caused and on any theory of liability whether in contract strict
        liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
        the possibility of such damage""",
    "bsd-3-clause": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met <<beginOptional>>1 <<endOptional>>redistributions of source code must retain the above copyright notice
        this list of conditions and the following disclaimer <<beginOptional>>2 <<endOptional>>redistributions in binary form must
        reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution <<beginOptional>>3 <<endOptional>>neither the name of
        <<var;name=organisation;min=1;max=12>> nor the names of <<var;name=whose;min=1;max=3>> contributors may be used to endorse or
        promote products derived from this software without specific prior written permission this software is provided by
        <<var;name=holder;min=1;max=12>> as is and any express or implied warranties including but not limited to the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
        <<var;name=holder;min=1;max=12>> be liable for any direct indirect incidental special exemplary or consequential damages
        including but not limited to procurement of substitute goods or services loss of use data or profits or business
        interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence
        or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "isc-text": """
        permission to use copy modify and <<beginOptional>>or <<endOptional>>distribute this software for any purpose with or without
        fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software
        is provided as is and <<var;name=author;min=1;max=12>> disclaims all warranties with regard to this software including all
        implied warranties of merchantability and fitness in no event shall <<var;name=author;min=1;max=12>> be liable for any
        special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether
        in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of
        this software""",
    "apache-2.0-header": """
        licensed under the apache license version 2 0 the license you may not use this <<var;name=file;min=1;max=2>> except in
        compliance with the license you may obtain a copy of the license at <<var;name=scheme;min=1;max=1>> www apache org licenses
        license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed
        on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license""",
    "gpl-2.0-header": """
        is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation <<beginOptional>>either <<endOptional>>version 2 of the license
        <<beginOptional>>or at your option any later version <<endOptional>><<var;name=program;min=1;max=4>> is distributed in the hope
        that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
        particular purpose see the gnu general public license for more details""",
    "gpl-3.0-header": """
        is free software you can redistribute it and or modify it under the terms of the gnu general
        public license as published by the free software foundation <<beginOptional>>either <<endOptional>>version 3 of the license
        <<beginOptional>>or at your option any later version <<endOptional>><<var;name=program;min=1;max=4>> is distributed in the hope
        that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
        particular purpose see the gnu general public license for more details""",
    "mpl-2.0-header": """
        this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed
        with this file you can obtain one at <<var;name=scheme;min=1;max=1>> mozilla org mpl 2 0""",
    "mit-notice": "<<beginOptional>>this <<var;name=what;min=1;max=3>> is <<endOptional>>released under the <<beginOptional>>terms of the <<endOptional>>mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-3.0-notice": "licensed under the <<beginOptional>>terms of the <<endOptional>>gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>>version 3",
    "gpl-2.0-notice": "licensed under the <<beginOptional>>terms of the <<endOptional>>gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>>version 2",
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>>the <<endOptional>>cc by nc 4 0",
    "cc-by-4.0-notice": "licensed under <<beginOptional>>the <<endOptional>>cc by 4 0",
}

_MARK = re.compile(r"<<(.*?)>>")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class TokenAutomaton:
    """A nondeterministic automaton over words: arcs by word, arcs by any word, and empty arcs."""

    def __init__(self, markup: str):
        self.by_word: list[dict[str, list[int]]] = [{}]
        self.any_word: list[list[int]] = [[]]
        self.empty: list[list[int]] = [[]]
        here, opened, at = 0, [], 0
        for m in [*_MARK.finditer(markup), None]:
            for w in _WORD.findall(markup[at : m.start() if m else len(markup)].lower()):
                here = self._step(here, w)
            if m is None:
                break
            at = m.end()
            kind, *fields = m[1].split(";")
            if kind == "beginOptional":
                opened.append(here)
                here = self._state(here)
            elif kind == "endOptional":
                after = self._state(here)
                self.empty[opened.pop()].append(after)
                here = after
            elif kind == "var":
                f = dict(x.split("=", 1) for x in fields)
                skips = []
                for k in range(int(f.get("max", 1))):
                    if k >= int(f.get("min", 0)):
                        skips.append(here)
                    nxt = self._state(None)
                    self.any_word[here].append(nxt)
                    here = nxt
                for s in skips:
                    self.empty[s].append(here)
            else:
                raise ValueError(f"unknown markup: {m[1]}")
        if opened:
            raise ValueError("an optional region isn't closed")
        self.final = here
        start = self._close({0})
        if self.final in start:
            raise ValueError("a template needs mandatory wording")
        #: Words that can begin the template; None if any word can.
        self.first = None if any(self.any_word[s] for s in start) else {w for s in start for w in self.by_word[s]}

    def _state(self, empty_from: int | None) -> int:
        self.by_word.append({})
        self.any_word.append([])
        self.empty.append([])
        if empty_from is not None:
            self.empty[empty_from].append(len(self.empty) - 1)
        return len(self.empty) - 1

    def _step(self, here: int, word: str) -> int:
        nxt = self._state(None)
        self.by_word[here].setdefault(word, []).append(nxt)
        return nxt

    def _close(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def accepts_at(self, words, i: int) -> int | None:
        """The end of the shortest accepted run of words that begins at i."""
        states = self._close({0})
        while self.final not in states:
            if i >= len(words):
                return None
            w = words[i]
            nxt = {t for s in states for t in self.by_word[s].get(w, ())} | {t for s in states for t in self.any_word[s]}
            if not nxt:
                return None
            states, i = self._close(nxt), i + 1
        return i

    def key_word(self) -> str:
        """A word that every accepted text has: some mandatory word, the longest."""
        every = [w for w in {w for arcs in self.by_word for w in arcs} if not self._without(w)]
        return max(every, key=len)

    def _without(self, word: str) -> bool:
        seen = set(self._close({0}))
        todo = list(seen)
        while todo:
            s = todo.pop()
            for w, to in self.by_word[s].items():
                if w != word:
                    for t in self._close(set(to)) - seen:
                        seen.add(t)
                        todo.append(t)
            for t in self.any_word[s]:
                for u in self._close({t}) - seen:
                    seen.add(u)
                    todo.append(u)
        return self.final in seen


def compile_templates(templates: dict[str, str]) -> list[tuple[str, TokenAutomaton]]:
    return [(name, TokenAutomaton(markup)) for name, markup in templates.items()]


def match_templates(words: list[str], compiled) -> list[tuple[str, int, int]]:
    """Every (template, first word, end) accepted in these words."""
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    out = []
    for name, automaton in compiled:
        at = range(len(words)) if automaton.first is None else sorted(i for w in automaton.first for i in places.get(w, ()))
        for i in at:
            end = automaton.accepts_at(words, i)
            if end is not None:
                out.append((name, i, end))
    return out




def _hash(word: str) -> np.uint64:
    b = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(b, np.array([0]), np.array([len(b)]))[0]


SCHEMA = "doc_id long, n_words long, base array<struct<label:string,start:long>>, matches array<struct<template:string,start:long,end:long>>"


def _scan(base: dict[str, str], templates: dict[str, str]):
    def run(batches):
        import pyarrow as pa

        phrases = [(label, phrase.split(), [_hash(w) for w in phrase.split()]) for phrase, label in base.items()]
        compiled = compile_templates(templates)
        keys = np.unique(np.array([_hash(a.key_word()) for _, a in compiled], np.uint64))
        base_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
        match_type = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in text_slices(batch):
                low, off, starts, ends, owner, hashes = words_of(part.column(1), WORD)
                n = part.num_rows
                count = np.bincount(owner, minlength=n).astype(np.int64)
                first = np.cumsum(count) - count
                found: dict[int, list] = {}
                for label, words, hs in phrases:
                    m = len(words)
                    if len(hashes) < m:
                        continue
                    at = np.ones(len(hashes) - m + 1, bool)
                    for j, h in enumerate(hs):
                        at &= hashes[j : len(hashes) - m + 1 + j] == h
                    at = np.flatnonzero(at)
                    at = at[owner[at] == owner[at + m - 1]] if len(at) else at
                    for p in at:
                        if all(low[starts[p + j] : ends[p + j]].tobytes() == words[j].encode() for j in range(m)):
                            found.setdefault(int(owner[p]), []).append({"label": label, "start": int(p - first[owner[p]])})
                matches: dict[int, list] = {}
                for d in np.unique(owner[np.isin(hashes, keys)]):
                    span = range(first[d], first[d] + count[d])
                    words = [low[starts[i] : ends[i]].tobytes().decode("utf-8", "replace") for i in span]
                    if got := match_templates(words, compiled):
                        matches[int(d)] = [{"template": t, "start": a, "end": b} for t, a, b in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(count, pa.int64()),
                        pa.array([found.get(i, []) for i in range(n)], base_type),
                        pa.array([matches.get(i, []) for i in range(n)], match_type),
                    ],
                    names=["doc_id", "n_words", "base", "matches"],
                )

    return run


def license_matches(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places of base phrases, accepted templates with their first word and end."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_scan(base, templates), SCHEMA)


def summary(matches: DataFrame) -> DataFrame:
    labels = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return matches.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "matches.template")).alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.size("base") > 0, 0.5).otherwise(0.0).alias("score"),
    )
