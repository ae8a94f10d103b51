"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A text's words are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
Each benchmark item gives windows of `window` consecutive words; an item of fewer words, but not none,
is one window. Windows of one length m make one pattern table: the shift table, sized by the patterns,
says for the hash of a block of two words how far the search may jump; where it says 0, the block
selects a suffix-hash bucket, the hash of the window its candidates there, and those are compared with
the text byte by byte. All texts of a slice are searched at once, cut into overlapping lanes whose
cursors jump independently.

Patterns are handled in blocks of bounded size (`block_bytes`, one item at least), fetched and
broadcast one at a time. A row passes through the blocks within its task and gathers what each finds,
so nothing is shuffled, and the result is the same for any size of blocks.

Null and empty texts have no words and are never hit. Items without words match nothing; several items
with the same window are all found; windows of an item without item_id hit, but can't be listed. Rows
that repeat, and rows with equal or null doc_ids, are judged one by one. A very long text is a slice
of its own. Empty tables give no rows, or no hits. There are no ties to break. Extra columns are
ignored by `contamination` and kept by `remove_contaminated`.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, mix64, text_slices, words_of

WINDOW = 10
#: Item text that one search table holds; its words, hashes and buckets take about seven times as much memory.
BLOCK_BYTES = 16 << 20
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_LANE = 128

#: For each document: its words, whether each is hit (as runs), and the items found.
HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def item_windows(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = [w.encode() for w in _WORDS.findall((text or "").translate(_ASCII_LOWER))]
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class WuManber:
    """Distinct patterns of one length m: runs of m words of a buffer that holds the items' words."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, heads: np.ndarray, items: np.ndarray, m: int):
        self.m, self.block = m, min(2, m)
        self.low, self.starts, self.ends = low, starts.astype(np.int32), ends.astype(np.int32)
        first, second = self.windows(hashes, heads), self.windows(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), heads)
        last = self.blocks(hashes, heads + m - 1)
        order = np.lexsort((second, first, last))
        heads, items, first, second, last = (x[order] for x in (heads, items, first, second, last))
        new = np.ones(len(heads), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        at = np.flatnonzero(new)
        self.heads = heads[at].astype(np.int32)  # suffix-hash buckets, and by window hash within a bucket
        self.items, self.item_at = items.astype(np.int32), np.append(at, len(heads)).astype(np.int64)
        self.suffixes = last[at]
        self.keys = mix64(self.suffixes * np.uint64(3) + first[at])
        self.by_key = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[self.by_key]
        # eight slots for each block of the patterns, so that most blocks of a text jump
        jump = m - self.block + 1
        self.bits = int(min(24, max(16, math.ceil(math.log2(max(1, len(at) * jump))) + 3)))
        self.shift = np.full(1 << self.bits, jump, np.int32)
        for j in range(self.block - 1, m):
            np.minimum.at(self.shift, self.slot(self.blocks(hashes, self.heads.astype(np.int64) + j)), m - 1 - j)

    def windows(self, hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """A hash of the m words from each head on."""
        acc = np.zeros(len(heads), np.uint64)
        for j in range(self.m):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[heads + j]
        return mix64(acc)

    def blocks(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The hash of the block of words that ends at each place."""
        return hashes[at] if self.block == 1 else mix64(hashes[at - 1] * np.uint64(3) + hashes[at])

    def slot(self, b: np.ndarray) -> np.ndarray:
        return (b >> np.uint64(64 - self.bits)).astype(np.int64)

    def items_of(self, k: int) -> list[int]:
        return self.items[self.item_at[k] : self.item_at[k + 1]].tolist()

    def equal(self, k: int, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: int) -> bool:
        """Compares a pattern with the text's words byte by byte."""
        head = int(self.heads[k])
        return all(self.low[self.starts[head + j] : self.ends[head + j]].tobytes() == low[starts[begin + j] : ends[begin + j]].tobytes() for j in range(self.m))

    def search(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray, count: np.ndarray):
        """Yields (first word, pattern) of every occurrence; texts have words first[i] .. first[i] + count[i]."""
        # lanes: windows that begin at word at .. to - 1 of a text
        n_starts = np.maximum(count - self.m + 1, 0)
        lanes = -(-n_starts // _LANE)
        if not lanes.sum():
            return
        text = np.repeat(np.arange(len(count)), lanes)
        part = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        cursor = first[text] + part * _LANE + self.m - 1  # of the window's last word
        stop = first[text] + np.minimum((part + 1) * _LANE, n_starts[text]) + self.m - 1
        while len(cursor):
            b = self.blocks(hashes, cursor)
            step = self.shift[self.slot(b)]
            at_zero = np.flatnonzero(step == 0)
            if len(at_zero):
                at_zero = at_zero[np.searchsorted(self.suffixes, b[at_zero], side="right") > np.searchsorted(self.suffixes, b[at_zero], side="left")]
            if len(at_zero):
                begins = cursor[at_zero] - self.m + 1
                key = mix64(b[at_zero] * np.uint64(3) + self.windows(hashes, begins))
                lo, hi = np.searchsorted(self.keys, key, side="left"), np.searchsorted(self.keys, key, side="right")
                for i in np.flatnonzero(hi > lo):
                    for k in self.by_key[lo[i] : hi[i]]:
                        if self.equal(int(k), low, starts, ends, int(begins[i])):
                            yield int(begins[i]), int(k)
            cursor = cursor + np.maximum(step, 1)
            live = cursor < stop
            if not live.all():
                cursor, stop = cursor[live], stop[live]


class Patterns:
    """A search table for each window length of a block of items, and the items' names (None: no id)."""

    def __init__(self, rows, window: int):
        import pyarrow as pa

        self.names = [None if item is None else str(item) for item, _ in rows]
        self.tables: list[WuManber] = []
        low, _, starts, ends, owner, hashes = words_of(pa.array([t for _, t in rows], pa.large_string()), WORD)
        count = np.bincount(owner, minlength=len(rows)).astype(np.int64)
        first = np.cumsum(count) - count
        length = np.minimum(count, window)
        for m in sorted(set(length[length > 0].tolist())):
            own = np.flatnonzero(length == m)
            n = count[own] - m + 1
            items = np.repeat(own, n)
            heads = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[items]
            self.tables.append(WuManber(low, starts, ends, hashes, heads, items, m))


def _scan(patterns, keep_text: bool):
    """Adds what a block of patterns hits to each row: doc_id, text, spans, items."""

    def run(batches):
        import pyarrow as pa

        value = patterns.value if patterns is not None else None
        tables, names = (value.tables, value.names) if value else ([], [])
        for batch in batches:
            for part in text_slices(batch):
                low, off, starts, ends, owner, hashes = words_of(part.column(1), WORD)
                n = part.num_rows
                count = np.bincount(owner, minlength=n).astype(np.int64)
                first = np.cumsum(count) - count
                marks = np.zeros(len(starts) + 1, np.int64)
                items: dict[int, set[str]] = {}
                if part.num_columns > 2:  # of the blocks before this one
                    for d, (spans, found) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                        if spans:
                            items[d] = set(found)
                            for a, b in spans:
                                marks[first[d] + a] += 1
                                marks[first[d] + b] -= 1
                for table in tables:
                    for begin, k in table.search(low, starts, ends, hashes, first, count):
                        marks[begin] += 1
                        marks[begin + table.m] -= 1
                        items.setdefault(int(owner[begin]), set()).update(names[i] for i in table.items_of(k) if names[i] is not None)
                hit = np.cumsum(marks[:-1]) > 0
                spans = {}
                for d in items:
                    h = np.concatenate(([0], hit[first[d] : first[d] + count[d]].astype(np.int8), [0]))
                    spans[d] = np.flatnonzero(np.diff(h)).reshape(-1, 2).tolist()
                found = [pa.array([spans.get(i, []) for i in range(n)], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.string()))]
                if keep_text:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], names=["doc_id", "text", "spans", "items"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(count, pa.int64()), *found], names=HITS.names)

    return run


def _pattern_blocks(benchmark: DataFrame, block_bytes: int):
    """The item texts in blocks of about `block_bytes`, fetched one at a time; items are dealt out by hash."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = -(-total // block_bytes)
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [tuple(r) for r in block.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, spans (hit runs of words, end exclusive), items found."""
    spark = docs.sparkSession
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = [spark.sparkContext.broadcast(Patterns(rows, window)) for rows in _pattern_blocks(benchmark, block_bytes)]
    # a row passes from block to block within its task, so nothing is joined and rows are told apart without a key
    for patterns in held[:-1]:
        out = out.mapInArrow(_scan(patterns, True), "doc_id long, text string, spans array<array<bigint>>, items array<string>")
    return out.mapInArrow(_scan(held[-1] if held else None, False), HITS)


def summary(hits: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any hit word, with all their columns; the text is searched in place, so nothing is joined."""
    out = docs
    for rows in _pattern_blocks(benchmark, block_bytes):
        out = out.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(Patterns(rows, window))), out.schema)
    return out


def _clean(patterns):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            k = batch.schema.get_field_index("text")
            for part in text_slices(batch):
                low, off, starts, ends, owner, hashes = words_of(part.column(k), WORD)
                count = np.bincount(owner, minlength=part.num_rows).astype(np.int64)
                first = np.cumsum(count) - count
                keep = np.ones(part.num_rows, bool)
                for table in patterns.value.tables:
                    for begin, _ in table.search(low, starts, ends, hashes, first, count):
                        keep[owner[begin]] = False
                yield part if keep.all() else part.filter(pa.array(keep))

    return run


def brute_force(doc: str | None, items: dict, window: int = WINDOW) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items of one text, by comparing every window at every place."""
    words = _WORDS.findall((doc or "").translate(_ASCII_LOWER))
    hit, found = set(), set()
    for item, text in items.items():
        for w in item_windows(text, window):
            w = [x.decode() for x in w]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
