"""Exact dedup with Patricia-trie owners.

Texts are equal when their bytes are equal after deleting every character of [\\x20\\x09-\\x0D].
Every task inserts its normalised texts into a compressed radix trie whose terminal nodes hold the
smallest owner seen (most code points in the original text, then smallest doc_id) and a count, so a
group of copies leaves a task as one string, however large it is. The strings are dealt out by length
and content hash, and each receiving task inserts them into tries again, one subtree for each slice of
the hash; a subtree is written out as soon as its slice has passed and the tries exceed their memory.
Membership is a join of (length, hash) keys, never a list of members.

Null counts as empty. Empty texts are equal to each other and to texts of white space only. Of rows
with the same doc_id and equal texts each is reported, with the same owner. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, text_slices

SPACE = b" \t\n\x0b\x0c\r"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Text bytes that a trie holds before finished subtrees are written out.
TRIE_BYTES = 48 << 20


class PatriciaOwners:
    """A compressed radix trie over byte strings. A node is [label, children by first byte, value]."""

    def __init__(self):
        self.root = [b"", {}, None]
        self.held = 0

    def insert(self, key: bytes, owner: tuple, count: int) -> None:
        """owner: smaller is better; counts of equal keys add up."""
        node, at, n = self.root, 0, len(key)
        while at < n:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, (owner, count)]
                self.held += n - at
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = self._common(label, key, at)
            # the edge splits where the strings part
            upper = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][key[at]] = upper
            node, at = upper, at + same
        old = node[2]
        node[2] = (owner, count) if old is None else (min(owner, old[0]), count + old[1])

    @staticmethod
    def _common(label: bytes, key: bytes, at: int) -> int:
        lo, hi = 0, min(len(label), len(key) - at)
        while lo < hi:  # bisection over slices that C compares
            mid = (lo + hi + 1) // 2
            if key.startswith(label[:mid], at):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def items(self):
        stack = [(b"", self.root)]
        while stack:
            prefix, (label, children, value) = stack.pop()
            here = prefix + label
            if value is not None:
                yield here, *value
            stack.extend((here, c) for c in children.values())


_LOCAL = "n_bytes long, digest binary, body binary, chars long, doc_id long, n long"
_OWNERS = "n_bytes long, digest binary, keep_id long, group_size long"


def _batch(rows, names):
    import pyarrow as pa

    kinds = {"n_bytes": pa.int64(), "digest": pa.binary(), "body": pa.binary(), "chars": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64()}
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, cols, strict=True)], names=names)


def _chunks(rows, names, size_at):
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 64 + (len(r[size_at]) if size_at is not None else 0)
        if size > SLICE_BYTES:
            yield _batch(out, names)
            out, size = [], 0
    if out:
        yield _batch(out, names)


def _order(doc_id):
    return (doc_id is None, doc_id or 0)


def _gather(batches):
    """Collapses the copies within a task."""
    names = ["n_bytes", "digest", "body", "chars", "doc_id", "n"]

    def flush(trie):
        return ((len(b), hashlib.sha256(b).digest(), b, -owner[0], None if owner[1][0] else owner[1][1], n) for b, owner, n in trie.items())

    trie = PatriciaOwners()
    for batch in batches:
        for part in text_slices(batch):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = text or ""
                trie.insert(text.encode().translate(None, SPACE), (-len(text), _order(doc_id)), 1)
            if trie.held > TRIE_BYTES:
                yield from _chunks(flush(trie), names, 2)
                trie = PatriciaOwners()
    yield from _chunks(flush(trie), names, 2)


def _own(batches):
    """Final owners. Rows come sorted by (n_bytes, digest), so copies are neighbours, and a trie that is full can be written out
    between any two texts: what follows belongs to other subtrees of its (length, hash) partition."""
    names = ["n_bytes", "digest", "keep_id", "group_size"]

    def flush(trie):
        return ((len(b), hashlib.sha256(b).digest(), None if owner[1][0] else owner[1][1], n) for b, owner, n in trie.items())

    trie, last = PatriciaOwners(), None
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        for n_bytes, digest, body, chars, doc_id, n in zip(*cols, strict=True):
            part = (n_bytes, digest)
            if part != last and trie.held > TRIE_BYTES:
                yield from _chunks(flush(trie), names, None)
                trie = PatriciaOwners()
            last = part
            trie.insert(body, (-chars, _order(doc_id)), n)
    yield from _chunks(flush(trie), names, None)


def owners(docs: DataFrame) -> DataFrame:
    """One row for each distinct normalised text: n_bytes, digest (SHA-256), keep_id, group_size."""
    local = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_gather, _LOCAL)
    return local.repartition("n_bytes", "digest").sortWithinPartitions("n_bytes", "digest").mapInArrow(_own, _OWNERS)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Each document with the row of its group that stays, the group's size and the text's hash."""
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _SPACE_CHARS, ""), 256).alias("text_sha256"),
    )
    shared = owners(docs).where("group_size > 1").select(F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size", F.lit(True).alias("shared"))
    joined = keys.join(shared, "text_sha256", "left")
    keep = F.when(F.col("shared"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
