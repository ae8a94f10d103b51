"""Suffix-array dedup of byte strings, built column by column over collections of aligned strings.

Every byte covered by a string of `window` bytes that also starts earlier (smaller doc_id, or same
document and earlier start) is removed; strings never cross documents and are judged on the input.

A window belongs to its anchor, the k-byte string of least hash in it. Equal windows have equal anchors
at equal offsets, so the suffixes that matter can be sorted apart for each anchor: its occurrences, with
the bytes of their windows, form one collection of short strings aligned at the anchor.

1. Texts are packed into slices of about 2 MB, written once.
2. Each slice emits the hashes of its anchors, once for identical surroundings; what occurs once
   anywhere else drops out here, which is nearly all of an unrepetitive corpus.
3. The surroundings of repeated anchors are dealt out by anchor. A task inserts one symbol a string
   each round, from the last column to the first: the order of the suffixes (whose preceding symbols
   are the collection's Burrows-Wheeler transform) is stably sorted by the new symbol, and the common
   prefixes of neighbours are updated from the least since the symbol's last occurrence. After each
   round the intervals with common prefixes of `window` bytes are the equal windows; all but the
   earliest are covered. Only the last column's order and prefixes are held, and columns are read in
   sequence. An anchor with very many occurrences is dealt out by whole windows instead, so equal
   surroundings meet and different ones spread.
4. Covered stretches go back to their slices, where overlaps are joined.

Null and empty texts have no bytes, and texts shorter than the window lose none. Rows with equal
doc_ids are told apart by their slice and place, so of wholly repeated rows all but one lose their
windows, however they are dealt out over partitions. Null doc_ids sort first. A very long text is a
slice of its own, searched for anchors in stretches. An empty table gives no rows. Other columns are
ignored. Surroundings are compared by 64-bit hash within a slice and byte by byte across slices.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _MIX, SLICE_BYTES, Stage, mix64, powers, release, shuffle_partitions, text_bytes, text_slices

WINDOW = 100
ANCHOR = 40
#: Occurrences of an anchor, after each slice's copies are joined, from which its windows are dealt out one by one.
HOT = 8192
#: Text bytes for which there is one bucket of anchors.
BUCKET_BYTES = 16 << 20
_POS = np.uint64((1 << 24) - 1)
_NO_ID = -(1 << 63)


# --------------------------------------------------------------------------- anchors of a slice


def anchors(buf: np.ndarray, off: np.ndarray, window: int, k: int):
    """For each anchor: place, first and last window start that it serves, text, hash, hash of its surroundings."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_MIX[buf] * p[:-1], out=sums[1:])
    h = mix64((sums[k:] - sums[:-k]) * q[: n - k + 1])
    found = []
    # places fit 24 bits, so a longer slice (one long text) is taken in overlapping stretches
    step = 1 << 23
    for base in range(0, n - window + 1, step):
        part = h[base : base + step + window - k]
        least = (part & ~_POS) | np.arange(len(part), dtype=np.uint64)
        width = 1
        span = window - k + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        found.append((least[: min(step, n - window + 1 - base)] & _POS).astype(np.int64) + base)
    at = np.concatenate(found)  # anchor of the window that starts here
    text = np.searchsorted(off, np.arange(len(at)), side="right") - 1
    starts = np.flatnonzero(np.arange(len(at)) + window <= off[text + 1])
    if not len(starts):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    a = at[starts]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, place = starts[first], starts[np.append(first[1:], len(a)) - 1], a[first]
    around = mix64((sums[hi + window] - sums[lo]) * q[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (place - lo).astype(np.uint64))
    return place, lo, hi, text[lo], h[place], around


def first_of_copies(around: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each item whether it is the first, by rank, of those with equal surroundings."""
    order = np.lexsort((rank, around))
    first = np.ones(len(order), bool)
    first[1:] = around[order][1:] != around[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[first]] = True
    return out


class Slice:
    """The documents of a slice, decoded; ids order texts, so rank orders places."""

    def __init__(self, raw: bytes, ids: list[int], lengths: list[int], window: int, k: int):
        import zstandard

        self.ids = np.array(ids, np.int64)
        self.off = np.concatenate(([0], np.cumsum(np.array(lengths, np.int64))))
        size = int(self.off[-1])
        self.buf = np.frombuffer(zstandard.decompress(raw, max_output_size=max(size, 1)), np.uint8) if size else np.zeros(0, np.uint8)
        self.place, self.lo, self.hi, self.text, self.hash, self.around = anchors(self.buf, self.off, window, k)
        order = np.argsort(self.ids, kind="stable")
        by_id = np.empty(len(order), np.int64)
        by_id[order] = np.arange(len(order))
        self.first = first_of_copies(self.around, by_id[self.text] * (1 << 40) + self.place)


SLICES = "slice long, ids array<long>, nulls array<boolean>, lengths array<long>, raw binary, size long"


def _pack(batches):
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    z = zstandard.ZstdCompressor(level=3)
    name = (TaskContext.get().partitionId() << 32) - 1  # the table is written once, so names stand even if a task runs again
    for batch in batches:
        for part in text_slices(batch, limit=SLICE_BYTES):
            buf, off = text_bytes(part.column(1))
            ids = part.column(0).to_pylist()
            raw = buf.tobytes()
            keys = [_NO_ID if i is None else i for i in ids]
            name += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.int64()),
                    pa.array([keys], pa.list_(pa.int64())),
                    pa.array([[i is None for i in ids]], pa.list_(pa.bool_())),
                    pa.array([np.diff(off).tolist()], pa.list_(pa.int64())),
                    pa.array([z.compress(raw)], pa.binary()),
                    pa.array([len(raw)], pa.int64()),
                ],
                names=["slice", "ids", "nulls", "lengths", "raw", "size"],
            )


def _read(batch, i, window, k) -> Slice:
    get = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
    return Slice(get["raw"].as_buffer().to_pybytes(), get["ids"].as_py(), get["lengths"].as_py(), window, k)


# --------------------------------------------------------------------------- repeated anchors


def _post(window: int, k: int, buckets: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                s = _read(batch, i, window, k)
                own = np.flatnonzero(s.first)
                h, place = s.hash[own], s.place[own]
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(np.diff(cuts))
                hs, ps = h[order].astype("<u8"), place[order].astype("<u4")
                name = batch.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)),
                        pa.array([name] * len(used), pa.int64()),
                        pa.array([hs[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()),
                        pa.array([ps[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()),
                    ],
                    names=["bucket", "slice", "hashes", "places"],
                )

    return run


def _repeated(hot: int):
    def run(key, table):
        import pyarrow as pa

        hs = [np.frombuffer(x.as_buffer().to_pybytes(), "<u8") for x in table.column("hashes")]
        ps = [np.frombuffer(x.as_buffer().to_pybytes(), "<u4") for x in table.column("places")]
        sizes = np.array([len(x) for x in hs])
        h = np.concatenate(hs)
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        many = times[back]
        keep = many > 1
        marked = np.concatenate(ps).astype(np.uint64) * np.uint64(2) + (many > hot).astype(np.uint64)
        ends = np.cumsum(sizes)
        rows = [(name, marked[e - n : e][keep[e - n : e]].astype("<u8").tobytes()) for name, e, n in zip(table.column("slice").to_pylist(), ends, sizes, strict=True) if keep[e - n : e].any()]
        return pa.table({"slice": pa.array([a for a, _ in rows], pa.int64()), "marked": pa.array([b for _, b in rows], pa.binary())})

    return run


# --------------------------------------------------------------------------- collections

_ITEM = "<QqIHHH"  # key, doc_id, place of the anchor, bytes before it, windows, length


def _surroundings(window: int, k: int, buckets: int):
    """The strings of a slice's repeated anchors, by bucket."""

    def run(key, left, right):
        import pyarrow as pa
        import zstandard

        names = {"bucket": pa.int32(), "slice": pa.int64(), "items": pa.binary(), "bodies": pa.binary(), "n": pa.int64()}
        if not right.num_rows or not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        s = _read(left.combine_chunks().to_batches()[0], 0, window, k)
        marked = np.concatenate([np.frombuffer(x.as_buffer().to_pybytes(), "<u8") for x in right.column("marked")])
        wanted = dict(zip((marked >> np.uint64(1)).tolist(), (marked & np.uint64(1)).tolist(), strict=True))
        out: dict[int, list] = {}
        ids = s.ids
        for a, lo, hi, t, h, own in zip(s.place.tolist(), s.lo.tolist(), s.hi.tolist(), s.text.tolist(), s.hash.tolist(), s.first.tolist(), strict=True):
            if not own or a not in wanted:
                continue
            doc = int(ids[t])
            if not wanted[a]:
                out.setdefault(h % buckets, []).append((struct.pack(_ITEM, h, doc, a, a - lo, hi - lo + 1, hi + window - lo), s.buf[lo : hi + window].tobytes()))
                continue
            for w in range(lo, hi + 1):
                body = s.buf[w : w + window].tobytes()
                name = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little")
                out.setdefault(name % buckets, []).append((struct.pack(_ITEM, name, doc, w, 0, 1, window), body))
        z = zstandard.ZstdCompressor(level=3)
        rows = [(b, z.compress(b"".join(x for x, _ in v)), z.compress(b"".join(y for _, y in v)), len(v)) for b, v in out.items()]
        name = left.column("slice")[0].as_py()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "slice": pa.array([name] * len(rows), pa.int64()), "items": pa.array([r[1] for r in rows], pa.binary()), "bodies": pa.array([r[2] for r in rows], pa.binary()), "n": pa.array([r[3] for r in rows], pa.int64())})

    return run


def covered_windows(group: np.ndarray, columns: np.ndarray, known: np.ndarray, n_starts: int, window: int) -> np.ndarray:
    """For strings sorted by group and place: which windows also start earlier in their group.

    columns[j] holds the symbols of column j, known[j] whether the string reaches there. Returns a table of
    n_starts columns. One symbol is inserted a round, from the last column on; `order` sorts the suffixes
    that begin in the column within their groups, `common[i]` is the prefix shared with the one before.
    """
    n = len(group)
    order = np.arange(n)
    common = np.zeros(n, np.int16)
    covered = np.zeros((n_starts, n), bool)
    same_group = np.zeros(n, bool)
    same_group[1:] = group[1:] == group[:-1]
    base = group.astype(np.int64) << 9
    for j in range(len(columns) - 1, -1, -1):
        symbol, here = columns[j][order].astype(np.int64), known[j][order]
        key = base + np.where(here, symbol + 1, 0)  # groups stay where they are, so base needs no reordering
        if (key[1:] >= key[:-1]).all():
            least = common
            sorted_key, sorted_here = key, here
        else:
            to = np.argsort(key, kind="stable")
            sorted_key, sorted_here = key[to], here[to]
            least = common[to].copy()
            # neighbours that others parted: the least common prefix since the symbol's last occurrence
            apart = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (to[1:] != to[:-1] + 1)) + 1
            if len(apart):
                begin, end = to[apart - 1] + 1, to[apart] + 1
                size = end - begin
                heads = np.cumsum(size) - size
                flat = np.arange(size.sum()) - np.repeat(heads, size) + np.repeat(begin, size)
                least[apart] = np.minimum.reduceat(common[flat], heads)
            order = order[to]
        match = np.zeros(n, bool)
        match[1:] = (sorted_key[1:] == sorted_key[:-1]) & sorted_here[1:]
        common = np.where(match, np.minimum(least + 1, window), 0).astype(np.int16)
        if j < n_starts:
            equal = common >= window
            if equal.any():
                run = np.flatnonzero(~equal)
                owner = np.minimum.reduceat(order, run)
                size = np.diff(np.append(run, n))
                mine = np.repeat(owner, size)
                covered[j, order[(order != mine)]] = True
    return covered


def _collect(window: int, k: int):
    lead = window - k

    def run(key, table):
        import pyarrow as pa
        import zstandard

        kind = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("before", "<u2"), ("starts", "<u2"), ("size", "<u2")])
        none = pa.table({"slice": pa.array([], pa.int64()), "spans": pa.array([], pa.binary())})
        items, bodies, owner = [], [], []
        names = table.column("slice").to_pylist()
        for i in range(table.num_rows):
            it = np.frombuffer(zstandard.decompress(table.column("items")[i].as_buffer().to_pybytes(), max_output_size=1 << 31), kind)
            items.append(it)
            bodies.append(zstandard.decompress(table.column("bodies")[i].as_buffer().to_pybytes(), max_output_size=1 << 31))
            owner.append(np.full(len(it), i))
        it, who = np.concatenate(items), np.concatenate(owner)
        data = np.frombuffer(b"".join(bodies), np.uint8)
        where = np.cumsum(it["size"].astype(np.int64)) - it["size"]
        slice_rank = np.argsort(np.argsort(np.array(names)))
        order = np.lexsort((it["at"], slice_rank[who], it["doc"], it["key"]))
        it, who, where = it[order], who[order], where[order]
        alone = np.ones(len(it), bool)
        alone[1:] &= it["key"][1:] != it["key"][:-1]
        alone[:-1] &= it["key"][1:] != it["key"][:-1]
        it, who, where = it[~alone], who[~alone], where[~alone]
        if not len(it):
            return none
        group = np.cumsum(np.append(True, it["key"][1:] != it["key"][:-1])) - 1
        n = len(it)
        before, size = it["before"].astype(np.int64), it["size"].astype(np.int64)
        width = int(lead + (size - before).max())
        columns = np.zeros((width, n), np.uint8)
        known = np.zeros((width, n), bool)
        for j in range(width):
            at = j - lead + before
            ok = (at >= 0) & (at < size)
            known[j] = ok
            columns[j, ok] = data[where[ok] + at[ok]]
        covered = covered_windows(group, columns, known, lead + 1, window)
        # runs of covered window starts of each string, as stretches of bytes
        edge = np.zeros((lead + 3, n), np.int8)
        edge[1:-1] = covered
        step = np.diff(edge, axis=0)
        s_row, s_j = np.nonzero((step == 1).T)
        _, e_j = np.nonzero((step == -1).T)
        start = it["at"][s_row].astype(np.int64) - lead + s_j
        end = it["at"][s_row].astype(np.int64) - lead + e_j - 1 + window
        who = who[s_row]
        order = np.argsort(who, kind="stable")
        cuts = np.searchsorted(who[order], np.arange(len(names) + 1))
        flat = np.stack([start[order], end[order]], axis=1).astype("<u4")
        rows = [(names[i], flat[cuts[i] : cuts[i + 1]].tobytes()) for i in range(len(names)) if cuts[i + 1] > cuts[i]]
        return pa.table({"slice": pa.array([a for a, _ in rows], pa.int64()), "spans": pa.array([b for _, b in rows], pa.binary())})

    return run


RESULT = "doc_id long, n_bytes long, spans array<array<bigint>>, kept binary"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(window: int, k: int, digest: bool):
    def run(key, left, right):
        import pyarrow as pa

        out: list[tuple] = []
        batches = left.combine_chunks().to_batches()
        for batch in batches:
            for i in range(batch.num_rows):
                s = _read(batch, i, window, k)
                marks = np.zeros(len(s.buf) + 1, np.int32)
                later = ~s.first
                np.add.at(marks, s.lo[later], 1)
                np.add.at(marks, s.hi[later] + window, -1)
                for x in right.column("spans"):
                    spans = np.frombuffer(x.as_buffer().to_pybytes(), "<u4").reshape(-1, 2)
                    np.add.at(marks, spans[:, 0], 1)
                    np.add.at(marks, spans[:, 1], -1)
                gone = np.cumsum(marks[:-1]) > 0
                nulls = batch.column(batch.schema.get_field_index("nulls"))[i].as_py()
                for d in range(len(s.ids)):
                    a, b = s.off[d], s.off[d + 1]
                    g = gone[a:b]
                    body = s.buf[a:b]
                    doc = None if nulls[d] else int(s.ids[d])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
                    kept = body[~g].tobytes() if len(edge) else body.tobytes()
                    if digest:
                        out.append((doc, len(body), len(body) - len(kept), len(edge) // 2, hashlib.sha256(kept).hexdigest()))
                    else:
                        out.append((doc, len(body), edge.reshape(-1, 2).tolist(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["doc_id", "n_bytes", "spans", "kept"]
        cols = list(zip(*out, strict=True)) or [[] for _ in names]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, kinds, strict=True)})

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, digest: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, end exclusive) and kept bytes; or their digests."""
    stage = Stage(spark, "suffix")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slices = stage.keep(text.mapInArrow(_pack, SLICES), "slices")
    total = slices.agg(F.sum("size")).first()[0] or 0
    buckets = int(max(2 * shuffle_partitions(spark), -(-total // BUCKET_BYTES)))
    posts = slices.mapInArrow(_post(window, k, buckets), "bucket int, slice long, hashes binary, places binary")
    marked = stage.keep(posts.groupBy("bucket").applyInArrow(_repeated(hot), "slice long, marked binary"), "marked")
    release(spark)
    strings = slices.groupBy("slice").cogroup(marked.groupBy("slice")).applyInArrow(_surroundings(window, k, buckets), "bucket int, slice long, items binary, bodies binary, n long")
    spans = stage.keep(strings.groupBy("bucket").applyInArrow(_collect(window, k), "slice long, spans binary"), "spans")
    stage.drop("marked")
    release(spark)
    return slices.groupBy("slice").cogroup(spans.groupBy("slice")).applyInArrow(_finish(window, k, digest), DIGEST if digest else RESULT)


def brute_force(texts: dict, window: int) -> dict:
    """doc_id -> (bytes removed, removed runs, bytes left), from the definition."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            else:
                seen.add(w)
        g = gone[:-1]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], g.view(np.int8), [0]))))
        out[i] = (int(g.sum()), len(edge) // 2, np.frombuffer(b, np.uint8)[~g].tobytes())
    return out
