"""Token ids in a binary format coded with a static range asymmetric numeral system (rANS).

All blocks share one frequency table, counted over all ids and scaled to 2**`bits`, so that blocks are
independent. Within a block `LANES` coder states are interleaved: id i belongs to lane i mod LANES.
Every `CHECK_STEPS` steps a checkpoint holds the states and the place in the words, so a block can be
decoded from any checkpoint, and all stretches between checkpoints at once. A checksum covers the ids
of each block and another the block's bytes; decoding raises on a mismatch.

A block holds whole documents, in ascending doc_id order, and lists them with their lengths, under a
checksum of its own; lengths and not end ids delimit documents, as an end id may be an ordinary id as well.

The files: `table` holds the counts that the frequency table is made of, with a checksum; `blocks` holds
the blocks, each with the checksum of the table that codes it. `read_tokens` needs the folder alone.

Null text counts as empty, so it has the end id only. Null doc_ids come first. Rows with equal doc_ids
stand next to each other in any order. A very long text is a block of its own. Other columns are ignored.
An empty table gives no blocks.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, release, shuffle_partitions, text_slices

LANES = 64
CHECK_STEPS = 256
BLOCK_IDS = 1 << 16
MAGIC, DOCS_MAGIC, VERSION = b"QANS", b"QDOC", 1
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4sHHIIIIII")  # magic, version, lanes, ids, steps, checkpoints, words, crc of ids, crc of the rest
NO_ID = -(1 << 63)


# --------------------------------------------------------------------------- the coder


class Frequencies:
    """Counts scaled to a power of two, at least 1 for every id that occurs."""

    def __init__(self, counts: np.ndarray):
        self.crc = zlib.crc32(np.asarray(counts, "<i8").tobytes())
        counts = np.asarray(counts, np.float64)
        used = int((counts > 0).sum())
        self.bits = max(12, min(24, int(np.ceil(np.log2(max(used, 1)))) + 4))
        total = 1 << self.bits
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * total / max(counts.sum(), 1))), 0).astype(np.int64)
        spare = total - int(freq.sum())
        if used:
            order = np.argsort(-freq, kind="stable")[:used]
            if spare > 0:
                freq[order[0]] += spare
            while spare < 0:  # taken from the largest, which lose least
                take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * -spare // total))
                upto = np.cumsum(take)
                take = np.where(upto <= -spare, take, np.maximum(0, take - (upto + spare)))
                freq[order] -= take
                spare += int(take.sum())
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_blocks(blocks: list[np.ndarray], table: Frequencies) -> list[bytes]:
    """Codes blocks of ids, all at once where their numbers of steps allow."""
    steps = [max(1, -(-len(b) // LANES)) for b in blocks]
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: steps[i])
    at = 0
    while at < len(order):
        group = [order[at]]
        while at + len(group) < len(order) and steps[order[at + len(group)]] <= 1.25 * steps[group[0]] + 8:
            group.append(order[at + len(group)])
        at += len(group)
        for i, coded in zip(group, _encode_group([blocks[i] for i in group], table), strict=True):
            out[i] = coded
    return out


def _encode_group(blocks: list[np.ndarray], table: Frequencies) -> list[bytes]:
    n_steps = np.array([max(1, -(-len(b) // LANES)) for b in blocks])
    top, nb = int(n_steps.max()), len(blocks)
    ids = np.zeros((nb, top * LANES), np.uint32)
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
        if len(b):
            ids[i, len(b) :] = b[-1]  # padding that the count leaves out
    ids = ids.reshape(nb, top, LANES)
    x = np.full((nb, LANES), _LOW, np.uint64)
    words = np.zeros((top, nb, LANES), np.uint32)
    sent = np.zeros((top, nb, LANES), bool)
    marks: dict[int, np.ndarray] = {}
    limit, bits = np.uint64(63 - table.bits), np.uint64(table.bits)
    for t in range(top - 1, -1, -1):
        live = (n_steps > t)[:, None]
        s = ids[:, t]
        f, c = table.freq[s], table.start[s]
        full = (x >= (f << limit)) & live
        words[t] = x.astype(np.uint32)
        sent[t] = full
        y = np.where(full, x >> _WORD, x)
        f1 = np.maximum(f, np.uint64(1))
        q = y // f1
        x = np.where(live, (q << bits) + c + (y - q * f1), x)
        if t % CHECK_STEPS == 0:
            marks[t] = x
    before = np.zeros((top + 1, nb), np.int64)
    np.cumsum(sent.sum(axis=2), axis=0, out=before[1:])
    out = []
    for i, b in enumerate(blocks):
        own = words[: n_steps[i], i][sent[: n_steps[i], i]].astype("<u4")
        points = [t for t in sorted(marks) if t < n_steps[i]]
        body = b"".join(struct.pack("<II", t, before[t, i]) + marks[t][i].astype("<u8").tobytes() for t in points) + own.tobytes()
        out.append(_HEAD.pack(MAGIC, VERSION, LANES, len(b), n_steps[i], len(points), len(own), zlib.crc32(b.astype("<u4").tobytes()), zlib.crc32(body)) + body)
    return out


def decode_blocks(coded: list[bytes], table: Frequencies) -> list[np.ndarray]:
    """The ids of each block; every stretch between checkpoints is decoded side by side with the others."""
    heads, states, places, stretch_of, first_step, n_steps, streams = [], [], [], [], [], [], []
    base = 0
    for i, raw in enumerate(coded):
        magic, version, lanes, n, steps, points, n_words, ids_crc, body_crc = _HEAD.unpack_from(raw)
        body = raw[_HEAD.size :]
        if magic != MAGIC or version != VERSION or lanes != LANES or zlib.crc32(body) != body_crc:
            raise ValueError("damaged block")
        heads.append((n, steps, ids_crc))
        size = 8 + 8 * LANES
        for k in range(points):
            t, place = struct.unpack_from("<II", body, k * size)
            states.append(np.frombuffer(body, "<u8", LANES, k * size + 8))
            places.append(base + place)
            stretch_of.append(i)
            first_step.append(t)
            n_steps.append(min(CHECK_STEPS, steps - t))
        streams.append(np.frombuffer(body, "<u4", n_words, points * size))
        base += n_words
    if not coded:
        return []
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    x = np.array(states, np.uint64)
    place = np.array(places, np.int64)
    todo = np.array(n_steps)
    top = int(todo.max())
    out = np.zeros((len(x), top, LANES), np.uint32)
    mask, bits = np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    slots = table.slots
    for t in range(top):
        live = todo > t
        slot = x & mask
        s = slots[slot.astype(np.int64)]
        out[:, t] = s
        y = table.freq[s] * (x >> bits) + slot - table.start[s]
        need = (y < _LOW) & live[:, None]
        at = place[:, None] + np.cumsum(need, axis=1) - 1
        y = np.where(need, (y << _WORD) | stream[np.where(need, at, 0)], y)
        x = np.where(live[:, None], y, x)
        place = place + need.sum(axis=1)
    parts: list[list[np.ndarray]] = [[] for _ in coded]
    for k, i in enumerate(stretch_of):
        parts[i].append(out[k, : n_steps[k]].reshape(-1))
    found = []
    for (n, _, ids_crc), p in zip(heads, parts, strict=True):
        ids = np.concatenate(p)[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise ValueError("checksum of ids differs")
        found.append(ids)
    return found


_DOCS = struct.Struct("<4sIIII")  # magic, documents, bytes of their list, crc of the list, crc of the table


def pack_block(ids: list, lengths: list[int], coded: bytes, table_crc: int) -> bytes:
    """A block of the files: its documents (ids, which of them are null, lengths), then the coded ids."""
    known = np.array([i is not None for i in ids], np.uint8)
    raw = np.array([i or 0 for i in ids], "<i8").tobytes() + known.tobytes() + np.array(lengths, "<u4").tobytes()
    raw = zlib.compress(raw, 1)
    return _DOCS.pack(DOCS_MAGIC, len(ids), len(raw), zlib.crc32(raw), table_crc) + raw + coded


def unpack_block(block: bytes, table_crc: int) -> tuple[list, list[int], bytes]:
    magic, n, size, crc, table = _DOCS.unpack_from(block)
    raw = block[_DOCS.size : _DOCS.size + size]
    if magic != DOCS_MAGIC or zlib.crc32(raw) != crc:
        raise ValueError("damaged list of documents")
    if table != table_crc:
        raise ValueError("the block was coded with another table")
    raw = zlib.decompress(raw)
    ids, known = np.frombuffer(raw, "<i8", n).tolist(), np.frombuffer(raw, np.uint8, n, 8 * n)
    return [i if k else None for i, k in zip(ids, known, strict=True)], np.frombuffer(raw, "<u4", n, 9 * n).tolist(), block[_DOCS.size + size :]


# --------------------------------------------------------------------------- ids of texts

# The file's pattern over U+0000-U+00FF, where Python and the library agree on every class.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^ \t-\r{_LETTER}{_NUMBER}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
# In U+0000-U+00FF, the characters that only one of the two takes for white space.
_DOUBTFUL = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\x85", b"\xa0")


def plain(text: str) -> bool:
    """Whether all of a text lies in U+0000-U+00FF without doubtful characters or marks of special tokens."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text and not any(c in raw for c in _DOUBTFUL)


CACHE = 1_000_000


class _Memory(dict):
    """Ids of pre-tokens, as bytes; what wasn't asked for in the last half of the cache's size is forgotten."""

    def __init__(self, tokenize):
        super().__init__()
        self.tokenize, self.old = tokenize, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE // 2:
            self.old = dict(self)
            self.clear()
        found = self.old.get(piece)
        self[piece] = found = self.tokenize(piece) if found is None else found
        return found


class ByteTokenizer:
    """Ids by the tokenizers library. Pre-tokens are found with the file's pattern where its classes are beyond doubt,
    the library's model encodes each once, and its answer is remembered; all other texts go to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from .bpe import byte_alphabet

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.alphabet = byte_alphabet()
        self.known = _Memory(self.piece)

    def piece(self, piece: str) -> bytes:
        tokens = self.model.tokenize("".join(map(self.alphabet.__getitem__, piece.encode())))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def encode(self, text: str) -> bytes:
        if not plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, _PIECES.findall(text)))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


_tokenizers: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """One for each file in the worker's life, so that what it remembers serves later tasks too."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def _tokenize(path: str, end_id: int, cuts: list[int]):
    """part (how many cuts are smaller than the doc_id), doc_id, number of ids and ids of each text."""

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t, end = tokenizer(path), struct.pack("<I", end_id)
        for batch in batches:
            for part in text_slices(batch):
                ids = [b + end for b in t.encode_batch([x or "" for x in part.column(1).to_pylist()])]
                packed = [_pack(np.frombuffer(b, "<u4")) for b in ids]
                doc = part.column(0).cast(pa.int64())
                to = np.searchsorted(np.array(cuts, np.int64), np.asarray(doc.fill_null(NO_ID)), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(to), doc, pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(packed, pa.binary())], names=["part", "doc_id", "n", "ids"])

    return run


def _pack(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four, with a leading mark."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1)


def _count(size: int):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        held, n = [], 0

        def add():
            nonlocal total
            ids = np.concatenate(held)
            more = np.bincount(ids, minlength=len(total))
            total = more + np.pad(total, (0, len(more) - len(total)))

        for batch in batches:
            for raw in batch.column(0):
                held.append(_unpack(raw.as_buffer()))
                n += len(held[-1])
                if n > 1 << 20:  # a count of all ids for each text would cost more than the texts
                    add()
                    held, n = [], 0
        if held:
            add()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return run


def _encode(counts):
    def run(batches):
        import pyarrow as pa

        table = Frequencies(counts.value)
        names = ["part", "first_id", "last_id", "ordinal", "n_ids", "payload"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        pending, held, ordinal = [], 0, 0
        part, docs, lengths, parts, size = None, [], [], [], 0

        def close():
            nonlocal docs, lengths, parts, size, held
            if docs:
                pending.append((part, docs, lengths, np.concatenate(parts)))
                held += size
            docs, lengths, parts, size = [], [], [], 0

        def flush():
            nonlocal pending, held, ordinal
            rows = []
            for (p, d, n, ids), raw in zip(pending, encode_blocks([x[3] for x in pending], table), strict=True):
                key = [NO_ID if i is None else i for i in (d[0], d[-1])]
                rows.append((p, *key, ordinal, len(ids), pack_block(d, n, raw, table.crc)))
                ordinal += 1
            pending, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for p, doc, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                key = NO_ID if doc is None else doc
                if size >= BLOCK_IDS or (docs and (p != part or key < (NO_ID if docs[-1] is None else docs[-1]))):
                    close()
                    if held >= 48 * BLOCK_IDS:
                        yield flush()
                part = p
                docs.append(doc)
                lengths.append(n)
                parts.append(_unpack(raw.as_buffer().to_pybytes()))
                size += n
        close()
        if pending:
            yield flush()

    return run


BLOCKS = "part int, first_id long, last_id long, ordinal long, n_ids long, payload binary"
TABLE = "id int, n long, crc long"


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0, parts: int | None = None, to: str | None = None) -> str:
    """Encodes all texts with the tokenizer file at `path`; returns the folder of the files (`to`, or one in the shared folder)."""
    stage = Stage(spark, "tokens")
    to = (to or f"{stage.base}/files").rstrip("/")
    parts = parts or max(2, 2 * shuffle_partitions(spark))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = text.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})
    tokens = text.mapInArrow(_tokenize(path, end_id, cuts), "part int, doc_id long, n long, ids binary")
    ordered = tokens.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "doc_id")
    kept = stage.keep(ordered, "ids")
    del ordered
    release(spark)
    size = 1 << 16
    rows = kept.select("ids").mapInArrow(_count(size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row an id of the vocabulary
    counts = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    crc = Frequencies(counts).crc
    spark.createDataFrame([(int(i), int(counts[i]), crc) for i in np.flatnonzero(counts)], TABLE).coalesce(1).write.mode("overwrite").parquet(f"{to}/table")
    kept.mapInArrow(_encode(spark.sparkContext.broadcast(counts)), BLOCKS).write.mode("overwrite").parquet(f"{to}/blocks")
    stage.drop("ids")
    return to


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """The counts of the files' table, one row an id of the vocabulary, held against their checksum."""
    rows = spark.read.schema(TABLE).parquet(f"{path}/table").collect()
    counts = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    if any(r["crc"] != Frequencies(counts).crc for r in rows[:1]):
        raise ValueError("damaged table")
    return counts


def _decode(counts):
    def run(batches):
        import pyarrow as pa

        table = Frequencies(counts.value)
        kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
        for batch in batches:
            n = batch.num_rows
            for at in range(0, n, 16):
                rows = batch.slice(at, min(16, n - at))
                blocks = [unpack_block(r.as_buffer().to_pybytes(), table.crc) for r in rows.column(4)]
                ids = decode_blocks([x[2] for x in blocks], table)
                out = [[], [], [], [], [], [], [], []]
                for k, (docs, lengths, _) in enumerate(blocks):
                    key = [rows.column(c)[k].as_py() for c in range(4)]
                    begin = 0
                    for doc, length in zip(docs, lengths, strict=True):
                        own = ids[k][begin : begin + length].astype("<u4").tobytes()
                        for c, v in zip(out, (*key, begin, doc, length, own), strict=True):
                            c.append(v)
                        begin += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["part", "first_id", "last_id", "ordinal", "begin", "doc_id", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document's ids from the files: doc_id, ids (little-endian unsigned 32-bit), n_tokens and start.

    A block's start comes from the ids of the blocks before it in its part, and of the parts before that.
    """
    blocks, counts = spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), read_table(spark, path)
    key = ["part", "first_id", "last_id", "ordinal"]
    before = Window.partitionBy("part").orderBy("first_id", "last_id", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select(*key, "n_ids").withColumn("in_part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    totals = sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row a part
    starts, total = [], 0
    for r in totals:
        starts.append((r["part"], total))
        total += r["n"]
    bases = spark.createDataFrame(starts, "part int, base long")
    docs = blocks.select(*key, "payload").mapInArrow(_decode(spark.sparkContext.broadcast(counts)), "part int, first_id long, last_id long, ordinal long, begin long, doc_id long, n_tokens long, ids binary")
    place = index.join(F.broadcast(bases), "part").select(*key, (F.col("base") + F.col("in_part")).alias("block_start"))
    return docs.withColumn("ids_crc32", F.crc32("ids")).join(place, key).select("doc_id", (F.col("block_start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", "ids")
