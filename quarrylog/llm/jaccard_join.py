"""Exact n-gram Jaccard self-join: rare-first prefix filtering, then length, positional and suffix filters.

A document's set holds its distinct shingles of `width` words (words are runs of other than
[\\x20\\x09-\\x0D], A-Z lower-cased); a document with fewer words, but not none, has its whole sequence
as the one shingle; without words its set is empty and it is linked with nothing. Two documents link
when den * |intersection| >= num * |union|. Shingles are 64-bit hashes of word hashes; a vertex of the
join is a distinct set, named by a 128-bit hash, so exact copies never meet each other.

1. Texts are read once. Their shingles go, packed, to the hash range that each belongs to, and there all
   shingles of the corpus are counted, without a sketch and without a cap. What comes back to a slice of
   texts are the shingles that occur in two sets or more and their counts. Those that occur once are the
   rarest, so it is enough to know how many they are.
2. Each set's prefix of n - ceil(num * n / den) + 1 shingles in the order of counts, rarest first, gives
   postings. Two sets that link share a shingle of both prefixes, and such a shingle occurs twice.
3. Hub rounds: every shingle shared by several classes picks a few of its sets as hubs; a set is paired
   with one of each pick, of another class, under the length and positional filters and a bitmap filter.
   So a round makes `PICKS` pairs a set at most, however many near copies there are. Pairs are verified,
   classes joined, and shingles of one class leave. Another round follows only where what is left may
   make many more pairs than there are postings, and the last round was worth it.
4. Residual round: what is left of shingles is paired across classes only, by equal shingle and length
   band, under the same filters. No link between classes is lost; links within a class tell nothing.

The bitmap filter holds the parity of each set's shingles in 256 bits; sets differ in as many shingles at
least as their bitmaps do in bits, so it never rejects a link. Verification has a suffix filter and is exact.

Null or empty text: empty set, a component of its own. Rows with equal doc_ids are judged one by one,
repeated rows alike. A null doc_id takes part; a class's component_id is its smallest doc_id that is not
null. Ties go to the smaller doc_id. A very long text is a slice of its own. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NONSPACE, Stage, components, mix64, release, text_slices, words_of

WIDTH, NUM, DEN = 5, 8, 10
#: Text bytes for each range of shingle hashes that is counted by itself.
RANGE_BYTES = 8 << 20
#: Shingles that travel together from a task to the ranges.
PACK = 1 << 20
#: Hubs that a shingle picks in a round, and rounds at most; the residual round is exact after any number of them.
PICKS, HUB_ROUNDS = 3, 4
#: Another round follows only where the residual round would look at more pairs a posting than this, before its filters,
#: and while a round makes this share of the links that the first has made.
LOOKS, WORTH = 256, 0.1
_BITS = 256
_WORDS = [f"b{k}" for k in range(_BITS // 64)]


# --------------------------------------------------------------------------- sets of a slice of texts


def shingle_sets(col, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text: text of each shingle, and its hash; ordered by text, then hash."""
    _, _, starts, _, owner, h = words_of(col, NONSPACE)
    n = len(col)
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    size = len(h)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.zeros(size, np.uint64)
    for j in range(width):
        acc = acc * np.uint64(0x9E3779B97F4A7C15)
        if j < size:
            acc[: size - j] += h[j:]
    whole = count >= width
    full = np.zeros(size, bool)
    full[: max(0, size - width + 1)] = owner[: max(0, size - width + 1)] == owner[width - 1 :][: max(0, size - width + 1)]
    texts, values = owner[full], mix64(acc[full] + np.uint64(width))
    short = np.flatnonzero(~whole & (count > 0))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k, d in enumerate(short):
            a = np.zeros(1, np.uint64)
            for x in h[first[d] : first[d] + count[d]]:
                a = a * np.uint64(0x9E3779B97F4A7C15) + x
            extra[k] = mix64(a + np.uint64(count[d]))[0]
        texts, values = np.concatenate([texts, short]), np.concatenate([values, extra])
    order = np.lexsort((values, texts))
    texts, values = texts[order], values[order]
    keep = np.ones(len(texts), bool)
    keep[1:] = (texts[1:] != texts[:-1]) | (values[1:] != values[:-1])
    return texts[keep], values[keep]


def signatures(values: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """A 128-bit hash of each set of a slice; none of the empty set."""
    raw, ends = values.astype("<u8").tobytes(), np.cumsum(n).tolist()
    return [hashlib.blake2b(raw[8 * (e - k) : 8 * e], digest_size=16).digest() if k else None for e, k in zip(ends, n.tolist(), strict=True)]


def bitmaps(texts: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The parity bitmap of each set, as rows of 64-bit words."""
    out = np.zeros((rows, _BITS // 64), "<u8")
    step = 4096
    edges = np.searchsorted(texts, np.arange(0, rows + step, step))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        some = min(step, rows - k * step)
        if some <= 0 or a == b:
            continue
        at = (texts[a:b] - k * step) * _BITS + (values[a:b] >> np.uint64(56)).astype(np.int64)
        odd = (np.bincount(at, minlength=some * _BITS) & 1).astype(np.uint8).reshape(some, _BITS)
        out[k * step : k * step + some] = np.packbits(odd, axis=1).view("<u8")
    return out


def prefix_length(n, num: int, den: int):
    return n - -(-num * n // den) + 1


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """The exact test of two sorted sets, after the length and suffix filters."""
    n, m = len(a), len(b)
    if not n or not m or num * max(n, m) > den * min(n, m):
        return False
    least = -(-num * (n + m) // (num + den))
    # suffix filter: elements on either side of a pivot bound the overlap
    pivot = a[n // 2]
    la, lb = n // 2, int(np.searchsorted(b, pivot))
    if min(la, lb) + min(n - la, m - lb) < least:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (n + m - common)


# --------------------------------------------------------------------------- counts, and prefixes by them

#: p >= 0: shingles of a slice that belong to range p; p < 0: the slice's documents.
_PACKED = "p long, slice long, grams binary, docs binary, counts binary, doc_id array<long>, n array<int>, sig array<binary>, bits binary"


def _packed(p, slices, grams=None, docs=None, counts=None, doc_id=None, n=None, sig=None, bits=None):
    import pyarrow as pa

    k = len(p)
    none = [None] * k
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary())
    values = (p, slices, grams or none, docs or none, counts or none, doc_id or none, n or none, sig or none, bits or none)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=[x.split(" ")[0] for x in _PACKED.split(", ")])


def _scan(width: int, range_bits: int):
    """Reads texts: a set's shingles go to their ranges once a task at least, in packs of `PACK`."""
    shift, low32 = np.uint64(64 - range_bits), np.uint64(32 - range_bits)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        seen: set[bytes] = set()
        ids, sizes, sigs, bits, grams, docs, held = [], [], [], [], [], [], 0

        def flush():
            nonlocal number, held
            g, d = np.concatenate(grams), np.concatenate(docs)
            if len(g):
                part = (g >> shift).astype(np.int64) if range_bits else np.zeros(len(g), np.int64)
                order = np.argsort(part, kind="stable")
                part, g, d = part[order], g[order], d[order]
                begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                ends = np.append(begin[1:], len(part))
                g = (g >> low32).astype("<u4")  # the 32 bits below those that name the range
                yield _packed(part[begin], [number] * len(begin), [g[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], [d[a:b].tobytes() for a, b in zip(begin, ends, strict=True)])
            yield _packed([-1 - number], [number], doc_id=[ids], n=[sizes], sig=[sigs], bits=[np.concatenate(bits).tobytes()])
            number, held = number + 1, 0
            ids.clear(), sizes.clear(), sigs.clear(), bits.clear(), grams.clear(), docs.clear()

        for batch in batches:
            for part in text_slices(batch):
                texts, values = shingle_sets(part.column(1), width)
                n = np.bincount(texts, minlength=part.num_rows)
                sig = signatures(values, n)
                fresh = np.zeros(part.num_rows, bool)
                for k, s in enumerate(sig):
                    if s is not None and s not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(s)
                        fresh[k] = True
                bits.append(bitmaps(texts, values, part.num_rows))
                use = fresh[texts]
                grams.append(values[use])
                docs.append((texts[use] + len(ids)).astype("<u4"))
                ids += part.column(0).cast(pa.int64()).to_pylist()
                sizes += n.tolist()
                sigs += sig
                held += int(use.sum())
                if held >= PACK or len(ids) >= PACK:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def _count(key, table):
    """Counts the shingles of a range; each slice gets back those that occur twice or more. Documents pass through."""
    import pyarrow as pa

    p = key[0].as_py()
    if p < 0:
        return table
    slices, raw = table.column("slice").to_pylist(), [x.as_py() for x in table.column("grams")]
    grams = np.frombuffer(b"".join(raw), "<u4")
    docs = np.frombuffer(b"".join(x.as_py() for x in table.column("docs")), "<u4")
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    times = np.diff(np.append(begin, len(s)))
    counts = np.empty(len(s), "<u4")
    counts[order] = np.repeat(times, times)
    ends = np.cumsum([len(x) // 4 for x in raw])
    out: list[list] = [[], [], [], []]
    for name, e, x in zip(slices, ends, raw, strict=True):
        a = e - len(x) // 4
        use = counts[a:e] > 1
        if use.any():
            for held, v in zip(out, (name, grams[a:e][use].tobytes(), docs[a:e][use].tobytes(), counts[a:e][use].tobytes()), strict=True):
                held.append(v)
    return pa.Table.from_batches([_packed([p] * len(out[0]), *out)])


def _prefixes(num: int, den: int):
    def run(key, table):
        import pyarrow as pa

        names = ["gram", "v", "n", "at", *_WORDS]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), *[pa.int64()] * len(_WORDS)]
        is_docs = np.asarray(table.column("p")) < 0
        packs = table.filter(pa.array(~is_docs))
        if not packs.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        about = table.filter(pa.array(is_docs)).slice(0, 1).to_pylist()[0]
        n = np.array(about["n"], np.int64)
        join = lambda c: np.frombuffer(b"".join(x.as_py() for x in packs.column(c)), "<u4")
        docs, counts = join("docs").astype(np.int64), join("counts")
        gram = join("grams").astype(np.int64) | np.repeat(np.asarray(packs.column("p")) << 32, [len(x.as_py()) // 4 for x in packs.column("grams")])
        order = np.lexsort((gram, counts, docs))
        d, g = docs[order], gram[order]
        several = np.bincount(d, minlength=len(n))
        at = np.arange(len(d)) - (np.cumsum(several) - several)[d] + (n - several)[d]  # those that occur once come first
        keep = at < prefix_length(n, num, den)[d]
        d = d[keep]
        bits = np.frombuffer(about["bits"], "<i8").reshape(len(n), len(_WORDS))
        sig = pa.array(about["sig"], pa.binary()).take(pa.array(d))
        return pa.Table.from_arrays([pa.array(g[keep]), sig, pa.array(n[d].astype(np.int32)), pa.array(at[keep].astype(np.int32)), *[pa.array(bits[d, k]) for k in range(len(_WORDS))]], names=names)

    return run


def _sets(width: int):
    """The sets that are wanted: v is the name of the set that the row's doc_id stands for."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch):
                texts, values = shingle_sets(part.column(1), width)
                n = np.bincount(texts, minlength=part.num_rows)
                right = [k for k, (a, b) in enumerate(zip(signatures(values, n), part.column(0).to_pylist(), strict=True)) if a == b]
                raw, ends = values.astype("<u8").tobytes(), np.cumsum(n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(right, pa.int64())), pa.array([raw[8 * (ends[k] - n[k]) : 8 * ends[k]] for k in right], pa.binary())], names=["v", "grams"])

    return run


def _verify(num: int, den: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ok = [links(np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8"), num, den) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


# --------------------------------------------------------------------------- the join


class _Pairs:
    """Candidates and verified links among the sets of a written table of postings."""

    def __init__(self, stage: Stage, sets: DataFrame, num: int, den: int):
        self.stage, self.sets, self.num, self.den = stage, sets, num, den

    def fits(self, x: str, y: str):
        """Length, positional and bitmap filters of two sets that share a shingle at these places of the order."""
        c = lambda side, name: F.col(f"{side}.{name}")
        nx, ny, both = c(x, "n"), c(y, "n"), self.num + self.den
        rest = F.least(nx - c(x, "at"), ny - c(y, "at"))  # this shingle and all that may follow it in both
        differ = sum((F.bit_count(c(x, b).bitwiseXOR(c(y, b))) for b in _WORDS), F.lit(0))
        least = F.ceil((nx + ny) * self.num / both)
        return (F.greatest(nx, ny) * self.num <= F.least(nx, ny) * self.den) & (rest * both >= (nx + ny) * self.num) & (differ <= nx + ny - 2 * least)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        a, b = self.sets.withColumnsRenamed({"v": "a", "grams": "ga"}), self.sets.withColumnsRenamed({"v": "b", "grams": "gb"})
        out = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "ga", "gb")
        return self.stage.keep(out.mapInArrow(_verify(self.num, self.den), "a binary, b binary"), f"{name}-edges")

    def hubs(self, postings: DataFrame, k: int) -> DataFrame:
        """Pairs of a set with hubs of other classes: for each pick the one that most others of its shingles may have picked too."""
        item = lambda j: F.struct(F.xxhash64("v", F.lit(k * PICKS + j)).alias("pick"), "v", "class", "n", "at", *_WORDS)
        heads = postings.groupBy("gram").agg(*[F.min(item(j)).alias(f"h{j}") for j in range(PICKS)])
        heads = self.stage.keep(heads.select("gram", F.array_distinct(F.array(*[f"h{j}" for j in range(PICKS)])).alias("hubs")), f"heads-{k}")
        met = postings.join(heads.hint("merge"), "gram").select(F.struct("v", "class", "n", "at", *_WORDS).alias("x"), F.posexplode("hubs").alias("j", "hub"))
        met = met.where(F.col("x.class") != F.col("hub.class")).where(self.fits("x", "hub"))
        pairs = met.groupBy(F.col("x.v").alias("a"), "j").agg(F.min(F.struct("hub.pick", "hub.v")).alias("to"))
        return self.stage.keep(pairs.select(F.least("a", "to.v").alias("a"), F.greatest("a", "to.v").alias("b")).distinct(), f"pairs-{k}")

    def pairs_left(self, postings: DataFrame) -> tuple[int, int]:
        """Pairs of classes that still share a shingle, counted for each shingle, and postings."""
        each = postings.groupBy("gram").agg(F.count_distinct("class").alias("c"), F.count("*").alias("n"))
        row = each.agg(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.sum("n")).first()
        return int(row[0] or 0), int(row[1] or 0)

    def residual(self, postings: DataFrame) -> DataFrame:
        """Pairs of different classes, each once, by equal shingle and neighbouring length bands."""
        if self.num == self.den:
            band = F.col("n").cast("long")
        else:  # a hair wider than the ratio of lengths that link, so that rounding never parts them by two bands
            band = F.floor(F.log(F.col("n")) / (math.log(self.den / self.num) * (1 + 1e-9)))
        x = postings.withColumn("band", band).alias("x")
        y = postings.withColumn("band", F.explode(F.array(band, band - 1))).alias("y")
        smaller = F.struct(F.col("x.n"), F.col("x.v")) < F.struct(F.col("y.n"), F.col("y.v"))
        met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.band") == F.col("y.band")) & smaller & (F.col("x.class") != F.col("y.class")) & self.fits("x", "y"))
        return self.stage.keep(met.select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).distinct(), "residual-pairs")


def _split_classes(stage: Stage, postings: DataFrame, classes: DataFrame | None, name: str) -> DataFrame:
    """The postings with their classes, of shingles that several classes share; at first a set is a class of its own."""
    if classes is None:
        named = postings.withColumn("class", F.col("v"))
    else:
        named = postings.drop("class").join(classes.select(F.col("id").alias("v"), F.col("component").alias("class")).hint("merge"), "v", "left").withColumn("class", F.coalesce("class", "v"))
    named = stage.keep(named, f"{name}-named")
    mixed = named.groupBy("gram").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("gram")
    mixed = stage.keep(mixed, f"{name}-mixed")
    out = stage.keep(named.join(mixed.hint("merge"), "gram"), f"{name}-postings")
    stage.drop(f"{name}-named"), stage.drop(f"{name}-mixed")
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, range_bytes: int = RANGE_BYTES, rounds: int = HUB_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    stage = Stage(spark, "jaccard")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = min(31, max(0, math.ceil(math.log2(max(1, size / range_bytes)))))
    counted = text.mapInArrow(_scan(width, range_bits), _PACKED).groupBy("p").applyInArrow(_count, _PACKED)
    counted = stage.keep(counted, "counted")
    release(spark)
    known = counted.where("p < 0").select(F.explode(F.arrays_zip("doc_id", "n", "sig")).alias("d")).select("d.doc_id", "d.n", F.col("d.sig").alias("v"))
    known = stage.keep(known, "known")
    firsts = stage.keep(known.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("first")), "firsts")
    schema = "gram long, v binary, n int, at int, " + ", ".join(f"{b} long" for b in _WORDS)
    postings = counted.groupBy("slice").applyInArrow(_prefixes(num, den), schema)
    postings = _split_classes(stage, postings.dropDuplicates(["gram", "v"]), None, "start")
    stage.drop("counted")

    # sets of the rows that stand for a set with a shared shingle; a null doc_id is as good as any
    absent = F.lit(-(1 << 63))
    wanted = postings.select("v").distinct().join(firsts, "v").select("v", F.coalesce("first", absent).alias("row"))
    wanted = stage.keep(wanted, "wanted")
    # a merge join at every size: whether `wanted` fits a broadcast must not change what is moved
    chosen = text.where("text is not null").withColumn("row", F.coalesce("doc_id", absent)).join(wanted.hint("merge"), "row").select("v", "text")
    sets = stage.keep(chosen.mapInArrow(_sets(width), "v binary, grams binary").dropDuplicates(["v"]), "sets")
    release(spark)

    join = _Pairs(stage, sets, num, den)
    classes, first = spark.createDataFrame([], "id binary, component binary"), 0
    for k in range(rounds):
        found = join.verified(join.hubs(postings, k), f"hub-{k}")
        made = found.count()
        first = made if k == 0 else first
        if not made:
            break
        classes = components(spark, stage, classes.toDF("a", "b").unionByName(found), f"classes-{k}")
        left = _split_classes(stage, postings, classes, f"round-{k}")
        stage.drop("start-postings" if k == 0 else f"round-{k - 1}-postings")
        postings = left
        release(spark)
        pairs, rows = join.pairs_left(postings)
        if pairs <= LOOKS * rows or made < WORTH * first:
            break
    more = join.verified(join.residual(postings), "residual")
    if more.limit(1).count():
        classes = components(spark, stage, classes.toDF("a", "b").unionByName(more), "classes")
    labels = firsts.join(classes.withColumnsRenamed({"id": "v", "component": "class"}), "v", "left").withColumn("class", F.coalesce("class", "v"))
    labels = stage.keep(labels, "labels")
    least = stage.keep(labels.groupBy("class").agg(F.min("first").alias("component_id")), "least")
    names = stage.keep(labels.join(least.hint("merge"), "class").select("v", "component_id"), "names")
    release(spark)
    rows = known.where("v is not null").join(names.hint("merge"), "v").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return rows.unionByName(known.where("v is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def brute_force(texts: dict, width: int, num: int, den: int) -> dict:
    """doc_id -> (n_shingles, component_id), comparing all pairs."""
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            o = len(sets[a] & sets[b])
            if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
