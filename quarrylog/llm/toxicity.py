"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of the characters of a word given the characters before
it; both classes back off to one set of continuation counts, so an expression that is rare in either
class gets nearly the same likelihood from both. A word's evidence is its toxic less its ordinary
log-likelihood. A document's score is a logistic function, fitted on labelled rows kept apart from the
models, of length-normalised differences over the text's distinct words: the sum of clear evidence by
the root of the length, the mean of the three most telling words, and the mean of all.

Discounts are estimated from counts of counts, for each class and for the shared counts.

Class counts come from all labelled rows but the third that the logistic function is fitted on; the shared
counts come from the words of all documents, labelled or not. Both are gathered where the texts are. Every
gram that occurs twice in a class is in the models, however many there are, and the logistic weights come
from all labelled rows of their third, summed where the rows are. What a gram that occurs once had goes to
what its context leaves to the shared counts. Callers may ask for fewer grams (`max_grams`, those that tell
the classes apart most) or rows (`max_toxic`, `max_ordinary`); nothing does so by itself. Log-ratios are
computed in the cluster; the driver and the workers hold 16 bytes a gram. Equal texts of a class count once
(rows equal in doc_id too are not told apart) and a word once a document. Class shares are counted over all
labelled rows. Every row is scored, over its whole text; labels, language, source and doc_id are no inputs
of a score.

Null or empty texts, and texts without letters, get the score of no evidence. Without labels of both
classes every score is 0; an empty table gives no rows. A doc_id with several labels counts as toxic if
one of them is 1. A very long text is one slice and is scored whole. Ties at the threshold count as toxic.
Other columns are ignored by `scores` and kept by `reject_toxic`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, forget, mix64, release, text_slices

ORDER = 6
#: Discounts of grams that occur once, twice and more often, where counts of counts are too few to estimate them.
DISCOUNTS = (0.75, 1.5, 2.5)
THRESHOLD = 0.3
#: Words whose evidence a worker remembers, and words that it counts before it hands them on.
CACHE, HELD_WORDS = 100_000, 120_000
#: Bytes of text that are scored, and words that are looked up, at once.
SCORED_BYTES, LOOKED_UP = 1 << 18, 20_000
_WORDS = re.compile(r"[^\W\d_]+")
#: Evidence of a word below which it tells nothing about a document.
EVIDENCE = 2.0


def word_grams(word: str, order: int = ORDER):
    s = f"^{word}$"
    return [s[max(0, i - order + 1) : i + 1] for i in range(1, len(s))]


class KneserNey:
    """Two class models with shared backoff, over the grams that were kept.

    shared: suffix -> times, total and rest of its context; kept: gram -> times in each class; contexts: context ->
    total and rest in each class. The rest is what discounts and pruned grams leave to the shorter context.
    discounts: of the ordinary class, the toxic class and the shared counts.
    """

    def __init__(self, shared: dict, kept: dict, contexts: dict, alphabet: int, order: int = ORDER, discounts: tuple = (DISCOUNTS,) * 3):
        self.order, self.shared, self.kept, self.contexts = order, shared, kept, contexts
        self.alphabet, self.discounts = max(64, alphabet), discounts
        self.known: dict[str, float] = {}

    @staticmethod
    def _mixed(n: int, total: int, rest: float, below: float, discounts: tuple) -> float:
        if not total:
            return below
        return max((n - discount(n, discounts)) / total + rest / total * below, 1e-15)

    def _shared(self, g: str) -> float:
        if not g:
            return 1.0 / self.alphabet
        p = self.known.get(g)
        if p is None:
            p = self._shared(g[1:])
            if g in self.shared:
                p = self._mixed(*self.shared[g], p, self.discounts[2])
            self.known[g] = p
        return p

    def probability(self, g: str, label: int) -> float:
        """Of a gram's last character after the others, in a class."""
        t, r = self.contexts[g[:-1]][label], self.contexts[g[:-1]][2 + label]
        return self._mixed(self.kept.get(g, (0, 0))[label], t, r, self._shared(g[1:]), self.discounts[label])

    def ratio(self, g: str) -> float:
        return math.log(self.probability(g, 1) / self.probability(g, 0))

    def evidence(self) -> Evidence:
        """All that scoring needs. For a gram that was not kept the shared part cancels and the ratio is that of what
        is left in its context; where no gram of a context was kept, all of it is left."""
        rest = lambda t, r: max(r / t, 1e-15) if t else 1.0
        context = {h: math.log(rest(t1, r1) / rest(t0, r0)) for h, (t0, t1, r0, r1) in self.contexts.items()}
        return Evidence(self.order, {g: self.ratio(g) for g in self.kept}, context)


def discount(n: int, discounts: tuple) -> float:
    return min(n, discounts[min(n, 3) - 1]) if n > 0 else 0.0


def estimated(counts) -> tuple[float, float, float]:
    """Discounts from how many grams occur once, twice, three and four times."""
    n1, n2, n3, n4 = (int(x or 0) for x in counts)
    if not (n1 and n2 and n3 and n4):
        return DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), k + 0.9) for k, d in enumerate(found))


def _times(n):
    """How many rows have a count of one, two, three and four."""
    return F.array(*[F.count_if(n == k) for k in range(1, 5)])


def _discount(n, discounts: tuple):
    """discount() of a column."""
    return F.when(n > 2, discounts[2]).when(n == 2, discounts[1]).when(n == 1, discounts[0]).otherwise(0.0)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, one after another, and how many each has."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(x) for x in strings], np.int64)


def _keys(codes: np.ndarray, last: np.ndarray, length: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` code points (`order` at most) that ends at `last`."""
    h = np.zeros(len(last), np.uint64)
    for j in range(0, order, 3):
        for k in range(j, min(j + 3, order)):
            h ^= np.where(k < length, codes[np.maximum(last - k, 0)], 0).astype(np.uint64) << np.uint64(21 * (k - j))
        h = mix64(h)
    return h


class Table:
    """Values by key, in two sorted arrays of 16 bytes a key together."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two grams have one key")

    @staticmethod
    def of(found: dict[str, float], order: int) -> Table:
        codes, n = _codes(list(found))
        return Table(_keys(codes, np.cumsum(n) - 1, n, order), np.array(list(found.values()), np.float64))

    def __len__(self) -> int:
        return len(self.keys)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and which keys are known."""
        if not len(self):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.values[at], 0.0), known


class Evidence:
    """Log-ratio of each seen gram and context."""

    def __init__(self, order: int, grams: dict[str, float] | Table, contexts: dict[str, float] | Table):
        self.order = order
        self.grams, self.contexts = (x if isinstance(x, Table) else Table.of(x, order) for x in (grams, contexts))

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for a in range(0, len(words), LOOKED_UP):
            part = words[a : a + LOOKED_UP]
            codes, n = _codes([f"^{w}$" for w in part])
            at = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
            last = np.flatnonzero(at)
            v, known = self.grams.get(_keys(codes, last, np.minimum(at[last] + 1, self.order), self.order))
            rest = last[~known]
            v[~known] = self.contexts.get(_keys(codes, rest - 1, np.minimum(at[rest], self.order - 1), self.order))[0]
            out[a : a + len(part)] = np.bincount(np.repeat(np.arange(len(part)), n)[last], weights=v, minlength=len(part))
        return out

    def word(self, word: str) -> float:
        return float(self.words([word])[0])


class Scorer:
    def __init__(self, model: Evidence | None, weights: np.ndarray | None):
        self.model, self.weights = model, weights
        self.known: dict[str, float] = {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Three numbers of each text; words that aren't remembered are looked up together."""
        out = np.zeros((len(texts), 3))
        if self.model is None:
            return out
        found = [_WORDS.findall((t or "").lower()) for t in texts]
        sizes = [len(x) for x in found]
        for k, x in enumerate(found):
            found[k] = set(x)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = [w for w in set().union(*found) if w not in known]
        known.update(zip(new, self.model.words(new).tolist(), strict=True))
        for k, x in enumerate(found):
            if not x:
                continue
            v = np.array([known[w] for w in x])
            top = np.partition(v, len(v) - 3)[-3:] if len(v) > 3 else v
            telling = float(np.maximum(v - EVIDENCE, 0).sum()) / (1 + math.sqrt(sizes[k]))
            out[k] = math.log1p(8 * telling), top.mean(), v.mean()
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.weights is None:
            return [0.0] * len(texts)
        z = [float(np.dot(self.weights, [1.0, *f])) for f in self.features(texts)]
        return [1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def _slopes(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, summed over rows."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x


def logistic(slopes, size: int, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic regression by damped Newton steps; the first is the constant's. slopes: `_slopes` of weights, over all rows."""
    w = np.zeros(size)
    pull = np.full(size, ridge)
    pull[0] = 1e-6
    for _ in range(rounds):
        g, h = slopes(w)
        step = np.linalg.solve(h + np.diag(pull) + 1e-9 * np.eye(size), g + pull * w)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sums_of_slopes(w: np.ndarray, weights: tuple[float, float]):
    def run(batches):
        import pyarrow as pa

        g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            y = np.asarray(batch.column(0)).astype(np.float64)
            x = np.column_stack([np.ones(len(y)), *[np.asarray(c) for c in batch.columns[1:]]])
            more = _slopes(x, y, np.where(y == 1, weights[1], weights[0]), w)
            g, h = g + more[0], h + more[1]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, h.ravel()]).tobytes()], pa.binary())], names=["sums"])

    return run


#: Bits of the table that tells which texts may have a label, so that only those are shuffled to their labels; where labels
#: fill it, more texts are.
FILTER_BITS = 25


def _slots(doc_id, bits: int) -> np.ndarray:
    return (mix64(np.asarray(doc_id).astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _mark(bits: int):
    def run(batches):
        import pyarrow as pa

        table = np.zeros(1 << bits, bool)
        for batch in batches:
            table[_slots(batch.column(0), bits)] = True
        chunks = np.packbits(table).reshape(64, -1)
        used = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([chunks[k].tobytes() for k in used], pa.binary())], names=["chunk", "data"])

    return run


def _either(key, table):
    import pyarrow as pa

    data = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("data")])
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})


def _maybe_labelled(spark: SparkSession, ids: DataFrame, bits: int = FILTER_BITS, then=None):
    """A filter of texts (doc_id first) that lets all pass whose doc_id is among `ids`, and few others; 2**bits / 8 bytes.
    What passes goes through `then`."""
    table = np.zeros((64, (1 << bits) // 512), np.uint8)
    for r in ids.select("doc_id").mapInArrow(_mark(bits), "chunk int, data binary").groupBy("chunk").applyInArrow(_either, "chunk int, data binary").collect():
        table[r["chunk"]] = np.frombuffer(r["data"], np.uint8)
    shared = spark.sparkContext.broadcast(table.reshape(-1))

    def run(batches):
        import pyarrow as pa

        flat = shared.value
        for batch in batches:
            at = _slots(batch.column(0).fill_null(0), bits)
            yield batch.filter(pa.array((flat[at >> 3] >> (7 - (at & 7))) & 1 > 0))

    return run if then is None else lambda batches: then(run(batches))


def _words(batches):
    """A task's words, with the texts of each class that have them (label null: none); a word counts once a text."""
    import pyarrow as pa

    forget()
    counts, plain = [Counter(), Counter()], set()

    def flush():
        items = sorted(plain.union(*counts))  # neighbours compress well
        for a in range(0, len(items), 50_000):
            part = items[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([counts[k][w] for w in part], pa.int64()) for k in (0, 1)]], names=["word", "n0", "n1"])
        counts[0].clear(), counts[1].clear(), plain.clear()

    for batch in batches:
        for part in text_slices(batch):
            for label, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                words = set(_WORDS.findall((text.as_py() or "").lower()))
                if label is None:
                    plain |= words
                else:
                    counts[label].update(words)
            if len(plain) + len(counts[0]) + len(counts[1]) > HELD_WORDS:
                yield from flush()
    yield from flush()


def gram_counts(words: DataFrame) -> DataFrame:
    """Grams of words (word, n0, n1), each gram once: what `word_grams` gives, summed."""
    s = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    words = words.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).select(s.alias("s"), "n0", "n1")
    grams = F.transform(F.sequence(F.lit(2), F.length("s")), lambda i: F.substring(F.col("s"), F.greatest(i - (ORDER - 1), F.lit(1)), F.least(i, F.lit(ORDER))))
    return words.select(F.explode(grams).alias("gram"), "n0", "n1").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class Counts(NamedTuple):
    """What the models are made of. kept: gram, n0, n1; contexts: h, t0, t1, r0, r1; asked (shared counts): s, n, t, r."""

    kept: DataFrame
    contexts: DataFrame
    asked: DataFrame
    alphabet: int
    discounts: tuple


def _suffixes(df: DataFrame, column: str, first: int) -> DataFrame:
    """Each row's string, and its suffixes from the `first` character on, one a row."""
    return df.select(F.col(column).alias("of"), F.explode(F.transform(F.sequence(F.lit(first), F.length(column)), lambda i: F.substring(F.col(column), i, F.lit(ORDER)))).alias("s"))


def _counts(stage: Stage, grams: DataFrame, max_grams: int | None) -> Counts | None:
    """grams: gram, n0, n1, each gram once. None if a class has none."""
    sums = grams.agg(F.sum("n0"), F.sum("n1"), F.count(F.when(F.greatest("n0", "n1") > 1, 1)), _times(F.col("n0")), _times(F.col("n1"))).first()
    if not sums[0] or not sums[1]:
        return None
    of_class = [estimated(sums[3 + k]) for k in (0, 1)]
    # a gram that occurs once at most is pruned and scores as if it were unknown
    kept = F.greatest("n0", "n1") > 1
    if max_grams is not None and sums[2] > max_grams:
        share = [(F.col(f"n{k}") + 0.5) / sums[k] for k in (0, 1)]
        weight = F.when(kept, (share[0] + share[1]) * F.abs(F.log(share[1] / share[0])))
        kept = F.coalesce(weight > grams.agg(F.percentile_approx(weight, F.lit(1.0 - max_grams / sums[2]), F.lit(10_000))).first()[0], F.lit(False))
    marked = grams.withColumn("kept", kept)
    head = F.expr("left(gram, length(gram) - 1)")
    rest = [F.sum(F.when(F.col("kept"), _discount(F.col(f"n{k}"), of_class[k])).otherwise(F.col(f"n{k}"))) for k in (0, 1)]
    contexts = marked.groupBy(head.alias("h")).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), rest[0].alias("r0"), rest[1].alias("r1"), F.max("kept").alias("kept")).where("kept").drop("kept")
    # shared counts: how many characters stand before a suffix, in all words
    before = stage.keep(_suffixes(grams, "gram", 1).select("s").distinct().where("length(s) > 1").groupBy(F.expr("substring(s, 2)").alias("s")).agg(F.count("*").alias("n")), "before")
    shared = estimated(before.agg(_times(F.col("n"))).first()[0])
    total = before.groupBy(F.expr("left(s, length(s) - 1)").alias("h")).agg(F.sum("n").alias("t"), F.sum(_discount(F.col("n"), shared)).alias("r"))
    known = marked.where("kept").select("gram", "n0", "n1")
    asked = before.join(_suffixes(known, "gram", 2).select("s").distinct(), "s", "left_semi").withColumn("h", F.expr("left(s, length(s) - 1)")).join(total, "h").select("s", "n", "t", "r")
    return Counts(known, stage.keep(contexts, "contexts"), stage.keep(asked, "asked"), before.where("length(s) = 1").count(), (*of_class, shared))


def _model(stage: Stage, grams: DataFrame, max_grams: int | None) -> KneserNey | None:
    """The models on the driver, to look into; `_evidence` gives the same log-ratios without gathering counts."""
    c = _counts(stage, grams, max_grams)
    if c is None:
        return None
    return KneserNey(
        {x["s"]: (x["n"], x["t"], x["r"]) for x in c.asked.toLocalIterator()},
        {x["gram"]: (x["n0"], x["n1"]) for x in c.kept.toLocalIterator()},
        {x["h"]: (x["t0"], x["t1"], x["r0"], x["r1"]) for x in c.contexts.toLocalIterator()},
        c.alphabet,
        discounts=c.discounts,
    )


def _log_ratios(c: Counts) -> DataFrame:
    """kind (0: gram, 1: context), s and v: what `KneserNey.evidence` says of each, by joins."""
    least = F.lit(1e-15)
    step = c.asked.select("s", F.struct(F.length("s").alias("k"), ((F.col("n") - _discount(F.col("n"), c.discounts[2])) / F.col("t")).alias("a"), (F.col("r") / F.col("t")).alias("b")).alias("x"))
    # shared probabilities: from the last character to the whole string, each backing off to the one before
    chain = F.aggregate(F.array_sort(F.collect_list("x")), F.lit(1.0 / max(64, c.alphabet)), lambda p, x: F.greatest(x["a"] + x["b"] * p, least))
    shared = _suffixes(c.asked, "s", 1).join(step, "s").groupBy("of").agg(chain.alias("p"))
    n, t, r = ([F.col(f"{x}{k}") for k in (0, 1)] for x in "ntr")
    p = [F.when(t[k] > 0, F.greatest((n[k] - _discount(n[k], c.discounts[k])) / t[k] + r[k] / t[k] * F.col("p"), least)).otherwise(F.col("p")) for k in (0, 1)]
    grams = c.kept.withColumns({"h": F.expr("left(gram, length(gram) - 1)"), "of": F.expr("substring(gram, 2)")}).join(c.contexts, "h").join(shared, "of")
    rest = [F.when(t[k] > 0, F.greatest(r[k] / t[k], least)).otherwise(1.0) for k in (0, 1)]
    contexts = c.contexts.select(F.lit(1).alias("kind"), F.col("h").alias("s"), F.log(rest[1] / rest[0]).alias("v"))
    return grams.select(F.lit(0).alias("kind"), F.col("gram").alias("s"), F.log(p[1] / p[0]).alias("v")).unionByName(contexts)


def _packed(batches):
    import pyarrow as pa

    for batch in batches:
        codes, n = _codes(batch.column(1).to_pylist())
        keys, kind, v = _keys(codes, np.cumsum(n) - 1, n, ORDER), np.asarray(batch.column(0)), np.asarray(batch.column(2))
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), *[pa.array([x[kind == k].tobytes() for k in (0, 1)], pa.binary()) for x in (keys, v)]], names=["kind", "keys", "vals"])


def _evidence(c: Counts) -> Evidence:
    parts = _log_ratios(c).mapInArrow(_packed, "kind int, keys binary, vals binary").collect()
    both = lambda kind, column, of: np.frombuffer(b"".join(x[column] for x in parts if x["kind"] == kind), of)
    return Evidence(ORDER, *[Table(both(k, "keys", np.uint64), both(k, "vals", np.float64)) for k in (0, 1)])


def _features(model):
    """doc_id, hash of the text and features, of texts."""

    def run(batches):
        import pyarrow as pa

        forget()
        scorer = Scorer(model.value, None)
        for batch in batches:
            for part in text_slices(batch, limit=SCORED_BYTES):
                texts = part.column(1).to_pylist()
                h = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), h, *[pa.array(x) for x in scorer.features(texts).T]], names=["doc_id", "h", "a", "b", "c"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_toxic: int | None = None, max_ordinary: int | None = None, max_grams: int | None = None) -> Scorer:
    """labels: doc_id and toxic (0, 1 or null)."""
    each = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).where("label in (0, 1)")
    shares = {r["label"]: r["count"] for r in each.groupBy("label").count().collect()}
    if len(shares) < 2:
        return Scorer(None, None)
    stage = Stage(spark, "toxicity")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    plain, text = text, text.withColumn("h", F.unhex(F.sha2("text", 256)))
    chosen = text.select("doc_id", "h").join(each, "doc_id").groupBy("label", "h").agg(F.min("doc_id").alias("doc_id"))
    chosen = stage.keep(chosen.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(3))), "chosen")
    used = chosen.where("part <> 0").select("doc_id", "h", "label")
    near = plain.mapInArrow(_maybe_labelled(spark, used), plain.schema).withColumn("h", F.unhex(F.sha2("text", 256)))
    marked = near.join(used.hint("merge"), ["doc_id", "h"]).select("label", "text")
    words = text.select(F.lit(None).cast("int").alias("label"), "text").mapInArrow(_words, "word string, n0 long, n1 long")
    grams = stage.keep(gram_counts(words.unionByName(marked.mapInArrow(_words, "word string, n0 long, n1 long"))), "grams")
    del marked, words, near
    release(spark)
    counts = _counts(stage, grams, max_grams)
    if counts is None:
        return Scorer(None, None)
    model = _evidence(counts)
    for name in ("grams", "before", "contexts", "asked"):
        stage.drop(name)
    rows = [chosen.where((F.col("part") == 0) & (F.col("label") == k)).select("doc_id", "h", "label") for k in (0, 1)]
    rows = [x if most is None else x.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for x, most in zip(rows, (max_ordinary, max_toxic), strict=True)]
    rows = rows[0].unionByName(rows[1])
    features = plain.mapInArrow(_maybe_labelled(spark, rows, then=_features(spark.sparkContext.broadcast(model))), "doc_id long, h binary, a double, b double, c double")
    features = stage.keep(features.join(rows.hint("merge"), ["doc_id", "h"]).select("label", "a", "b", "c").sortWithinPartitions("label", "a", "b", "c"), "features")
    have = {r["label"]: r["count"] for r in features.groupBy("label").count().collect()}
    if len(have) < 2:
        return Scorer(None, None)
    scale = (have[0] + have[1]) / (shares[0] + shares[1])
    weights = tuple(scale * shares[k] / have[k] for k in (0, 1))

    def slopes(w):
        sums = np.array([np.frombuffer(r["sums"]) for r in features.mapInArrow(_sums_of_slopes(w, weights), "sums binary").collect()])
        sums = np.array([math.fsum(x) for x in sums.T])
        return sums[: len(w)], sums[len(w) :].reshape(len(w), len(w))

    return Scorer(model, logistic(slopes, 4))


def _score(scorer):
    def run(batches):
        import pyarrow as pa

        forget()
        s = scorer.value
        for batch in batches:
            for part in text_slices(batch, limit=SCORED_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return run


def scores(spark: SparkSession, docs: DataFrame, scorer: Scorer) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_score(spark.sparkContext.broadcast(scorer)), "doc_id long, score double")


def reject_toxic(spark: SparkSession, docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches):
        import pyarrow as pa

        forget()
        s = shared.value
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for part in text_slices(batch, limit=SCORED_BYTES):
                yield part.filter(pa.array([x < threshold for x in s.scores(part.column(k).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
