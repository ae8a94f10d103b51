"""Helpers shared by the operators: staging in the cluster's shared folder, and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20

WORD = "alnum"
NONSPACE = "nonspace"


# --------------------------------------------------------------------------- memory of workers

_remembered: list = []


def remembered(container):
    """A dict or list that an operator fills again when it finds it empty; `forget` empties it."""
    _remembered.append(container)
    return container


def forget() -> None:
    """Gives back what other operators left in a worker that outlived their tasks; for tasks that use none of it."""
    if any(_remembered):
        for container in _remembered:
            container.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


# --------------------------------------------------------------------------- staging


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of our own, but only if executors share this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarrylog-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark writes."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


_stages: list[Stage] = []


class Stage:
    """Tables written under the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _stages.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that nothing will read again."""
        remove(self.spark, f"{self.base}/{name}")


@contextlib.contextmanager
def swept():
    """Deletes, at its end, the tables of all operators that ran within; their results must have been written by then."""
    before = len(_stages)
    yield
    while len(_stages) > before:
        stage = _stages.pop()
        remove(stage.spark, stage.base)


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that nothing will read again, before the next ones are written."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet: `name`, with as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- Arrow batches


def text_slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Splits an Arrow batch into zero-copy slices of about `limit` text bytes, one row at least."""
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(column))
    n = batch.num_rows
    if n == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        base = ends[at] - lengths[at]
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty), and the n + 1 offsets into them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if col.null_count:
        col = pc.fill_null(col, "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if large else np.int32
    off = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


# --------------------------------------------------------------------------- words


def _classes() -> dict[str, np.ndarray]:
    b = np.arange(256)
    alnum = ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    return {WORD: alnum, NONSPACE: ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))}


CLASSES = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MIX = np.random.RandomState(20240607).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = remembered([])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and of its inverse; kept for the worker's life."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        both = []
        for base in (_ODD, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_bounds(low: np.ndarray, off: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (maximal runs of the class, never across texts), and the text each stands in."""
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = CLASSES[kind][low]
    first = np.zeros(len(low) + 1, bool)
    first[off[:-1][off[:-1] < len(low)]] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    cut = np.zeros(len(low) + 1, bool)
    cut[off[1:]] = True
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length, the same on every worker."""
    p, q = powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_MIX[low] * p[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(col, kind: str):
    """Bytes with A-Z lower-cased, offsets, word starts, ends, text of each word, and word hashes."""
    buf, off = text_bytes(col)
    low = LOWER[buf]
    starts, ends, owner = word_bounds(low, off, kind)
    return low, off, starts, ends, owner, span_hashes(low, starts, ends)


def counts_by_text(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64)


# --------------------------------------------------------------------------- connected classes


def components(spark: SparkSession, stage: Stage, edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Smallest member reachable from each vertex of `edges` (columns a and b): columns id, component.

    Alternates large-star and small-star over a written table of edges, with one row for each edge at
    most in every round, so no group is gathered anywhere; it ends once all that is left are stars.
    What a hub's rows are joined with is written first, so that they may be split among tasks.
    """
    e = edges.select("a", "b").where("a <> b")
    e = stage.keep(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    for k in range(max_rounds):
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-low-{k}")
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage.keep(large, f"{name}-large-{k}")
        # small star: u and its smaller neighbours are tied to the smallest neighbour; a vertex has few of them by now
        least = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stage.keep(small.where("u <> v").distinct(), f"{name}-{k + 1}")
        for old in (f"{name}-low-{k}", f"{name}-large-{k}", f"{name}-{k}"):
            stage.drop(old)
        # stars: no vertex is tied twice, and none that others are tied to is tied itself
        roles = e.select(F.col("u").alias("x"), F.lit(1).alias("ties"), F.lit(0).alias("hub")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("ties"), F.lit(1).alias("hub")))
        odd = roles.groupBy("x").agg(F.sum("ties").alias("ties"), F.max("hub").alias("hub")).where("ties > 1 or (ties > 0 and hub > 0)")
        if not odd.limit(1).count():
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    raise RuntimeError("components: no fixed point")
