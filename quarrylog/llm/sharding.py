"""Sharding by Karmarkar-Karp differencing, with groups that may not be divided.

Rows of equal text form a group. A partial partition is a vector of k subset sums; a group alone is one
with a single sum that isn't zero. Differencing takes the two partial partitions with the largest
spread (largest sum less smallest) and adds them in opposite order, until one is left.

Groups larger than a small part of a shard are few, whatever the input: at most k * `PARTS`. The driver
differences those. All others are dealt out by hash into units of about `UNIT_GROUPS` groups. A task
differences a unit's groups together with the unit's share of the large groups' sums, which is a partial
partition as well; so each unit fills up what the large groups leave, and its parts are shards at once.
One unit comes last, with the exact sums of all others, and evens out what they have left.

A text's size is its UTF-8 bytes plus 16; null has no bytes and goes with the empty text. A group larger than a fair share fills a shard by itself. Repeated rows are
placed one by one, all in their group's shard. Slots are gapless from 0 in each shard, in doc_id order
within hash buckets of doc_id; null doc_ids have a bucket too. Ties of spread go to the vector that came
first, so the result depends on the groups alone. Long texts count by their size only. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage

ROW_BYTES = 16
#: Groups that a task differences together, on average.
UNIT_GROUPS = 1000
#: A group is large beyond this part of a fair share.
PARTS = 64


def difference_groups(sizes: np.ndarray, k: int, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The final sums and the part of each group. `base` is a partial partition to start from: parts are its entries.

    A vector is a pair of sorted sums and the node that made them; parts are handed down the tree of nodes.
    """
    n = len(sizes)
    base = np.zeros(k, np.int64) if base is None else np.asarray(base, np.int64)
    size = 2 * n + 2
    left, right, perm = np.full(size, -1, np.int64), np.full(size, -1, np.int64), [None] * size
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    rank = np.argsort(-base, kind="stable")
    sums: dict[int, np.ndarray] = {n: base[rank]}
    heap.append((-int(base.max() - base.min()), n))
    heapq.heapify(heap)
    top = n + 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        # every held vector is sorted downwards
        va, vb = (sums.pop(i, None) for i in (a, b))
        if va is None:
            va = np.zeros(k, np.int64)
            va[0] = sizes[a]
        if vb is None:
            vb = np.zeros(k, np.int64)
            vb[0] = sizes[b]
        new = va + vb[::-1]
        order = np.argsort(-new, kind="stable").astype(np.int16 if k < 32768 else np.int64)
        sums[top] = new = new[order]
        # old entry j of a stands at inv[j]; of b at inv[k - 1 - j]
        left[top], right[top], perm[top] = a, b, order
        heapq.heappush(heap, (-int(new[0] - new[-1]), top))
        top += 1
    root = heap[0][1]
    place: dict[int, np.ndarray] = {root: np.arange(k)}
    part = np.zeros(n, np.int64)
    for i in range(top - 1, n, -1):
        here = place.pop(i, None)
        if here is None:
            continue
        inv = np.empty(k, np.int64)
        inv[perm[i]] = np.arange(k)
        for child, to in ((left[i], here[inv]), (right[i], here[inv[::-1]])):
            if child < n:
                part[child] = to[0]
            else:
                place[int(child)] = to
    entry = np.empty(k, np.int64)  # the entry of base that stands at each place of the root
    entry[place[n]] = rank
    out = np.empty(k, np.int64)
    out[entry] = sums[root]
    return out, entry[part]


def _unit(k: int, large: np.ndarray, rest: int):
    """The shard of each group of a unit; large: sums of the large groups, rest: size of all others."""

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by([("size", "descending"), ("digest", "ascending")])
        sizes = table.column("size").to_numpy()
        share = (large * (float(sizes.sum()) / max(rest, 1))).astype(np.int64)
        return pa.table({"digest": table.column("digest"), "size": table.column("size"), "shard": pa.array(difference_groups(sizes, k, share)[1], pa.int32())})

    return run


def shards(spark: SparkSession, docs: DataFrame, k: int = 40, unit_groups: int = UNIT_GROUPS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, group (digest), shard and slot of every row."""
    stage = Stage(spark, "sharding")
    text = F.col("text").cast("string")
    rows = stage.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + row_bytes).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("digest"),
        ),
        "rows",
    )
    groups = stage.keep(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    about = groups.agg(F.count("*"), F.sum("size")).first()
    units, total = max(1, about[0] // unit_groups), about[1] or 0
    limit = total // (k * PARTS)
    by_size = lambda rows: sorted(((r["size"], bytes(r["digest"])) for r in rows), key=lambda x: (-x[0], x[1]))
    large = by_size(groups.where(F.col("size") > limit).collect())  # k * PARTS at most, as their sizes add up to the total
    sums, part = difference_groups(np.array([s for s, _ in large], np.int64), k)
    rest = total - int(sums.sum())
    small = groups.where(F.col("size") <= limit).withColumn("unit", F.pmod(F.xxhash64("digest"), F.lit(units)))
    placed = small.where("unit > 0").groupBy("unit").applyInArrow(_unit(k, sums, rest), "digest binary, size long, shard int")
    placed = stage.keep(placed, "units")
    for r in placed.groupBy("shard").agg(F.sum("size").alias("n")).collect():  # k rows
        sums[r["shard"]] += r["n"]
    last = by_size(small.where("unit = 0").select("size", "digest").collect())  # one unit
    few = [(d, int(p)) for (_, d), p in zip(large, part, strict=True)] + [(d, int(p)) for (_, d), p in zip(last, difference_groups(np.array([s for s, _ in last], np.int64), k, sums)[1], strict=True)]
    placed = placed.select("digest", "shard").unionByName(spark.createDataFrame(few, "digest binary, shard int"))
    placed = stage.keep(placed, "placed")
    deals = F.pmod(F.xxhash64("doc_id"), F.lit(units)).cast("int")
    dealt = stage.keep(rows.join(placed.hint("merge"), "digest").withColumn("deal", deals), "dealt")
    before = Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "deal").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("shard", "deal").orderBy("doc_id", "digest"))
    return dealt.withColumn("rank", rank).join(starts.hint("merge"), ["shard", "deal"]).select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
