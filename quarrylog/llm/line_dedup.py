"""Line dedup by a suffix array over line-id sequences; DataFrame functions only.

A text is a sequence of lines (split at \\n). Prefix doubling ranks the runs of 1, 2, 4, ... lines that
begin at each line: the rank of 2**(k+1) lines is the place of the pair (rank of the first 2**k, rank of
the next 2**k) in sorted order. Runs that occur once drop out of the next round, so rounds shrink, and
they end at the longest run that is asked about.

A run counts when it has `min_words` words; it begins at a line that has words. Two kinds of windows
tell all such runs: for every line the shortest run of `min_words` words that begins there, and the
shortest that ends there. A window of L lines has a name: the suffixes that agree in their first L
lines are one interval of the suffix array whose common prefixes are L lines or longer, told by two
overlapping ranks of 2**k <= L lines. The interval's smallest place (doc_id, then line) owns the window;
in all later places its lines are deleted. In a maximal repeated run the window that begins at its
first line, and those that end at each line after that window, lie inside the run and cover it. What
is deleted of a document is therefore exactly the union of its maximal repeated runs of `min_words`
words or more that begin earlier elsewhere; overlaps count, and runs are judged on the input, not on
what is left.

A line's words are its maximal runs of characters other than blank, tab and carriage return. Null text
stays null, empty text stays empty; neither has runs. Blank lines have no words; they go inside or at the
end of a run, and stay before it. Null doc_ids sort first. Rows with equal doc_ids are told apart by their
text; wholly repeated rows are one document and are treated alike. A very long text is one row for each
of its lines. An empty table gives no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, free_name, release

MIN_WORDS = 40
_KEY = ["d", "t"]


def _key() -> list:
    """What tells documents apart; the text matters only where doc_ids repeat."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))]


def n_words(line: str):
    """Words of a column; only lines with neighbouring blanks need a pattern."""
    plain = F.trim(F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))
    blanks = F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(plain == "", 0).when(plain.contains("  "), F.regexp_count(plain, F.lit("[^ ]+"))).otherwise(blanks + 1)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """d, t, pos, two hashes of the line, and n to m: the lines of the windows that begin here.

    n is the shortest run of min_words words; the longer ones, if any, are the shortest that end where they end."""
    d, t = _key()
    keyed = docs.select(d.alias("d"), t.alias("t"), F.col("text").cast("string").alias("text")).where("text <> ''")
    if keyed.groupBy(*_KEY).count().where("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(_KEY)
    each = keyed.select(*_KEY, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    each = each.select(*_KEY, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), F.least(n_words("line"), F.lit(min_words)).cast("long").alias("w"))
    # words are counted up to min_words a line, so the run that begins after a line ends within 2 * min_words
    by_doc = Window.partitionBy(*_KEY).orderBy("pos")
    summed = each.withColumn("sum", F.sum("w").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.min("pos").over(Window.partitionBy(*_KEY).orderBy("sum").rangeBetween(min_words, 2 * min_words))
    summed = summed.withColumn("end_after", after)
    first_end = F.min(F.when(F.col("sum") >= min_words, F.col("pos"))).over(by_doc.rowsBetween(0, Window.unboundedFollowing))
    end = F.when(F.col("w") >= min_words, F.col("pos")).when(F.col("pos") == 0, first_end).otherwise(F.lag("end_after").over(by_doc))
    # until the next line's own shortest run ends, or the text does, no shorter run ends there
    ends = summed.withColumn("end", end).withColumn("last", F.coalesce(F.lead("end").over(by_doc) - 1, F.max("pos").over(Window.partitionBy(*_KEY))))
    length = lambda to: F.when(F.col("w") > 0, F.col(to) - F.col("pos") + 1)
    return ends.select(*_KEY, "pos", "h1", "h2", length("end").alias("n"), F.when(F.col("end").isNotNull(), F.greatest(length("end"), length("last"))).alias("m"))


def _ranked(stage: Stage, rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """d, t, pos, n, m, r: r is the place of the row's key among the sorted keys that occur twice or more."""
    keys = rows.groupBy(*by).agg(F.count("*").alias("times")).where("times > 1").select(*by)
    order = stage.keep(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id()), f"order-{name}")
    ranked = stage.keep(rows.join(order, by).select(*_KEY, "pos", "n", "m", "r"), f"rank-{name}")
    stage.drop(f"order-{name}")
    del keys, order
    release(rows.sparkSession)  # a round's shuffles are of no use to the next
    return ranked


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, stage: Stage | None = None) -> DataFrame:
    """Maximal runs of lines to delete: d, t (document), start, end (inclusive lines)."""
    stage = stage or Stage(spark, "lines")
    lines = stage.keep(_lines(docs, min_words), "lines")
    rank = _ranked(stage, lines, ["h1", "h2"], "0")
    stage.drop("lines")
    longest = rank.agg(F.max("m")).first()[0] or 0
    named, k = [], 0
    while (1 << k) <= longest:
        step = 1 << k
        here = rank.where((F.col("m") >= step) & (F.col("n") < 2 * step))
        here = here.select(*_KEY, "pos", "r", F.explode(F.sequence(F.greatest("n", F.lit(step)), F.least("m", F.lit(2 * step - 1)))).alias("n"))
        tail = rank.select(*_KEY, F.col("pos").alias("at"), F.col("r").alias("r2"))
        if k == 0:
            whole = here.withColumn("r2", F.col("r"))
        else:
            whole = here.withColumn("at", F.col("pos") + F.col("n") - step).join(tail, [*_KEY, "at"]).drop("at")
        named.append(stage.keep(whole.select(*_KEY, "pos", "n", F.col("r").alias("r1"), "r2"), f"named-{k}"))
        k += 1
        if (1 << k) > longest:
            break
        pairs = rank.withColumn("at", F.col("pos") + step).join(tail, [*_KEY, "at"]).select(*_KEY, "pos", "n", "m", F.col("r").alias("r1"), "r2")
        rank = _ranked(stage, pairs, ["r1", "r2"], str(k))
        stage.drop(f"rank-{k - 1}")
    if not named:
        return spark.createDataFrame([], "d long, t long, start int, end int")
    every = named[0]
    for x in named[1:]:
        every = every.unionByName(x)
    # one interval of the suffix array for each name; its smallest place owns the run
    name = ["n", "r1", "r2"]
    # written first, so that the rows of a hot name may be split among tasks where they meet it
    owners = every.groupBy(*name).agg(F.min(F.struct(*_KEY, "pos")).alias("owner"), F.count("*").alias("times")).where("times > 1").drop("times")
    owners = stage.keep(owners, "owners")
    later = every.join(owners.hint("merge"), name).where(F.struct(*_KEY, "pos") > F.col("owner")).select(*_KEY, F.col("pos").alias("start"), (F.col("pos") + F.col("n") - 1).cast("int").alias("end"))
    # overlapping and touching runs of a document become one
    order = Window.partitionBy(*_KEY).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*_KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs. The last column, `__removed` or with more underscores where
    that is taken, has the deleted runs (array of start and end lines, or null)."""
    stage = Stage(spark, "line-dedup")
    runs = repeated_runs(spark, docs, min_words, stage)
    removed, d, t = (free_name(docs, x) for x in ("__removed", "__d", "__t"))
    by_doc = stage.keep(runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(removed)), "removed")
    # a merge join at every size: whether `removed` fits a broadcast must not change what is moved
    keyed = docs.withColumns(dict(zip((d, t), _key(), strict=True)))
    keyed = keyed.join(by_doc.withColumnsRenamed({"d": d, "t": t}).hint("merge"), [d, t], "left").select(*[keyed[c] for c in docs.columns], removed)
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.exists(F.col(removed), lambda s: (i >= s["start"]) & (i <= s["end"])))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return keyed.withColumn("text", text)


def summary(docs: DataFrame) -> DataFrame:
    """Of what remove_repeated_lines returns: lines deleted, maximal runs, and the hash of what is left."""
    runs = F.col(docs.columns[-1])
    lines = F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"] + 1), F.lit(0).cast("long"))
    return docs.select("doc_id", lines.alias("n_removed_lines"), F.coalesce(F.when(runs.isNotNull(), F.size(runs)), F.lit(0)).cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute_force(texts: dict, min_words: int) -> dict:
    """doc_id -> (lines deleted, text left), from the definition: every run that also begins earlier, as long as it gets."""
    lines = {i: (t.split("\n") if t else []) for i, t in texts.items()}
    words = {i: [len(x.replace("\t", " ").replace("\r", " ").split(" ")) - x.replace("\t", " ").replace("\r", " ").split(" ").count("") for x in xs] for i, xs in lines.items()}
    earlier: dict[str, list] = {}
    out = {}
    for i in sorted(texts):
        gone: set[int] = set()
        for p, x in enumerate(lines[i]):
            far = 0
            for j, q in earlier.get(x, ()):
                k = 1
                while p + k < len(lines[i]) and q + k < len(lines[j]) and lines[i][p + k] == lines[j][q + k]:
                    k += 1
                far = max(far, k)
            if words[i][p] and sum(words[i][p : p + far]) >= min_words:
                gone.update(range(p, p + far))
            earlier.setdefault(x, []).append((i, p))
        out[i] = (len(gone), "\n".join(x for p, x in enumerate(lines[i]) if p not in gone))
    return out
