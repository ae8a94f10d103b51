from pyspark.sql import functions as F

from quarrylog import queries

SF = "/root/testdata/sf0.001"


def test_every_line_has_a_class_and_a_verdict(spark):
    n = {r.event_type: r["count"] for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").count().collect()}
    rest = sum(n.values()) - n["error"] - n["purchase"]
    got = {(r["class"], r.passes): r.n for r in queries.QUERIES["gate_lines"](spark, SF).collect()}
    assert got == {("fatal", True): n["error"], ("continuation", True): 2 * n["error"], ("none", True): n["error"], ("lmk", True): n["purchase"], ("none", False): rest}


def test_every_event_is_highlighted(spark):
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    assert queries.QUERIES["highlight_tokens_all"](spark, SF).where(F.col("n_tokens").isNotNull()).count() == total
