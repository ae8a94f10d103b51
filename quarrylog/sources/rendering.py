"""Renders event tables as log text, so that text operators can be run and checked on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Level of each event type.
LEVEL_OF = {"click": "I", "view": "D", "signup": "W", "error": "E", "purchase": "F"}


def events_as_lines(events: DataFrame, style: str = "threadtime") -> DataFrame:
    """line_no, raw: one line an event, in threadtime or time format."""
    level = F.create_map(*[F.lit(x) for kv in LEVEL_OF.items() for x in kv])[F.col("event_type")]
    when = F.date_format("ts", "MM-dd HH:mm:ss.SSS")
    pid, tid = (F.col("user_id") + 1000).cast("string"), (F.col("user_id") + 2000).cast("string")
    tag = F.concat(F.initcap("event_type"), F.lit("Service"))
    if style == "threadtime":
        raw = F.concat(when, F.lit("  "), pid, F.lit("  "), tid, F.lit(" "), level, F.lit(" "), tag, F.lit(": "), F.col("props"))
    else:
        raw = F.concat(when, F.lit(" "), level, F.lit("/"), tag, F.lit("( "), pid, F.lit("): "), F.col("props"))
    return events.select((F.col("event_id") + 1).alias("line_no"), raw.alias("raw"))


def documents_as_lines(docs: DataFrame) -> DataFrame:
    """source_id, line_no, raw: the lines of each document."""
    return docs.select(F.col("doc_id").alias("source_id"), F.posexplode(F.split("text", "\n", -1)).alias("at", "raw")).select("source_id", (F.col("at") + 1).cast("long").alias("line_no"), "raw")


def events_as_problems(events: DataFrame) -> DataFrame:
    """line_no, raw: errors as four lines of a crash, purchases as one line of the low-memory killer, others as plain lines."""
    when = F.date_format("ts", "MM-dd HH:mm:ss.SSS")
    pid = (F.col("user_id") + 1000).cast("string")
    name = F.concat(F.lit("com.example.u"), (F.col("user_id") % 10).cast("string"))
    head = F.concat(when, F.lit("  "), pid, F.lit("  "), pid, F.lit(" "))
    fatal = lambda text: F.concat(head, F.lit("E AndroidRuntime: "), text)
    kind = F.concat(F.lit("com.example.Fault"), (F.col("user_id") % 5).cast("string"), F.lit("Exception"))
    crash = F.array(fatal(F.lit("FATAL EXCEPTION: main")), fatal(F.concat(F.lit("Process: "), name, F.lit(", PID: "), pid)), fatal(F.concat(kind, F.lit(": boom"))), fatal(F.lit("\tat com.example.Main.run(Main.java:10)")))
    kill = F.array(F.concat(head, F.lit("I lmkd: Kill '"), name, F.lit("' ("), pid, F.lit("), uid 10001, oom_score_adj 900 to free 1000kB rss; reason: low watermark is breached")))
    plain = F.array(F.concat(head, F.lit("D Ui: "), F.col("props")))
    lines = F.when(F.col("event_type") == "error", crash).when(F.col("event_type") == "purchase", kill).otherwise(plain)
    return events.select("event_id", F.posexplode(lines).alias("j", "raw")).select((F.col("event_id") * 8 + F.col("j") + 1).alias("line_no"), "raw")


def tables_as_lines(events: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """raw: one device log of three tables, a line a row. Very few are faults, as in a healthy device's log: one
    event in 4096 that is an error is a crash of four lines, one that is a purchase a kill by the low-memory killer."""
    shop = orders.select(F.concat(F.date_format("o_orderdate", "MM-dd HH:mm:ss.SSS"), F.lit("  2100  2101 "), F.when(F.col("o_orderpriority").startswith("1"), "W").otherwise("I"), F.lit(" OrderService: order "), F.col("o_orderkey"), F.lit(" of customer "), F.col("o_custkey"), F.lit(" placed, total "), F.col("o_totalprice"), F.lit(", connection kept")).alias("raw"))
    level = F.when(F.col("l_returnflag") == "R", "E").when(F.col("l_returnflag") == "A", "I").otherwise("D")
    ship = lineitem.select(F.concat(F.date_format("l_shipdate", "MM-dd HH:mm:ss.SSS"), F.lit("  2200  "), (F.col("l_suppkey") % 30 + 2200), F.lit(" "), level, F.lit(" ShipService: item "), F.col("l_linenumber"), F.lit(" of order "), F.col("l_orderkey"), F.lit(" from supplier "), F.col("l_suppkey"), F.lit(", quantity "), F.col("l_quantity"), F.when(F.col("l_linestatus") == "O", ", connection reset").otherwise(", connection timeout after retry")).alias("raw"))
    rare = F.col("event_id") % 4096 == 0
    kind = F.when(rare, F.col("event_type")).otherwise("click")
    faults = events_as_problems(events.withColumn("event_type", kind)).select("raw")
    return shop.unionByName(ship).unionByName(faults)
