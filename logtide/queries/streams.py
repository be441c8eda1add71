"""Streams over the fixture tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.plans.ledger import LedgerTable
from logtide.queries.purging import NOW
from logtide.queries.registry import query, table, work_dir
from logtide.queries.routing import DEFAULT, ROUTED, ROUTES
from logtide.sources.files import folders
from logtide.streaming.jobs import catch_up, catch_up_with_ids, dedupe_exact, dedupe_late, live_policy, run_to_end, to_parquet


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream: its one file, or the files of its folder."""
    reader, file = spark.readStream.schema(table(spark, folder, name).schema), f"{name}.parquet"
    if file in folders(spark, folder):
        return reader.parquet(f"{folder}/{file}")
    return reader.option("pathGlobFilter", file).parquet(folder)


@query("stream_catch_up", """SELECT event_id, event_type, user_id FROM events
    WHERE event_id > (SELECT min(event_id) FROM events WHERE ts >= TIMESTAMP '2024-01-10')""")
def _(spark, folder):
    """Events after the last one a snapshot took on 10 January, appended behind it."""
    out, checkpoint = work_dir(spark), work_dir(spark)
    taken = table(spark, folder, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    mark = taken.agg(F.min("event_id")).first()[0]
    for _run in range(2):  # a second run finds nothing new
        run_to_end(catch_up(stream(spark, folder, "events"), "event_id", mark, out, checkpoint))
    return spark.read.parquet(out).select("event_id", "event_type", "user_id")


@query("stream_dedupe_late", "SELECT event_id, user_id FROM events WHERE event_type <> 'purchase'")
def _(spark, folder):
    """Every event twice; purchases carry a time a year ahead and are left out."""
    out, checkpoint = work_dir(spark), work_dir(spark)
    events = stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ahead = F.when(F.col("event_type") == "purchase", F.col("ts") + F.expr("INTERVAL 365 DAYS")).otherwise(F.col("ts"))
    twice = events.withColumn("ts", ahead).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    run_to_end(to_parquet(dedupe_late(twice, "event_id", "ts", NOW).select("event_id", "user_id"), out, checkpoint))
    return spark.read.parquet(out)


@query("stream_catch_up_ids", """
    WITH m AS (SELECT min(event_id) AS taken FROM events WHERE ts >= TIMESTAMP '2024-01-10')
    SELECT 1000000 + row_number() OVER (ORDER BY event_id) AS rowid, event_id, user_id FROM events, m WHERE event_id > taken""")
def _(spark, folder):
    """The same events, with ids of their own above a mark of a million."""
    ledger, checkpoint = LedgerTable(spark, work_dir(spark)), work_dir(spark)
    late = table(spark, folder, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    taken = late.agg(F.min("event_id")).first()[0]
    for _run in range(2):
        run_to_end(catch_up_with_ids(stream(spark, folder, "events").select("event_id", "user_id"), "event_id", "rowid", taken, 1_000_000, ledger, checkpoint))
    return ledger.read("rowid bigint, event_id bigint, user_id bigint").select("rowid", "event_id", "user_id")


@query("stream_dedupe_exact", "SELECT event_id, user_id FROM events WHERE event_type <> 'purchase'")
def _(spark, folder):
    """Every event twice, by two streams into one table; the second brings its copies months late. Purchases carry a time a year ahead."""
    ledger = LedgerTable(spark, work_dir(spark))
    for days in (0, 200):
        events = stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
        ahead = F.when(F.col("event_type") == "purchase", F.lit("2025-06-01").cast("timestamp")).otherwise(F.col("ts"))
        run_to_end(dedupe_exact(events.select("event_id", "user_id", ahead.alias("ts")), "event_id", "ts", NOW, ledger, work_dir(spark)))
    return ledger.read("event_id bigint, user_id bigint").select("event_id", "user_id")


@query("stream_route", ROUTED)
def _(spark, folder):
    out, checkpoint = work_dir(spark), work_dir(spark)
    decided = live_policy(stream(spark, folder, "pages").select("page_id", "url"), "url", ROUTES, DEFAULT)
    run_to_end(to_parquet(decided.select("page_id", "normalized", "pattern", "action", "is_default"), out, checkpoint))
    return spark.read.parquet(out)
