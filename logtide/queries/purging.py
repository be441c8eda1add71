"""Purges, links, retention and change logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.functions.times import seconds_of
from logtide.operators.changelog import latest_state
from logtide.operators.links import clear_links, orphans, purge_orphans, purge_unreferenced
from logtide.operators.retention import (partition_retention, purge_by_policy, purge_expired,
                                         purge_range_plan, purge_walked, removed_rows)
from logtide.operators.stats import high_water, table_stats
from logtide.plans.purge import EXPIRED, ORPHANED, LinkGraph, audit_rows, purge_cascade, purge_report, retain_partitions
from logtide.plans.resumable import resumable_purge
from logtide.queries.registry import query, table, work_dir

#: 2024-01-16, in the middle of the events
EVENTS_CUTOFF = 1_705_363_200
#: 1998-01-01, in the middle of the orders
ORDERS_CUTOFF = 883_612_800
#: 2024-02-10
NOW = 1_707_523_200

EVENTS_OLD = "ts >= TIMESTAMP '1970-01-01' AND ts < TIMESTAMP '2024-01-16'"
ORDERS_OLD = "o_orderdate >= TIMESTAMP '1970-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'"
ITEMS_OLD = "l_shipdate >= TIMESTAMP '1970-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'"


@query("purge_expired", f"SELECT * FROM events WHERE NOT ({EVENTS_OLD})")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return purge_expired(table(spark, folder, "events"), "event_id", "ts", EVENTS_CUTOFF)


@query("purge_keep_newest", """
    SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders
    WHERE NOT (o_orderdate >= TIMESTAMP '1970-01-01' AND o_orderdate < TIMESTAMP '2002-01-01')
       OR o_orderkey = (SELECT max(o_orderkey) FROM orders)""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    return purge_expired(orders, "o_orderkey", "o_orderdate", 1_009_843_200, keep_newest=True).select(
        "o_orderkey", "o_orderdate", "o_orderstatus")


@query("purge_idempotent", f"SELECT event_id, event_type FROM events WHERE NOT ({EVENTS_OLD})")
def _(spark, folder):
    once = purge_expired(table(spark, folder, "events"), "event_id", "ts", EVENTS_CUTOFF)
    return purge_expired(once, "event_id", "ts", EVENTS_CUTOFF).select("event_id", "event_type")


POLICIES = [("click", "30d"), ("error", "4w,2d12h # a month and a bit"), ("view", "false"), ("signup", "6months"),
            ("purchase", "720.5h")]


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "table string, retention string")


@query("purge_by_policy", f"""
    SELECT event_id, event_type FROM (
        SELECT event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE event_type
            WHEN 'click' THEN {NOW} - 2592000 WHEN 'error' THEN {NOW} - 2635200
            WHEN 'purchase' THEN {NOW} - 2593800 END AS cutoff FROM events)
    WHERE cutoff IS NULL OR t < 0 OR t >= cutoff""")
def _(spark, folder):
    events = table(spark, folder, "events")
    return purge_by_policy(events, "event_type", "ts", policies(spark), NOW).select("event_id", "event_type")


def disordered(events: DataFrame) -> DataFrame:
    """Events as a log whose errors carry times ten days behind and whose purchases a year ahead."""
    at = seconds_of(events, "ts")
    return events.select("event_id", F.when(F.col("event_type") == "error", at - 864_000)
                         .when(F.col("user_id") == 7, at + 31_536_000).otherwise(at).alias("time"), "event_type", "user_id")


DISORDERED = """SELECT event_id, event_type, user_id, CAST(floor(epoch(ts)) AS BIGINT)
    + CASE WHEN event_type = 'error' THEN -864000 WHEN user_id = 7 THEN 31536000 ELSE 0 END AS time FROM events"""

WALK = f"""WITH d AS ({DISORDERED}), r AS (
        SELECT event_id // 200 AS range, min(event_id) AS from_id, max(event_id) AS to_id, count(*) AS rows,
            min(time) AS oldest, count(*) FILTER (WHERE time >= 0 AND time < {EVENTS_CUTOFF}) AS expired FROM d GROUP BY 1),
    e AS (SELECT min(range) AS finish FROM r
        WHERE oldest >= {EVENTS_CUTOFF} + 86400 AND oldest <= {NOW} + 86400)"""


@query("purge_range_plan", WALK + f"""
    SELECT range, from_id, to_id, rows, oldest, expired, step,
        CASE WHEN step = 'purge' THEN expired ELSE 0 END AS removed
    FROM (SELECT r.*, CASE WHEN range > finish THEN 'leave' WHEN range = finish THEN 'finish'
              WHEN oldest >= {EVENTS_CUTOFF} THEN 'skip' ELSE 'purge' END AS step FROM r, e)""")
def _(spark, folder):
    return purge_range_plan(disordered(table(spark, folder, "events")), "event_id", "time", EVENTS_CUTOFF, NOW, 200)


@query("purge_walked", WALK + f"""
    SELECT event_id, time FROM d, e
    WHERE NOT (time >= 0 AND time < {EVENTS_CUTOFF} AND (finish IS NULL OR event_id // 200 < finish))""")
def _(spark, folder):
    log = disordered(table(spark, folder, "events"))
    return purge_walked(log, "event_id", "time", EVENTS_CUTOFF, NOW, 200).select("event_id", "time")


@query("partition_retention", """
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS rows,
        count(*) FILTER (WHERE NOT (l_shipdate >= TIMESTAMP '1970-01-01' AND l_shipdate < TIMESTAMP '1998-01-15')) AS kept_rows,
        CASE WHEN date_trunc('month', l_shipdate) + INTERVAL 1 MONTH <= TIMESTAMP '1998-01-15' THEN 'drop'
             WHEN date_trunc('month', l_shipdate) >= TIMESTAMP '1998-01-15' THEN 'keep' ELSE 'rewrite' END AS action
    FROM lineitem GROUP BY date_trunc('month', l_shipdate)""")
def _(spark, folder):
    return partition_retention(table(spark, folder, "lineitem"), "l_shipdate", 884_822_400)


@query("retain_months", """SELECT l_orderkey, l_linenumber, l_shipdate, CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem
    WHERE NOT (l_shipdate >= TIMESTAMP '1970-01-01' AND l_shipdate < TIMESTAMP '1998-01-15')""")
def _(spark, folder):
    """Line items in a catalog table by month: old months are dropped from the catalog alone, the month of the cutoff is rewritten."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    path, name = work_dir(spark), f"months_{uuid.uuid4().hex}"
    items.withColumn("month", F.trunc("l_shipdate", "MM").cast("date")).repartition("month").write.partitionBy("month").parquet(path)
    spark.sql(f"CREATE TABLE {name} (l_orderkey BIGINT, l_linenumber {dict(items.dtypes)['l_linenumber']}, l_shipdate {dict(items.dtypes)['l_shipdate']}, month DATE) "
              f"USING parquet PARTITIONED BY (month) LOCATION '{path}'")
    try:
        spark.sql(f"MSCK REPAIR TABLE {name}")
        retain_partitions(spark, name, "month", "l_shipdate", 884_822_400, work_dir(spark))
        left = [row[0] for row in spark.sql(f"SHOW PARTITIONS {name}").collect()]
        kept_months = [part.split("=", 1)[1] for part in left]
        schema = spark.table(name).schema
    finally:
        spark.sql(f"DROP TABLE {name}")
    # What the catalog listed last, by path: the query's result outlives the catalog entry
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/month={m}" for m in kept_months])


@query("clear_links", """
    SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN o_custkey END AS o_custkey, o_orderstatus
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus FROM orders)
    LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 1000) ON o_custkey = c_custkey""")
def _(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"), "o_orderstatus")
    customers = table(spark, folder, "customer").filter(F.col("c_acctbal") >= 1000)
    return clear_links(orders, "o_custkey", customers, "c_custkey")


@query("purge_orphans", f"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem
    WHERE NOT ({ITEMS_OLD} AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND NOT ({ORDERS_OLD})))""")
def _(spark, folder):
    orders = purge_expired(table(spark, folder, "orders"), "o_orderkey", "o_orderdate", ORDERS_CUTOFF)
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    return purge_orphans(items, "l_orderkey", orders, "o_orderkey", "l_shipdate", ORDERS_CUTOFF)


@query("purge_unreferenced", f"""
    SELECT o_orderkey, o_orderstatus FROM orders
    WHERE NOT ({ORDERS_OLD} AND o_orderstatus = 'F'
        AND NOT EXISTS (SELECT 1 FROM lineitem WHERE CASE WHEN l_returnflag = 'R' THEN l_orderkey END = o_orderkey)
        AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_orderkey))""")
def _(spark, folder):
    items = table(spark, folder, "lineitem").select(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("l_orderkey"))
    return purge_unreferenced(
        table(spark, folder, "orders"), "o_orderkey",
        [(items, "l_orderkey"), (table(spark, folder, "events"), "user_id")],
        F.col("o_orderstatus") == "F", "o_orderdate", ORDERS_CUTOFF).select("o_orderkey", "o_orderstatus")


# The cascade: orders are the hub, linked to events and customers; line items and parts refer to it.

def cascade_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("rowid"),
        (F.lit(ORDERS_CUTOFF) + F.floor(F.col("c_acctbal")).cast("bigint") * 1000 - 4_000_000).alias("time"))
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("rowid"),
        (seconds_of(table(spark, folder, "events"), "ts") - (EVENTS_CUTOFF - ORDERS_CUTOFF)).alias("time"))
    orders = table(spark, folder, "orders")
    hub = orders.select(
        F.col("o_orderkey").alias("rowid"), seconds_of(orders, "o_orderdate").alias("time"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).alias("block_rowid"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey")).alias("kill_rowid"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("removed"))
    items = table(spark, folder, "lineitem")
    interactions = items.select(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("entity_spawn_rowid"), "l_partkey", "l_linenumber",
                                seconds_of(items, "l_shipdate").alias("time"))
    parts = table(spark, folder, "part")
    containers = parts.select(
        F.col("p_partkey").alias("rowid"), (F.col("p_partkey") * 9).alias("entity_spawn_rowid"),
        (F.lit(ORDERS_CUTOFF) + (F.col("p_size").cast("bigint") - 25) * 1_000_000).alias("time"))
    return {"block": customers, "entity": events, "entity_spawn": hub, "entity_interaction": interactions,
            "entity_container": containers}


def cascade(spark: SparkSession, folder: str):
    return purge_cascade(cascade_tables(spark, folder), ["block", "entity"], LinkGraph(), ORDERS_CUTOFF)


CASCADE = f"""WITH block0 AS (SELECT c_custkey AS rowid,
        {ORDERS_CUTOFF} + CAST(floor(c_acctbal) AS BIGINT) * 1000 - 4000000 AS time FROM customer),
    entity0 AS (SELECT event_id AS rowid,
        CAST(floor(epoch(ts)) AS BIGINT) - {EVENTS_CUTOFF - ORDERS_CUTOFF} AS time FROM events),
    spawn0 AS (SELECT o_orderkey AS rowid, CAST(epoch(o_orderdate) AS BIGINT) AS time,
        CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS block_rowid,
        CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey END AS kill_rowid,
        CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS removed FROM orders),
    inter0 AS (SELECT CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS spawn, l_partkey, l_linenumber,
        CAST(epoch(l_shipdate) AS BIGINT) AS time FROM lineitem),
    cont0 AS (SELECT p_partkey AS rowid, p_partkey * 9 AS spawn, {ORDERS_CUTOFF} + (p_size - 25) * 1000000 AS time FROM part),
    block1 AS (SELECT * FROM block0 WHERE NOT (time >= 0 AND time < {ORDERS_CUTOFF})),
    entity1 AS (SELECT * FROM entity0 WHERE NOT (time >= 0 AND time < {ORDERS_CUTOFF})),
    spawn1 AS (SELECT s.*,
        s.kill_rowid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entity1 e WHERE e.rowid = s.kill_rowid) AS kill_gone,
        s.block_rowid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM block1 b WHERE b.rowid = s.block_rowid) AS block_gone
        FROM spawn0 s),
    spawn2 AS (SELECT rowid, time, removed, kill_gone, block_gone,
        CASE WHEN NOT kill_gone THEN kill_rowid END AS kill_rowid,
        CASE WHEN NOT block_gone THEN block_rowid END AS block_rowid FROM spawn1),
    inter1 AS (SELECT i.*, i.time >= 0 AND i.time < {ORDERS_CUTOFF}
        AND NOT EXISTS (SELECT 1 FROM spawn0 s WHERE s.rowid = i.spawn) AS orphan FROM inter0 i),
    cont1 AS (SELECT c.*, c.time >= 0 AND c.time < {ORDERS_CUTOFF}
        AND NOT EXISTS (SELECT 1 FROM spawn0 s WHERE s.rowid = c.spawn) AS orphan FROM cont0 c),
    spawn3 AS (SELECT s.*, s.time >= 0 AND s.time < {ORDERS_CUTOFF} AND removed = 1
        AND block_rowid IS NULL AND kill_rowid IS NULL
        AND NOT EXISTS (SELECT 1 FROM cont1 c WHERE NOT c.orphan AND c.spawn = s.rowid)
        AND NOT EXISTS (SELECT 1 FROM inter1 i WHERE NOT i.orphan AND i.spawn = s.rowid) AS orphan FROM spawn2 s)"""


@query("purge_cascade", CASCADE + " SELECT rowid, time, block_rowid, kill_rowid, removed FROM spawn3 WHERE NOT orphan")
def _(spark, folder):
    return cascade(spark, folder).tables["entity_spawn"]


@query("purge_report", CASCADE + """, rows_by_kind AS (
    SELECT 'block' AS "table", 'expired rows' AS kind, (SELECT count(*) FROM block0) - (SELECT count(*) FROM block1) AS rows
    UNION ALL SELECT 'entity', 'expired rows', (SELECT count(*) FROM entity0) - (SELECT count(*) FROM entity1)
    UNION ALL SELECT 'entity_spawn', 'links', (SELECT count(*) FROM spawn1 WHERE kill_gone) + (SELECT count(*) FROM spawn1 WHERE block_gone)
    UNION ALL SELECT 'entity_interaction', 'orphaned rows', (SELECT count(*) FROM inter1 WHERE orphan)
    UNION ALL SELECT 'entity_container', 'orphaned rows', (SELECT count(*) FROM cont1 WHERE orphan)
    UNION ALL SELECT 'entity_spawn', 'orphaned rows', (SELECT count(*) FROM spawn3 WHERE orphan))
    SELECT "table", kind, rows, CASE WHEN kind = 'links' THEN 0 ELSE rows END AS removed,
        CASE WHEN kind = 'expired rows' THEN 0 ELSE rows END AS orphans_changed FROM rows_by_kind""")
def _(spark, folder):
    return cascade(spark, folder).report()


@query("purge_resumed", CASCADE + """
    SELECT 'block' AS "table", 'expired rows' AS kind, (SELECT count(*) FROM block0) - (SELECT count(*) FROM block1) AS rows, (SELECT count(*) FROM block1) AS "left"
    UNION ALL SELECT 'entity', 'expired rows', (SELECT count(*) FROM entity0) - (SELECT count(*) FROM entity1), (SELECT count(*) FROM entity1)
    UNION ALL SELECT 'entity_interaction', 'orphaned rows', count(*) FILTER (WHERE orphan), count(*) FILTER (WHERE NOT orphan) FROM inter1
    UNION ALL SELECT 'entity_container', 'orphaned rows', count(*) FILTER (WHERE orphan), count(*) FILTER (WHERE NOT orphan) FROM cont1
    UNION ALL SELECT 'entity_spawn', 'links', (SELECT count(*) FILTER (WHERE kill_gone) + count(*) FILTER (WHERE block_gone) FROM spawn1),
        (SELECT count(*) FROM spawn3 WHERE NOT orphan)
    UNION ALL SELECT 'entity_spawn', 'orphaned rows', count(*) FILTER (WHERE orphan), count(*) FILTER (WHERE NOT orphan) FROM spawn3""")
def _(spark, folder):
    """A purge of stored tables that is stopped between two steps and goes on from its journal."""
    root, sources = work_dir(spark), {}
    for name, df in cascade_tables(spark, folder).items():
        sources[name] = f"{root}/source/{name}"
        df.write.parquet(sources[name])
    purge = lambda stop: resumable_purge(spark, f"{root}/purge", sources, ["block", "entity"], LinkGraph(), ORDERS_CUTOFF, stop=stop)
    purge(lambda step: step == "orphans entity_container")
    return purge(lambda step: False).report(spark)


@query("purge_flagship", f"""
    WITH kept_orders AS (SELECT * FROM orders WHERE NOT ({ORDERS_OLD})),
    lost AS (SELECT count(*) AS n FROM lineitem WHERE {ITEMS_OLD}
        AND NOT EXISTS (SELECT 1 FROM kept_orders WHERE o_orderkey = l_orderkey)),
    r AS (SELECT 'orders' AS "table", 'expired rows' AS kind, (SELECT count(*) FROM orders WHERE {ORDERS_OLD}) AS rows
        UNION ALL SELECT 'lineitem', 'orphaned rows', n FROM lost)
    SELECT "table", kind, rows, rows AS removed, CASE WHEN kind = 'expired rows' THEN 0 ELSE rows END AS orphans_changed FROM r""")
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Purge old orders, remove the line items they leave behind, and report."""
    orders, items = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    gone = removed_rows(orders, "o_orderkey", "o_orderdate", ORDERS_CUTOFF)
    left = purge_expired(orders, "o_orderkey", "o_orderdate", ORDERS_CUTOFF)
    lost = orphans(items, "l_orderkey", left, "o_orderkey", "l_shipdate", ORDERS_CUTOFF)
    return purge_report([audit_rows(gone, "orders", EXPIRED), audit_rows(lost, "lineitem", ORPHANED)])


@query("high_water", """SELECT 'events' AS "table", max(event_id) AS high_water FROM events
    UNION ALL SELECT 'orders', max(o_orderkey) FROM orders""")
def _(spark, folder):
    before = {"events": (table(spark, folder, "events"), "event_id"), "orders": (table(spark, folder, "orders"), "o_orderkey")}
    allocated = table_stats(before).select("table", F.col("max_id").alias("allocated"))
    # Errors and urgent orders gone, whichever ids they had
    after = {"events": (before["events"][0].filter(F.col("event_type") == "click"), "event_id"),
             "orders": (before["orders"][0].filter(F.col("o_orderpriority") == "5-LOW"), "o_orderkey")}
    return high_water(table_stats(after), allocated)


@query("latest_state", """
    SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS event_type,
        arg_max(value, event_id) FILTER (WHERE event_type <> 'click') AS value,
        arg_max(props, event_id) FILTER (WHERE event_type = 'purchase') AS props
    FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0""")
def _(spark, folder):
    kind = F.col("event_type")
    log = table(spark, folder, "events").select(
        "user_id", "event_id", F.when(kind != "view", kind).alias("event_type"),
        F.when(kind != "click", F.col("value")).alias("value"), F.when(kind == "purchase", F.col("props")).alias("props"))
    return latest_state(log, "user_id", "event_id", shown_with="props")
