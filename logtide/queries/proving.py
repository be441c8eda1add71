"""Statistics, digests, comparisons and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logtide.functions.times import seconds_of
from logtide.functions.values import normalize, same
from logtide.operators.diff import diff_full, diff_pruned, diff_sample
from logtide.operators.digest import table_digest
from logtide.operators.positions import id_gaps, order_violations, page_bounds, with_position
from logtide.operators.sample import sample_plan, sample_ranges
from logtide.operators.stats import (coverage_counts, duplicate_keys, duplicate_report, family_counts, hidden_rows,
                                     identifier_conflicts, occupancy_report, row_size_stats, stats_verdict, table_stats)
from logtide.queries.purging import DISORDERED, EVENTS_CUTOFF, EVENTS_OLD, disordered
from logtide.operators.retention import purge_expired
from logtide.queries.registry import query, table
from logtide.session import work_dir, written
from logtide.sources.zones import diff_sample_stored, write_zoned

IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
       "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id",
       "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
       "conversations": "conv_id"}


def all_tables(spark: SparkSession, folder: str) -> dict[str, tuple[DataFrame, str]]:
    return {name: (table(spark, folder, name), id) for name, id in IDS.items()}


def stats_sql(names=IDS, where: dict[str, str] | None = None) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", count(*) AS rows, CAST(coalesce(min({IDS[n]}), 0) AS BIGINT) AS min_id,
            CAST(coalesce(max({IDS[n]}), 0) AS BIGINT) AS max_id FROM {n} WHERE {(where or {}).get(n, 'true')}""" for n in names)


@query("table_stats", stats_sql())
def _(spark, folder):
    return table_stats(all_tables(spark, folder))


@query("stats_verdict", """
    SELECT 'orders' AS "table", 'ok' AS verdict, count(*) AS source_rows, count(*) AS target_rows FROM orders
    UNION ALL SELECT 'events', 'target differs', count(*), count(*) FILTER (WHERE NOT (""" + EVENTS_OLD + """)) FROM events
    UNION ALL SELECT 'customer', 'source changed', count(*) FILTER (WHERE c_acctbal >= 0), count(*) FROM customer
    UNION ALL SELECT 'part', 'missing', count(*), 0 FROM part
    UNION ALL SELECT 'supplier', 'mark behind', count(*), count(*) FROM supplier
    UNION ALL SELECT 'pages', 'unexpected rows', 0, count(*) FROM pages""")
def _(spark, folder):
    t = all_tables(spark, folder)
    before = {n: t[n] for n in ("orders", "events", "customer", "part", "supplier")}
    customers = t["customer"][0].filter(F.col("c_acctbal") >= 0)
    now = {**before, "customer": (customers, "c_custkey")}
    target = {n: t[n] for n in ("orders", "customer", "supplier", "pages", "labels")}
    target["events"] = (purge_expired(t["events"][0], "event_id", "ts", EVENTS_CUTOFF), "event_id")
    stats = table_stats(before)
    marks = stats.select("table", (F.col("max_id") + 10).alias("high_water"))
    behind = marks.select("table", F.when(F.col("table") == "supplier", F.col("high_water") - 1)
                          .otherwise(F.col("high_water")).alias("high_water"))
    return stats_verdict(stats, table_stats(now), table_stats(target), ["labels"], marks, behind)


FIXTURES = "nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("occupancy_report", " UNION ALL ".join(f"""SELECT DISTINCT '{name}' AS "table" FROM {name}""" for name in FIXTURES))
def _(spark, folder):
    whole = {name: table(spark, folder, name) for name in FIXTURES}
    return occupancy_report({**whole, "drafts": whole["documents"].filter(F.col("n_chars") < 0), "database_lock": table(spark, folder, "region")})


@query("row_size_stats", """
    SELECT 'documents' AS "table", count(*) AS rows, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS widest FROM (
        SELECT 16 + 16 + 2 * length(text) + 40 + 2 * length(lang) + 40 + 2 * length(source) + 40 + 16 AS size FROM documents)""")
def _(spark, folder):
    return row_size_stats(table(spark, folder, "documents"), "documents")


@query("coverage_counts", """
    SELECT 'documents.text' AS "column", count(*) AS present FROM documents
    UNION ALL SELECT 'documents.lang', count(*) FILTER (WHERE lang <> 'fr') FROM documents
    UNION ALL SELECT 'documents.n_chars', count(*) FILTER (WHERE n_chars > 500) FROM documents""")
def _(spark, folder):
    docs = table(spark, folder, "documents").select(
        "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"),
        F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("n_chars"))
    return coverage_counts(docs, ["text", "lang", "n_chars"], "documents")


DUPLICATES = """SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS copies,
    array_to_string(list_sort(list(event_id))[1:5], ', ') AS first_ids
    FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN user_id END AS user_id FROM events)
    WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1"""


def _duplicates(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"))
    return duplicate_keys(events, "user_id", "event_id")


@query("duplicate_keys", DUPLICATES)
def _(spark, folder):
    return _duplicates(spark, folder)


@query("duplicate_report", f"""
    SELECT CASE WHEN count(*) > 100 THEN 'more than 100' ELSE CAST(count(*) AS VARCHAR) END AS shared,
        arg_min(value || ' in rows ' || first_ids, value) AS example FROM ({DUPLICATES})""")
def _(spark, folder):
    return duplicate_report(_duplicates(spark, folder))


@query("hidden_rows", """SELECT count(*) FILTER (WHERE event_type = 'signup' AND user_id > 10) AS hidden FROM events""")
def _(spark, folder):
    events = table(spark, folder, "events").select(
        F.when(F.col("event_type") != "signup", F.col("event_type")).alias("action"),
        F.when(F.col("user_id") > 10, F.col("user_id")).alias("user_id"))
    return hidden_rows(events, "action", "user_id")


@query("family_counts", """
    SELECT family, data_family, CASE WHEN family = data_family THEN family WHEN data_family = '' THEN 'lookup index'
        ELSE data_family || ' lookup index' END AS label, count(*) AS rows
    FROM (SELECT event_type AS family, CASE WHEN user_id < 20 THEN event_type WHEN user_id < 40 THEN 'click' ELSE '' END AS data_family
        FROM events) WHERE data_family <> 'error' GROUP BY 1, 2""")
def _(spark, folder):
    events = table(spark, folder, "events").select(
        "event_type", F.when(F.col("user_id") < 20, F.col("event_type")).when(F.col("user_id") < 40, "click").alias("indexed"))
    return family_counts(events, "event_type", "indexed", ["error"])


@query("identifier_conflicts", """
    SELECT 'nation_map' AS map, CAST(n_nationkey AS BIGINT) AS id FROM nation
    WHERE n_nationkey > (SELECT max(n_regionkey) FROM nation)
      AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000)""")
def _(spark, folder):
    assigned = table(spark, folder, "customer").filter(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("id"))
    return identifier_conflicts(table(spark, folder, "nation"), assigned, "nation_map", "n_nationkey", "n_regionkey")


@query("normalize_values", """
    SELECT CAST(l_quantity AS BIGINT) AS qty, l_extendedprice AS price, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS discount,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END::BIGINT AS returned, l_linenumber::BIGINT AS line, l_linestatus AS status,
        CAST(epoch(l_shipdate) AS BIGINT) AS shipped FROM lineitem""")
def _(spark, folder):
    items = table(spark, folder, "lineitem")
    return normalize(items.select(
        F.col("l_quantity").cast("decimal(12,0)").alias("qty"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_discount").cast("float").alias("discount"), (F.col("l_returnflag") == "R").alias("returned"),
        F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("status"),
        seconds_of(items, "l_shipdate").alias("shipped")))


@query("value_same", """
    WITH v AS (SELECT p_partkey, p_partkey + 9007199254740992 AS big, CAST(p_partkey + 9007199254740992 AS DOUBLE) AS bigd,
        p_partkey + CASE WHEN p_size > 25 THEN 0.5 ELSE 0 END AS half, p_name,
        CASE WHEN p_size > 40 THEN encode(p_brand) ELSE encode(p_name) END AS bytes,
        CASE WHEN p_brand = 'Brand#2' THEN NULL ELSE p_name END AS name2, CAST(p_retailprice AS FLOAT)::DOUBLE AS price2, p_retailprice FROM part)
    SELECT p_partkey, bigd = floor(bigd) AND CAST(bigd AS BIGINT) = big AS big_same, CAST(half AS DOUBLE) = p_partkey AS half_same,
        encode(p_name) = bytes AS bytes_same, name2 IS NOT DISTINCT FROM p_name AS name_same,
        price2 = p_retailprice AS price_same, false AS text_number FROM v""")
def _(spark, folder):
    long, double, text, binary = T.LongType(), T.DoubleType(), T.StringType(), T.BinaryType()
    big = F.col("p_partkey") + 9007199254740992
    half = F.col("p_partkey") + F.when(F.col("p_size") > 25, 0.5).otherwise(0.0)
    data = F.when(F.col("p_size") > 40, F.col("p_brand").cast("binary")).otherwise(F.col("p_name").cast("binary"))
    name2 = F.when(F.col("p_brand") != "Brand#2", F.col("p_name"))
    price2 = F.col("p_retailprice").cast("float")
    return table(spark, folder, "part").select(
        "p_partkey", same(big, big.cast("double"), long, double).alias("big_same"),
        same(F.col("p_partkey"), half, long, double).alias("half_same"),
        same(F.col("p_name"), data, text, binary).alias("bytes_same"),
        same(name2, F.col("p_name"), text, text).alias("name_same"),
        same(price2, F.col("p_retailprice"), T.FloatType(), double).alias("price_same"),
        same(F.col("p_partkey").cast("string"), F.col("p_partkey"), text, long).alias("text_number"))


def dated(orders: DataFrame) -> DataFrame:
    """Log tables hold no timestamps: the order date in seconds."""
    return orders.withColumn("o_orderdate", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))


DIGEST_LINE = """CAST(o_orderkey AS VARCHAR) || '|o_custkey=' || CAST(o_custkey AS VARCHAR) || '|o_orderdate=' || CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR)
    || '|o_orderpriority=''' || o_orderpriority
    || '''|o_orderstatus=''' || o_orderstatus || '''|o_totalprice=' || CAST(o_totalprice AS VARCHAR) || chr(10)"""


def fold_sql(source: str, by: str, name: str) -> str:
    key = f"CAST({by} AS VARCHAR) || ',' || " if by else ""
    words = ", ".join(f"CAST(sum(CAST('0x' || substr(hash, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS w{i}" for i in range(4))
    group = f"GROUP BY {by}" if by else ""
    return f"""{name}_w AS (SELECT {by + ',' if by else ''} CAST(sum(rows) AS BIGINT) AS rows, min(min_id) AS min_id, max(max_id) AS max_id, {words}
        FROM {source} {group}), {name} AS (SELECT {by + ',' if by else ''} rows, min_id, max_id,
        sha256({key}CAST(rows AS VARCHAR) || ',' || w0 || ',' || w1 || ',' || w2 || ',' || w3) AS hash FROM {name}_w)"""


@query("table_digest", f"""
    WITH h AS (SELECT o_orderkey >> 20 AS block, 1 AS rows, o_orderkey AS min_id, o_orderkey AS max_id, sha256({DIGEST_LINE}) AS hash FROM orders),
    {fold_sql('h', 'block', 'leaf')}, up AS (SELECT block >> 20 AS block, rows, min_id, max_id, hash FROM leaf),
    {fold_sql('up', 'block', 'upper')}, {fold_sql('upper', '', 'whole')}
    SELECT 'orders' AS "table", rows, min_id, max_id, substr(hash, 1, 16) AS digest FROM whole""")
def _(spark, folder):
    return table_digest(dated(table(spark, folder, "orders")), "o_orderkey", "orders")


# A copy of the orders with rows lost, changed and added

def damaged(orders: DataFrame) -> DataFrame:
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    left = orders.filter(~((price > 495_000) & (status == "P"))).select(
        F.col("O_ORDERKEY"), F.when(F.col("o_custkey") == 7, None).otherwise(F.col("o_custkey")).alias("o_custkey"), "o_orderdate", status,
        F.when((F.col("o_orderpriority") == "1-URGENT") & (price < 9_000), price + 1).otherwise(price).alias("o_totalprice"),
        F.when(price < 2_000, F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
        .cast("binary").alias("o_orderpriority"))
    added = orders.filter(F.col("o_custkey") == 5).select(
        (F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_custkey", "o_orderdate", status, price,
        F.col("o_orderpriority").cast("binary").alias("o_orderpriority"))
    return left.unionByName(added)


DAMAGED = """damaged AS (
        SELECT o_orderkey, CASE WHEN o_custkey <> 7 THEN o_custkey END AS o_custkey, o_orderstatus,
            CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 9000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
            CASE WHEN o_totalprice < 2000 THEN o_orderpriority || '!' ELSE o_orderpriority END AS o_orderpriority
        FROM orders WHERE NOT (o_totalprice > 495000 AND o_orderstatus = 'P')
        UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_custkey = 5),
    j AS (SELECT coalesce(o.o_orderkey, d.o_orderkey) AS id, o.o_orderkey AS ok, d.o_orderkey AS dk,
            o.o_custkey AS c1, d.o_custkey AS c2, o.o_totalprice AS p1, d.o_totalprice AS p2, o.o_orderpriority AS r1, d.o_orderpriority AS r2
        FROM orders o FULL OUTER JOIN damaged d ON o.o_orderkey = d.o_orderkey),
    diff AS (
        SELECT id, 'missing' AS kind, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target FROM j WHERE dk IS NULL
        UNION ALL SELECT id, 'extra', NULL, NULL, NULL FROM j WHERE ok IS NULL
        UNION ALL SELECT id, 'differs', 'o_custkey', CAST(c1 AS VARCHAR), coalesce(CAST(c2 AS VARCHAR), 'NULL') FROM j
            WHERE ok = dk AND c1 IS DISTINCT FROM c2
        UNION ALL SELECT id, 'differs', 'o_totalprice', CAST(p1 AS VARCHAR), CAST(p2 AS VARCHAR) FROM j WHERE ok = dk AND p1 <> p2
        UNION ALL SELECT id, 'differs', 'o_orderpriority', '''' || r1 || '''', octet_length(encode(r2)) || ' bytes' FROM j WHERE ok = dk AND r1 <> r2)"""


def both_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = dated(table(spark, folder, "orders"))
    return orders, damaged(orders)


@query("diff_full", f"WITH {DAMAGED} SELECT * FROM diff")
def _(spark, folder):
    return diff_full(*both_sides(spark, folder), "o_orderkey")


@query("diff_full_pruned", f"WITH {DAMAGED} SELECT * FROM diff")
def _(spark, folder):
    return diff_pruned(*both_sides(spark, folder), "o_orderkey")


def plan_sql(source: str, window_rows: int = 1_000_000, range_rows: int = 1_000, seed: int = 0) -> str:
    """The sample plan as CTEs ending in `plan`."""
    return f"""c AS (SELECT count(*) AS total FROM {source}),
    w0 AS (SELECT unnest(generate_series(0, (total + {window_rows} - 1) // {window_rows} - 1)) AS win, total FROM c),
    w1 AS (SELECT win, win * {window_rows} AS first, least({window_rows}, total - win * {window_rows}) AS rows FROM w0),
    w2 AS (SELECT *, greatest(1, (rows + 99) // 100) AS sampled FROM w1),
    w3 AS (SELECT *, greatest(1, (sampled * 2 + {range_rows}) // {2 * range_rows}) AS ranges FROM w2),
    w4 AS (SELECT *, greatest(1, (sampled + ranges - 1) // ranges) AS length, rows // ranges AS slot_rows FROM w3),
    w5 AS (SELECT *, unnest(generate_series(0, ranges - 1)) AS slot FROM w4),
    w6 AS (SELECT *, first + slot * slot_rows AS slot_start FROM w5),
    w7 AS (SELECT *, CASE WHEN slot = ranges - 1 THEN first + rows - slot_start ELSE slot_rows END AS slot_length FROM w6),
    w8 AS (SELECT *, least(length, slot_length) AS taken,
        CAST('0x' || substr(sha256('{seed}:' || win || ':' || slot), 1, 8) AS BIGINT) AS bits FROM w7),
    w9 AS (SELECT *, slot_start + (bits * (slot_length - taken + 1)) // 4294967296 AS start FROM w8),
    plan AS (SELECT win AS "window", slot, start, start + taken - 1 AS "end" FROM w9)"""


def ranges_sql(source: str, id: str, **plan) -> str:
    return f"""{plan_sql(source, **plan)},
    numbered AS (SELECT {id} AS id, row_number() OVER (ORDER BY {id}) - 1 AS pos FROM {source}),
    ranges AS (SELECT "window", slot, min(id) AS lo, max(id) AS hi, count(*) AS rows
        FROM plan JOIN numbered ON pos BETWEEN start AND "end" GROUP BY "window", slot)"""


@query("sample_plan", f"WITH {plan_sql('lineitem', window_rows=20_000, range_rows=50)} SELECT * FROM plan")
def _(spark, folder):
    return sample_plan(spark, table(spark, folder, "lineitem").count(), 0, 20_000, 50)


def order_ranges(spark: SparkSession, orders: DataFrame) -> DataFrame:
    return sample_ranges(orders, "o_orderkey", sample_plan(spark, orders.count(), 0, 5_000, 20))


@query("sample_ranges", f"WITH {ranges_sql('orders', 'o_orderkey', window_rows=5_000, range_rows=20)} SELECT * FROM ranges")
def _(spark, folder):
    return order_ranges(spark, table(spark, folder, "orders"))


@query("diff_sample", f"""WITH {ranges_sql('orders', 'o_orderkey', window_rows=5_000, range_rows=20)}, {DAMAGED}
    SELECT diff.* FROM diff JOIN ranges ON diff.id BETWEEN lo AND hi""")
def _(spark, folder):
    left, right = both_sides(spark, folder)
    return diff_sample(left, right, "o_orderkey", written(order_ranges(spark, left)))


@query("diff_sample_stored", f"""WITH {ranges_sql('orders', 'o_orderkey', window_rows=5_000, range_rows=20)}, {DAMAGED}
    SELECT diff.* FROM diff JOIN ranges ON diff.id BETWEEN lo AND hi""")
def _(spark, folder):
    """The same sample of two stored copies with zone maps: only files and pages with sampled ids are read."""
    left, right = both_sides(spark, folder)
    paths = [work_dir(spark), work_dir(spark)]
    for df, path in zip((left, right), paths):
        write_zoned(df, path, "o_orderkey")
    return diff_sample_stored(spark, *paths, "o_orderkey", written(order_ranges(spark, left)))


@query("row_positions", "SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events")
def _(spark, folder):
    return with_position(table(spark, folder, "events").select("event_id", "user_id"), "event_id")


def pages_sql(source: str, id: str, n: int) -> str:
    return f"""SELECT pos // {n} AS page, min(id) AS from_id, max(id) AS to_id, count(*) AS rows
        FROM (SELECT {id} AS id, row_number() OVER (ORDER BY {id}) - 1 AS pos FROM {source}) GROUP BY 1"""


@query("page_bounds", pages_sql("orders", "o_orderkey", 5_000))
def _(spark, folder):
    return page_bounds(table(spark, folder, "orders"), "o_orderkey", 5_000)


@query("page_bounds_small", pages_sql("events", "event_id", 300))
def _(spark, folder):
    return page_bounds(table(spark, folder, "events"), "event_id", 300)


@query("id_gaps", """SELECT after_id, next_id, next_id - after_id - 1 AS missing FROM (
    SELECT l_orderkey AS after_id, lead(l_orderkey) OVER (ORDER BY l_orderkey) AS next_id FROM (SELECT DISTINCT l_orderkey FROM lineitem))
    WHERE next_id - after_id > 1""")
def _(spark, folder):
    return id_gaps(table(spark, folder, "lineitem"), "l_orderkey")


@query("order_violations", f"""
    WITH d AS ({DISORDERED}), g AS (SELECT event_id, count(*) AS copies, min(time) AS oldest, max(time) AS newest FROM (
        SELECT * FROM d UNION ALL SELECT * FROM d WHERE event_type = 'signup') GROUP BY event_id),
    v AS (SELECT event_id, copies, max(newest) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - oldest AS lag FROM g)
    SELECT event_id, copies, CASE WHEN lag > 86400 THEN lag END AS lag FROM v WHERE copies > 1 OR lag > 86400""")
def _(spark, folder):
    log = disordered(table(spark, folder, "events"))
    return order_violations(log.unionByName(log.filter(F.col("event_type") == "signup")), "event_id", "time", 86_400)


@query("diff_repeated", """SELECT o_orderkey AS id, 'repeated' AS kind, CAST(NULL AS VARCHAR) AS "column", '1' AS source, '3' AS target
    FROM orders WHERE o_custkey % 100 = 3""")
def _(spark, folder):
    """What appends that were retried twice leave."""
    orders = dated(table(spark, folder, "orders"))
    again = orders.filter(F.col("o_custkey") % 100 == 3)
    return diff_pruned(orders, orders.unionByName(again).unionByName(again), "o_orderkey")
