"""Scans, encodings, copies and publishing."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.operators.encode import Codec, canonical, empty_is_null, encode, fit_audit, null_is_zero, reject_report, unwrap_binary
from logtide.operators.sample import sample_plan, sample_ranges
from logtide.operators.stats import table_stats
from logtide.plans.ledger import LedgerTable, write_batches
from logtide.plans.migration import copy_tables, migrate, plan_copy
from logtide.plans.writes import (IDENTITY, begin_version, complete_version, open_published, pending_batches, plan_batches,
                                  read_buckets, write_idempotent)
from logtide.queries.proving import IDS, dated, ranges_sql, stats_sql
from logtide.queries.registry import query, table, work_dir
from logtide.session import written
from logtide.sources.scan import scan_after, scan_range, scan_ranges
from logtide.sources.stores import ParquetStore


@query("scan_after_id", "SELECT event_id, user_id, value FROM events WHERE event_id > 0")
def _(spark, folder):
    return scan_after(table(spark, folder, "events"), "event_id", 0, ["user_id", "value"])


@query("scan_id_range", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1 AND 4611686018427387904")
def _(spark, folder):
    return scan_range(table(spark, folder, "orders"), "o_orderkey", 1, 1 << 62, ["o_custkey", "o_totalprice"])


@query("scan_multi_range", f"""WITH {ranges_sql('events', 'event_id', window_rows=1_000, range_rows=4)}
    SELECT event_id, user_id, value FROM events JOIN ranges ON event_id BETWEEN lo AND hi""")
def _(spark, folder):
    events = table(spark, folder, "events")
    ranges = written(sample_ranges(events, "event_id", sample_plan(spark, events.count(), 0, 1_000, 4)))
    return scan_ranges(events, "event_id", ranges, ["user_id", "value"])


@query("fit_audit", """
    WITH v AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders)
    SELECT 'orders' AS "table", 'o_custkey' AS "column", o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS value, 'range' AS reason
        FROM v WHERE o_custkey > 255
    UNION ALL SELECT 'orders', 'o_totalprice', o_orderkey, CAST(o_totalprice AS VARCHAR), 'fraction'
        FROM v WHERE round(o_totalprice) <> o_totalprice
    UNION ALL SELECT 'orders', 'status', o_orderkey, 'NULL', 'missing' FROM v WHERE status IS NULL
    UNION ALL SELECT 'orders', 'o_orderdate', o_orderkey, CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR), 'range' FROM v
    UNION ALL SELECT 'orders', 'o_orderpriority', o_orderkey, '''' || o_orderpriority || '''', 'kind' FROM v""")
def _(spark, folder):
    orders = dated(table(spark, folder, "orders")).withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return fit_audit(orders, "o_orderkey", {"o_orderkey": "UInt64", "o_custkey": "UInt8", "o_totalprice": "UInt32",
                                            "status": "String", "o_orderdate": "SMALLINT", "o_orderpriority": "Nullable(Int32)"}, "orders")


def hex_codec() -> Codec:
    """Text as hexadecimal UTF-8; long texts cannot be converted."""
    return Codec(lambda col: F.hex(col.cast("binary")), lambda col: F.when(F.length(col) > 3_000, "too long"))


@query("encode_with_policy", """SELECT doc_id, CASE WHEN length(text) > 3000 THEN text ELSE hex(encode(text)) END AS text, lang
    FROM documents""")
def _(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return encode(docs, "doc_id", {"text": hex_codec()}, "documents", "keep")[0]


@query("encode_rejects", """SELECT 'documents' AS "table", 'text' AS "column", doc_id AS id, 'too long' AS error
    FROM documents WHERE length(text) > 3000""")
def _(spark, folder):
    return encode(table(spark, folder, "documents"), "doc_id", {"text": hex_codec()}, "documents", "keep")[1]


@query("reject_report", """SELECT count(*) AS rejected, array_to_string(list_sort(list('documents.text of row ' || doc_id || ' (too long)')
        FILTER (WHERE k <= 5)), '; ') AS examples
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE length(text) > 3000)""")
def _(spark, folder):
    return reject_report(encode(table(spark, folder, "documents"), "doc_id", {"text": hex_codec()}, "documents", "keep")[1])


@query("canonical_form", """SELECT event_id, nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS uuid,
    coalesce(CASE WHEN event_type <> 'click' THEN user_id END, 0) AS action,
    CASE WHEN length(props) < 9 THEN hex(encode(props)) ELSE props END AS props FROM events""")
def _(spark, folder):
    kind = F.col("event_type")
    events = table(spark, folder, "events").select(
        "event_id", F.when(kind == "view", "").otherwise(kind).alias("uuid"),
        F.when(kind != "click", F.col("user_id")).alias("action"), "props")
    codec = Codec(lambda col: F.hex(col.cast("binary")), lambda col: F.when(F.length(col) >= 9, "too long"))
    return canonical(events, {"uuid": empty_is_null, "action": null_is_zero}, {"props": codec})


@query("unwrap_binary", """SELECT doc_id, CASE WHEN lang = 'de' OR lang = 'es' THEN NULL ELSE text END AS text FROM documents""")
def _(spark, folder):
    return unwrap_binary(wrapped(table(spark, folder, "documents")), "doc_id", ["data"])[0].select(
        "doc_id", F.col("data").cast("string").alias("text"))


@query("unwrap_rejects", """SELECT doc_id AS id, 'data' AS "column", '01' AS marker FROM documents WHERE lang = 'es'""")
def _(spark, folder):
    return unwrap_binary(wrapped(table(spark, folder, "documents")), "doc_id", ["data"])[1]


def wrapped(docs: DataFrame) -> DataFrame:
    """Texts as binary behind a presence byte: 0, a wrong one for Spanish, nothing at all for German."""
    mark = F.when(F.col("lang") == "es", F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return docs.select("doc_id", F.when(F.col("lang") == "de", F.unhex(F.lit("")))
                       .otherwise(F.concat(mark, F.col("text").cast("binary"))).alias("data"))


@query("idempotent_write", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS ids, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def _(spark, folder):
    path = work_dir(spark)
    orders = table(spark, folder, "orders")
    for _attempt in range(2):
        write_idempotent(orders, path, "o_orderkey", bits=12)
    return read_buckets(spark, path).agg(
        F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("ids"), F.min("o_orderkey").alias("lo"),
        F.max("o_orderkey").alias("hi"))


BATCH = """SELECT o_orderkey >> 10 AS bucket, 'orders' AS "table", 'o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns,
    count(*) AS count, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders"""


@query("pending_batches", f"""WITH p AS ({BATCH} GROUP BY 1), d AS ({BATCH} WHERE o_totalprice < 499900 GROUP BY 1)
    SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.bucket = p.bucket AND d.count = p.count
        AND d.first_id = p.first_id AND d.last_id = p.last_id)""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    done = plan_batches(orders.filter(F.col("o_totalprice") < 499_900), "orders", "o_orderkey", 10).select(*IDENTITY)
    return pending_batches(plan_batches(orders, "orders", "o_orderkey", 10), done).select(
        "bucket", "table", "columns", "count", "first_id", "last_id")


@query("ledger_batches", """SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def _(spark, folder):
    """Orders, some without an id, in batches that are each committed once; a second writer of the same finds nothing to do."""
    orders = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", "o_orderstatus", "o_totalprice")
    ledger, width = LedgerTable(spark, work_dir(spark)), max(1, orders.agg(F.max("o_orderkey") - F.min("o_orderkey")).first()[0] // 4)
    for _attempt in range(2):
        write_batches(ledger, orders, "orders", "o_orderkey", width)
    return ledger.read()


COPIED = list(IDS)


@query("copy_tables", stats_sql(COPIED))
def _(spark, folder):
    """Copies into columns in another order and case, then the statistics of the copies."""
    sources = {name: table(spark, folder, name) for name in COPIED}
    targets = {name: [c.upper() for c in reversed(df.columns)] for name, df in sources.items()}
    store = ParquetStore(work_dir(spark))
    plans = plan_copy(sources, IDS, targets, core=["orders"])
    copy_tables(sources, store, plans)
    return table_stats({name: (store.read(spark, name), IDS[name].upper()) for name in COPIED})


@query("publish_manifest", "SELECT * FROM orders")
def _(spark, folder):
    root = work_dir(spark)
    orders = table(spark, folder, "orders")
    target = begin_version(spark, root, "v1")
    ParquetStore(target).write(orders, "orders", "o_orderkey")
    stats = table_stats({"orders": (spark.read.parquet(f"{target}/orders"), "o_orderkey")}).first().asDict()
    complete_version(spark, root, "v1", {"orders": {k: v for k, v in stats.items() if k != "table"}})
    return open_published(spark, root, "orders")


@query("write_partial_buckets", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, folder):
    """Batches that share folders, by price: each leaves the other's rows, and a repeated one adds none."""
    path = work_dir(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cheap = F.col("o_totalprice") < 200_000
    for batch in (orders.filter(cheap), orders.filter(~cheap), orders.filter(cheap)):
        write_idempotent(batch, path, "o_orderkey")
    return read_buckets(spark, path).select("o_orderkey", "o_custkey", "o_totalprice")


def as_log_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables with what log tables hold: times in seconds, lists as text."""
    def plain(df: DataFrame, name: str, kind: str):
        if kind.startswith(("timestamp", "date")):
            return F.unix_seconds(F.col(name).cast("timestamp")).alias(name)
        return F.to_json(name).alias(name) if kind.startswith("array") else F.col(name)
    tables = {name: table(spark, folder, name) for name in IDS}
    return {name: df.select(*[plain(df, *c) for c in df.dtypes]) for name, df in tables.items()}


@query("migrate", " UNION ALL ".join(f"""SELECT '{name}' AS "table", 'ok' AS verdict, count(*) AS source_rows, count(*) AS target_rows FROM {name}""" for name in IDS))
def _(spark, folder):
    """A migration that is stopped by a table that cannot be read, and gone on with."""
    root, sources = work_dir(spark), as_log_tables(spark, folder)
    broken = {**sources, "orders": sources["orders"].withColumn("o_custkey", F.raise_error(F.lit("unreadable")).cast("long"))}
    try:
        migrate(spark, broken, IDS, root, "v1", core=["orders"])
    except PySparkException:
        pass  # nothing is published
    verdicts = migrate(spark, sources, IDS, root, "v1", core=["orders"])
    open_published(spark, root, "orders")
    return verdicts
