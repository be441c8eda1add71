"""Logs of network attempts: reading, runs of one host, attribution and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FIELDS = ["kind", "target", "attribution", "thread", "stack"]


def parse_egress(lines: DataFrame, line: str = "value") -> DataFrame:
    """Five tab-separated fields per line; missing ones are empty, tabs after the fourth belong to the stack."""
    others = [c for c in lines.columns if c != line]
    parts = F.split(F.col(line), "\t", 5)
    return lines.select(*others, *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(name)
                                   for i, name in enumerate(FIELDS)])


def read_egress_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_egress(spark.read.text(path))


def host_of(target: Column) -> Column:
    return F.regexp_replace(target, r":[0-9]+\z", "")


def is_local(target: Column) -> Column:
    """Loopback and local names, which are no egress."""
    host = F.lower(host_of(target))
    # Names and addresses of the machine itself
    return ((host == "localhost") | host.endswith(".localhost") | host.startswith("127.")
            | host.isin("::1", "[::1]", "0.0.0.0"))


def attribution(stack: Column, prefixes: list[str]) -> Column:
    """`plugin` if any frame of the stack starts with a known prefix, else `server`."""
    def known(frame: Column) -> Column:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | frame.startswith(prefix)
        return test
    return F.when(F.exists(F.split(stack, r"\|"), known), "plugin").otherwise("server")


def egress_violations(log: DataFrame, prefixes: list[str], allowed_hosts: list[str],
                      client: str | None = None) -> DataFrame:
    """Attempts made by the plugin that are not allowed, with the reason.

    Allowed is a name lookup or a connection to port 443 of an allowed host, through `client` if one
    is named. The allow-list is configuration and becomes a predicate.
    """
    rows = log.filter(~is_local(F.col("target"))).withColumn("attribution", attribution(F.col("stack"), prefixes))
    host = host_of(F.col("target"))
    reason = (F.when(~F.lower(host).isin(*[name.lower() for name in allowed_hosts]), "host not allowed")
              .when((F.col("kind") != "resolve") & ~F.col("target").endswith(":443"), "not HTTPS"))
    if client:
        reason = reason.when(~F.col("stack").contains(client), "not the allowed client")
    return (rows.filter(F.col("attribution") == "plugin").withColumn("host", host)
            .withColumn("reason", reason).filter(F.col("reason").isNotNull()))


def collapse_runs(df: DataFrame, stream: str, seq: str, target: str) -> DataFrame:
    """Hosts of a stream of attempts in order, each kept only where it differs from the one before.

    A stream is split into stretches of its sequence, so a stream that holds most of the log is many
    windows; only the last host of every stretch crosses to the next.
    """
    rows = df.select(F.col(stream).alias("stream"), F.col(seq).alias("seq"), host_of(F.col(target)).alias("host"))
    rows = rows.withColumn("stretch", F.shiftright("seq", 16))
    ends = rows.groupBy("stream", "stretch").agg(F.max_by("host", "seq").alias("last"))
    carried = ends.withColumn("before", F.lag("last").over(Window.partitionBy("stream").orderBy("stretch")))
    inner = Window.partitionBy("stream", "stretch").orderBy("seq")
    marked = (rows.withColumn("previous", F.lag("host").over(inner))
              .withColumn("first", F.row_number().over(inner) == 1)
              .join(carried.select("stream", "stretch", "before"), ["stream", "stretch"]))
    previous = F.when(F.col("first"), F.col("before")).otherwise(F.col("previous"))
    return marked.filter(~F.col("host").eqNullSafe(previous)).select("stream", "seq", "host")
