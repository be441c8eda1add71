"""Expiring rows: by cutoff, by a policy table, by id ranges, by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions.retention import retention
from logtide.functions.times import expired, kept, seconds_of
from logtide.session import fits

# Fixed value: how far id order may lag time order, in seconds.
ORDER_SLACK = 86_400
#: Policies up to this count (some 50 bytes each) are broadcast.
BROADCAST_POLICIES = 200_000


def _not_newest(df: DataFrame, id: str, keep_newest: bool) -> Column:
    return F.col(id) != df.agg(F.max(id)).scalar() if keep_newest else F.lit(True)


def removed_rows(df: DataFrame, id: str, time: str, cutoff: int, keep_newest: bool = False) -> DataFrame:
    return df.filter(expired(df, time, cutoff) & _not_newest(df, id, keep_newest))


def purge_expired(df: DataFrame, id: str, time: str, cutoff: int, keep_newest: bool = False) -> DataFrame:
    """Rows left after a purge. With `keep_newest` the row with the highest id stays, however old,
    so that a store which reuses ids never hands it out again."""
    left = kept(df, time, cutoff)
    if keep_newest:
        left = left | (F.col(id) == df.agg(F.max(id)).scalar())
    return df.filter(left)


def purge_by_policy(df: DataFrame, key: str, time: str, policies: DataFrame, now: int) -> DataFrame:
    """Rows left when each table (the value of `key`) expires by its own retention text.

    `policies` has (table, retention). A table without a usable retention keeps everything; of several policies for
    one table, the one that keeps most counts.
    """
    cutoffs = policies.select(F.col("table").alias(key), retention(F.col("retention")).alias("r")).groupBy(key).agg(
        F.when(F.every(F.coalesce(F.col("r.seconds") > 0, F.lit(False))), F.lit(now) - F.max("r.seconds")).alias("cutoff"))
    at = seconds_of(df, time)
    # A log has few values of `key`, each of them hot in a shuffle; more policies than fit are joined with skew handling
    joined = df.join(F.broadcast(cutoffs) if fits(policies, BROADCAST_POLICIES) else cutoffs, key, "left")
    return joined.filter(F.col("cutoff").isNull() | F.col(time).isNull() | (at < 0)
                         | (at >= F.col("cutoff"))).drop("cutoff")


def policy_report(policies: DataFrame) -> DataFrame:
    """What each retention text means: seconds (0 is off) and the problem with it, if any."""
    return policies.select("table", "retention", retention(F.col("retention")).alias("r")).select(
        "table", "retention", "r.seconds", "r.problem")


def _walk(df: DataFrame, id: str, time: str, cutoff: int, now: int, width: int, keep_newest: bool):
    """(ranges with their statistics, the range at which the walk finishes or null)."""
    at = seconds_of(df, time)
    rows = df.select(F.col(id).alias("id"), at.alias("at"), expired(df, time, cutoff).alias("old"))
    if keep_newest:
        rows = rows.filter(F.col("id") != df.agg(F.max(id)).scalar())
    ranges = (rows.groupBy(F.expr(f"(id - pmod(id, {width}L)) div {width}L").alias("range"))
              .agg(F.min("id").alias("from_id"), F.max("id").alias("to_id"), F.count("*").alias("rows"),
                   F.min("at").alias("oldest"), F.count_if("old").alias("expired")))
    finishing = ranges.filter((F.col("oldest") >= cutoff + ORDER_SLACK) & (F.col("oldest") <= now + ORDER_SLACK))
    return ranges, finishing.agg(F.min("range")).scalar()


def purge_range_plan(df: DataFrame, id: str, time: str, cutoff: int, now: int, width: int,
                     keep_newest: bool = False) -> DataFrame:
    """What a walk over id ranges of `width` would do: purge, skip, finish, or leave (after the finish).

    The walk finishes at the first range whose oldest row is a day past the cutoff and not more than
    a day in the future; old rows behind it wait for a later run. Depends on `width`: this is the
    incremental walk's answer, `purge_expired` is the exact one.
    """
    ranges, end = _walk(df, id, time, cutoff, now, width, keep_newest)
    step = (F.when(F.col("range") > end, "leave").when(F.col("range") == end, "finish")
            .when(F.col("oldest") >= cutoff, "skip").otherwise("purge"))
    return ranges.withColumn("step", step).withColumn(
        "removed", F.when(F.col("step") == "purge", F.col("expired")).otherwise(F.lit(0).cast("bigint")))


def purge_walked(df: DataFrame, id: str, time: str, cutoff: int, now: int, width: int,
                 keep_newest: bool = False) -> DataFrame:
    """Rows left after the range walk of `purge_range_plan`."""
    _, end = _walk(df, id, time, cutoff, now, width, keep_newest)
    place = F.expr(f"(`{id}` - pmod(`{id}`, {width}L)) div {width}L")
    gone = expired(df, time, cutoff) & _not_newest(df, id, keep_newest) & (end.isNull() | (place < end))
    return df.filter(~F.coalesce(gone, F.lit(False)))


def month_start(df: DataFrame, time: str) -> Column:
    return F.trunc(F.timestamp_seconds(seconds_of(df, time)).cast("date"), "MM")


def partition_class(month: Column, cutoff: int) -> Column:
    """drop, rewrite or keep a month partition, from its first day alone.

    Rows before 1970 never expire, so their months are kept.
    """
    first = F.unix_date(month) * 86_400
    last = F.unix_date(F.add_months(month, 1)) * 86_400
    return (F.when(month.isNull() | (first < 0), "keep").when(last <= cutoff, "drop")
            .when(first >= cutoff, "keep").otherwise("rewrite"))


def partition_retention(df: DataFrame, time: str, cutoff: int, month: str | None = None) -> DataFrame:
    """Per month: what happens to the partition, its rows, and the rows left.

    With `month`, a partition column holding the month's first day, the class needs no data.
    """
    first = F.col(month) if month else month_start(df, time)
    left = kept(df, time, cutoff)
    return (df.select(first.alias("month"), left.alias("left")).groupBy("month")
            .agg(F.count("*").alias("rows"), F.count_if("left").alias("kept_rows"))
            .withColumn("action", partition_class(F.col("month"), cutoff)))
