"""Cutoffs on log times, which are Unix seconds or timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T


def time_literal(df: DataFrame, time: str, seconds: int) -> Column:
    """`seconds` in the type of the time column, so that a comparison reaches the scan."""
    dtype = df.schema[time].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        moment = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds)
        if isinstance(dtype, T.TimestampNTZType):
            return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(moment.isoformat(sep=" ") + "+00:00").cast("timestamp")
    return F.lit(seconds).cast("bigint")


def seconds_of(df: DataFrame, time: str) -> Column:
    """The time column as Unix seconds (timestamps without a zone count as UTC)."""
    dtype = df.schema[time].dataType
    if isinstance(dtype, T.TimestampType):
        return F.unix_seconds(F.col(time))
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_seconds(F.from_utc_timestamp(F.col(time).cast("timestamp"), F.current_timezone()))
    return F.col(time).cast("bigint")


def expired(df: DataFrame, time: str, cutoff: int) -> Column:
    """Older than the cutoff. Negative times mark rows that never expire; nulls compare as null."""
    return (F.col(time) >= time_literal(df, time, 0)) & (F.col(time) < time_literal(df, time, cutoff))


def kept(df: DataFrame, time: str, cutoff: int) -> Column:
    """The exact complement of `expired`, nulls included, spelled so that it can be pushed down."""
    return (F.col(time).isNull() | (F.col(time) < time_literal(df, time, 0))
            | (F.col(time) >= time_literal(df, time, cutoff)))
