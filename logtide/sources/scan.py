"""Reads by id: after an id, in a range, in many ranges. Order only on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtide.operators.sample import in_ranges, literal_ranges

#: The most ranges one predicate spells out; more are joined.
LITERAL_RANGES = 1_000


def scan_after(df: DataFrame, id: str, after: int, columns: list[str] | None = None) -> DataFrame:
    """Rows with ids above `after`; the comparison and the column list reach the scan."""
    rows = df.filter(F.col(id) > after)
    return rows if columns is None else rows.select(id, *[c for c in columns if c != id])


def scan_range(df: DataFrame, id: str, lo: int, hi: int, columns: list[str] | None = None) -> DataFrame:
    rows = df.filter(F.col(id).between(lo, hi))
    return rows if columns is None else rows.select(id, *[c for c in columns if c != id])


def merged(ranges) -> list[tuple[int, int]]:
    """Ascending ranges that neither overlap nor touch; empty ones (lo over hi) go."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((lo, hi) for lo, hi in ranges if lo <= hi):
        if out and lo <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def scan_ranges(df: DataFrame, id: str, ranges, columns: list[str] | None = None) -> DataFrame:
    """Rows in any of the ranges, each once, in one scan: a list of pairs, or a DataFrame with disjoint lo and hi.

    Pairs are merged first, so they may overlap.
    """
    if columns is not None:
        df = df.select(id, *[c for c in columns if c != id])
    if isinstance(ranges, DataFrame):
        return in_ranges(df, id, ranges.select("lo", "hi")).drop("range_lo")
    ranges = merged(ranges)
    if len(ranges) > LITERAL_RANGES:
        pairs = df.sparkSession.createDataFrame(list(ranges), "lo bigint, hi bigint")
        return in_ranges(df, id, pairs).drop("range_lo")
    return df.filter(literal_ranges(id, ranges))


def in_id_order(df: DataFrame, id: str, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted within, for a sink that wants files in id order."""
    ranged = df.repartitionByRange(partitions, id) if partitions else df.repartitionByRange(id)
    return ranged.sortWithinPartitions(id)
