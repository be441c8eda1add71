"""Reads of many id ranges that open little: a zone map of a stored table, and its merge with the ranges.

A zone is a file's least and greatest id. A table that is written in id order has zones side by side, so a stretch of
ranges concerns a few files; inside of them the ranges go to the scan as a predicate, and Parquet's own statistics skip
row groups and pages. One scan spells out a bounded number of spans, and one read has a bounded number of scans; several run one
after the other. More ranges than that are first drawn together to spans, block by block of ids, and looked up exactly in what the
spans let through.

An unordered table has zones that overlap, so more files are read; the rows are the same. So they are without a zone map, or
when files were added after it: files it does not know are always read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.operators.diff import diff_sample
from logtide.operators.sample import in_any_range, in_ranges, literal_ranges, prepared
from logtide.session import fits, work_dir, written
from logtide.sources.files import exists
from logtide.sources.scan import in_id_order, merged

#: The folder of the zone map in the table's own; readers skip names with an underscore.
ZONES = "_zones"
#: Spans that one scan spells out, and scans of one read.
SPELLED, SCANS = 500, 32


def write_zones(spark: SparkSession, path: str, id: str) -> None:
    """The zone map of a table as it is now: one scan of its ids, combined in each task."""
    ids = spark.read.parquet(path).select(F.col(id).cast("bigint").alias("id"), F.col("_metadata.file_path").alias("file"))
    zones = ids.groupBy("file").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("rows"), F.count_if(F.col("id").isNull()).alias("without"))
    zones.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/{ZONES}")


def write_zoned(df: DataFrame, path: str, id: str, files: int | None = None, group_bytes: int = 16 << 20) -> None:
    """A table in id order with small row groups, and its zone map."""
    in_id_order(df, id, files).write.mode("overwrite").option("partitionOverwriteMode", "static").option("parquet.block.size", group_bytes).parquet(path)
    write_zones(df.sparkSession, path, id)


@dataclass(frozen=True)
class Span:
    lo: int
    hi: int


def spans_of(ranges: DataFrame, most: int = SPELLED * SCANS) -> list[Span]:
    """Ascending spans that cover the ranges (lo, hi): the ranges themselves if they are at most `most`, else one for each
    occupied block of ids, of the smallest blocks that are few enough. No more than `most` come to the driver."""
    some = ranges.select(F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi")).filter("lo <= hi")
    found = some.limit(most + 1).collect()
    for bits in range(8, 64, 4):
        if len(found) <= most:
            break
        # A block's span ends where its last range does, in another block perhaps: merging below takes care of that
        found = some.groupBy(F.shiftright("lo", bits)).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi").limit(most + 1).collect()
    return [Span(lo, hi) for lo, hi in merged(tuple(row) for row in found)]


def _plain(uri: str) -> str:
    """A file's path as readers take it: Spark tells it as a URI, with one or three slashes."""
    return re.sub("^file:/+", "file:///", unquote(uri))


def files_of(spark: SparkSession, path: str, groups: list[list[Span]]) -> list[list[str] | None]:
    """For each group of ascending spans the files that may hold some of their ids; None: all there are.

    Spans and zones are merged as the two sorted lists they are; zones number as many as files.
    """
    if not exists(spark, f"{path}/{ZONES}"):
        return [None] * len(groups)
    every = {_plain(file) for file in spark.read.parquet(path).inputFiles()}
    zones = [(row.lo, row.hi, _plain(row.file)) for row in spark.read.parquet(f"{path}/{ZONES}").filter("lo is not null").orderBy("lo").toLocalIterator()]
    without = {_plain(row.file) for row in spark.read.parquet(f"{path}/{ZONES}").filter("lo is null").collect()}
    known = {file for _, _, file in zones} | without
    if not known <= every:
        return [None] * len(groups)  # of files that are gone: a zone map of another version
    out = []
    for spans in groups:
        files = sorted(every - known)
        at, last = 0, len(spans)
        for lo, hi, file in zones:
            if lo > spans[-1].hi:
                break
            while at < last and spans[at].hi < lo:
                at += 1  # zones come by their least id, so no later zone meets this span either
            if at < last and spans[at].lo <= hi:
                files.append(file)
        out.append(files)
    return out


def read_spans(spark: SparkSession, path: str, id: str, spans: list[Span], columns: list[str] | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """Rows of a stored table whose id lies in one of the ascending spans.

    Spans that one scan spells out are read when the rows are. More are read scan by scan when called, into the shared folder: a plan of all
    scans would hold every span several times over. `ranges` are those the spans were drawn from; of rows in no range none are written.
    """
    whole = spark.read.parquet(path)
    picked = lambda df: df if columns is None else df.select(id, *[c for c in columns if c != id])
    groups = [spans[k:k + SPELLED] for k in range(0, len(spans), SPELLED)]
    scans = [(group, files) for group, files in zip(groups, files_of(spark, path, groups) if groups else []) if files != []]

    def scan(group: list[Span], files: list[str] | None) -> DataFrame:
        source = whole if files is None else spark.read.schema(whole.schema).option("basePath", path).parquet(*files)
        return picked(source.filter(literal_ranges(id, [(s.lo, s.hi) for s in group])))

    if not scans:
        return picked(whole.filter(F.lit(False)))
    if len(scans) == 1:
        return scan(*scans[0])
    drawn = None if ranges is None or fits(ranges, len(spans)) else prepared(written(ranges.select("lo", "hi").filter("lo <= hi")))
    to = work_dir(spark)
    for group, files in scans:
        rows = scan(group, files)
        if drawn is not None:
            near = drawn.covers.filter((F.col("range_hi") >= group[0].lo) & (F.col("range_lo") <= group[-1].hi))
            rows = in_any_range(rows, id, replace(drawn, covers=near))
        rows.write.mode("append").parquet(to)
    return spark.read.schema(picked(whole).schema).parquet(to)


def read_ranges(spark: SparkSession, path: str, id: str, ranges: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of a stored table in any of the disjoint ranges (lo, hi), each once."""
    rows = read_spans(spark, path, id, spans_of(ranges), columns, ranges)
    return in_ranges(rows, id, ranges.select("lo", "hi")).drop("range_lo")


def diff_sample_stored(spark: SparkSession, left: str, right: str, id: str, ranges: DataFrame) -> DataFrame:
    """`diff_sample` of two stored tables that opens only what the ranges (lo, hi, rows) touch."""
    spans = spans_of(ranges)
    sides = [read_spans(spark, path, id, spans, ranges=ranges) for path in (left, right)]
    return diff_sample(*sides, id, ranges)
