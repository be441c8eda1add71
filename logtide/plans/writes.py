"""Writes that may be repeated: by id range, by batch ledger, and published versions."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.session import written
from logtide.sources.files import exists, folders, read_json, write_json

BUCKET = "id_bucket"
#: Ids per output folder, as a power of two: at most 16 million rows each.
BUCKET_BITS = 24


class RowsWithoutId(Exception):
    pass


def write_idempotent(df: DataFrame, path: str, id: str, bits: int = BUCKET_BITS) -> None:
    """Write rows into folders by id range; a repeated write replaces the rows with its ids.

    Folders are replaced whole: rows of other ids in a folder that the batch touches are read first, kept in the
    shared folder, and written again beside it. Batches that share a folder must not be written at the same time. Rows
    without an id have nothing that a repeated write could replace: a batch with some is refused before anything is
    written (`LedgerTable` takes them).
    """
    if not df.filter(F.col(id).isNull()).isEmpty():
        raise RowsWithoutId(f"rows without {id} cannot be written repeatably by id")
    bucketed = df.withColumn(BUCKET, F.shiftright(F.col(id), bits))
    if exists(df.sparkSession, path):
        before = df.sparkSession.read.parquet(path)
        before = before.withColumn(BUCKET, F.col(BUCKET).cast(bucketed.schema[BUCKET].dataType))
        touched = bucketed.select(BUCKET).distinct()
        others = before.join(touched, BUCKET, "left_semi").join(df.select(id).distinct(), id, "left_anti")
        bucketed = bucketed.unionByName(written(others))
    (bucketed.repartitionByRange(BUCKET, id).sortWithinPartitions(BUCKET, id)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


IDENTITY = ["table", "columns", "count", "first_id", "last_id"]


def plan_batches(df: DataFrame, table: str, id: str, bits: int = BUCKET_BITS) -> DataFrame:
    """The batches of a table, by id bucket, each with the identity under which it may be retried."""
    columns = ",".join(c for c in df.columns if c != id)
    return (df.groupBy(F.shiftright(F.col(id), bits).alias("bucket"))
            .agg(F.count("*").alias("count"), F.min(id).alias("first_id"), F.max(id).alias("last_id"))
            .select("bucket", F.lit(table).alias("table"), F.lit(columns).alias("columns"), "count", "first_id", "last_id"))


def pending_batches(planned: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned batches the ledger does not have under the same identity."""
    return planned.join(ledger.select(*IDENTITY).distinct(), IDENTITY, "left_anti")


# Published versions: <root>/<version>/<table>, and <root>/<version>/_manifest.json

MANIFEST = "_manifest.json"


class NotPublished(Exception):
    pass


def begin_version(spark: SparkSession, root: str, version: str) -> str:
    """Mark a new version incomplete before anything is written to it; returns its folder."""
    folder = f"{root}/{version}"
    if exists(spark, folder):
        raise FileExistsError(f"{folder} already holds a version")
    write_json(spark, f"{folder}/{MANIFEST}", {"status": "incomplete", "at": int(time.time())})
    return folder


def complete_version(spark: SparkSession, root: str, version: str, tables: dict[str, dict]) -> None:
    """The last step: mark a validated version complete, with each table's counts and high-water mark."""
    write_json(spark, f"{root}/{version}/{MANIFEST}",
               {"status": "complete", "at": int(time.time()), "tables": tables})


def manifest(spark: SparkSession, root: str, version: str) -> dict:
    found = read_json(spark, f"{root}/{version}/{MANIFEST}")
    if found is None:
        raise NotPublished(f"{root}/{version} has no manifest")
    return found


def latest_version(spark: SparkSession, root: str) -> str:
    for version in reversed(folders(spark, root)):
        found = read_json(spark, f"{root}/{version}/{MANIFEST}")
        if found and found["status"] == "complete":
            return version
    raise NotPublished(f"{root} has no complete version")


def open_published(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A table of a complete version; one that is not complete is refused."""
    version = version or latest_version(spark, root)
    if manifest(spark, root, version)["status"] != "complete":
        raise NotPublished(f"{root}/{version} is not complete")
    return spark.read.parquet(f"{root}/{version}/{table}")
