"""Stores that hold log tables: a folder of parquet tables, a catalog database, or a JDBC database."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.sources.files import exists, folders
from logtide.sources.scan import in_id_order


@dataclass(frozen=True)
class ParquetStore:
    root: str

    def tables(self, spark: SparkSession) -> list[str]:
        return folders(spark, self.root)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{table}")

    def has(self, spark: SparkSession, table: str) -> bool:
        return exists(spark, f"{self.root}/{table}")

    def write(self, df: DataFrame, table: str, id: str, replace: bool = False) -> None:
        """A new table in id order, so that later range reads skip row groups; `replace` puts it over a partial one."""
        in_id_order(df, id).write.mode("overwrite" if replace else "errorifexists").option(
            "partitionOverwriteMode", "static").parquet(f"{self.root}/{table}")


@dataclass(frozen=True)
class CatalogStore:
    database: str

    def tables(self, spark: SparkSession) -> list[str]:
        return sorted(t.name for t in spark.catalog.listTables(self.database) if not t.isTemporary)

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.table(f"`{self.database}`.`{table}`")

    def has(self, spark: SparkSession, table: str) -> bool:
        return spark.catalog.tableExists(f"`{self.database}`.`{table}`")

    def write(self, df: DataFrame, table: str, id: str, replace: bool = False) -> None:
        in_id_order(df, id).write.format("parquet").mode("overwrite" if replace else "errorifexists").saveAsTable(f"`{self.database}`.`{table}`")


@dataclass(frozen=True)
class JdbcStore:
    """Any database with a JDBC driver on the class path. Quoting and types are the dialect's business."""
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    prefix: str = ""
    partitions: int = 32
    batch_rows: int = 10_000

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.jdbc(self.url, self.prefix + table, properties=self.properties)

    def read_by_id(self, spark: SparkSession, table: str, id: str, lo: int, hi: int) -> DataFrame:
        """Parallel read in even id strides; right when ids are spread evenly."""
        return spark.read.jdbc(self.url, self.prefix + table, column=id, lowerBound=lo, upperBound=hi + 1,
                               numPartitions=self.partitions, properties=self.properties)

    def read_pages(self, spark: SparkSession, table: str, id: str, bounds: list[tuple[int, int]]) -> DataFrame:
        """Parallel read with one partition per page of `page_bounds`, even where ids have gaps."""
        return spark.read.jdbc(self.url, self.prefix + table, predicates=page_predicates(id, bounds),
                               properties=self.properties)

    def write(self, df: DataFrame, table: str, id: str, replace: bool = False) -> None:
        """Appends; a retried task may write rows twice, which a comparison reports as `repeated`."""
        if replace:
            raise NotImplementedError("a JDBC table is not replaced here: empty it, then copy it anew")
        (df.write.mode("append").option("batchsize", self.batch_rows).option("isolationLevel", "READ_COMMITTED")
         .jdbc(self.url, self.prefix + table, properties=self.properties))


def page_predicates(id: str, bounds: list[tuple[int, int]]) -> list[str]:
    return [f"{id} >= {lo} AND {id} <= {hi}" for lo, hi in bounds]


def drop_prefix(names: list[str], prefix: str) -> dict[str, str]:
    """Unprefixed table names with the names they have in the store."""
    return {name[len(prefix):]: name for name in names if name.lower().startswith(prefix.lower())}
