"""A table written batch by batch, with a commit record for each: readers and retries go by the records alone.

    <root>/data/<folder>/       the rows of one batch, as encoded and written once
    <root>/_pending.json        the batch that is being written: its identity and its folder
    <root>/_commits/<n>.json    record n: identity, folder, rows, and facts that the writer wants to remember

A record is created under the next number, never over another, so of two writers one loses and finds out. A crash before
the folder is complete leaves a pending batch without rows: the folder goes, and the batch is made again. One after it leaves a
complete folder: the retry publishes it, without making the batch again. One after the record leaves a batch that
is committed: the retry returns its record. While a batch is pending, only the same batch may be written. Rows belong to
their batch, not to their ids, so rows without an id are neither doubled nor lost.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.sources.files import create_json, delete, exists, names, read_json, write_json

#: Digits of a record's number, so that names sort.
DIGITS = 12


class OtherBatchPending(Exception):
    pass


class AnotherWriter(Exception):
    pass


@dataclass(frozen=True)
class Identity:
    """What tells a batch: a retry is of the same rows if these are the same. `name` tells batches apart that the rest does not."""
    table: str
    columns: tuple[str, ...]
    count: int
    first_id: int | None
    last_id: int | None
    name: str = ""

    def plain(self) -> dict:
        return {"table": self.table, "columns": list(self.columns), "count": self.count, "first_id": self.first_id, "last_id": self.last_id, "name": self.name}


def identity_of(df: DataFrame, table: str, id: str, name: str = "") -> Identity:
    count, first, last = df.agg(F.count("*"), F.min(F.col(id).cast("bigint")), F.max(F.col(id).cast("bigint"))).first()
    return Identity(table, tuple(c for c in df.columns if c != id), count, first, last, name)


class LedgerTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Records

    def _record(self, number: int) -> str:
        return f"{self.root}/_commits/{number:0{DIGITS}d}.json"

    def commits(self) -> list[dict]:
        """The records, in their order."""
        return [read_json(self.spark, f"{self.root}/_commits/{name}") for name in names(self.spark, f"{self.root}/_commits") if name.endswith(".json")]

    def committed(self, identity: Identity) -> dict | None:
        plain = identity.plain()
        return next((r for r in reversed(self.commits()) if r["identity"] == plain), None)

    def pending(self) -> dict | None:
        return read_json(self.spark, f"{self.root}/_pending.json")

    # Writing

    def write(self, identity: Identity, made: Callable[[], DataFrame], facts: Callable[[DataFrame], dict] = lambda rows: {}) -> dict:
        """Commit a batch once: `made` is asked for the rows only if no complete folder of them is there. Returns the record.

        `facts` of the rows as they were written go into the record.
        """
        found = self.committed(identity)
        waiting = self.pending()
        if found:
            if waiting and waiting["identity"] == identity.plain():
                delete(self.spark, f"{self.root}/_pending.json")  # cut off between the record and this
            return found
        if waiting and waiting["identity"] != identity.plain():
            raise OtherBatchPending(f"{waiting['identity']} is not published yet and must be written again first")
        if waiting and not exists(self.spark, f"{self.root}/data/{waiting['folder']}/_SUCCESS"):
            delete(self.spark, f"{self.root}/data/{waiting['folder']}")
            waiting = None
        if not waiting:
            waiting = {"identity": identity.plain(), "folder": uuid.uuid4().hex}
            write_json(self.spark, f"{self.root}/_pending.json", waiting)
            self._encode(made(), waiting["folder"])
        return self._publish(waiting, facts)

    def _encode(self, df: DataFrame, folder: str) -> None:
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/data/{folder}")

    def _publish(self, waiting: dict, facts: Callable[[DataFrame], dict]) -> dict:
        rows = self.spark.read.parquet(f"{self.root}/data/{waiting['folder']}")
        record = {"identity": waiting["identity"], "folder": waiting["folder"], "rows": rows.count(), "facts": facts(rows)}
        number = len(names(self.spark, f"{self.root}/_commits"))
        if not create_json(self.spark, self._record(number), record):
            raise AnotherWriter(f"record {number} of {self.root} was created by another writer meanwhile")
        delete(self.spark, f"{self.root}/_pending.json")
        return record

    # Reading

    def read(self, schema=None) -> DataFrame:
        """The rows of all committed batches, each batch whole or not at all."""
        folders = [f"{self.root}/data/{r['folder']}" for r in self.commits() if r["rows"]]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        if folders:
            return reader.parquet(*folders)
        if schema is None:
            raise FileNotFoundError(f"{self.root} has no committed rows, and no schema was given")
        return self.spark.createDataFrame([], schema)


def write_batches(ledger: LedgerTable, df: DataFrame, table: str, id: str, width: int) -> list[dict]:
    """A table in batches of `width` ids, rows without an id in one of their own, each committed once.

    The batches are planned by one aggregate; how many there are is the driver's, their rows never. A batch that is committed is not read
    again, and one that was cut off goes first.
    """
    place = F.expr(f"(cast(`{id}` as bigint) - pmod(cast(`{id}` as bigint), {width}L)) div {width}L")
    plan = (df.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(F.col(id).cast("bigint")).alias("first"), F.max(F.col(id).cast("bigint")).alias("last"))
            .orderBy(F.col("place").asc_nulls_last()).collect())
    columns = tuple(c for c in df.columns if c != id)
    planned = [(Identity(table, columns, r.n, r.first, r.last), r) for r in plan]
    waiting = ledger.pending()
    if waiting:
        planned.sort(key=lambda p: p[0].plain() != waiting["identity"])
    done = []
    for identity, r in planned:
        rows = df.filter(F.col(id).isNull()) if r.place is None else df.filter(F.col(id).between(r["first"], r["last"]))
        done.append(ledger.write(identity, lambda rows=rows: rows))
    return done
