"""The three behaviours that go on while logs arrive: catching up, late rows, and live policy."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from logtide.functions.times import kept
from logtide.operators.positions import assign_ids
from logtide.operators.retention import ORDER_SLACK
from logtide.operators.routing import Route, route
from logtide.plans.ledger import Identity, LedgerTable


def catch_up(stream: DataFrame, id: str, high_water: int, path: str, checkpoint: str) -> DataStreamWriter:
    """Rows above the high-water mark into a parquet folder, exactly once.

    A batch is written under its checkpoint's name and its own number, so a batch that is replayed after a failure
    replaces itself instead of adding rows, and streams with other checkpoints replace nothing.
    """
    name = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        (batch.withColumn("stream", F.lit(f"s{name}")).withColumn("batch", F.lit(number)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch").parquet(path))

    return (stream.filter(F.col(id) > high_water).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint))


def _stream_batch(df: DataFrame, checkpoint: str, number: int) -> Identity:
    """A micro-batch is told by its checkpoint and number: Spark replays it with the same rows."""
    return Identity("stream", tuple(df.columns), -1, None, None, f"{checkpoint.rstrip('/')}#{number}")


def last_id(ledger: LedgerTable, high_water: int) -> int:
    """The highest id handed out so far: what the newest record says, or the mark before any."""
    marks = [r["facts"]["mark"] for r in ledger.commits() if "mark" in r["facts"]]
    return max([high_water, *marks])


def catch_up_with_ids(stream: DataFrame, key: str, id: str, taken: int, high_water: int, ledger: LedgerTable, checkpoint: str) -> DataStreamWriter:
    """Rows with keys above `taken`, each once, with ids of their own above `high_water` and without gaps.

    A micro-batch gets its ids in key order from where the last committed one ended, and that end goes into the record
    that publishes it. So a batch replayed after a crash gets the same ids, a new run goes on behind the last record, and
    readers of the ledger see whole batches. Rows without a key cannot be placed above the mark and are left out, as the others are.
    """
    def write(batch: DataFrame, number: int) -> None:
        def made() -> DataFrame:
            return assign_ids(batch, key, last_id(ledger, high_water), id)

        def facts(rows: DataFrame) -> dict:
            highest = rows.agg(F.max(id)).first()[0]
            return {} if highest is None else {"mark": highest}
        ledger.write(_stream_batch(batch, checkpoint, number), made, facts)

    return (stream.filter(F.col(key) > taken).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


#: Ids of a bucket in which earlier copies are looked for, as a power of two; touched buckets that a predicate spells out.
LOOKUP_BITS, SPELLED_BUCKETS = 16, 1_000


def dedupe_exact(stream: DataFrame, id: str, time: str, now: int, ledger: LedgerTable, checkpoint: str, slack: int = ORDER_SLACK) -> DataStreamWriter:
    """Each id once, however late its first copy or its repeats come.

    Nothing is kept in memory between batches: a batch's ids are looked up among those committed, in the buckets of ids
    that it touches. Rows dated too far ahead or without a time are left out, as `dedupe_late` does, but no row is
    for being late. Rows without an id are repeats of nothing and stay.
    """
    timely = stream.filter(F.col(time) <= F.timestamp_seconds(F.lit(now + slack)))
    bucket = F.shiftright(F.col(id), LOOKUP_BITS)

    def write(batch: DataFrame, number: int) -> None:
        def made() -> DataFrame:
            rows = batch.filter(F.col(id).isNotNull()).dropDuplicates([id]).withColumn("id_bucket", bucket)
            before = [r for r in ledger.commits() if r["rows"]]
            if before:
                touched = rows.select("id_bucket").distinct()
                some = touched.limit(SPELLED_BUCKETS + 1).collect()
                target = ledger.read().select("id_bucket", id)
                target = (target.filter(F.col("id_bucket").isin([r[0] for r in some])) if len(some) <= SPELLED_BUCKETS
                          else target.join(touched, "id_bucket", "left_semi"))
                rows = rows.join(target.select(id), id, "left_anti")
            without = batch.filter(F.col(id).isNull()).withColumn("id_bucket", bucket)
            # In id order within files, so that a later lookup skips what it does not touch
            return rows.select(*without.columns).unionByName(without).sortWithinPartitions("id_bucket", id)
        ledger.write(_stream_batch(batch, checkpoint, number), made)

    return timely.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def dedupe_late(stream: DataFrame, id: str, time: str, now: int, slack: int = ORDER_SLACK) -> DataFrame:
    """Each id once, as long as its copies come within `slack` seconds of event time.

    Rows dated further than `slack` ahead of `now` are left out before the watermark: one wrong
    clock would otherwise make everything after it late; so are rows without a time, which no watermark can
    place. `future_rows` gives both to a side sink. A row that comes behind the watermark is dropped by Spark,
    its first copy too: `missed` finds those afterwards.
    """
    timely = stream.filter(F.col(time) <= F.timestamp_seconds(F.lit(now + slack)))
    return timely.withWatermark(time, f"{slack} seconds").dropDuplicatesWithinWatermark([id])


def future_rows(stream: DataFrame, time: str, now: int, slack: int = ORDER_SLACK) -> DataFrame:
    """What `dedupe_late` leaves out before the watermark: rows too far ahead, and rows without a time."""
    return stream.filter(F.col(time).isNull() | (F.col(time) > F.timestamp_seconds(F.lit(now + slack))))


def missed(source: DataFrame, target: DataFrame, id: str, time: str, now: int, slack: int = ORDER_SLACK) -> DataFrame:
    """Of a stream that ran to its end: source rows with a timely date whose id the target has not, one for each id.

    Their first copies came behind the watermark. Both are tables; append the result to the target to lose nothing.
    """
    timely = source.filter(F.col(time) <= F.timestamp_seconds(F.lit(now + slack)))
    return timely.join(target.select(id), id, "left_anti").dropDuplicates([id]).select(*source.columns)


def live_policy(stream: DataFrame, url: str, routes: list[Route], default: str, time: str | None = None,
                cutoff: int | None = None) -> DataFrame:
    """Each arriving URL with its route decision; rows already past the cutoff never enter. Stateless."""
    fresh = stream if time is None or cutoff is None else stream.filter(kept(stream, time, cutoff))
    return route(fresh, url, routes, default)


def run_to_end(writer: DataStreamWriter, timeout: int = 3600) -> None:
    """Process what is there and stop."""
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination(timeout)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)


