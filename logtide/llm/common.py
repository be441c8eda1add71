"""Helpers that the operators share: tables, hold-outs, model hand-over, intermediate tables."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from logtide.session import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`: who may be learned from is decided by this alone."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def kept(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: its lineage ends there.

    Each call takes a new folder; a lost executor costs a new read of the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, column: str) -> DataFrame:
    """The table as `kept`, with a folder for each value of a column: reading one value opens its files alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete what `kept` wrote for a table; only for tables that no later job reads."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a table that tells which ids may be in a set: fixed, 8 MB. Ids that share a bit are told apart by what follows.
TABLE_BITS = 26
#: Bits of one of its blocks, as Spark's bitmap functions have them.
BLOCK_BITS = 32768


def empty_table(bits: int | None = None) -> np.ndarray:
    return np.zeros(1 << (TABLE_BITS if bits is None else bits) - 3, np.uint8)


def used(table: np.ndarray) -> int:
    """Bits of an id that tell its place in the table."""
    return (8 * len(table)).bit_length() - 1


def has(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = ids >> np.uint64(64 - used(table))
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def with_bits(table: np.ndarray, ids: DataFrame) -> np.ndarray:
    """The table with the bits of more ids (a column `id` of evenly spread longs), set block by block on the executors."""
    bit = F.shiftrightunsigned("id", 64 - used(table))
    placed = ids.select(bit.alias("bit")).select(F.expr(f"bit div {BLOCK_BITS}").alias("block"), (F.col("bit") % BLOCK_BITS).alias("place"))
    out, size = table.copy(), BLOCK_BITS // 8
    for row in placed.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")).toLocalIterator():
        out[row.block * size:(row.block + 1) * size] |= np.frombuffer(row.bits, np.uint8)
    return out


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


#: Bytes of text that are worked on at once in a task.
CHUNK_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts add up to about `limit` bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after the other, and where each begins (one more than there are texts); null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, starts, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(starts, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def fitted_in_task(sample: DataFrame, function: Callable[[pa.Table], object]) -> object:
    """What a function makes of a bounded, sorted sample: it runs in one task, and its small result comes back."""
    schema = sample.schema

    def fit(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(function(pa.Table.from_batches(list(batches), to_arrow_schema(schema))))], pa.binary())], ["model"])
    rows = sample.coalesce(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(rows[0].model) if rows else function(to_arrow_schema(schema).empty_table())  # no row, no task
