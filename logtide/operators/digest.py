"""Digests of whole tables that combine before every shuffle.

A row's SHA-256 is read as four 32-bit words (its first 128 bits); the words of a block of ids are summed. Sums do not
depend on order, so no rows are sorted or gathered, and the id inside each hashed line still fixes
which row is which. Blocks of blocks are folded the same way, up to one line per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions.values import render_row

WORDS = 4
#: Ids per block and blocks per parent, as powers of two. 2**20 words of 32 bits stay far from 2**63.
BLOCK_BITS = 20


def words(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"w{i}") for i in range(WORDS)]


def _fold(hashed: DataFrame, by: list[str]) -> DataFrame:
    """Sum the words of `hash` per group and hash the sums again."""
    wide = hashed.select(*by, "rows", "min_id", "max_id", *words(F.col("hash")))
    summed = wide.groupBy(*by).agg(F.sum("rows").alias("rows"), F.min("min_id").alias("min_id"),
                                   F.max("max_id").alias("max_id"),
                                   *[F.sum(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    line = F.concat_ws(",", *by, "rows", *[f"w{i}" for i in range(WORDS)])
    return summed.select(*by, "rows", "min_id", "max_id", F.sha2(line, 256).alias("hash"))


def block_digests(df: DataFrame, id: str, line: Column, bits: int = BLOCK_BITS) -> DataFrame:
    """One digest per block of 2**bits ids: (block, rows, min_id, max_id, hash)."""
    key = F.col(id).cast("bigint")
    hashed = df.select(F.shiftright(key, bits).alias("block"), F.lit(1).cast("bigint").alias("rows"),
                       key.alias("min_id"), key.alias("max_id"), F.sha2(line, 256).alias("hash"))
    return _fold(hashed, ["block"])


def table_digest(df: DataFrame, id: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """Rows, lowest and highest id, and 16 hex digits that change when any row does."""
    leaves = block_digests(df, id, render_row(df, id, columns))
    upper = _fold(leaves.withColumn("block", F.shiftright("block", BLOCK_BITS)), ["block"])
    whole = _fold(upper.drop("block"), [])
    return whole.select(
        F.lit(table).alias("table"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("min_id", F.lit(0)).alias("min_id"), F.coalesce("max_id", F.lit(0)).alias("max_id"),
        F.substring("hash", 1, 16).alias("digest"))
