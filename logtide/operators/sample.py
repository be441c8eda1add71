"""Stratified samples by position, and reading many id ranges in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logtide.operators.positions import BROADCAST_HITS, block_offsets, ids_at
from logtide.session import fits

# Fixed values of the sample: about 1% of every million rows, in ranges of about a thousand.
WINDOW_ROWS = 1_000_000
FRACTION_PERCENT = 1
RANGE_ROWS = 1_000

#: Ranges up to this count (at most 32 bytes each, twice) are broadcast; more are joined by shuffle.
BROADCAST_RANGES = 1_000_000
#: Ranges of a predicate that are tested one by one, once their bounds hold.
TESTED = 25


def sample_plan(spark: SparkSession, row_count: int, seed: int = 0, window_rows: int = WINDOW_ROWS,
                range_rows: int = RANGE_ROWS) -> DataFrame:
    """Positions to compare: per window, 1% of its rows in ranges, one random range inside each equal slot.

    The offset comes from a hash of (seed, window, slot), so a retried task plans the same ranges.
    """
    windows = (row_count + window_rows - 1) // window_rows
    w = spark.range(windows).withColumnRenamed("id", "window")
    w = w.select(
        "window", (F.col("window") * window_rows).alias("first"),
        F.least(F.lit(window_rows), F.lit(row_count) - F.col("window") * window_rows).alias("rows"))
    w = w.withColumn("sampled", F.greatest(F.lit(1), F.expr(f"(rows * {FRACTION_PERCENT} + 99) div 100")))
    w = w.withColumn("ranges", F.greatest(F.lit(1), F.expr(f"(sampled * 2 + {range_rows}) div {2 * range_rows}")))
    w = w.withColumn("length", F.greatest(F.lit(1), F.expr("(sampled + ranges - 1) div ranges")))
    w = w.withColumn("slot_rows", F.expr("rows div ranges"))
    w = w.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))
    w = w.withColumn("slot_start", F.col("first") + F.col("slot") * F.col("slot_rows"))
    w = w.withColumn("slot_length", F.when(
        F.col("slot") == F.col("ranges") - 1, F.col("first") + F.col("rows") - F.col("slot_start"))
        .otherwise(F.col("slot_rows")))
    w = w.withColumn("taken", F.least("length", "slot_length"))
    # 32 random bits, scaled to the free room of the slot
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "window", "slot"), 256), 1, 8), 16, 10)
    offset = F.expr("(bits * (slot_length - taken + 1)) div 4294967296")
    w = w.withColumn("bits", bits.cast("bigint")).withColumn("start", F.col("slot_start") + offset)
    return w.select("window", "slot", "start", (F.col("start") + F.col("taken") - 1).alias("end"))


def sample_ranges(df: DataFrame, id: str, plan: DataFrame) -> DataFrame:
    """The planned positions as id ranges with their row counts; a range past the end is cut short."""
    offsets, total = block_offsets(df.select(id), id)
    small = fits(plan, BROADCAST_HITS // 2)
    plan = (plan.filter(F.col("start") < total)
            .withColumn("end", F.least(F.col("end"), F.lit(total - 1))))
    edges = plan.select("window", "slot", "start", "end",
                        F.explode(F.array_distinct(F.array("start", "end"))).alias("position"))
    found = ids_at(df, id, edges.select("position"), offsets, small)
    return (edges.join(found, "position").groupBy("window", "slot")
            .agg(F.min(id).alias("lo"), F.max(id).alias("hi"),
                 F.first(F.col("end") - F.col("start") + 1).alias("rows")))


@dataclass(frozen=True)
class Ranges:
    """Ascending, disjoint id ranges made ready for lookups."""
    covers: DataFrame
    levels: list[int]
    small: bool


def prepared(ranges: DataFrame) -> Ranges:
    """Each range (lo, hi) under the one or two aligned blocks that cover it, at the finest of the levels
    0, 4 … 60, 63 where two do.

    Blocks of a level hold 2**level ids. A range is longer than a 32nd of a block of its level, so a
    lookup fans out by a small constant whatever the gaps between ids, and ranges of like length
    share a level: a row is looked up once or twice. Counting the ranges also lists the levels.
    """
    level = F.expr("filter(array_append(sequence(0, 60, 4), 63), k -> shiftright(hi, k) - shiftright(lo, k) <= 1)[0]")
    leveled = ranges.select("lo", "hi", level.alias("level"))
    count, levels = leveled.agg(F.count("*"), F.sort_array(F.collect_set("level"))).first()
    blocks = F.expr("sequence(shiftright(lo, level), shiftright(hi, level))")
    covers = leveled.select(F.col("lo").alias("range_lo"), F.col("hi").alias("range_hi"), "level", F.explode(blocks).alias("cover"))
    return Ranges(covers, list(levels), count <= BROADCAST_RANGES)


def in_ranges(df: DataFrame, id: str, ranges: DataFrame | Ranges) -> DataFrame:
    """Rows whose id lies in one of the ranges, plus that range's `range_lo`. One scan, no range join."""
    ready = ranges if isinstance(ranges, Ranges) else prepared(ranges)
    if not ready.levels:
        return df.withColumn("range_lo", F.col(id)).filter(F.lit(False))
    levels = F.array(*[F.lit(level) for level in ready.levels])
    keyed = df.withColumn("level", F.explode(levels) if len(ready.levels) > 1 else F.lit(ready.levels[0]))
    keyed = keyed.withColumn("cover", F.expr(f"shiftright(`{id}`, level)"))
    covers = F.broadcast(ready.covers) if ready.small else ready.covers
    return (keyed.join(covers, ["level", "cover"])
            .filter(F.col(id).between(F.col("range_lo"), F.col("range_hi")))
            .drop("level", "cover", "range_hi"))


def in_any_range(df: DataFrame, id: str, ready: Ranges) -> DataFrame:
    """Rows whose id lies in any of the ranges, each once even where ranges overlap. One scan, no range join.

    A block holds the few ranges that are longer than a 32nd of it, so each level's are looked up as a list.
    """
    rows, found, helpers = df, F.lit(False), []
    for level in ready.levels:
        helpers += (cover := f"_cover_{level}", held := f"_ranges_{level}")
        lists = (ready.covers.filter(F.col("level") == level).groupBy(F.col("cover").alias(cover))
                 .agg(F.collect_set(F.struct("range_lo", "range_hi")).alias(held)))
        rows = (rows.withColumn(cover, F.shiftright(F.col(id).cast("bigint"), level))
                .join(F.broadcast(lists) if ready.small else lists, cover, "left"))
        inside = F.exists(held, lambda r: F.col(id).between(r["range_lo"], r["range_hi"]))
        found = found | F.coalesce(inside, F.lit(False))
    return rows.filter(found).drop(*helpers)


def literal_ranges(id: str, ranges: list[tuple[int, int]]) -> Column:
    """Hundreds of ranges at most as a predicate that prunes row groups.

    A row is tested against the bounds of some ranges before it is tested against each of them. All is parsed as one text, as each column made
    from here is several calls to the driver's JVM. The parser joins tests by pairs: the planner goes down a predicate by recursion, and one
    as deep as there are ranges overflows its stack.
    """
    name = id if "`" in id else ".".join(f"`{part}`" for part in id.split("."))
    known = sorted(tuple(r) for r in ranges if None not in tuple(r))
    tests = []
    for k in range(0, len(known), TESTED):
        some = known[k:k + TESTED]
        each = " OR ".join(f"({name} >= {lo} AND {name} <= {hi})" for lo, hi in some)
        tests.append(each if len(some) == 1 else f"({name} >= {some[0][0]} AND {name} <= {max(hi for _, hi in some)} AND ({each}))")
    return F.expr(" OR ".join(tests)) if tests else F.lit(False)
