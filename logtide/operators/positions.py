"""Row positions in id order, without sorting a table into one task.

Ids are unique, so the ids that share all but their low `LEAF_BITS` bits are at most `2**LEAF_BITS`
rows however the ids are spread: no such block can be hot. Rows are counted per block by a
combined aggregate, which is written down because everything else starts from it; running
totals over many blocks are taken level by level, and only rows in blocks that a caller asks about
are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logtide.session import fits, written

LEAF_BITS = 12
#: Blocks per parent at each level above the leaves; 12 + 20 + 20 bits leave 4,096 top blocks.
FAN_BITS = 20
#: Up to this many blocks (a few bytes each) one window takes the running totals of all.
FLAT_BLOCKS = 100_000
#: Up to this many asked positions (24 bytes each) are broadcast to the ids.
BROADCAST_HITS = 200_000


def block_of(id: str) -> Column:
    return F.shiftright(F.col(id), LEAF_BITS).alias("block")


def running(blocks: DataFrame, value: str, out: str, how, few: bool | None = None) -> DataFrame:
    """`blocks` (unique `block`, `value`) plus `out`: `how` (F.sum or F.max) over all earlier blocks.

    `blocks` is a written table; `few` says whether it has at most `FLAT_BLOCKS` rows, left out it is
    counted. More are partitioned by their parent block, whose
    own running value is joined back: no window is wider than 2**FAN_BITS blocks, the last 4,096.
    """
    def before(frame: DataFrame, by: list[str]) -> DataFrame:
        over = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumn("within", how(value).over(over))

    if fits(blocks, FLAT_BLOCKS) if few is None else few:
        flat = before(blocks, []).withColumnRenamed("within", out)
        return flat.withColumn(out, F.coalesce(out, F.lit(0))) if how is F.sum else flat
    parents = (blocks.groupBy(F.shiftright("block", FAN_BITS).alias("parent"))
               .agg(how(value).alias(value)).withColumnRenamed("parent", "block"))
    grands = (parents.groupBy(F.shiftright("block", FAN_BITS).alias("parent"))
              .agg(how(value).alias(value)).withColumnRenamed("parent", "block"))
    top = before(grands, []).select(F.col("block").alias("parent"), F.col("within").alias("carried"))
    for level in (parents, blocks):
        own = before(level.withColumn("parent", F.shiftright("block", FAN_BITS)), ["parent"])
        joined = own.join(top, "parent")
        if how is F.sum:
            total = F.coalesce("within", F.lit(0)) + F.coalesce("carried", F.lit(0))
        else:
            total = F.greatest("within", "carried")
        done = joined.withColumn(out, total).drop("within", "carried", "parent")
        top = done.select(F.col("block").alias("parent"), F.col(out).alias("carried"))
    return done


def block_offsets(df: DataFrame, id: str) -> tuple[DataFrame, int]:
    """Occupied blocks with their row count `n` and the position `first` of their first row; and all rows' count."""
    counts = written(df.filter(F.col(id).isNotNull()).groupBy(block_of(id)).agg(F.count("*").alias("n")))
    blocks, rows = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return running(counts, "n", "first", F.sum, blocks <= FLAT_BLOCKS), rows


def with_position(df: DataFrame, id: str, out: str = "position") -> DataFrame:
    """Number the rows 0, 1, 2 … in id order; rows without an id stay, without a position. Rows are shuffled once, by block.

    Counts the blocks when called.
    """
    rank = F.row_number().over(Window.partitionBy("block").orderBy(id))
    offsets = block_offsets(df.select(id), id)[0].select("block", "first")
    numbered = (df.filter(F.col(id).isNotNull()).withColumn("block", block_of(id)).withColumn(out, rank)
                .join(offsets, "block")
                .withColumn(out, F.col("first") + F.col(out) - 1).drop("block", "first"))
    # not by a null block: all of those rows would meet in one task
    return numbered.unionByName(df.filter(F.col(id).isNull()).withColumn(out, F.lit(None).cast("bigint")))


def ids_at(df: DataFrame, id: str, positions: DataFrame, offsets: DataFrame | None = None,
           small: bool | None = None) -> DataFrame:
    """The ids at the distinct `position`s asked for. Positions past the last row find nothing.

    Only the ids of blocks that hold an asked position are shuffled and ranked. `small` says whether
    the positions are proven to number at most `BROADCAST_HITS`; left out, they are counted.
    """
    ids = df.select(id)
    offsets = offsets if offsets is not None else block_offsets(ids, id)[0]
    # Equi-join on stretches of 4,096 positions: a block reaches into two of them at most
    stretches = offsets.withColumn("stretch", F.explode(F.sequence(
        F.shiftright("first", LEAF_BITS), F.shiftright(F.col("first") + F.col("n") - 1, LEAF_BITS))))
    asked = positions.select("position", F.shiftright("position", LEAF_BITS).alias("stretch"))
    hits = (asked.join(stretches, "stretch")
            .filter((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n")))
            .select("block", "position", (F.col("position") - F.col("first") + 1).alias("rank")))
    wanted = hits.select("block").distinct()
    if fits(positions, BROADCAST_HITS) if small is None else small:
        wanted, hits = F.broadcast(wanted), F.broadcast(hits)
    ranked = (ids.withColumn("block", block_of(id))
              .join(wanted, "block", "left_semi")
              .withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(id))))
    return ranked.join(hits, ["block", "rank"]).select("position", id)


def assign_ids(df: DataFrame, order: str, start: int, out: str = "rowid") -> DataFrame:
    """Give new rows the ids after the high-water mark `start`, in the order of a unique key; rows without a key get none."""
    return with_position(df, order, out).withColumn(out, F.col(out) + F.lit(start) + 1)


def page_bounds(df: DataFrame, id: str, rows_per_page: int) -> DataFrame:
    """First and last id and row count of each page of rows in id order."""
    if rows_per_page < 1 << LEAF_BITS:
        numbered = with_position(df.select(id).filter(F.col(id).isNotNull()), id)
        return (numbered.groupBy(F.floor(F.col("position") / rows_per_page).alias("page"))
                .agg(F.min(id).alias("from_id"), F.max(id).alias("to_id"), F.count("*").alias("rows")))
    # The row count plans the pages by arithmetic; only their edge rows are looked up
    offsets, total = block_offsets(df.select(id), id)
    pages = (df.sparkSession.range((total + rows_per_page - 1) // rows_per_page).withColumnRenamed("id", "page")
             .withColumn("start", F.col("page") * rows_per_page)
             .withColumn("end", F.least(F.col("start") + rows_per_page, F.lit(total)) - 1))
    edges = pages.select("page", "start", "end", F.explode(F.array_distinct(F.array("start", "end"))).alias("position"))
    found = ids_at(df, id, edges.select("position"), offsets, 2 * total <= BROADCAST_HITS * rows_per_page)
    return (edges.join(found, "position")
            .groupBy("page").agg(F.min(id).alias("from_id"), F.max(id).alias("to_id"),
                                 F.first(F.col("end") - F.col("start") + 1).alias("rows")))


def id_gaps(df: DataFrame, id: str) -> DataFrame:
    """Stretches of unused ids between used ones: `after_id`, `next_id`, `missing`.

    Ids are shuffled once, by block; gaps within a block and its bounds come from one sorted pass over it. That pass
    runs when called.
    """
    ids = df.select(F.col(id).alias("id"), block_of(id)).filter(F.col("id").isNotNull())
    walked = ids.withColumn("after_id", F.lag("id").over(Window.partitionBy("block").orderBy("id")))
    gap = F.when(F.col("id") - F.col("after_id") > 1, F.struct("after_id", F.col("id").alias("next_id")))
    blocks = written(walked.groupBy("block").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.collect_list(gap).alias("gaps")))
    bounds = blocks.select("block", "lo", "hi")
    between = running(bounds, "hi", "previous", F.max).filter(F.col("lo") - F.col("previous") > 1).select(
        F.col("previous").alias("after_id"), F.col("lo").alias("next_id"))
    within = blocks.select(F.inline("gaps"))
    return between.unionByName(within).withColumn("missing", F.col("next_id") - F.col("after_id") - 1)


def order_violations(df: DataFrame, id: str, time: str, slack: int = 0) -> DataFrame:
    """Ids used more than once, and ids whose oldest time lags an earlier id's time by more than `slack` seconds.

    Copies of one id are folded before the shuffle, so a badly repeated id is one row.
    """
    df = df.filter(F.col(id).isNotNull())
    per_id = df.groupBy(id).agg(F.count("*").alias("copies"), F.min(time).alias("oldest"), F.max(time).alias("newest"))
    per_id = per_id.withColumn("block", block_of(id))
    blocks = written(df.groupBy(block_of(id)).agg(F.max(time).alias("newest")))
    carried = running(blocks, "newest", "before", F.max).select("block", "before")
    inner = Window.partitionBy("block").orderBy(id).rowsBetween(Window.unboundedPreceding, -1)
    checked = (per_id.withColumn("within", F.max("newest").over(inner)).join(carried, "block")
               .withColumn("lag", F.greatest("within", "before") - F.col("oldest")))
    return (checked.select(id, "copies", F.when(F.col("lag") > slack, F.col("lag")).alias("lag"))
            .filter((F.col("copies") > 1) | F.col("lag").isNotNull()))
