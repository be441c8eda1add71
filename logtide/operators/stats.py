"""Table statistics, their comparison, and small profile counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from logtide.functions.values import row_size
from logtide.session import fits, written


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_stats(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count, lowest and highest id of each table, zeros when empty. `tables`: name -> (rows, id column)."""
    # One combined aggregate over all tables; a row without an id stands for a table that may be empty
    spark = next(iter(tables.values()))[0].sparkSession
    ids = [df.select(F.lit(name).alias("table"), F.lit(1).alias("one"), F.col(id).cast("bigint").alias("id"))
           for name, (df, id) in tables.items()]
    names = spark.range(1).select(F.explode(F.array(*[F.lit(name) for name in tables])).alias("table"),
                                  F.lit(0).alias("one"), F.lit(None).cast("bigint").alias("id"))
    return union_all([*ids, names]).groupBy("table").agg(
        F.sum("one").alias("rows"), F.coalesce(F.min("id"), F.lit(0)).alias("min_id"),
        F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))


def high_water(stats: DataFrame, allocated: DataFrame | None = None) -> DataFrame:
    """The highest id ever handed out per table: what the allocator says, or the highest in use."""
    if allocated is None:
        return stats.select("table", F.col("max_id").alias("high_water"))
    return stats.join(allocated.select("table", "allocated"), "table", "left").select(
        "table", F.greatest(F.coalesce("allocated", F.lit(0)), "max_id").alias("high_water"))


def stats_verdict(before: DataFrame, now: DataFrame, target: DataFrame, ignored: list[str] = (),
                  marks: DataFrame | None = None, target_marks: DataFrame | None = None) -> DataFrame:
    """One verdict per table: ok, source changed, target differs, mark behind, missing, or unexpected rows."""
    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("table", F.struct("rows", "min_id", "max_id").alias(prefix))

    joined = (named(before, "before").join(named(now, "now"), "table", "full_outer")
              .join(named(target, "target"), "table", "full_outer")
              .filter(~F.col("table").isin(list(ignored)) if ignored else F.lit(True)))
    behind = F.lit(False)
    if marks is not None and target_marks is not None:
        joined = (joined.join(marks.select("table", F.col("high_water").alias("mark")), "table", "left")
                  .join(target_marks.select("table", F.col("high_water").alias("target_mark")), "table", "left"))
        behind = F.col("target_mark").isNotNull() & (F.col("target_mark") < F.col("mark"))
    verdict = (F.when(F.col("before").isNull() & (F.coalesce(F.col("target.rows"), F.lit(0)) > 0), "unexpected rows")
               .when(F.col("before").isNull(), "ok")
               .when(~F.col("before").eqNullSafe(F.col("now")), "source changed")
               .when(F.col("target").isNull(), "missing")
               .when(~F.col("now").eqNullSafe(F.col("target")), "target differs")
               .when(behind, "mark behind")
               .otherwise("ok"))
    return joined.select("table", verdict.alias("verdict"),
                         F.coalesce("now.rows", F.lit(0)).alias("source_rows"),
                         F.coalesce("target.rows", F.lit(0)).alias("target_rows"))


def row_size_stats(df: DataFrame, table: str) -> DataFrame:
    """Rows, estimated bytes in memory, and the widest row of a table."""
    return df.select(row_size(df).alias("size")).agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("widest")).select(
        F.lit(table).alias("table"), "rows", "bytes", "widest")


def coverage_counts(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Values that are not null, per column. One aggregate, then one row per column."""
    counted = df.agg(*[F.count(F.col(c)).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(f"{table}.{c}").alias("column"), F.col(c).alias("present")) for c in columns])
    return counted.select(F.inline(pairs))


#: Stripes of a value's rows, by a hash of the id, each of which keeps its least id; values up to this count are broadcast.
STRIPES, BROADCAST_VALUES = 16, 200_000


def duplicate_keys(df: DataFrame, key: str, id: str, examples: int = 5) -> DataFrame:
    """Non-null values shared by several rows, how many, and their smallest ids.

    A value keeps its count and least id for each of a few stripes of its rows: two aggregates that combine before their
    shuffle, so a value that half of the rows have sends a few rows a task. The `examples`-th of these ids is a bound: no id above
    it is among the least. Most values are told by that. Of the others, rows up to the bound are looked at again, in every
    task by itself, and each task sends on `examples` rows of a value at most.
    """
    stripe = F.pmod(F.xxhash64("id"), F.lit(STRIPES)).alias("stripe")
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("value"), F.col(id).cast("bigint").alias("id")).select("*", stripe)
    least = rows.groupBy("value", "stripe").agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.min("id").alias("id"))
    minima = F.filter(F.array_sort(F.collect_list(F.struct("id", "ids"))), lambda m: m["id"].isNotNull())
    shared = least.groupBy("value").agg(F.sum("n").alias("copies"), minima.alias("minima")).filter(F.col("copies") > 1)
    bound = F.when(F.size("minima") >= examples, F.element_at("minima", examples)["id"])
    hides = F.exists("minima", lambda m: (m["ids"] > 1) & (F.col("bound").isNull() | (m["id"] < F.col("bound"))))
    shared = written(shared.withColumn("bound", bound).withColumn("unsure", hides))
    sure = shared.filter(~F.col("unsure")).select("value", "copies", F.slice(F.transform("minima", lambda m: m["id"]), 1, examples).alias("ids"))

    unsure = shared.filter("unsure").select("value", "copies", "bound")
    if fits(unsure, BROADCAST_VALUES):
        near = rows.join(F.broadcast(unsure), "value")
    else:
        near = rows.join(unsure.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(STRIPES - 1)).cast("array<bigint>"))), ["value", "stripe"])
    near = near.filter(F.col("id").isNotNull() & (F.col("bound").isNull() | (F.col("id") <= F.col("bound"))))
    first = (near.withColumn("at", F.row_number().over(Window.partitionBy("value").orderBy("id"))).filter(F.col("at") <= examples)
             .groupBy("value").agg(F.first("copies").alias("copies"), F.array_sort(F.collect_list("id")).alias("ids")))
    return sure.unionByName(first).select(
        F.col("value").cast("string").alias("value"), "copies",
        F.array_join(F.transform("ids", lambda i: i.cast("string")), ", ").alias("first_ids"))


def duplicate_report(duplicates: DataFrame, counted: int = 100) -> DataFrame:
    """How many values are shared (up to `counted`, then "more than") and one example."""
    head = duplicates.orderBy("value").limit(counted + 1)
    summary = head.agg(F.count("*").alias("n"), F.min_by(
        F.concat("value", F.lit(" in rows "), "first_ids"), "value").alias("example"))
    return summary.select(
        F.when(F.col("n") > counted, f"more than {counted}").otherwise(F.format_number("n", 0)).alias("shared"),
        "example")


def hidden_rows(df: DataFrame, shown_with: str, user: str, family: Column | None = None) -> DataFrame:
    """Rows a reader leaves out for want of `shown_with` although a user made them."""
    lost = F.col(shown_with).isNull() & F.col(user).isNotNull()
    return df.agg(F.count_if(lost if family is None else lost & family).alias("hidden"))


def family_counts(df: DataFrame, family: str, data_family: str | None = None, excluded: list[str] = ()) -> DataFrame:
    """Rows per family; rows of a lookup index count under the family they index, labelled as an index."""
    data = F.coalesce(F.col(data_family), F.lit("")) if data_family else F.col(family)
    counted = (df.select(F.col(family).alias("family"), data.alias("data_family"))
               .filter(~F.col("data_family").isin(list(excluded)) if excluded else F.lit(True))
               .groupBy("family", "data_family").agg(F.count("*").alias("rows")))
    label = (F.when(F.col("family") == F.col("data_family"), F.col("family"))
             .when(F.col("data_family") == "", "lookup index")
             .otherwise(F.concat("data_family", F.lit(" lookup index"))))
    return counted.select("family", "data_family", label.alias("label"), "rows")


def occupancy_report(tables: dict[str, DataFrame], ignored: list[str] = ("database_lock",)) -> DataFrame:
    """Which tables of a target hold rows. Each probe stops at its first row."""
    probes = [df.limit(1).select(F.lit(name).alias("table")) for name, df in tables.items() if name not in ignored]
    return union_all(probes)


def identifier_conflicts(map_rows: DataFrame, assigned: DataFrame, name: str, id: str = "rowid",
                         identifier: str = "id") -> DataFrame:
    """Ids of copied map rows above every copied identifier that the allocator already gave to another value."""
    highest = map_rows.agg(F.coalesce(F.max(identifier), F.lit(0))).scalar()
    free = map_rows.filter(F.col(id) > highest).select(F.col(id).cast("bigint").alias("id"))
    taken = assigned.select(F.col("id").cast("bigint").alias("id")).distinct()
    return free.join(taken, "id", "left_semi").select(F.lit(name).alias("map"), "id")
