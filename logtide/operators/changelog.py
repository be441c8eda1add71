"""The current rows of a change log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def latest_state(df: DataFrame, key: str, seq: str, shown_with: str | None = None) -> DataFrame:
    """One row per key: each column's last value that was set. Keys never given `shown_with` are hidden.

    A later row that leaves a column unset does not count for it; `seq` tells a key's rows apart. First only the winning sequence
    number of each column is found, by a hash aggregate of numbers that combines in every map task. Then the rows that win a column are
    joined by key and number, so a hot key is spread, and a key brings together as many rows as it has columns, at most.
    """
    columns = [c for c in df.columns if c not in (key, seq)]
    won = df.groupBy(F.col(f"`{key}`").alias("key")).agg(*[F.max(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{seq}`"))).alias(f"w{i}") for i, c in enumerate(columns)])
    if shown_with is not None:
        won = won.filter(F.col(f"w{columns.index(shown_with)}").isNotNull())
    wins = won.select("key", F.explode(F.array_compact(F.array_distinct(F.array(*[f"w{i}" for i in range(len(columns))])))).alias("seq"))
    rows = df.select(F.col(f"`{key}`").alias("k"), F.struct(F.col(f"`{seq}`").alias("seq"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"))
    found = (rows.join(wins, F.col("k").eqNullSafe(F.col("key")) & (F.col("row.seq") == F.col("seq")), "left_semi")
             .groupBy("k").agg(F.collect_list("row").alias("rows")))

    def last(i: int):
        """Of the rows with the column set the one with the highest number."""
        given = F.filter("rows", lambda r: r[f"c{i}"].isNotNull())
        highest = F.array_max(F.transform(given, lambda r: r["seq"]))
        return F.get(F.transform(F.filter(given, lambda r: r["seq"] == highest), lambda r: r[f"c{i}"]), F.lit(0))

    latest = found.select(F.col("k").alias(key), *[last(i).alias(c) for i, c in enumerate(columns)])
    if shown_with is not None:
        return latest
    nothing = reduce(lambda a, b: a & b, [F.col(f"w{i}").isNull() for i in range(len(columns))], F.lit(True))
    types = dict(latest.dtypes)
    return latest.unionByName(won.filter(nothing).select(F.col("key").alias(key), *[F.lit(None).cast(types[c]).alias(c) for c in columns]))
