"""Row comparison of two tables by id: every row, only what a hash tree finds unequal, or a sample.

A comparison descends a tree of hashes over ids: block, sub-block, row. What is equal at a level is left behind there, and only
hashes are shuffled; values are fetched at the end, for ids that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions.values import comparable, describe, same
from logtide.operators.digest import block_digests
from logtide.operators.sample import in_ranges, literal_ranges, prepared
from logtide.session import written

#: Ids per block at each level above the rows, as powers of two.
TREE_BITS = (12, 6)
#: Unequal blocks or ids up to this count (16 bytes each) are broadcast to the rows; more are joined by shuffle.
BROADCAST_UNEQUAL = 1_000_000
#: The most rows that one row of a result may stand for before they are listed.
LISTED = 1_000
#: The most sampled ranges that a predicate spells out, so that the scan skips what lies between.
SPELLED_RANGES = 500


def shared_columns(left: DataFrame, right: DataFrame, id: str) -> list[tuple[str, str]]:
    """Columns both sides have, matched without regard to case, as (left, right) names."""
    there = {name.lower(): name for name in right.columns}
    return [(name, there[name.lower()]) for name in left.columns
            if name.lower() in there and name.lower() != id.lower()]


def _sides(left: DataFrame, right: DataFrame, id: str):
    pairs = shared_columns(left, right, id)
    right_id = next(name for name in right.columns if name.lower() == id.lower())
    l_types = {f.name: f.dataType for f in left.schema.fields}
    r_types = {f.name: f.dataType for f in right.schema.fields}
    source = left.select(F.col(id).cast("bigint").alias("id"), *[F.col(f"`{a}`").alias(f"s{i}")
                                                                 for i, (a, _) in enumerate(pairs)])
    target = right.select(F.col(right_id).cast("bigint").alias("id"), *[F.col(f"`{b}`").alias(f"t{i}")
                                                                        for i, (_, b) in enumerate(pairs)])
    typed = [(a, l_types[a], r_types[b]) for a, b in pairs]
    return source, target, typed


def _line(typed: list, prefix: str, which: int) -> Column:
    """A row's id and compared columns in their comparable forms."""
    return F.concat_ws("|", F.col("id").cast("string"), *[comparable(F.col(f"{prefix}{i}"), t[which]) for i, t in enumerate(typed)])


def _finding(kind: str, column, a: Column, b: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(column).cast("string").alias("column"), a.alias("source"), b.alias("target"))


def _alone(kind: str) -> Column:
    return _finding(kind, None, F.lit(None).cast("string"), F.lit(None).cast("string"))


def _without_id(source: DataFrame, target: DataFrame) -> DataFrame:
    """A finding for each row without an id: it has no counterpart."""
    found = [side.filter("id IS NULL").select("id", _alone(kind).alias("f")) for side, kind in ((source, "missing"), (target, "extra"))]
    return found[0].unionByName(found[1]).select("id", "f.*")


def _compare(source: DataFrame, target: DataFrame, typed: list) -> DataFrame:
    """Equal rows of one id are counted on both sides, and as many as both have drop out; an id's other rows are findings.

    The first shuffle is by id and content, the second by id with the contents of what is left: rows of a hot id are spread, then summed.
    """
    def side(df: DataFrame, prefix: str, which: int) -> DataFrame:
        values = F.struct(F.lit(True).alias("present"), *[F.col(f"{prefix}{i}") for i in range(len(typed))])
        return df.filter("id IS NOT NULL").select("id", F.unhex(F.sha2(_line(typed, prefix, which), 256)).alias("row"),
                                                  F.lit(1 if which == 1 else 0).cast("bigint").alias("s"), F.lit(1 if which == 2 else 0).cast("bigint").alias("t"),
                                                  values.alias(f"{prefix}_values"))

    both_sides = side(source, "s", 1).unionByName(side(target, "t", 2), allowMissingColumns=True)
    counted = both_sides.groupBy("id", "row").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.any_value("s_values", F.lit(True)).alias("s_values"),
                                                  F.any_value("t_values", F.lit(True)).alias("t_values"))
    s, t = F.col("s"), F.col("t")

    def left(n: Column, other: Column, prefix: str) -> list[Column]:
        return [F.sum(n).alias(f"{prefix}_rows"), F.sum(F.greatest(n - other, F.lit(0))).alias(f"{prefix}_left"),
                F.sum(F.when(other == 0, n).otherwise(0)).alias(f"{prefix}_only"), F.count_if(n > other).alias(f"{prefix}_groups"),
                F.any_value(F.when(n > other, F.col(f"{prefix}_values")), F.lit(True)).alias(f"{prefix}_values")]

    ids = counted.groupBy("id").agg(*left(s, t, "s"), *left(t, s, "t")).filter("s_groups + t_groups > 0")
    single = (F.col("s_groups") == 1) & (F.col("t_groups") == 1)
    copies = (F.col("s_groups") == 0) | (F.col("t_groups") == 0)  # a row that both sides have is repeated, not missing or extra
    repeated = (F.col("s_rows") > 0) & (F.col("t_rows") > 0) & (F.col("s_rows") != F.col("t_rows"))
    found = [F.when(repeated, _finding("repeated", None, F.col("s_rows").cast("string"), F.col("t_rows").cast("string")))]
    for i, (name, a_type, b_type) in enumerate(typed):
        a, b = F.col(f"s_values.s{i}"), F.col(f"t_values.t{i}")
        found.append(F.when(single & ~same(a, b, a_type, b_type), _finding("differs", name, describe(a, a_type), describe(b, b_type))))

    def rows(kind: str, prefix: str) -> Column:
        n = F.when(single, 0).when(copies, F.col(f"{prefix}_only")).otherwise(F.col(f"{prefix}_left"))
        return n.cast("bigint")

    named = ids.select("id", F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")).select("id", "f.*")
    return named.unionByName(_listed(ids, "missing", rows("missing", "s"))).unionByName(_listed(ids, "extra", rows("extra", "t")))


def _listed(ids: DataFrame, kind: str, n: Column) -> DataFrame:
    """A finding for each of an id's `n` rows: in two steps, so that no row holds more than a list of its hundreds or thousands."""
    some = ids.select("id", n.alias("n")).filter("n > 0")
    parts = some.select("id", F.explode(F.expr(f"transform(sequence(0L, (n - 1) div {LISTED}), k -> least({LISTED}L, n - k * {LISTED}))")).alias("part"))
    return parts.select("id", F.explode(F.expr("sequence(1L, part)")).alias("k")).select("id", _alone(kind).alias("f")).select("id", "f.*")


def _hash(typed: list, prefix: str, which: int) -> Column:
    """128 bits of a row's content."""
    return F.substring(F.unhex(F.sha2(_line(typed, prefix, which), 256)), 1, 16)


def _few(unequal: DataFrame) -> tuple[DataFrame, int]:
    """Unequal blocks or ids, written down, and how many; few are broadcast, so that the rows they are joined to stay where they are."""
    unequal = written(unequal)
    n = unequal.count()
    return F.broadcast(unequal) if n <= BROADCAST_UNEQUAL else unequal, n


def _within(df: DataFrame, place: Column, unequal: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, place).join(unequal, name, "left_semi").drop(name)


def _unequal_ids(source: DataFrame, target: DataFrame, typed: list, levels: tuple[int, ...]) -> tuple[DataFrame | None, int]:
    """The ids whose bags of rows differ, by descent: the blocks of each level that differ, then the ids in those of the last. None once nothing differs.

    Up to the last level a block is one sum of hashes, combined before the shuffle. Of the rows below, id and hash are shuffled.
    """
    sides = [side.filter("id IS NOT NULL") for side in (source, target)]
    above: list[tuple[int, DataFrame]] = []

    def rows(k: int) -> DataFrame:
        df = sides[k]
        for bits, unequal in above[-1:]:
            df = _within(df, F.shiftright("id", bits), unequal, "block")
        return df

    for bits in levels:
        sums = [block_digests(rows(k), "id", _line(typed, prefix, k + 1), bits).select("block", F.col("hash").alias(f"{prefix}_hash")) for k, prefix in enumerate("st")]
        unequal = sums[0].join(sums[1], "block", "full_outer").filter(~F.col("s_hash").eqNullSafe(F.col("t_hash"))).select("block")
        unequal, n = _few(unequal)
        if not n:
            return None, 0
        above.append((bits, unequal))
    both = None
    for k, prefix in enumerate("st"):
        one = rows(k).select("id", _hash(typed, prefix, k + 1).alias("row"), F.lit(1 - 2 * k).alias("n"))
        both = one if both is None else both.unionByName(one)
    left = both.groupBy("id", "row").agg(F.sum("n").alias("n")).filter("n <> 0")
    return _few(left.select(F.col("id").alias("at")).distinct())


def _descend(left: DataFrame, right: DataFrame, id: str, levels: tuple[int, ...]) -> DataFrame:
    source, target, typed = _sides(left, right, id)
    ids, n = _unequal_ids(source, target, typed, levels)
    if not n:
        return _without_id(source, target)
    late = [_within(side.filter("id IS NOT NULL"), F.col("id"), ids, "at") for side in (source, target)]
    return _compare(*late, typed).unionByName(_without_id(source, target))


def diff_full(left: DataFrame, right: DataFrame, id: str) -> DataFrame:
    """Every difference between a source and its copy: missing and extra rows, each differing column, and ids that
    the sides have different numbers of (`repeated`, with the two numbers).

    Rows of a repeated id are compared as a bag: what is left of equal rows is named by column where it is one row on each side, else each
    row is missing or extra. So is each row without an id. Hashes of all rows are shuffled once, when called; values are read
    again for ids that differ.
    """
    return _descend(left, right, id, ())


def diff_pruned(left: DataFrame, right: DataFrame, id: str) -> DataFrame:
    """The same differences by descent from blocks: for a copy that is almost right, next to nothing is shuffled.

    Reads both sides once a level that still differs, when called.
    """
    return _descend(left, right, id, TREE_BITS)


def diff_sample(left: DataFrame, right: DataFrame, id: str, ranges: DataFrame) -> DataFrame:
    """The differences inside the sampled id `ranges` (lo, hi, rows), read in one pass per side.

    A range whose source rows no longer number `rows` is reported as `moved`, with the two counts.
    """
    source, target, typed = _sides(left, right, id)
    some = ranges.select("lo", "hi").limit(SPELLED_RANGES + 1).collect()
    if len(some) <= SPELLED_RANGES:  # they reach the scan, which skips pages and row groups between them
        spelled = literal_ranges("id", [tuple(r) for r in some])
        source, target = source.filter(spelled), target.filter(spelled)
    bounds = prepared(ranges)
    sampled = in_ranges(source, "id", bounds)
    differences = _compare(sampled.drop("range_lo"), in_ranges(target, "id", bounds).drop("range_lo"), typed)
    now = sampled.groupBy(F.col("range_lo").alias("lo")).agg(F.count("*").alias("now"))
    moved = (ranges.select("lo", "rows").join(now, "lo", "left")
             .filter(F.coalesce("now", F.lit(0)) != F.col("rows"))
             .select(F.col("lo").alias("id"), F.lit("moved").alias("kind"), F.lit(None).cast("string").alias("column"),
                     F.col("rows").cast("string").alias("source"),
                     F.coalesce("now", F.lit(0)).cast("string").alias("target")))
    return differences.unionByName(moved)
