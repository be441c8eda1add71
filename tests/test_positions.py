from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Row, functions as F

from logtide.operators.diff import diff_full, diff_pruned, diff_sample
from logtide.operators.digest import table_digest
from logtide.operators.positions import assign_ids, id_gaps, ids_at, order_violations, page_bounds, with_position
from logtide.operators.sample import in_ranges, prepared, sample_plan, sample_ranges
from logtide.operators.stats import duplicate_keys, duplicate_report, high_water, stats_verdict, table_stats
from logtide.sources.scan import scan_ranges

IDS = sorted({-2**62, -5, -1, 0, 7, *range(1000, 9000, 3), *range(100_000, 101_000), 5_000_000_000, 2**62})


@pytest.fixture(scope="module")
def sparse(spark):
    return spark.createDataFrame([(i, f"row {i}") for i in IDS], "rowid bigint, text string").repartition(5).persist()


def test_positions(sparse):
    got = with_position(sparse, "rowid").collect()
    assert sorted((r["position"], r["rowid"]) for r in got) == list(enumerate(IDS))
    assert all(r["text"] == f"row {r['rowid']}" for r in got)


def test_ids_at_positions(spark, sparse):
    asked = [0, 1, 5, 2000, len(IDS) - 1, len(IDS), 10**9]
    got = ids_at(sparse, "rowid", spark.createDataFrame([(p,) for p in asked], "position bigint")).collect()
    assert sorted((r["position"], r["rowid"]) for r in got) == [(p, IDS[p]) for p in asked if p < len(IDS)]


def test_assigned_ids_follow_the_mark(sparse):
    got = assign_ids(sparse.withColumnRenamed("rowid", "seq"), "seq", 500).collect()
    assert sorted(r["rowid"] for r in got) == list(range(501, 501 + len(IDS)))


@pytest.mark.parametrize("size", [100, 5000])
def test_page_bounds(spark, size):
    ids = [i * 3 for i in range(12_345)]
    df = spark.range(12_345).select((F.col("id") * 3).alias("rowid"))
    pages = [ids[i:i + size] for i in range(0, len(ids), size)]
    got = sorted(tuple(r[c] for c in ("page", "from_id", "to_id", "rows")) for r in page_bounds(df, "rowid", size).collect())
    assert got == [(n, p[0], p[-1], len(p)) for n, p in enumerate(pages)]


def test_id_gaps(sparse):
    want = [(a, b, b - a - 1) for a, b in zip(IDS, IDS[1:]) if b - a > 1 and b - a < 2**62]
    got = sorted(tuple(r) for r in id_gaps(sparse.filter(F.col("rowid").between(-10, 2**61)), "rowid").collect())
    assert got == [w for w in want if w[0] >= -10 and w[1] <= 2**61]


def test_order_violations(spark):
    rows = [(i, 1000 + i) for i in range(20_000)] + [(500, 1500), (500, 1500), (15_000, 3)]
    rows[9_999] = (9_999, 50)
    got = {r[0]: (r["copies"], r["lag"]) for r in order_violations(spark.createDataFrame(rows, "rowid bigint, time bigint"), "rowid", "time", 100).collect()}
    assert got == {500: (3, None), 9_999: (1, 10_998 - 50), 15_000: (2, 15_999 - 3)}


@pytest.mark.parametrize("rows", [1, 99, 100_001, 1_000_000, 2_500_000])
def test_plan_covers_one_percent_of_each_million(spark, rows):
    plan = sorted(tuple(r) for r in sample_plan(spark, rows, 3).collect())
    spans = [(s, e) for _, _, s, e in plan]
    assert rows / 100 <= sum(e - s + 1 for s, e in spans) <= rows / 100 + 1_000
    assert all(0 <= s <= e < rows for s, e in spans)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    for window in range((rows + 999_999) // 1_000_000):
        start, end = window * 1_000_000, min(rows, (window + 1) * 1_000_000)
        assert sum(e - s + 1 for s, e in spans if s >= start and e < end) >= (end - start) / 100


def test_plan_depends_on_the_seed_only(spark):
    def starts(seed):
        return [r["start"] for r in sample_plan(spark, 500_000, seed).orderBy("start").collect()]
    assert starts(1) == starts(1) and starts(1) != starts(2)


def test_ranges_match_positions_and_are_cut_short(spark):
    df = spark.range(300_000).select((F.col("id") * 7 + F.when(F.col("id") > 150_000, 10_000_000).otherwise(0)).alias("rowid"))
    ids = [r[0] for r in df.orderBy("rowid").collect()]
    plan = sample_plan(spark, 300_000, 11)
    planned = {(r["window"], r["slot"]): (r["start"], r["end"]) for r in plan.collect()}
    got = {(r["window"], r["slot"]): (r["lo"], r["hi"], r["rows"]) for r in sample_ranges(df, "rowid", plan).collect()}
    assert got == {k: (ids[s], ids[e], e - s + 1) for k, (s, e) in planned.items()} and len(got) == 3
    first = min(planned.values())
    short = df.filter(F.col("rowid") <= ids[first[0] + 9])
    assert [(r["lo"], r["hi"], r["rows"]) for r in sample_ranges(short, "rowid", plan).collect()] == [(ids[first[0]], ids[first[0] + 9], 10)]


@pytest.mark.parametrize("small", [True, False])
def test_many_ranges_in_one_scan(spark, sparse, small):
    ranges = [(-2**62, -3), (-1, -1), (1001, 1003), (1004, 1500), (4095, 4097), (8000, 100_500), (100_502, 2**62 - 1)]
    df = spark.createDataFrame(ranges, "lo bigint, hi bigint")
    ready = prepared(df)
    assert ready.small
    got = {r["rowid"]: r["range_lo"] for r in in_ranges(sparse, "rowid", replace(ready, small=small)).collect()}
    assert got == {i: lo for i in IDS for lo, hi in ranges if lo <= i <= hi}
    assert sorted(r["rowid"] for r in scan_ranges(sparse, "rowid", ranges).collect()) == sorted(got)


def test_no_ranges_no_rows(spark, sparse):
    assert in_ranges(sparse, "rowid", spark.createDataFrame([], "lo bigint, hi bigint")).isEmpty()


@pytest.mark.parametrize("limit", [1, 10**9])
def test_running_totals_by_parent_block(spark, monkeypatch, limit):
    from logtide.operators import positions
    monkeypatch.setattr(positions, "FLAT_BLOCKS", limit)
    keys = sorted({0, 1, 2, 5_000_000, -7, -2**50, 2**50, 2**50 + 1, 2**30, 2**30 + 9, *range(10_000, 10_050)})
    blocks = spark.createDataFrame([(k, n + 1) for n, k in enumerate(keys)], "block bigint, n bigint")
    sums = {r["block"]: r["x"] for r in positions.running(blocks, "n", "x", F.sum).collect()}
    tops = {r["block"]: r["x"] for r in positions.running(blocks, "n", "x", F.max).collect()}
    assert sums == {k: n * (n + 1) // 2 for n, k in enumerate(keys)}
    assert tops == {k: n or None for n, k in enumerate(keys)}


def damaged(spark, rows=20_000):
    left = spark.range(rows).select(F.col("id").alias("rowid"), (F.col("id") * 2).alias("x"), F.concat(F.lit("t"), "id").alias("t"))
    right = (left.filter(~F.col("rowid").isin(3, 9_000))
             .withColumn("x", F.when(F.col("rowid") == 77, -1).otherwise(F.col("x")).cast("double"))
             .withColumn("t", F.when(F.col("rowid").isin(77, 15_000), "changed").otherwise(F.col("t")))
             .unionByName(spark.createDataFrame([(rows + 5, 1.0, "new")], "rowid bigint, x double, t string")))
    return left, right.select("T", "X", "ROWID")


WANT = [(3, "missing", None), (77, "differs", "t"), (77, "differs", "x"), (9_000, "missing", None), (15_000, "differs", "t"), (20_005, "extra", None)]


@pytest.mark.parametrize("diff", [diff_full, diff_pruned])
def test_diff_reports_exactly_the_damage(spark, diff):
    left, right = damaged(spark)
    got = sorted(((r["id"], r["kind"], r["column"]) for r in diff(left, right, "rowid").collect()), key=str)
    assert got == sorted(WANT, key=str)
    assert diff(left, left.select("t", "x", "rowid"), "rowid").isEmpty()


def test_sampled_diff_sees_its_ranges_only(spark):
    left, right = damaged(spark)
    ranges = spark.createDataFrame([(0, 99, 100), (8_990, 9_010, 21), (19_000, 20_010, 1_000), (500, 520, 99)], "lo bigint, hi bigint, rows bigint")
    got = sorted(((r["id"], r["kind"], r["column"]) for r in diff_sample(left, right, "rowid", ranges).collect()), key=str)
    assert got == sorted([w for w in WANT if w[0] != 15_000] + [(500, "moved", None)], key=str)


def test_digest_sees_every_change(spark):
    left, right = damaged(spark)
    digest = [table_digest(df, "rowid", "x").first() for df in (
        left, left.repartition(7), left.filter("rowid <> 3"), left.withColumn("t", F.when(F.col("rowid") == 5, "").otherwise(F.col("t"))),
        left.select("rowid", F.when(F.col("rowid") < 2, 2 - F.col("x")).otherwise(F.col("x")).alias("x"), "t"), left.limit(0))]
    assert digest[0] == digest[1] and digest[0]["rows"] == 20_000
    assert len({d["digest"] for d in digest}) == 5
    assert (digest[5]["rows"], digest[5]["min_id"], digest[5]["max_id"]) == (0, 0, 0)


def test_stats_and_verdicts(spark):
    some, none = spark.range(5, 10), spark.range(0)
    stats = table_stats({"a": (some, "id"), "b": (none, "id")})
    assert sorted(tuple(r) for r in stats.collect()) == [("a", 5, 5, 9), ("b", 0, 0, 0)]
    allocated = spark.createDataFrame([("a", 100)], "table string, allocated bigint")
    marks = high_water(stats, allocated)
    assert {r[0]: r[1] for r in marks.collect()} == {"a": 100, "b": 0}
    target = table_stats({"a": (some, "id"), "b": (none, "id"), "c": (some, "id"), "d": (none, "id")})
    behind = spark.createDataFrame([("a", 99)], "table string, high_water bigint")
    got = {r["table"]: r["verdict"] for r in stats_verdict(stats, stats, target, [], marks, behind).collect()}
    assert got == {"a": "mark behind", "b": "ok", "c": "unexpected rows", "d": "ok"}


def test_duplicates_of_a_hot_key(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") / 2).cast("int"))).alias("k"))
    df = df.withColumn("k", F.when(F.col("id") != 1, F.col("k")))
    got = {r["value"]: r for r in duplicate_keys(df, "k", "id").collect()}
    assert got["hot"] == Row(value="hot", copies=1000, first_ids="0, 3, 6, 9, 12")
    report = duplicate_report(duplicate_keys(df, "k", "id")).first()
    assert report["shared"] == "more than 100" and report["example"] == "hot in rows 0, 3, 6, 9, 12"
    assert duplicate_report(duplicate_keys(spark.range(3), "id", "id")).first() == Row(shared="0", example=None)


@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 400)), min_size=1, max_size=12), st.sampled_from([1, 37, 10**9, -10**12]))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_ranges(spark, steps, scale):
    """Disjoint ranges with gaps and lengths of any kind, against a plain loop."""
    ranges, at = [], -5
    for gap, length in steps:
        lo, hi = sorted(((at + 1 + gap) * scale, (at + 1 + gap + length) * scale))
        ranges.append((lo, hi))
        at += 1 + gap + length
    ids = sorted({e + d for lo, hi in ranges for e in (lo, hi, (lo + hi) // 2) for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(i,) for i in ids], "rowid bigint")
    got = sorted((r["rowid"], r["range_lo"]) for r in in_ranges(rows, "rowid", spark.createDataFrame(sorted(ranges), "lo bigint, hi bigint")).collect())
    assert got == [(i, lo) for i in ids for lo, hi in sorted(ranges) if lo <= i <= hi]
