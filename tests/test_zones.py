"""Reads by zone map: the same rows as a whole scan, and fewer bytes where ids are in order."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from logtide.operators.diff import diff_full, diff_sample
from logtide.operators.sample import in_any_range, in_ranges, literal_ranges, prepared, sample_plan, sample_ranges
from logtide.session import written
from logtide.sources import zones
from logtide.sources.zones import Span, diff_sample_stored, files_of, read_ranges, read_spans, spans_of, write_zoned, write_zones

ROWS = 60_000


def rows(spark):
    """Ids with gaps, and values that do not compress."""
    return spark.range(ROWS).select((F.col("id") * 3 + F.col("id") % 2).alias("rowid"), F.sha2(F.col("id").cast("string"), 512).alias("note"), (F.col("id") % 97).alias("n"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("zones")
    paths = {name: f"{root}/a b%20c é/{name}" for name in ("ordered", "shuffled", "bare", "copy")}
    write_zoned(rows(spark), paths["ordered"], "rowid", 8, 256 << 10)
    rows(spark).repartition(8, "n").write.parquet(paths["shuffled"])
    write_zones(spark, paths["shuffled"], "rowid")
    rows(spark).repartition(4).write.parquet(paths["bare"])
    damaged = rows(spark).withColumn("note", F.when(F.col("rowid") % 1000 < 3, "x").otherwise(F.col("note"))).filter("rowid % 5003 > 1")
    write_zoned(damaged, paths["copy"], "rowid", 8, 256 << 10)
    return paths


def rows_read(spark, action) -> int:
    """Rows that scans decoded: those of skipped files, row groups and pages are not among them."""
    def total():
        nothing = spark._jvm.java.util.ArrayList()
        stages = spark._jsc.sc().statusStore().stageList(nothing, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), nothing)
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))
    before = total()
    action()
    return total() - before


@pytest.mark.parametrize("name", ["ordered", "shuffled", "bare"])
def test_same_rows(spark, stored, name):
    rng = random.Random(4)
    starts = sorted(rng.sample(range(0, 3 * ROWS, 50), 60))
    pairs = [(s, s + rng.choice((0, 1, 30, 49))) for s in starts] + [(10**9, 10**9 + 5), (-50, -3)]
    ranges = spark.createDataFrame(pairs, "lo bigint, hi bigint")
    want = sorted(r.rowid for r in rows(spark).collect() if any(lo <= r.rowid <= hi for lo, hi in pairs))
    got = read_ranges(spark, stored[name], "rowid", ranges, ["n"])
    assert got.columns == ["rowid", "n"] and sorted(r.rowid for r in got.collect()) == want
    assert read_ranges(spark, stored[name], "rowid", ranges.limit(0)).collect() == []


def test_many_ranges_become_spans(spark, stored, monkeypatch):
    pairs = [(k, k + 1) for k in range(0, 100_000, 40)]
    ranges = spark.createDataFrame(pairs, "lo bigint, hi bigint")
    spans = spans_of(ranges, 100)
    assert len(spans) <= 100 and all(a.hi < b.lo for a, b in zip(spans, spans[1:]))
    assert all(any(s.lo <= lo and hi <= s.hi for s in spans) for lo, hi in pairs[::37])
    monkeypatch.setattr(zones, "SPELLED", 7)
    monkeypatch.setattr(zones, "spans_of", lambda ranges: spans_of(ranges, 100))
    want = {r.rowid for r in rows(spark).collect() if r.rowid < 100_000 and r.rowid % 40 <= 1}
    assert {r.rowid for r in read_ranges(spark, stored["ordered"], "rowid", ranges).collect()} == want
    wide = spark.createDataFrame([(0, 5), (10, 3 * ROWS), (2**62, 2**62 + 1), (7, 3)], "lo bigint, hi bigint")
    assert spans_of(wide, 2) == [Span(0, 3 * ROWS), Span(2**62, 2**62 + 1)] and spans_of(wide) == [Span(0, 5), Span(10, 3 * ROWS), Span(2**62, 2**62 + 1)]


def test_files_by_zone(spark, stored):
    ordered = files_of(spark, stored["ordered"], [[Span(0, 10), Span(100, 200)], [Span(3 * ROWS - 30, 3 * ROWS)], [Span(-9, -1)], [Span(10**9, 10**9)]])
    assert [len(f) for f in ordered] == [1, 1, 0, 0]
    assert len(files_of(spark, stored["shuffled"], [[Span(0, 300)]])[0]) == 8
    assert files_of(spark, stored["bare"], [[Span(0, 300)]]) == [None]


def test_files_added_or_gone(spark, stored, tmp_path):
    path = str(tmp_path / "t")
    write_zoned(rows(spark).filter("rowid < 3000"), path, "rowid", 2)
    rows(spark).filter("rowid between 3000 and 6000").write.mode("append").parquet(path)
    assert {r.rowid for r in read_spans(spark, path, "rowid", [Span(2990, 3010)]).collect()} == {r.rowid for r in rows(spark).filter("rowid between 2990 and 3010").collect()}
    rows(spark).filter("rowid < 50").withColumn("rowid", F.when(F.col("rowid") > 20, F.col("rowid"))).repartition(1).write.mode("overwrite").parquet(str(tmp_path / "n"))
    write_zones(spark, str(tmp_path / "n"), "rowid")
    assert read_spans(spark, str(tmp_path / "n"), "rowid", [Span(0, 22)]).count() == 1


def test_a_sample_reads_less(spark, stored):
    ranges = written(sample_ranges(rows(spark), "rowid", sample_plan(spark, ROWS, seed=3, window_rows=30_000, range_rows=100)))
    left, right = (spark.read.parquet(stored[n]) for n in ("ordered", "copy"))
    found = {}
    sampled = rows_read(spark, lambda: found.update(a=diff_sample_stored(spark, stored["ordered"], stored["copy"], "rowid", ranges).collect()))
    whole = rows_read(spark, lambda: found.update(b=diff_full(left, right, "rowid").collect()))
    assert sampled < whole / 2
    bounds = [(r.lo, r.hi) for r in ranges.collect()]
    inside = sorted(map(tuple, (r for r in found["b"] if any(lo <= r.id <= hi for lo, hi in bounds))), key=str)
    assert sorted((tuple(r) for r in found["a"] if r.kind != "moved"), key=str) == inside and len(inside) > 1
    again = diff_sample(left, right, "rowid", ranges).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found["a"]), key=str)
    unordered = diff_sample_stored(spark, stored["shuffled"], stored["copy"], "rowid", ranges).collect()
    assert sorted(map(tuple, unordered), key=str) == sorted(map(tuple, found["a"]), key=str)


def test_a_predicate_of_many_ranges_is_planned(spark):
    ranges = [(k * 10, k * 10 + 3) for k in range(1_000)]
    rows = spark.range(20_000).filter(literal_ranges("id", ranges)).filter(literal_ranges("id", ranges))
    assert rows.count() == 4_000
    assert spark.range(5).filter(literal_ranges("id", [])).count() == 0


def scans_of(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_the_plan_does_not_grow_with_the_ranges(spark, stored, monkeypatch):
    monkeypatch.setattr(zones, "SPELLED", 7)
    pairs = [(k, k + 40) for k in range(0, 3 * ROWS, 6_000)]  # 30: five scans
    ranges = written(spark.createDataFrame(pairs, "lo bigint, hi bigint").join(rows(spark), F.col("rowid").between(F.col("lo"), F.col("hi"))).groupBy("lo", "hi").agg(F.count("*").alias("rows")))
    spans = spans_of(ranges)
    assert len(spans) == 30
    for name in ("ordered", "shuffled", "bare"):
        assert scans_of(read_spans(spark, stored[name], "rowid", spans)) == 1
        assert scans_of(read_ranges(spark, stored[name], "rowid", ranges)) <= 2
    found = diff_sample_stored(spark, stored["ordered"], stored["copy"], "rowid", ranges)
    few = diff_sample_stored(spark, stored["ordered"], stored["copy"], "rowid", ranges.filter("lo < 9000"))
    assert scans_of(found) == scans_of(few)
    left, right = (spark.read.parquet(stored[n]) for n in ("ordered", "copy"))
    want = diff_sample(left, right, "rowid", ranges).collect()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want), key=str) and len(want) > 30


def test_of_spans_drawn_together_only_rows_in_ranges_are_kept(spark, stored, monkeypatch):
    pairs = [(k, k + 1) for k in range(0, 100_000, 40)] + [(1, 5), (4, 200), (0, 70_000)]  # overlapping, of several lengths
    ranges = spark.createDataFrame(pairs[:-1], "lo bigint, hi bigint")
    monkeypatch.setattr(zones, "SPELLED", 7)
    monkeypatch.setattr(zones, "spans_of", lambda ranges: spans_of(ranges, 30))
    want = sorted(r.rowid for r in rows(spark).collect() if r.rowid < 100_000 and r.rowid % 40 <= 1 or 1 <= r.rowid <= 200)
    got = read_spans(spark, stored["ordered"], "rowid", spans_of(ranges, 30), ["n"], ranges)
    assert got.columns == ["rowid", "n"] and sorted(r.rowid for r in got.collect()) == want
    ready = prepared(spark.createDataFrame(pairs, "lo bigint, hi bigint"))
    assert len(ready.levels) > 2
    for small in (True, False):
        some = in_any_range(rows(spark).filter("rowid < 80000"), "rowid", replace(ready, small=small))
        assert some.count() == rows(spark).filter("rowid <= 70000 OR rowid < 80000 AND rowid % 40 <= 1").count()
    # as from a whole scan: a row is there once for each range that it is in
    whole = sorted(r.rowid for r in in_ranges(rows(spark), "rowid", ranges).collect())
    assert sorted(r.rowid for r in read_ranges(spark, stored["ordered"], "rowid", ranges).collect()) == whole != want


def test_spelled_ranges_may_overlap_and_lack_a_bound(spark):
    ranges = [(k * 10, k * 10 + 3) for k in range(100)] + [(5, 500), (-7, -2), (None, 3), (2**40, 2**40 + 1)]
    ids = spark.range(-20, 1_100).unionByName(spark.createDataFrame([(None,), (2**40,)], "id bigint"))
    want = sorted(i for i in [*range(-20, 1_100), 2**40] if any(lo <= i <= hi for lo, hi in ranges if lo is not None))
    assert sorted(r.id for r in ids.filter(literal_ranges("id", ranges)).collect()) == want
    nested = ids.select(F.struct("id").alias("s"), F.col("id").alias("a b"))
    for name in ("s.id", "a b", "`a b`"):
        assert nested.filter(literal_ranges(name, ranges)).count() == len(want)
