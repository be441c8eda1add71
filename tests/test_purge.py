import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from logtide.functions.retention import retention
from logtide.operators.changelog import latest_state
from logtide.operators.links import purge_unreferenced, unreferenced
from logtide.operators.retention import (partition_retention, purge_by_policy, purge_expired, purge_range_plan,
                                         purge_walked, removed_rows)
from logtide.plans.purge import LinkGraph, month_class, purge_cascade, retain_partitions

DAY = 86_400
CUTOFF = 1_700_000_000
NOW = CUTOFF + 40 * DAY


def log(spark, *pieces):
    """(first id, last id, time) pieces as one table of `rowid` and `time`."""
    out = None
    for first, last, time in pieces:
        piece = spark.range(first, last + 1).select(F.col("id").alias("rowid"), F.lit(time).cast("bigint").alias("time"))
        out = piece if out is None else out.unionByName(piece)
    return out


def test_deletes_older_rows_across_gaps(spark):
    log_rows = spark.range(700).select((F.col("id") * F.col("id")).alias("rowid"), (CUTOFF + 60 * (F.col("id") - 400)).alias("time"))
    assert removed_rows(log_rows, "rowid", "time", CUTOFF).count() == 400
    left = purge_expired(log_rows, "rowid", "time", CUTOFF)
    assert left.count() == 300 and left.agg(F.min("rowid")).first()[0] == 400 * 400
    assert purge_expired(left, "rowid", "time", CUTOFF).count() == 300


@pytest.mark.parametrize("newest", [False, True])
def test_keeps_rows_around_the_cutoff(spark, ids, newest):
    times = [CUTOFF + step for step in (-2, -1, 0, 1, 2)] * 300
    random.Random(11).shuffle(times)
    rows = list(enumerate([*times, CUTOFF - 1]))
    df = spark.createDataFrame(rows, "rowid bigint, time bigint")
    want = [i for i, t in rows if t >= CUTOFF or (newest and i == len(times))]
    assert ids(purge_expired(df, "rowid", "time", CUTOFF, newest)) == want


def test_newest_row_stays(spark, ids):
    block = log(spark, (1, 50, CUTOFF - 100 * DAY))
    assert ids(purge_expired(block, "rowid", "time", CUTOFF, keep_newest=True)) == [50]
    assert ids(purge_expired(block, "rowid", "time", CUTOFF)) == []


def test_negative_and_missing_times_stay(spark, ids):
    df = spark.createDataFrame([(1, -1), (2, 0), (3, CUTOFF - 1), (4, CUTOFF), (5, None)], "rowid bigint, time bigint")
    assert ids(purge_expired(df, "rowid", "time", CUTOFF)) == [1, 4, 5]


def stretches(spark, *runs):
    """A log of runs of rows, each (rows, days from the cutoff)."""
    spans, first = [], 0
    for rows, days in runs:
        spans.append((first, first + rows - 1, CUTOFF + days * DAY))
        first += rows
    return log(spark, *spans)


def test_walk_finishes_past_the_cutoff(spark):
    df = stretches(spark, (240, -7), (9_000, 3), (30, -2), (5, 4))
    left = purge_walked(df, "rowid", "time", CUTOFF, NOW, 300)
    assert df.count() - left.count() == 240 and left.filter(F.col("time") < CUTOFF).count() == 30, "what lies past the finish stays"
    steps = purge_range_plan(df, "rowid", "time", CUTOFF, NOW, 300).orderBy("range").collect()
    assert [p["step"] for p in steps[:2]] == ["purge", "finish"] and {p["step"] for p in steps[2:]} == {"leave"}
    assert [p["removed"] for p in steps if p["removed"]] == [240]


def test_walk_goes_past_future_rows_run_after_run(spark):
    df = stretches(spark, (700, -30), (3_000, 400), (2_500, -12), (1, 9))
    for day in (0, 1, 2):
        df = purge_walked(df, "rowid", "time", CUTOFF + day * DAY, NOW, 450)
    assert sorted((r["time"] - CUTOFF) // DAY for r in df.select("time").distinct().collect()) == [9, 400]
    assert df.count() == 3_001


def test_walk_finishes_after_future_rows(spark):
    df = stretches(spark, (60, -9), (2_000, 400), (4_000, 2), (25, -3), (1, 3))
    left = purge_walked(df, "rowid", "time", CUTOFF, NOW, 200)
    assert df.count() - left.count() == 60 and left.filter(F.col("time") < CUTOFF).count() == 25


RETENTIONS = {
    "30d": 2592000, "6mo": 15552000, "1y": 31536000, "12w": 7257600, "1mo2w": 3801600, "1mo 2w": 3801600, "1y6mo": 47088000,
    "720h": 2592000, "43200m": 2592000, "2592000s": 2592000, "1.5d": 129600, ".5y": 15768000, "30.d": 2592000, "30D": 2592000,
    "  30d  ": 2592000, "30d # a month": 2592000, "29d23h59m60s": 2592000, "1d1d": 172800, "0.0000001s": 1, "0d": 0,
    "0.00000000000000000001s": 1, "4w,2d": 2592000, "2w,5d,7h,2m,10s": 1666930, "1mo, 2w": 3801600, "1mo ,2w": 3801600,
    "30d , 1h": 2595600, "6m": 360, "99999999999999999999999y": 1000 * 365 * DAY, "2000y": 1000 * 365 * DAY,
}
INVALID = ["45", "w", "5q", "3 weeks", "+9d", "9d to 12d", "0..5h", "keep:9d", "yes", "9d,", "min", "# 9d", ", 9d", "9d, ,4h", ",,", "9d/4h"]
OFF = [None, "", "false", "FALSE", " false ", "false # off"]


def test_retention_texts(spark):
    texts = [*RETENTIONS, *INVALID, *OFF]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", retention(F.col("t")).alias("r")).collect()
    by_text = {row["t"]: row["r"] for row in got}
    for text, seconds in RETENTIONS.items():
        assert by_text[text]["parsed"] == seconds, text
        enough = seconds >= 30 * DAY
        assert by_text[text]["seconds"] == (seconds if enough else 0), text
        assert by_text[text]["problem"] == (None if enough else "below the minimum"), text
    for text in INVALID:
        assert tuple(by_text[text])[:2] == (0, "not a retention time"), text
    for text in OFF:
        assert tuple(by_text[text])[:2] == (0, None), text


def test_policies(spark, ids):
    df = spark.createDataFrame([(1, "a", CUTOFF), (2, "a", NOW), (3, "b", 0), (4, "c", 0), (5, "a", -5), (6, "a", None)],
                               "rowid bigint, table string, time bigint")
    policies = spark.createDataFrame([("a", "35d"), ("b", "soon")], "table string, retention string")
    assert ids(purge_by_policy(df, "table", "time", policies, NOW)) == [2, 3, 4, 5, 6]


#: Whether a row is past its time, and what a link can lead to: nothing, a row that stays, one that expires, none that ever was.
TIMES, LINKS = (CUTOFF - DAY, CUTOFF, CUTOFF + DAY), (None, 2, 1, 99)
HUB = [(n, *row) for n, row in enumerate(itertools.product(TIMES, LINKS, LINKS, (0, 1)), 1)]
USED = [n for n in range(1, len(HUB) + 1) if n % 5 == 0]


def seed(spark):
    both = spark.createDataFrame([(1, TIMES[0]), (2, TIMES[2])], "rowid bigint, time bigint")
    hub = spark.createDataFrame([(n, t, b, k, f"u{n}", r) for n, t, b, k, r in HUB],
                                "rowid bigint, time bigint, block_rowid bigint, kill_rowid bigint, uuid string, removed int")

    def children(links):
        rows = [(n, t, link) for n, (t, link) in enumerate(itertools.product(TIMES, links), 1)]
        return spark.createDataFrame(rows, "rowid bigint, time bigint, entity_spawn_rowid bigint")
    return {"block": both, "entity": both, "entity_spawn": hub, "entity_interaction": children([*USED, 5_000]), "entity_container": children([7_000, None])}


def expected(newest=False, expire=True):
    """Rows left, worked out row by row: (hub's links by id, ids of the children)."""
    alive = {2} if expire else {1, 2}
    links = {n: (k if k in alive else None, b if b in alive else None) for n, _, b, k, _ in HUB}
    gone = {n for n, t, _, _, r in HUB if t < CUTOFF and r and links[n] == (None, None) and n not in USED and not (newest and n == len(HUB))}
    children = {name: [n for n, (t, link) in enumerate(itertools.product(TIMES, found), 1) if t >= CUTOFF or link in links]
                for name, found in (("entity_interaction", [*USED, 5_000]), ("entity_container", [7_000, None]))}
    return {n: x for n, x in links.items() if n not in gone}, children


def state(purge, ids):
    hub = {r["rowid"]: (r["kill_rowid"], r["block_rowid"]) for r in purge.tables["entity_spawn"].collect()}
    return hub, {name: ids(purge.tables[name]) for name in ("entity_interaction", "entity_container")}


@pytest.mark.parametrize("newest", [False, True])
def test_cascade(spark, ids, newest):
    tables = seed(spark)
    purge = purge_cascade(tables, ["entity", "block"], LinkGraph(), CUTOFF, keep_newest=newest)
    assert state(purge, ids) == expected(newest)
    assert ids(purge.tables["block"]) == ids(purge.tables["entity"]) == [2]
    lost = sum(tables[name].count() - purge.tables[name].count() for name in tables)
    assert sum(r["removed"] for r in purge.report().collect()) == lost > 4 and purge.cleaned


def test_cascade_waits_for_something_to_clean(spark, ids):
    tables = {name: df.filter("rowid <> 1") if name in ("block", "entity") else df for name, df in seed(spark).items()}
    idle = purge_cascade(tables, ["entity", "block"], LinkGraph(), CUTOFF)
    assert sum(r["removed"] for r in idle.report().collect()) == 0 and len(idle.audits) == 2
    pending = purge_cascade(tables, ["entity", "block"], LinkGraph(), CUTOFF, orphans_pending=True)
    assert state(pending, ids) == expected()
    untracked = purge_cascade(seed(spark), ["entity", "block"], LinkGraph(), CUTOFF, orphans_pending=True, tracked=False)
    assert not untracked.cleaned and ids(untracked.tables["entity_spawn"]) == [n for n, *_ in HUB]


def test_cascade_keeps_the_newest_hub_row(spark, ids):
    tables = seed(spark)
    last = max(n for n, t, _, _, r in HUB if t < CUTOFF and r and n not in USED and n not in expected()[0])
    tables["entity_spawn"] = tables["entity_spawn"].filter(F.col("rowid") <= last)
    for newest in (True, False):
        assert (last in ids(purge_cascade(tables, ["entity", "block"], LinkGraph(), CUTOFF, newest).tables["entity_spawn"])) == newest


def test_latest_state(spark):
    rows = [(2, 1, 1_700_000_000, 3, "meta", 1, 0), (5, 2, 1_700_000_100, 4, None, 1, 0), (2, 3, 1_700_000_000, None, None, None, 1),
            (9, 4, 1_700_000_200, None, None, None, 1)]
    df = spark.createDataFrame(rows, "rowid bigint, seq bigint, time bigint, user bigint, meta string, action int, rolled_back int")
    got = sorted(tuple(r) for r in latest_state(df, "rowid", "seq", "action").collect())
    assert got == [(2, 1_700_000_000, 3, "meta", 1, 1), (5, 1_700_000_100, 4, None, 1, 0)]


def test_month_classes():
    first = int(dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc).timestamp())
    for month, cutoff, want in [(dt.date(2024, 1, 1), first, "drop"), (dt.date(2024, 1, 1), first - 1, "rewrite"),
                                (dt.date(2024, 2, 1), first, "keep"), (dt.date(1969, 12, 1), first, "keep")]:
        assert month_class(month, cutoff) == want


def test_partitions_are_dropped_and_one_rewritten(spark, tmp_path, ids):
    cutoff = int(dt.datetime(2024, 2, 10, tzinfo=dt.timezone.utc).timestamp())
    rows = spark.range(120).select(F.col("id").alias("rowid"), (F.lit(1_704_067_200) + F.col("id") * DAY).alias("time"))
    rows = rows.withColumn("month", F.trunc(F.timestamp_seconds("time").cast("date"), "MM"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS purge_test LOCATION '{tmp_path}'")
    rows.write.partitionBy("month").format("parquet").option("path", str(tmp_path / "log")).mode("overwrite").saveAsTable("purge_test.log")
    try:
        want = [i for i in range(120) if 1_704_067_200 + i * DAY >= cutoff]
        report = {str(r["month"]): (r["action"], r["kept_rows"]) for r in partition_retention(rows, "time", cutoff, "month").collect()}
        assert report["2024-01-01"] == ("drop", 0) and report["2024-02-01"] == ("rewrite", 20) and report["2024-03-01"] == ("keep", 31)
        for attempt in range(2):
            done = retain_partitions(spark, "purge_test.log", "month", "time", cutoff, str(tmp_path / f"stage{attempt}"))
            assert ids(spark.table("purge_test.log")) == want
        assert done["drop"] == []
    finally:
        spark.sql("DROP TABLE purge_test.log")


def test_several_links_are_cleared_at_once(spark):
    from logtide.operators.links import clear_all_links, clear_links
    rows = [(1, 1, 1, b"a"), (2, None, 2, None), (3, 3, None, b""), (4, None, None, b"d"), (5, 9, 9, b"e"), (6, 1, 9, b"f")]
    df = spark.createDataFrame(rows, "rowid bigint, a bigint, b bigint, data binary")
    a, b = spark.createDataFrame([(1,), (2,)], "x bigint"), spark.createDataFrame([(2,), (-7,)], "y bigint")
    got = {r["rowid"]: (r["a"], r["b"]) for r in clear_all_links(df, [("a", a, "x"), ("b", b, "y")]).collect()}
    assert got == {1: (1, None), 2: (None, 2), 3: (None, None), 4: (None, None), 5: (None, None), 6: (1, None)}
    one_by_one = clear_links(clear_links(df, "a", a, "x"), "b", b, "y")
    assert {r["rowid"]: (r["a"], r["b"]) for r in one_by_one.collect()} == got


def test_settled_cascade_is_the_same(spark, ids):
    from logtide.session import written
    steps = []

    def settle(name, df):
        steps.append(name)
        return written(df)

    purge = purge_cascade(seed(spark), ["entity", "block"], LinkGraph(), CUTOFF, settle=settle)
    lost = sum(df.count() - purge.tables[name].count() for name, df in seed(spark).items())
    assert state(purge, ids) == expected() and sum(r["removed"] for r in purge.report().collect()) == lost
    assert steps == ["entity", "block", "entity_spawn", "entity_interaction", "entity_container", "entity_spawn"]


def test_the_keys_of_all_children_are_made_distinct_once(spark):
    """Each further table of distinct keys holds as many rows in one task."""
    hub = spark.range(6).select(F.col("id").alias("rowid"), F.lit(CUTOFF - 1).alias("time"))
    children = [(spark.createDataFrame([(1,), (1,), (None,)], "a bigint"), "a"), (spark.createDataFrame([(1,), (4,)], "b int"), "b")]
    spared = purge_unreferenced(hub, "rowid", children, F.lit(True), "time", CUTOFF)
    gone = unreferenced(hub, "rowid", children, F.lit(True), "time", CUTOFF)
    for rows, want in ((spared, [1, 4]), (gone, [0, 2, 3, 5])):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
        assert sorted(r.rowid for r in rows.collect()) == want
    assert unreferenced(hub, "rowid", [], F.lit(True), "time", CUTOFF).count() == 6
