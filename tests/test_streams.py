import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtide.operators.routing import Route
from logtide.queries import QUERIES
from logtide.streaming.jobs import catch_up, dedupe_late, future_rows, live_policy, run_to_end, to_parquet

NOW = 1_705_363_200
SCHEMA = "rowid bigint, ts timestamp, url string"


def feed(spark, folder, rows):
    made = [(i, dt.datetime.fromtimestamp(NOW + t, dt.timezone.utc), u) for i, t, u in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).parquet(folder)


def test_catch_up_is_exactly_once(spark, tmp_path, ids):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(spark, folder, [(i, 0, "") for i in range(10)])
    run_to_end(catch_up(source(spark, folder), "rowid", 4, out, mark))
    feed(spark, folder, [(i, 0, "") for i in range(10, 15)])
    for _ in range(2):
        run_to_end(catch_up(source(spark, folder), "rowid", 4, out, mark))
    assert ids(spark.read.parquet(out)) == list(range(5, 15))


def test_repeats_and_wrong_clocks(spark, tmp_path, ids):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(spark, folder, [(1, 0, ""), (2, 10, ""), (3, 10**7, "")])
    run_to_end(to_parquet(dedupe_late(source(spark, folder), "rowid", "ts", NOW), out, mark))
    feed(spark, folder, [(1, 0, ""), (2, 10, ""), (4, -80_000, "")])
    for _ in range(2):
        run_to_end(to_parquet(dedupe_late(source(spark, folder), "rowid", "ts", NOW), out, mark))
    assert ids(spark.read.parquet(out)) == [1, 2, 4]
    assert ids(future_rows(spark.read.parquet(folder), "ts", NOW)) == [3]


def test_live_policy_equals_batch(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    feed(spark, folder, [(1, 0, "http://A.example/x"), (2, 0, "https://b.example/"), (3, -10**6, "https://b.example/")])
    routes = [Route(r"http://a\..*", "PASSTHROUGH")]
    live = live_policy(source(spark, folder), "url", routes, "BLOCK", "ts", NOW - 1000)
    run_to_end(to_parquet(live.select("rowid", "action"), out, mark))
    batch = live_policy(spark.read.parquet(folder), "url", routes, "BLOCK", "ts", NOW - 1000).select("rowid", "action")
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == sorted(tuple(r) for r in batch.collect()) == [(1, "PASSTHROUGH"), (2, "BLOCK")]


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_one_file_and_of_a_folder_are_streamed(spark, tmp_path, files):
    pages = [(i, f"https://h{i}.example/p", "") for i in range(6)]
    made = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    if files == 1:
        made.coalesce(1).write.parquet(str(tmp_path / "made"))
        next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    else:
        made.repartition(files).write.parquet(str(tmp_path / "pages.parquet"))
    found = QUERIES["stream_route"](spark, str(tmp_path))
    assert sorted(r.page_id for r in found.collect()) == list(range(6))
