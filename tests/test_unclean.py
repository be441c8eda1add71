"""Input that is not clean: nothing may be lost or doubled in silence."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtide import session
from logtide.operators.diff import diff_full, diff_pruned
from logtide.operators.egress import egress_violations
from logtide.operators.links import clear_all_links, clear_links, orphans
from logtide.operators.positions import assign_ids, id_gaps, order_violations, page_bounds, with_position
from logtide.operators.retention import purge_by_policy
from logtide.operators.routing import Route, policy_matrix, route_summary
from logtide.plans.writes import read_buckets, write_idempotent
from logtide.sources.scan import merged, scan_ranges
from logtide.streaming.jobs import catch_up, dedupe_late, future_rows, missed, run_to_end, to_parquet

NOW = 1_700_000_000


def numbers(spark, *ids):
    return spark.createDataFrame([(i, f"v{i}") for i in ids], "rowid bigint, v string")


def at(seconds):
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc)


def test_a_batch_leaves_other_rows_of_its_folder(spark, tmp_path, ids):
    path = str(tmp_path / "t")
    write_idempotent(numbers(spark, *range(10)), path, "rowid", bits=6)
    for _ in range(2):  # repeated: nothing more
        write_idempotent(numbers(spark, *range(10, 20), 200), path, "rowid", bits=6)
    assert ids(read_buckets(spark, path)) == [*range(20), 200]
    write_idempotent(numbers(spark, 5).withColumn("v", F.lit("new")), path, "rowid", bits=6)
    assert ids(read_buckets(spark, path)) == [*range(20), 200] and read_buckets(spark, path).filter("v = 'new'").count() == 1


def test_a_second_stream_leaves_the_first_one_s_rows(spark, tmp_path, ids):
    out = str(tmp_path / "out")
    for name, rows in (("a", range(10)), ("b", range(10, 13))):
        numbers(spark, *rows).coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema("rowid bigint, v string").parquet(str(tmp_path / name))
        run_to_end(catch_up(stream, "rowid", -1, out, str(tmp_path / f"mark-{name}")))
    assert ids(spark.read.parquet(out)) == list(range(13))


def test_rows_without_a_time_and_late_first_copies_are_found(spark, tmp_path, ids):
    folder, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "rowid bigint, ts timestamp"
    spark.createDataFrame([(1, at(NOW)), (2, None), (3, at(NOW + 10**6))], schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run_to_end(to_parquet(dedupe_late(stream, "rowid", "ts", NOW), out, str(tmp_path / "mark")))
    spark.createDataFrame([(9, at(NOW - 10 * 86_400)), (9, at(NOW - 10 * 86_400))], schema).coalesce(1).write.mode("append").parquet(folder)
    run_to_end(to_parquet(dedupe_late(stream, "rowid", "ts", NOW), out, str(tmp_path / "mark")))
    table, target = spark.read.parquet(folder), spark.read.parquet(out)
    assert ids(future_rows(table, "ts", NOW)) == [2, 3]
    late = missed(table, target, "rowid", "ts", NOW)
    assert sorted(ids(target) + ids(late)) == [1, 9]


def test_matrix_and_summary_count_every_request(spark):
    routes = [Route(r"https?://a\..*", "REDIRECT", "https://b.example/"), Route(r"https?://p\..*", "PASSTHROUGH")]
    df = spark.createDataFrame([("https://a.example/x",), ("https://p.example/",), ("https://c.example/",), ("no url",), (None,)], "url string")
    rows = {r.host: r for r in policy_matrix(df, "url", {"one": (routes, "BLOCK")}).collect()}
    assert rows["a.example"].one_redirect == 1 and rows["p.example"].one_passthrough == 1
    assert sum(sum(r[c] for c in ("one_block", "one_answer", "one_passthrough", "one_redirect")) for r in rows.values()) == 5
    assert route_summary(df, "url", {"one": (routes, "BLOCK")}).agg(F.sum("requests")).first()[0] == 5


def test_rows_without_an_id_have_no_position(spark, ids):
    df = numbers(spark, 7, 3).unionByName(spark.createDataFrame([(None, "n"), (None, "n")], "rowid bigint, v string"))
    assert sorted((r.rowid, r.position) for r in with_position(df, "rowid").collect() if r.rowid is not None) == [(3, 0), (7, 1)]
    assert with_position(df, "rowid").filter("rowid is null and position is null").count() == 2
    assert [tuple(r) for r in page_bounds(df, "rowid", 10).collect()] == [(0, 3, 7, 2)]
    assert assign_ids(df.withColumnRenamed("rowid", "k"), "k", 100).count() == 4
    assert [tuple(r) for r in id_gaps(df, "rowid").collect()] == [(3, 7, 3)]
    assert order_violations(df.withColumn("t", F.lit(1).cast("bigint")), "rowid", "t").collect() == []


@pytest.mark.parametrize("limit", [1000, 1])
def test_overlapping_ranges_give_each_row_once(spark, ids, monkeypatch, limit):
    monkeypatch.setattr("logtide.sources.scan.LITERAL_RANGES", limit)
    assert ids(scan_ranges(numbers(spark, *range(30)), "rowid", [(5, 9), (7, 12), (20, 21), (25, 24)])) == [*range(5, 13), 20, 21]
    assert merged([(3, 4), (5, 6), (1, 0)]) == [(3, 6)]


@pytest.mark.parametrize("diff", [diff_full, diff_pruned])
def test_repeated_rows_are_a_difference(spark, diff):
    once = numbers(spark, *range(20))
    found = diff(once, once.unionByName(once.filter("rowid < 3")), "rowid").collect()
    assert sorted((r.id, r.kind, r.source, r.target) for r in found) == [(i, "repeated", "1", "2") for i in range(3)]
    assert diff(once, once, "rowid").collect() == []


@pytest.mark.parametrize("diff", [diff_full, diff_pruned])
def test_repeated_ids_are_compared_by_all_their_rows(spark, diff):
    def found(source, target, kind="string"):
        left, right = spark.createDataFrame(source, "rowid bigint, v string"), spark.createDataFrame(target, "rowid bigint, v string")
        right = right.withColumn("v", F.col("v").cast(kind))
        return sorted(((r.id, r.kind, r.source) for r in diff(left, right, "rowid").collect()), key=str)
    texts = [chr(c) for c in range(ord("a"), ord("k"))]
    for a in texts:  # whichever hash is least
        for b, c in zip(texts, texts[1:]):
            if a not in (b, c):
                pairs = [(1, a), (1, b)], [(1, a), (1, c)]
                break
        assert found(*pairs) == [(1, "differs", f"'{b}'")]
    assert found([(1, v) for v in texts], [(1, v) for v in texts[::-1]], "binary") == []
    assert found([(1, "a"), (1, "a"), (1, "b")], [(1, "a"), (1, "b"), (1, "b")]) == [(1, "differs", "'a'")]
    assert found([(1, "a")], [(1, "a"), (1, "c")]) == [(1, "extra", None), (1, "repeated", "1")]
    assert found([(1, "a"), (1, "b"), (2, "x"), (2, "x")], [(1, "c"), (1, "d")]) == [(1, k, None) for k in ("extra", "extra", "missing", "missing")] + [(2, "missing", None)] * 2
    assert found([(None, "a"), (None, "a"), (None, "b"), (3, "c")], [(None, "a"), (3, "c")]) == [(None, "extra", None)] + [(None, "missing", None)] * 3


def test_several_policies_keep_what_the_longest_keeps(spark, ids):
    df = spark.createDataFrame([(1, "a", NOW - 50 * 86_400), (2, "a", NOW - 90 * 86_400), (3, "b", NOW - 90 * 86_400), (4, None, 0)], "rowid bigint, t string, time bigint")
    policies = spark.createDataFrame([("a", "40d"), ("a", "70d"), ("b", "40d"), ("b", "nonsense")], "table string, retention string")
    assert ids(purge_by_policy(df, "t", "time", policies, NOW)) == [1, 3, 4]


def test_repeated_parents_double_no_child(spark):
    children = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "rowid bigint, parent bigint")
    parents = spark.createDataFrame([(10,), (10,), (None,)], "id bigint")
    for cleared in (clear_links(children, "parent", parents, "id"), clear_all_links(children, [("parent", parents, "id")])):
        assert sorted(map(tuple, cleared.collect())) == [(1, 10), (2, None), (3, None)]
    old = children.withColumn("time", F.lit(1).cast("bigint"))
    assert sorted(r.rowid for r in orphans(old, "parent", parents, "id", "time", NOW).collect()) == [2, 3]


def test_allowed_hosts_have_no_case(spark):
    log = spark.createDataFrame([("connect", "A.example:443", "my.Frame"), ("connect", "evil.example:443", "my.Frame")], "kind string, target string, stack string")
    assert [r.host for r in egress_violations(log, ["my."], ["a.EXAMPLE"]).collect()] == ["evil.example"]


class Elsewhere:
    """A session on another master, without a shared folder."""

    class sparkContext:  # noqa: N801
        master, applicationId, chosen = "spark://host:7077", "app", None

        @classmethod
        def getCheckpointDir(cls):  # noqa: N802
            return cls.chosen

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    with pytest.raises(session.NoSharedFolder):
        session.shared_dir(Elsewhere)
    monkeypatch.setattr(Elsewhere.sparkContext, "chosen", "hdfs://x/y/")
    assert session.shared_dir(Elsewhere) == "hdfs://x/y"


def test_unicode_escapes_are_read_before_headers(spark):
    from logtide.functions.texts import header, unescaped
    rows = [("\\u0041\\uu00e9\\ud83d\\ude00x", "Aé😀x"), ("\\\\u0041", "\\\\u0041"), ("\\u00zz", "\\u00zz"), ("no escape", "no escape"), (None, None)]
    got = spark.createDataFrame(rows, "t string, want string").select(unescaped(F.col("t")), "want").collect()
    assert all(r[0] == r[1] for r in got)
    hidden = spark.createDataFrame([("\\u002f* Notice \\u002a/ class A {}",)], "t string").select(header(F.col("t"))).first()[0]
    assert hidden == "Notice"


def test_many_rows_of_one_id_are_listed_in_parts(spark):
    from logtide.operators.diff import LISTED, diff_full
    n = 2 * LISTED + 7
    left = spark.createDataFrame([(1, "a"), (2, "b")], "rowid bigint, v string").unionByName(spark.range(n).selectExpr("5L AS rowid", "concat('v', id % 3) AS v"))
    right = spark.createDataFrame([(1, "a"), (2, "c")], "rowid bigint, v string")
    got = diff_full(left, right, "rowid")
    counted = {(r["id"], r["kind"]): r["count"] for r in got.groupBy("id", "kind").count().collect()}
    assert counted == {(2, "differs"): 1, (5, "missing"): n}
    assert {(r["id"], r["kind"]): r["count"] for r in diff_full(right, left, "rowid").groupBy("id", "kind").count().collect()} == {(2, "differs"): 1, (5, "extra"): n}


def test_least_ids_of_hot_values(spark):
    import random
    from collections import defaultdict
    from logtide.operators import stats
    rng = random.Random(6)
    rows = [("hot", k * 3 % 5000) for k in range(3000)] + [(f"v{k % 700}", rng.randint(-50, 900)) for k in range(2500)] + [("same", 4)] * 40 + [("few", 1), ("few", None), ("none", None), ("none", None), (None, 3), (None, 3), ("once", 9)]
    want = defaultdict(list)
    for v, i in rows:
        want[v].append(i)
    want = {(v, len(ids), ", ".join(map(str, sorted(i for i in ids if i is not None)[:5]))) for v, ids in want.items() if v is not None and len(ids) > 1}
    df = spark.createDataFrame(rows, "v string, id bigint").repartition(6)
    assert {tuple(r) for r in stats.duplicate_keys(df, "v", "id").collect()} == want
    stats.BROADCAST_VALUES, kept = 0, stats.BROADCAST_VALUES
    try:
        assert {tuple(r) for r in stats.duplicate_keys(df, "v", "id").collect()} == want
    finally:
        stats.BROADCAST_VALUES = kept
