import pytest
from pyspark.sql import functions as F

from logtide.operators.encode import Codec, canonical, empty_is_null, encode, fit_audit, null_is_zero, reject_report, unwrap_binary
from logtide.operators.stats import (coverage_counts, family_counts, hidden_rows, identifier_conflicts, occupancy_report)
from logtide.plans.migration import MigrationRefused, copy_tables, match_columns, plan_copy, validate
from logtide.plans.writes import (IDENTITY, NotPublished, begin_version, complete_version, latest_version, open_published,
                                  pending_batches, plan_batches, read_buckets, write_idempotent)
from logtide.sources.stores import CatalogStore, JdbcStore, ParquetStore, drop_prefix, page_predicates
from logtide.specs import copy_order, is_reference

HEX = Codec(lambda c: F.hex(c.cast("binary")), lambda c: F.when(c.startswith("bad"), F.concat(F.lit("cannot read "), c)))


def test_encode_keeps_or_fails(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad1"), (3, None)], "rowid bigint, data string")
    rows, rejects = encode(df, "rowid", {"data": HEX}, "entity", "keep")
    assert {r["rowid"]: r["data"] for r in rows.collect()} == {1: "61", 2: "bad1", 3: None}
    assert [tuple(r) for r in rejects.collect()] == [("entity", "data", 2, "cannot read bad1")]
    assert tuple(reject_report(rejects).first()) == (1, "entity.data of row 2 (cannot read bad1)")
    with pytest.raises(Exception, match="cannot convert entity.data of row 2"):
        encode(df, "rowid", {"data": HEX}, "entity", "fail")[0].collect()
    assert encode(df.filter("rowid <> 2"), "rowid", {"data": HEX}, "entity", "fail")[0].count() == 2


def test_reject_report_names_five(spark):
    df = spark.range(1, 9).select(F.col("id").alias("rowid"), F.lit("bad").alias("data"))
    got = reject_report(encode(df, "rowid", {"data": HEX}, "t")[1]).first()
    assert got["rejected"] == 8 and got["examples"].count(";") == 4


def test_canonical_forms(spark):
    df = spark.createDataFrame([("", None, "a"), ("u", 1, "bad")], "uuid string, action int, data string")
    got = [tuple(r) for r in canonical(df, {"uuid": empty_is_null, "action": null_is_zero}, {"data": HEX}).collect()]
    assert got == [(None, 0, "61"), ("u", 1, "bad")]


def test_unwrap_binary(spark):
    df = spark.createDataFrame([(1, b""), (2, b"\0"), (3, b"\0ab"), (4, b"\1ab"), (5, None)], "rowid bigint, b binary")
    rows, rejects = unwrap_binary(df, "rowid", ["b"])
    assert {r["rowid"]: r["b"] for r in rows.collect()} == {1: None, 2: bytearray(b""), 3: bytearray(b"ab"), 4: None, 5: None}
    assert [tuple(r) for r in rejects.collect()] == [(4, "b", "01")]


FITS = [("UInt8", 255, 256), ("UInt32", 2**32 - 1, -1), ("UInt64", 2**63 - 1, -1), ("Int32", -2**31, 2**31), ("SMALLINT", 2**15 - 1, 2**15),
        ("TINYINT", -128, 128), ("Int32", 5.0, 5.5), ("UInt64", 2.0**62, 2.0**63), ("Float32", 3e38, 4e38), ("FLOAT", 0.5, 0.1),
        ("String", "x", 1), ("VARCHAR", "x", b"x"), ("BLOB", b"x", "x"), ("Float64", 1, "x"), ("BIGINT", 1, 1.0), ("DOUBLE", 1.0, 1),
        ("Int64", float(-2**63), float("nan")), ("Float32", float("inf"), "1")]


@pytest.mark.parametrize("target,fits,misfit", FITS)
def test_fit(spark, target, fits, misfit):
    kinds = {int: "bigint", float: "double", str: "string", bytes: "binary"}
    for value, problems in ((fits, 0), (misfit, 1)):
        df = spark.createDataFrame([(1, value)], f"rowid bigint, v {kinds[type(value)]}")
        assert fit_audit(df, "rowid", {"v": target}).count() == problems


def test_missing_values(spark):
    df = spark.createDataFrame([(7, None, None, None, None)], "rowid bigint, time bigint, x bigint, action bigint, user bigint")
    got = fit_audit(df, "rowid", {"time": "UInt32", "x": "Int32", "action": "Nullable(UInt8)", "user": "Nullable(UInt32)"}, "block", "action").collect()
    assert [(r["column"], r["reason"]) for r in got] == [("time", "missing"), ("action", "missing-shown")]


def test_profiles(spark):
    df = spark.createDataFrame([("sign", "sign", None, 3), ("sign", "sign", None, None), ("block", "block", 1, 3), ("index", "block", 1, 1), ("lock", "", 1, 1),
                                ("receipt", "receipt", 0, 0)], "family string, data string, action int, user int")
    assert hidden_rows(df, "action", "user", F.col("family") == "sign").first()[0] == 1
    got = {r["label"]: r["rows"] for r in family_counts(df, "family", "data", ["receipt"]).collect()}
    assert got == {"sign": 2, "block": 1, "block lookup index": 1, "lookup index": 1}
    assert {r[0]: r[1] for r in coverage_counts(df, ["action", "user"], "t").collect()} == {"t.action": 4, "t.user": 5}
    assert [r[0] for r in occupancy_report({"a": df, "b": df.limit(0), "database_lock": df}).collect()] == ["a"]


def test_identifier_conflicts(spark):
    rows = spark.createDataFrame([(1, 5), (7, 6), (9, 2)], "rowid bigint, id bigint")
    assigned = spark.createDataFrame([(7,), (1,), (8,)], "id bigint")
    assert [tuple(r) for r in identifier_conflicts(rows, assigned, "art_map").collect()] == [("art_map", 7)]


def test_copy_order():
    assert copy_order(["zzz", "block", "user", "aaa", "world", "sign"]) == ["world", "user", "block", "sign", "aaa", "zzz"]
    assert is_reference("art_map") and is_reference("version") and not is_reference("block")


def test_writes_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10_000).withColumnRenamed("id", "rowid").withColumn("v", F.lit(1))
    for _ in range(2):
        write_idempotent(rows, path, "rowid", 10)
    write_idempotent(rows.filter("rowid < 1024").withColumn("v", F.lit(2)), path, "rowid", 10)
    got = read_buckets(spark, path)
    assert got.count() == 10_000 and got.select("rowid").distinct().count() == 10_000 and got.filter("v = 2").count() == 1024


def test_pending_batches(spark):
    rows = spark.range(5_000).withColumnRenamed("id", "rowid")
    planned = plan_batches(rows, "block", "rowid", 10)
    done = plan_batches(rows.filter("rowid <> 2000"), "block", "rowid", 10).select(*IDENTITY)
    assert [r["first_id"] for r in pending_batches(planned, done).collect()] == [1024]
    assert pending_batches(planned, planned.select(*IDENTITY)).isEmpty()


def test_publishing(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(NotPublished):
        latest_version(spark, root)
    for version, rows in (("v1", 3), ("v2", 5)):
        ParquetStore(begin_version(spark, root, version)).write(spark.range(rows), "t", "id")
        with pytest.raises(NotPublished):
            open_published(spark, root, "t", version)
        if version == "v2":
            assert open_published(spark, root, "t").count() == 3
        complete_version(spark, root, version, {"t": {"rows": rows}})
        assert open_published(spark, root, "t").count() == rows
    with pytest.raises(FileExistsError):
        begin_version(spark, root, "v2")


def source(spark):
    make = spark.createDataFrame
    return {
        "version": make([(1, 0, "2.0")], "rowid bigint, time bigint, version string"), "user": make([(1, "u")], "rowid bigint, user string"),
        "world": make([(1, "w")], "rowid bigint, world string"), "database_lock": make([(1, 0)], "rowid bigint, status bigint"),
        "block": make([(1, 5, b"", "x"), (10_001, -2**31, None, "x"), (5_000_000_000, 7, b"\0" * 70_000, "x")],
                      "rowid bigint, Data bigint, meta binary, _key_at string"),
        "chat": make([(1, "tab\there"), (2, "''"), (3, ""), (4, None), (5, "名前🙂")], "rowid bigint, message string"),
    }


def test_copy_and_validate(spark, tmp_path):
    sources = source(spark)
    targets = {n: [c for c in reversed(df.columns) if not c.startswith("_key_")] for n, df in sources.items()}
    targets["block"] = ["META", "data", "rowid"]
    plans = plan_copy(sources, {}, targets, skip=("version",))
    assert [p.name for p in plans] == ["world", "user", "block", "chat"]
    store = ParquetStore(str(tmp_path / "store"))
    codecs = {"chat": {"message": Codec(lambda c: c, lambda c: F.when(c == "''", "odd"))}}
    result = copy_tables(sources, store, plans, codecs)
    assert result.rows == 10 and store.tables(spark) == ["block", "chat", "user", "world"]
    assert store.read(spark, "block").columns == ["rowid", "data", "META"]
    assert [r["id"] for r in result.rejects["chat"].collect()] == [2]
    for plan in plans:
        assert validate(sources[plan.name], store.read(spark, plan.name), plan).isEmpty()
    wrong = store.read(spark, "chat").withColumn("message", F.when(F.col("rowid") == 3, None).otherwise(F.col("message")))
    assert [(r["id"], r["source"], r["target"]) for r in validate(sources["chat"], wrong, plans[3]).collect()] == [(3, "''", "NULL")]


def test_tables_are_sampled_on_request(spark, tmp_path):
    big = spark.range(150_000).select((F.col("id") * 2).alias("rowid"), (F.col("id") % 7).alias("v"))
    tables = {**source(spark), "block": big}
    plan = next(p for p in plan_copy(tables, {}, sample=True) if p.name == "block")
    assert plan.sampled and not next(p for p in plan_copy(tables, {}) if p.name == "block").sampled
    assert validate(big, big, plan).isEmpty()
    assert 1_500 <= validate(big, big.withColumn("v", F.col("v") + 1), plan).count() <= 2_500


def test_refusals(spark):
    tables = source(spark)
    with pytest.raises(MigrationRefused, match="no table user"):
        plan_copy({k: v for k, v in tables.items() if k != "user"}, {})
    with pytest.raises(MigrationRefused, match="no data"):
        plan_copy({k: v.limit(0) for k, v in tables.items()}, {})
    with pytest.raises(MigrationRefused, match="no column extra"):
        match_columns(["rowid", "extra"], ["ROWID"], "t")
    assert match_columns(["rowid", "X", "_key_x"], ["x", "RowId"], "t") == [("rowid", "RowId"), ("X", "x")]


def test_stores(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS store_test LOCATION '{tmp_path}'")
    store = CatalogStore("store_test")
    try:
        store.write(spark.range(3), "t", "id")
        assert store.tables(spark) == ["t"] and store.has(spark, "t") and store.read(spark, "t").count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS store_test.t")
    assert page_predicates("rowid", [(1, 5), (6, 9)]) == ["rowid >= 1 AND rowid <= 5", "rowid >= 6 AND rowid <= 9"]
    assert drop_prefix(["co_block", "CO_user", "other"], "co_") == {"block": "co_block", "user": "CO_user"}
    assert JdbcStore("jdbc:x:", prefix="co_").partitions == 32


def test_a_stopped_migration_is_gone_on_with(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException

    from logtide.plans import migration
    from logtide.plans.writes import NotPublished, manifest, open_published
    tables, root = source(spark), str(tmp_path)
    broken = {**tables, "chat": tables["chat"].withColumn("message", F.raise_error(F.lit("gone")))}
    with pytest.raises(PySparkException):
        migration.migrate(spark, broken, {}, root, "v1")
    with pytest.raises(NotPublished):
        open_published(spark, root, "block")
    written, write = [], ParquetStore.write
    monkeypatch.setattr(ParquetStore, "write", lambda self, df, name, *a: (written.append(name), write(self, df, name, *a)))
    verdicts = migration.migrate(spark, tables, {}, root, "v1")
    assert {r["verdict"] for r in verdicts.collect()} == {"ok"} and "chat" in written and len(written) < len(tables)
    assert manifest(spark, root, "v1")["tables"]["chat"]["high_water"] == tables["chat"].agg(F.max("rowid")).first()[0]
    assert open_published(spark, root, "chat").count() == tables["chat"].count()
    with pytest.raises(MigrationRefused, match="occupied"):
        migration.migrate(spark, tables, {}, root, "v1")


def test_a_migration_with_foreign_or_wrong_rows_is_not_published(spark, tmp_path):
    from logtide.plans import migration
    from logtide.plans.writes import begin_version
    tables, root = source(spark), str(tmp_path)
    folder = begin_version(spark, root, "v1")
    spark.range(1).write.parquet(f"{folder}/stray")
    with pytest.raises(MigrationRefused, match="stray"):
        migration.migrate(spark, tables, {}, root, "v1")


CHAT = {"chat": {"message": Codec(lambda c: F.concat(F.lit("<"), c), lambda c: F.when(c == "''", "odd"))}}


def test_encoded_tables_are_compared(spark, tmp_path, monkeypatch):
    from logtide.plans import migration
    from logtide.plans.writes import NotPublished, open_published
    write = ParquetStore.write

    def damaging(self, df, name, *a):
        write(self, df.withColumn("message", F.when(F.col("rowid") != 1, F.col("message"))) if name == "chat" else df, name, *a)
    with monkeypatch.context() as patched:
        patched.setattr(ParquetStore, "write", damaging)
        with pytest.raises(MigrationRefused, match="chat"):
            migration.migrate(spark, source(spark), {}, str(tmp_path), "v1", codecs=CHAT)
    with pytest.raises(NotPublished):
        open_published(spark, str(tmp_path), "chat")


@pytest.mark.parametrize("sample", [False, True])
def test_a_resumed_migration_carries_rejects_and_no_stale_rows(spark, tmp_path, sample):
    from pyspark.errors import PySparkException

    from logtide.plans import migration
    from logtide.plans.writes import manifest, open_published
    tables, root = source(spark), str(tmp_path)
    tables["entity"] = spark.range(3).select(F.col("id").alias("rowid"), F.raise_error(F.lit("gone")).cast("string").alias("v"))
    with pytest.raises(PySparkException):
        migration.migrate(spark, tables, {}, root, "v1", sample, codecs=CHAT)
    tables["entity"] = spark.range(3).select(F.col("id").alias("rowid"), F.lit("v").alias("v"))
    tables["block"] = tables["block"].withColumn("Data", F.col("Data") + 1)
    migration.migrate(spark, tables, {}, root, "v1", sample, codecs=CHAT)
    found = manifest(spark, root, "v1")["tables"]
    assert found["chat"]["rejects"] == 1 and found["block"]["rejects"] == 0
    assert {r["rowid"]: r["message"] for r in open_published(spark, root, "chat").collect()} == {1: "<tab\there", 2: "''", 3: "<", 4: None, 5: "<名前🙂"}
    assert sorted(r["Data"] for r in open_published(spark, root, "block").collect()) == [1 - 2**31, 6, 8]


def test_a_migration_compares_tables_at_the_same_time(spark, tmp_path, monkeypatch):
    import threading

    from logtide.plans import migration
    both, compare = threading.Barrier(2), migration.validate
    met = []

    def meeting(*a, **b):
        if not met:
            met.append(both.wait(60))
        return compare(*a, **b)
    monkeypatch.setattr(migration, "validate", meeting)
    assert {r["verdict"] for r in migration.migrate(spark, source(spark), {}, str(tmp_path), "v1").collect()} == {"ok"}
