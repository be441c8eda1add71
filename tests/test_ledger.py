"""Batches committed once, whatever is cut off in between; streams on top of them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtide.plans import ledger as module
from logtide.plans.ledger import AnotherWriter, Identity, LedgerTable, OtherBatchPending, identity_of, write_batches
from logtide.plans.writes import RowsWithoutId, write_idempotent
from logtide.streaming.jobs import catch_up_with_ids, dedupe_exact, last_id, run_to_end

SCHEMA = "rowid bigint, v string"
ROWS = [(k if k % 5 else None, f"v{k}") for k in range(60)] + [(None, "v0"), (None, "v0"), (7, "again"), (-12, "below")]


class CutOff(Exception):
    pass


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_batches(spark, tmp_path):
    df, ledger = spark.createDataFrame(ROWS, SCHEMA), LedgerTable(spark, str(tmp_path))
    assert rows_of(ledger.read(SCHEMA)) == []
    with pytest.raises(FileNotFoundError):
        ledger.read()
    done = write_batches(ledger, df, "t", "rowid", 16)
    assert [r["rows"] for r in done] == [1, 13, 13, 13, 10, 14] and rows_of(ledger.read()) == sorted(ROWS, key=str)
    assert write_batches(ledger, df, "t", "rowid", 16) == done and len(ledger.commits()) == 6


@pytest.mark.parametrize("at", ["encode", "after encode", "publish", "after record"])
@pytest.mark.parametrize("batch", [0, 2, 5])
def test_cut_off(spark, tmp_path, monkeypatch, at, batch):
    """A batch is neither doubled nor lost, and one that is encoded is not encoded again."""
    df, ledger = spark.createDataFrame(ROWS, SCHEMA).coalesce(2), LedgerTable(spark, str(tmp_path))
    encoded, encode, create, gone = [], LedgerTable._encode, module.create_json, []

    def encodes(self, rows, folder):
        encoded.append(folder)
        if at == "encode" and len(encoded) == batch + 1:
            rows.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{self.root}/data/{folder}")
            raise CutOff
        encode(self, rows, folder)
        if at == "after encode" and len(encoded) == batch + 1:
            raise CutOff

    def creates(session, path, record):
        if at == "publish" and len(encoded) == batch + 1 and not gone:
            gone.append(1)
            raise CutOff
        made = create(session, path, record)
        if at == "after record" and len(encoded) == batch + 1 and not gone:
            gone.append(1)
            raise CutOff
        return made
    monkeypatch.setattr(LedgerTable, "_encode", encodes)
    monkeypatch.setattr(module, "create_json", creates)
    with pytest.raises(CutOff):
        write_batches(ledger, df, "t", "rowid", 16)
    committed = batch + (at == "after record")
    assert len(ledger.commits()) == committed and ledger.pending() is not None
    assert len(rows_of(ledger.read(SCHEMA))) == sum(r["rows"] for r in ledger.commits())
    if at != "after record":
        with pytest.raises(OtherBatchPending):
            ledger.write(Identity("t", ("v",), 1, 900, 900), lambda: df.limit(1))
    write_batches(LedgerTable(spark, str(tmp_path)), df, "t", "rowid", 16)
    assert rows_of(ledger.read()) == sorted(ROWS, key=str) and ledger.pending() is None
    assert len(encoded) == len(set(encoded)) == 6 + (at == "encode")


def test_two_writers(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(ROWS[:4], SCHEMA)
    one, other = LedgerTable(spark, str(tmp_path)), LedgerTable(spark, str(tmp_path))
    listed = module.names
    monkeypatch.setattr(module, "names", lambda spark, path: [] if path.endswith("_commits") else listed(spark, path))
    one.write(identity_of(df, "t", "rowid", "a"), lambda: df)
    with pytest.raises(AnotherWriter):  # it lists the records before the first was there
        other.write(identity_of(df, "t", "rowid", "b"), lambda: df)
    monkeypatch.undo()
    assert len(one.commits()) == 1 and rows_of(one.read()) == sorted(ROWS[:4], key=str)
    other.write(identity_of(df, "t", "rowid", "b"), lambda: df)
    assert one.read().count() == 8


def test_rows_without_id_are_refused_by_id_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(RowsWithoutId):
        write_idempotent(spark.createDataFrame([(1, "a"), (None, "x")], SCHEMA), path, "rowid")
    write_idempotent(spark.createDataFrame([(1, "a")], SCHEMA), path, "rowid")
    with pytest.raises(RowsWithoutId):
        write_idempotent(spark.createDataFrame([(2, "b"), (None, "y")], SCHEMA), path, "rowid")
    assert rows_of(spark.read.parquet(path).select("rowid", "v")) == [(1, "a")]


LOG, NOW = "key bigint, ts timestamp", 1_705_363_200


def feed(spark, folder, rows):
    made = [(k, None if t is None else dt.datetime.fromtimestamp(NOW + t, dt.timezone.utc)) for k, t in rows]
    spark.createDataFrame(made, LOG).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ids_without_gaps_over_restarts(spark, tmp_path, monkeypatch):
    folder, mark, ledger = str(tmp_path / "in"), str(tmp_path / "mark"), LedgerTable(spark, str(tmp_path / "out"))
    run = lambda: run_to_end(catch_up_with_ids(source(spark, folder).select("key"), "key", "rowid", 10, 500, ledger, mark))
    feed(spark, folder, [(k, 0) for k in (30, 12, 9, 25)])
    run()
    feed(spark, folder, [(k, 0) for k in (14, 11, 90, 10, None)])
    create = module.create_json

    def once(session, path, record):
        monkeypatch.setattr(module, "create_json", create)
        raise CutOff("between the rows and their record")
    monkeypatch.setattr(module, "create_json", once)
    with pytest.raises(Exception, match="between the rows"):
        run()
    assert rows_of(ledger.read()) == [(12, 501), (25, 502), (30, 503)] and ledger.pending()
    encode = LedgerTable._encode
    monkeypatch.setattr(LedgerTable, "_encode", lambda *a: pytest.fail("made again"))
    run()  # replays the batch: the rows as they were made
    monkeypatch.setattr(LedgerTable, "_encode", encode)
    assert rows_of(ledger.read()) == [(11, 504), (12, 501), (14, 505), (25, 502), (30, 503), (90, 506)]
    feed(spark, folder, [(5, 0)])
    feed(spark, folder, [(13, 0)])
    run()
    run()
    assert rows_of(ledger.read().filter("rowid > 506")) == [(13, 507)] and last_id(ledger, 500) == 507


def test_late_first_copies_stay_and_repeats_do_not(spark, tmp_path):
    folder, mark, ledger = str(tmp_path / "in"), str(tmp_path / "mark"), LedgerTable(spark, str(tmp_path / "out"))
    run = lambda: run_to_end(dedupe_exact(source(spark, folder), "key", "ts", NOW, ledger, mark))
    feed(spark, folder, [(1, 0), (2, 10), (2, 10), (3, 10**7), (None, 5), (8, None)])
    run()
    feed(spark, folder, [(1, 0), (4, -80_000_000), (5 << 40, -1), (None, 5)])  # years late, and in another bucket of ids
    run()
    feed(spark, folder, [(4, -80_000_000), (5 << 40, 0), (2, 11), (6, -7)])
    run()
    run()
    got = ledger.read().select("key")
    assert sorted((r.key for r in got.collect()), key=lambda k: (k is None, k)) == [1, 2, 4, 6, 5 << 40, None, None]
