"""Purges that stop after each step, or in the middle of one, and go on."""

import pytest
from pyspark.sql import functions as F

from logtide.plans import resumable
from logtide.plans.purge import LinkGraph, purge_cascade
from logtide.plans.resumable import purge_state, resumable_purge
from logtide.sources.files import exists, folders

CUTOFF, OLD, NEW = 1_000_000, 999_999, 1_000_001
SPAWN = "rowid bigint, time bigint, kill_rowid bigint, block_rowid bigint, removed int, note string"
ROWS = {
    "entity": [(k, OLD if k % 3 else NEW) for k in range(1, 13)], "block": [(k, OLD if k % 4 else NEW) for k in range(1, 13)] + [(90, None), (91, -5)],
    "entity_spawn": [(k, (OLD, NEW, None)[k % 3], (None, k % 12 + 1, 77)[k % 2 + k % 5 // 4], (None, k % 9 + 1)[k // 2 % 2], k // 3 % 2, f"n{k}") for k in range(1, 61)],
    "entity_interaction": [(k, (OLD, NEW)[k % 2], (k % 40 + 30, None)[k % 7 == 0]) for k in range(1, 40)],
    "entity_container": [(k, (OLD, NEW)[k % 2], k * 2) for k in range(1, 50)],
}
SCHEMAS = {"entity": "rowid bigint, time bigint", "block": "rowid bigint, time bigint", "entity_spawn": SPAWN,
           "entity_interaction": "rowid bigint, time bigint, entity_spawn_rowid bigint", "entity_container": "rowid bigint, time bigint, entity_spawn_rowid bigint"}
STEPS = ["expire block", "expire entity", "orphans entity_interaction", "orphans entity_container", "hub entity_spawn"]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    for name, rows in ROWS.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{root}/{name}")
    return {name: f"{root}/{name}" for name in ROWS}


def read(spark, tables):
    return {name: sorted((tuple(r) for r in spark.read.parquet(path).collect()), key=str) for name, path in tables.items()}


@pytest.fixture(scope="module")
def whole(spark, sources):
    """Tables and report of the steps that are not stored."""
    found = {}
    for newest in (False, True):
        purge = purge_cascade({n: spark.read.parquet(p) for n, p in sources.items()}, ["block", "entity"], LinkGraph(), CUTOFF, keep_newest=newest)
        found[newest] = ({n: sorted((tuple(r) for r in df.collect()), key=str) for n, df in purge.tables.items()},
                         {(r["table"], r["kind"]): r["rows"] for r in purge.report().collect()})
    return found


def run(spark, root, sources, cutoff=CUTOFF, **options):
    return resumable_purge(spark, str(root), sources, ["block", "entity"], LinkGraph(), cutoff, **options)


@pytest.mark.parametrize("newest", [False, True])
def test_unbroken(spark, sources, whole, tmp_path, newest):
    asked = []
    done = run(spark, tmp_path, sources, keep_newest=newest, stop=lambda s: asked.append(s))
    tables, counts = whole[newest]
    assert asked == STEPS and done.stopped is None and not done.orphans_pending
    assert read(spark, done.tables) == tables
    assert {(r["table"], r["kind"]): r["rows"] for r in done.report(spark).collect()} == counts
    assert {(r["table"], r["left"]) for r in done.report(spark).collect()} == {(n, len(rows)) for n, rows in tables.items()}
    assert len(folders(spark, str(tmp_path))) == 5  # what no table is in any more is gone
    assert read(spark, sources) == {n: sorted(rows, key=str) for n, rows in ROWS.items()}


@pytest.mark.parametrize("step", STEPS)
def test_stopped_before_each_step(spark, sources, whole, tmp_path, step):
    stopped = run(spark, tmp_path, sources, stop=lambda s: s == step)
    assert stopped.stopped == step and stopped.orphans_pending == (step != STEPS[0])
    assert [s["state"] for s in stopped.steps].count("done") == STEPS.index(step)
    before = read(spark, stopped.tables)  # the tables of the last finished step, whole
    assert before["entity_spawn"] == sorted(ROWS["entity_spawn"], key=str)
    done = run(spark, tmp_path, sources)
    assert read(spark, done.tables) == whole[False][0]
    assert {(r["table"], r["kind"]): r["rows"] for r in done.report(spark).collect()} == whole[False][1]


@pytest.mark.parametrize("late", [False, True])
@pytest.mark.parametrize("number", range(5))
def test_cut_off_inside_each_step(spark, sources, whole, tmp_path, monkeypatch, number, late):
    """The process ends before the step's folder is written, or after it and before it is noted."""
    write, calls = resumable._write, []

    def fails(df, folder):
        calls.append(folder)
        if len(calls) - 1 != number:
            return write(df, folder)
        if late:
            write(df, folder)
        raise RuntimeError("cut off")
    monkeypatch.setattr(resumable, "_write", fails)
    with pytest.raises(RuntimeError):
        run(spark, tmp_path, sources)
    state = purge_state(spark, str(tmp_path))
    assert [s["state"] for s in state["steps"]].count("started") == 1 and state["running"]
    assert set(read(spark, state["tables"])) == set(ROWS)
    monkeypatch.setattr(resumable, "_write", write)
    done = run(spark, tmp_path, sources)
    assert read(spark, done.tables) == whole[False][0] and not exists(spark, calls[-1])
    assert {(r["table"], r["kind"]): r["rows"] for r in done.report(spark).collect()} == whole[False][1]


def test_pending_orphans_survive_another_cutoff(spark, sources, whole, tmp_path):
    """Rows went, their orphans did not: a run with a cutoff that removes nothing still cleans up."""
    first = run(spark, tmp_path, sources, stop=lambda s: s.startswith("orphans"))
    assert first.orphans_pending
    second = run(spark, tmp_path, sources, cutoff=CUTOFF - 1, tracked=None)
    assert second.removed() == 0 and second.orphans_pending  # not known whether there are any: looked for again
    third = run(spark, tmp_path, sources, cutoff=CUTOFF)
    assert [s["name"] for s in third.steps] == ["expire", "expire", "orphans", "orphans", "hub"] and not third.orphans_pending
    assert read(spark, third.tables) == whole[False][0]
    again = run(spark, tmp_path, sources)
    assert again.removed() == 0 and [s["name"] for s in again.steps] == ["expire", "expire"]
    assert read(spark, again.tables) == whole[False][0]


def test_nothing_tracked_and_no_cutoff(spark, sources, tmp_path):
    done = run(spark, tmp_path / "a", sources, tracked=False)
    assert [s["name"] for s in done.steps] == ["expire", "expire"] and not done.orphans_pending
    nothing = run(spark, tmp_path / "b", sources, cutoff=0)
    assert nothing.steps == [] and nothing.tables == sources


def test_many_ids_are_joined(spark, sources, whole, tmp_path, monkeypatch):
    monkeypatch.setattr(resumable, "BROADCAST_IDS", 3)
    assert read(spark, run(spark, tmp_path, sources).tables) == whole[False][0]


def test_each_table_is_scanned_once_a_step(spark, sources):
    left = {n: spark.read.parquet(p) for n, p in sources.items()}
    plans = {"entity_spawn": resumable.hub_actions(left["entity_spawn"], LinkGraph(), left, CUTOFF),
             "entity_container": resumable.orphan_actions(left["entity_container"], "entity_spawn_rowid", left["entity_spawn"], "rowid", "time", CUTOFF)}
    for name, actions in plans.items():
        plan = actions.filter(F.col(resumable.ACTION) != "remove")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("note#" if name == "entity_spawn" else "entity_spawn_rowid#") and plan.count("parquet") == (5 if name == "entity_spawn" else 2)
