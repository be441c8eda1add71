"""A purge of stored tables that may stop anywhere and go on: a journal of steps, each one pass over one table.

The state is one small file, replaced atomically: where each table is, and the run's steps. A step notes the folder it
is going to write, writes the table's next version there, and notes what it removed together with the table's new place.
Whatever happens between two notes, the tables are those of the last finished step:

    planned -> started (folder noted) -> done (counts noted, table moved)

A step found `started` was cut off: its folder goes and it begins again. A run with the cutoff of the one that was cut
off goes on with that run's steps; one with another cutoff begins anew on the tables as they are, and remembers that
orphans may be left. What a step does to each row is one column, and its counts are observed as the rows are
written, in the stage that writes, so that a repeated task does not count twice: the report needs no scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from logtide.functions.times import expired
from logtide.plans.purge import EXPIRED, LINKS, ORPHANED, LinkGraph
from logtide.session import fits
from logtide.sources.files import delete, read_json, write_json
from logtide.specs import REFERENCED_TABLES

STATE = "_purge.json"
ACTION = "purge_action"
KEEP, CLEAR, REMOVE = "keep", "clear", "remove"
#: Distinct ids up to this count (some 16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Outcome:
    """`tables` are where the last finished step left them; `stopped` names the step that was not begun."""
    tables: dict[str, str]
    steps: list[dict]
    stopped: str | None
    orphans_pending: bool

    def removed(self) -> int:
        return sum(step["counts"].get(REMOVE, 0) for step in self.steps if step["state"] == "done")

    def report(self, spark: SparkSession) -> DataFrame:
        """(table, kind, rows, left) of each finished step: rows removed or changed, and the rows the table has since."""
        rows = [(s["table"], s["kind"], s["counts"][CLEAR if s["kind"] == LINKS else REMOVE], s["counts"]["rows"] - s["counts"][REMOVE])
                for step in self.steps if step["state"] == "done" for s in _lines(step)]
        return spark.createDataFrame(rows, "table string, kind string, rows bigint, left bigint")


def _lines(step: dict) -> list[dict]:
    """A step on the hub clears links and removes rows: two lines of the report."""
    kinds = [LINKS, ORPHANED] if step["name"] == "hub" else [EXPIRED if step["name"] == "expire" else ORPHANED]
    return [{**step, "kind": kind} for kind in kinds]


# What happens to each row

def _ids(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.col(column).alias(name)).filter(F.col(name).isNotNull()).distinct()


def _met(df: DataFrame, probe: Column, ids: DataFrame, name: str, applies: Column) -> DataFrame:
    """The rows with a flag `name`: whether `ids` has the probe. Each row once, whatever the sizes.

    Few ids are broadcast, and the table passes without a shuffle. Of more, rows the question does not apply to get a key
    of their own, so that they do not meet in one task.
    """
    key, met = f"{name}_key", ids.select(F.col(ids.columns[0]).alias(f"{name}_id"), F.lit(True).alias(f"{name}_met"))
    if fits(ids, BROADCAST_IDS):
        joined = df.withColumn(key, F.when(applies, probe)).join(F.broadcast(met), F.col(key) == F.col(f"{name}_id"), "left")
    else:
        spread = F.concat_ws(":", F.lit("-"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string"))
        keyed = df.withColumn(key, F.when(applies, probe.cast("string")).otherwise(spread))
        joined = keyed.join(met, F.col(key) == F.col(f"{name}_id").cast("string"), "left")
    return joined.withColumn(name, F.coalesce(f"{name}_met", F.lit(False))).drop(key, f"{name}_id", f"{name}_met")


def _newest(df: DataFrame, id: str, keep_newest: bool) -> Column:
    return F.col(id) == df.agg(F.max(id)).scalar() if keep_newest else F.lit(False)


def _action(removes: Column, clears: Column | None = None) -> Column:
    chosen = F.when(F.coalesce(removes, F.lit(False)), REMOVE)
    return (chosen if clears is None else chosen.when(clears, CLEAR)).otherwise(KEEP)


def expiry_actions(df: DataFrame, id: str, time: str, cutoff: int, keep_newest: bool = False) -> DataFrame:
    """The rows with their action: expired ones go, but for the newest where it is kept."""
    return df.withColumn(ACTION, _action(expired(df, time, cutoff) & ~F.coalesce(_newest(df, id, keep_newest), F.lit(False))))


def orphan_actions(df: DataFrame, fk: str, parents: DataFrame, pk: str, time: str, cutoff: int) -> DataFrame:
    """Expired rows go whose parent is gone, or that name none."""
    old = F.coalesce(expired(df, time, cutoff), F.lit(False))
    told = _met(df, F.col(fk), _ids(parents, pk, "parent"), "purge_owned", old & F.col(fk).isNotNull())
    return told.withColumn(ACTION, _action(old & ~F.col("purge_owned"))).drop("purge_owned")


def hub_actions(df: DataFrame, graph: LinkGraph, left: dict[str, DataFrame], cutoff: int, keep_newest: bool = False) -> DataFrame:
    """One pass over the hub: links to parents that are gone are cleared whatever the row's age; expired rows go that are
    marked removed, have no link left and no child. `<link>_gone` tells which links were cleared."""
    id = graph.id(graph.hub)
    rows, unlinked, gone = df, F.col(graph.removed) == 1, []
    for fk, parent in graph.links:
        rows = _met(rows, F.col(fk), _ids(left[parent], graph.id(parent), "parent"), f"{fk}_found", F.col(fk).isNotNull())
        gone.append((fk, F.col(fk).isNotNull() & ~F.col(f"{fk}_found")))
        unlinked = unlinked & ~F.col(f"{fk}_found")
    candidate = F.coalesce(expired(df, graph.time(graph.hub), cutoff) & unlinked, F.lit(False)) & ~F.coalesce(_newest(df, id, keep_newest), F.lit(False))
    rows = rows.withColumn("purge_candidate", candidate)
    used = None
    for child, fk in graph.children:
        some = left[child].select(F.col(fk).cast("bigint").alias("used")).filter("used IS NOT NULL")
        used = some if used is None else used.unionByName(some)
    rows = _met(rows, F.col(id), used.distinct(), "purge_referred", F.col("purge_candidate")) if used is not None else rows.withColumn("purge_referred", F.lit(False))
    clears = F.lit(False)
    for fk, test in gone:
        rows = rows.withColumn(f"{fk}_gone", test)
        clears = clears | F.col(f"{fk}_gone")
    rows = rows.withColumn(ACTION, _action(F.col("purge_candidate") & ~F.col("purge_referred"), clears))
    for fk, _ in graph.links:
        rows = rows.withColumn(fk, F.when(~F.col(f"{fk}_gone"), F.col(fk)))
    return rows.select(*df.columns, ACTION, *[f"{fk}_gone" for fk, _ in graph.links])


# The journal

def _write(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)


def _settle(actions: DataFrame, columns: list[str], folder: str) -> dict[str, int]:
    """Write what stays, and return the counts that were observed on the way."""
    cleared = sum((F.count_if(c) for c in actions.columns if c.endswith("_gone") and c not in columns), F.lit(0))
    seen = Observation()
    watched = actions.observe(seen, F.count("*").alias("rows"), F.count_if(F.col(ACTION) == REMOVE).alias(REMOVE), cleared.alias(CLEAR))
    _write(watched.filter(F.col(ACTION) != REMOVE).select(*columns), folder)
    return {name: int(seen.get.get(name) or 0) for name in ("rows", REMOVE, CLEAR)}


def _planned(name: str, table: str) -> dict:
    return {"name": name, "table": table, "state": "planned"}


def purge_state(spark: SparkSession, root: str) -> dict | None:
    return read_json(spark, f"{root}/{STATE}")


def resumable_purge(spark: SparkSession, root: str, sources: dict[str, str], by_time: list[str], graph: LinkGraph, cutoff: int,
                    keep_newest: bool = False, tracked: bool | None = True, stop: Callable[[str], bool] = lambda step: False) -> Outcome:
    """Purge the tables (name -> folder) into versions under `root`, or go on with the purge that `root` has begun.

    `sources` count for tables that no run has written yet; they are never changed. `stop(step)` is asked before each step.
    `tracked` None: it is not known whether there are orphans, so a later run looks again.
    """
    path = f"{root}/{STATE}"
    state = purge_state(spark, root) or {"tables": {}, "pending": False, "steps": [], "retired": [], "cutoff": None, "running": False}
    state["tables"] = {**sources, **state["tables"]}

    def note() -> None:
        write_json(spark, path, state)

    def discard(step: dict) -> None:
        delete(spark, step.pop("folder"))
        step["state"] = "planned"

    for step in state["steps"]:
        if step["state"] == "started":
            discard(step)
    again = state["running"] and state["cutoff"] == [cutoff, keep_newest]
    if not again:
        state.update(cutoff=[cutoff, keep_newest], running=True, steps=[_planned("expire", name) for name in by_time] if cutoff > 0 else [])
    note()

    def current(name: str) -> DataFrame:
        return spark.read.parquet(state["tables"][name])

    def act(step: dict) -> DataFrame:
        table, newest = step["table"], keep_newest and step["table"] in REFERENCED_TABLES
        df = current(table)
        if step["name"] == "expire":
            return expiry_actions(df, graph.id(table), graph.time(table), cutoff, newest)
        if step["name"] == "orphans":
            return orphan_actions(df, dict(graph.children)[table], current(graph.hub), graph.id(graph.hub), graph.time(table), cutoff)
        parents = {name: current(name) for name in [p for _, p in graph.links] + [c for c, _ in graph.children]}
        return hub_actions(df, graph, parents, cutoff, newest)

    while True:
        step = next((s for s in state["steps"] if s["state"] == "planned"), None)
        if step is None and tracked and state["pending"] and not any(s["name"] == "hub" for s in state["steps"]):
            # Children first, by the hub's ids; then the hub, which clears links and rows in one pass
            state["steps"] += [_planned("orphans", child) for child, _ in graph.children] + [_planned("hub", graph.hub)]
            note()
            continue
        if step is None:
            break
        title = f"{step['name']} {step['table']}"
        if stop(title):
            return Outcome(dict(state["tables"]), state["steps"], title, state["pending"])
        step.update(state="started", folder=f"{root}/{step['table']}-{uuid.uuid4().hex}")
        note()
        columns = current(step["table"]).columns
        step["counts"] = _settle(act(step), columns, step["folder"])
        before = state["tables"][step["table"]]
        if before != sources.get(step["table"]):
            state["retired"].append(before)
        state["tables"][step["table"]] = step["folder"]
        step["state"] = "done"
        # Rows that are gone may have left orphans: remembered until they have been looked for
        state["pending"] = state["pending"] or (step["name"] == "expire" and step["counts"][REMOVE] > 0)
        if step["name"] == "hub":
            state["pending"] = False
        note()
    state["running"] = False
    if tracked is False:
        state["pending"] = False
    note()
    for folder in state["retired"]:
        delete(spark, folder)  # no table is there any more
    state["retired"] = []
    note()
    return Outcome(dict(state["tables"]), state["steps"], None, state["pending"])
