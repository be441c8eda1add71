"""Copying every table of a store to a new version of another, and proving the copy."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.operators.diff import diff_pruned, diff_sample
from logtide.operators.encode import Codec, encode
from logtide.operators.sample import sample_plan, sample_ranges
from logtide.operators.stats import high_water, stats_verdict, table_stats
from logtide.plans.writes import MANIFEST, begin_version, complete_version
from logtide.session import written
from logtide.sources.files import exists, read_json, write_json
from logtide.sources.stores import ParquetStore
from logtide.specs import CORE_TABLES, LOOKUP_KEY_PREFIX, NEVER_COPIED, copy_order, is_reference

#: Tables copied at the same time; Spark's scheduler shares the executors among them.
PARALLEL_TABLES = 4
#: A version's folder of the tables that have arrived.
LEDGER = "_arrived"


class MigrationRefused(Exception):
    pass


def match_columns(source: list[str], target: list[str], table: str) -> list[tuple[str, str]]:
    """Source columns with the target's names for them, without regard to case or order.

    Lookup keys that only the source has are left behind; any other column must exist in the target.
    """
    there = {name.lower(): name for name in target}
    pairs = []
    for name in source:
        if name.lower() in there:
            pairs.append((name, there[name.lower()]))
        elif not name.startswith(LOOKUP_KEY_PREFIX):
            raise MigrationRefused(f"table {table} of the target has no column {name}")
    return pairs


def check_source(tables: list[str], core: list[str] = CORE_TABLES) -> None:
    missing = [name for name in core if name not in tables]
    if missing:
        raise MigrationRefused(f"the source has no table {', '.join(missing)}")


@dataclass(frozen=True)
class TablePlan:
    name: str
    id: str
    columns: list[tuple[str, str]]
    rows: int
    max_id: int
    sampled: bool


@dataclass
class CopyResult:
    plans: list[TablePlan]
    rejects: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(p.rows for p in self.plans)


def plan_copy(sources: dict[str, DataFrame], ids: dict[str, str], targets: dict[str, list[str]] | None = None,
              skip: tuple[str, ...] = (), sample: bool = False, core: list[str] = CORE_TABLES) -> list[TablePlan]:
    """What to copy, in order. Counts every table before anything is written; an empty source is refused.

    `sample` asks for a comparison of about 1% of every table but reference tables; without it all rows are compared.
    """
    check_source(list(sources), core)
    plans, total = [], 0
    counted = {name: (df, ids.get(name, "rowid")) for name, df in sources.items() if name != NEVER_COPIED}
    stats = {r["table"]: (r["rows"], r["max_id"]) for r in table_stats(counted).collect()}
    for name in copy_order(counted):
        df, id = counted[name]
        rows, highest = stats[name]
        total += rows
        if name in skip:
            continue
        wanted = targets[name] if targets else [c for c in df.columns if not c.startswith(LOOKUP_KEY_PREFIX)]
        plans.append(TablePlan(name, id, match_columns(df.columns, wanted, name), rows, highest,
                               sample and not is_reference(name)))
    if total == 0:
        raise MigrationRefused("the source holds no data")
    return plans


def copied(df: DataFrame, plan: TablePlan, codecs: dict[str, Codec] | None = None, policy: str = "keep"):
    """(rows under the target's names, rejects) of one table, ids unchanged."""
    renamed = df.select(*[F.col(f"`{a}`").alias(b) for a, b in plan.columns])
    if not codecs:
        return renamed, None
    target_id = next(b for a, b in plan.columns if a == plan.id)
    return encode(renamed, target_id, codecs, plan.name, policy)


def copy_tables(sources: dict[str, DataFrame], store, plans: list[TablePlan],
                codecs: dict[str, dict[str, Codec]] | None = None, policy: str = "keep", replace: bool = False,
                arrived: Callable[[TablePlan, DataFrame | None], None] | None = None) -> CopyResult:
    """Write every planned table to a store, several at a time, and check the rows written.

    `replace` writes over what a copy that was stopped left; `arrived` is called with each table that is there and counted, and its rejects.
    """
    result = CopyResult(plans)

    def one(plan: TablePlan) -> None:
        rows, rejects = copied(sources[plan.name], plan, (codecs or {}).get(plan.name), policy)
        if rejects is not None:
            result.rejects[plan.name] = rejects
        target_id = next(b for a, b in plan.columns if a == plan.id)
        store.write(rows, plan.name, target_id, replace)
        written_rows = store.read(rows.sparkSession, plan.name).count()
        if written_rows != plan.rows:
            raise MigrationRefused(f"copied {written_rows} rows of table {plan.name}, which had {plan.rows}: "
                                   "something else changed the source")
        if arrived:
            arrived(plan, rejects)

    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        list(pool.map(one, plans))
    return result


def migrate(spark: SparkSession, sources: dict[str, DataFrame], ids: dict[str, str], root: str, version: str, sample: bool = False,
            allocated: DataFrame | None = None, core: list[str] = CORE_TABLES, codecs: dict[str, dict[str, Codec]] | None = None,
            policy: str = "keep") -> DataFrame:
    """Copy all tables to a new version of a parquet store, prove the copy, and only then publish it.

    A version that is complete, or a folder that is not a version, is refused as occupied. One that is incomplete is gone
    on with: its ledger names the tables that arrived, with the counts and ids they had in the source and how many values were rejected; others are
    written again, and so are those of an earlier run that no longer are what the source would be copied to. Then the source's statistics must be
    as they were planned, the target's equal to them with no further table, the high-water marks carried, and no compared row may differ from the
    source's, encoded where the table has codecs; tables of an earlier run are compared in full. Returns the verdicts, one row a table; the
    manifest holds counts, ids, marks and the number of rejected values.
    """
    folder = f"{root}/{version}"
    if exists(spark, folder):
        found = read_json(spark, f"{folder}/{MANIFEST}")
        if found is None or found["status"] == "complete":
            raise MigrationRefused(f"{folder} is occupied")
    else:
        begin_version(spark, root, version)
    plans = plan_copy(sources, ids, sample=sample, core=core)
    store, planned = ParquetStore(folder), {p.name: {"rows": p.rows, "max_id": p.max_id} for p in plans}
    ledger = {name: read_json(spark, f"{folder}/{LEDGER}/{name}.json") for name in planned}
    pending = [p for p in plans if ledger[p.name] != {**planned[p.name], "rejects": (ledger[p.name] or {}).get("rejects")} or not store.has(spark, p.name)]
    rejects = {name: entry["rejects"] for name, entry in ledger.items() if entry and "rejects" in entry}

    def arrived(plan: TablePlan, rejected: DataFrame | None) -> None:
        rejects[plan.name] = 0 if rejected is None else rejected.count()
        write_json(spark, f"{folder}/{LEDGER}/{plan.name}.json", {**planned[plan.name], "rejects": rejects[plan.name]})

    def differs(plan: TablePlan) -> bool:
        if {b for _, b in plan.columns} != set(store.read(spark, plan.name).columns):
            return True
        return not validate(sources[plan.name], store.read(spark, plan.name), plan, codecs=(codecs or {}).get(plan.name), policy=policy).isEmpty()

    def differing_of(some: list[TablePlan]) -> list[str]:
        """Names of the tables that differ; several are compared at the same time, as they are copied."""
        with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
            return [p.name for p, found in zip(some, pool.map(differs, some)) if found]

    earlier = [replace(p, sampled=False) for p in plans if p not in pending]
    stale = set(differing_of(earlier))
    pending += [p for p in plans if p.name in stale]
    for plan in pending:
        if ledger[plan.name]:
            write_json(spark, f"{folder}/{LEDGER}/{plan.name}.json", {})
    copy_tables(sources, store, pending, codecs, policy, replace=True, arrived=arrived)

    tables = {p.name: (sources[p.name], p.id) for p in plans}
    target = {name: (store.read(spark, name), tables[name][1]) for name in store.tables(spark) if name in tables}
    unplanned = [name for name in store.tables(spark) if name not in tables and name[0] not in "_."]
    if unplanned:
        raise MigrationRefused(f"unexpected tables in {folder}: {', '.join(unplanned)}")
    now, there = table_stats(tables), table_stats(target)
    if changed := [r["table"] for r in now.collect() if planned[r["table"]] != {"rows": r["rows"], "max_id": r["max_id"]}]:
        raise MigrationRefused(f"the source changed while it was copied: {', '.join(changed)}")
    verdicts = stats_verdict(now, now, there)
    wrong = [r["table"] for r in verdicts.filter("verdict <> 'ok'").collect()]
    compared = [p for p in plans if p in pending] + [p for p in earlier if p.name not in stale]
    differing = differing_of([p for p in compared if p.name not in wrong])
    if wrong or differing:
        raise MigrationRefused(f"the copy is not the source: {', '.join(wrong + differing)}")
    marks = {r["table"]: r["high_water"] for r in high_water(now, allocated).collect()}
    complete_version(spark, root, version, {r["table"]: {"rows": r["rows"], "min_id": r["min_id"], "max_id": r["max_id"], "high_water": marks[r["table"]],
                                                         "rejects": rejects[r["table"]]} for r in there.collect()})
    return verdicts


def validate(source: DataFrame, target: DataFrame, plan: TablePlan, seed: int = 0, codecs: dict[str, Codec] | None = None, policy: str = "keep") -> DataFrame:
    """Differences of one copied table to its source as `copied` encodes it: all rows, or about 1% where the plan asks for a sample."""
    target_id = next(b for a, b in plan.columns if a == plan.id)
    left, _ = copied(source, plan, codecs, policy)
    if not plan.sampled:
        # A copy is expected to be right almost everywhere: shuffle only what its digests cannot clear
        return diff_pruned(left, target, target_id)
    plan_rows = sample_plan(left.sparkSession, plan.rows, seed)
    ranges = written(sample_ranges(left, target_id, plan_rows))
    return diff_sample(left, target, target_id, ranges)
