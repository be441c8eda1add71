"""Session settings the library is written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results or plans; everything else stays the cluster's.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side even if that costs a shuffle further up the plan.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Streams remember a day of ids: keep them off the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A JSON object may repeat a name; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "logtide", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


class NoSharedFolder(Exception):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, else what setCheckpointDir set.

    A folder of this machine is taken only where all tasks run on it; any other master is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise NoSharedFolder("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="logtide-")
    return _LOCAL[app]


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most `rows` rows; stops counting there."""
    return df.limit(rows + 1).count() <= rows


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    return f"{shared_dir(spark)}/logtide-work/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A small intermediate table that several jobs read, written to the shared folder.

    Its lineage ends there, lost executors cost nothing but a read, and the planner knows its size.
    """
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
