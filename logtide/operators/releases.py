"""Ranking versions, choosing the newest release and telling who should update."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from logtide.functions.versions import declared_numbers, version_struct


def version_rank(df: DataFrame, text: str, suffix: str) -> DataFrame:
    """Distinct valid versions, oldest first, with `rank`; versions that compare equal share one.

    Only versions of one upstream version are sorted together; their offsets come from counts.
    """
    versions = (df.select(F.col(text).alias("version")).distinct()
                .withColumn("v", version_struct(F.col("version"), suffix)).filter(F.col("v").isNotNull()))
    series = ["v.p1", "v.p2", "v.p3"]
    sizes = (versions.select("v").distinct().groupBy(*[F.col(c).alias(c[2:]) for c in series])
             .agg(F.count("*").alias("n")))
    # Numbers before those of p1, then within p1: windows over upstream versions, not over builds
    majors = sizes.groupBy("p1").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("p1").rowsBetween(Window.unboundedPreceding, -1)
    majors = majors.select("p1", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inner = Window.partitionBy("p1").orderBy("p2", "p3").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(majors, "p1")
               .select("p1", "p2", "p3", (F.col("base") + F.col("within")).alias("before")))
    ranked = versions.withColumn("at", F.dense_rank().over(Window.partitionBy(*series).orderBy("v")))
    return (ranked.select("version", "v.*", "at").join(offsets, ["p1", "p2", "p3"])
            .select("version", "p1", "p2", "p3", "is_dev", "revision", "commits", "dirty",
                    (F.col("before") + F.col("at")).alias("rank")))


def newest_release(releases: DataFrame, suffix: str) -> DataFrame:
    """The newest listed release of each source (source, priority, tag, draft, prerelease, status)."""
    tag = F.regexp_replace("tag", r"\Av", "")
    listed = releases.filter(~F.coalesce("draft", F.lit(False)) & ~F.coalesce("prerelease", F.lit(False))
                             & (F.col("status").isNull() | (F.col("status") == "listed")))
    parsed = (listed.select("source", "priority", tag.alias("version"), version_struct(tag, suffix).alias("v"))
              .filter(F.col("v").isNotNull() & ~F.col("v.is_dev")))
    return parsed.groupBy("source").agg(F.min("priority").alias("priority"), F.max(F.struct("v", "version")).alias("best")).select(
        "source", "priority", F.col("best.version").alias("version"))


def first_source(newest: DataFrame) -> DataFrame:
    """The release of the source that comes first among those that name one."""
    return newest.agg(F.min(F.struct("priority", "source", "version")).alias("s")).select("s.*").filter(
        F.col("source").isNotNull())


def update_candidates(running: DataFrame, releases: DataFrame, text: str, release: str, suffix: str,
                      declared: str | None = None) -> DataFrame:
    """Per running version, the newest of `releases` if it is an update for it, else null.

    A release is offered what is newer; a development build only what has newer upstream numbers than
    its own and than the version its host declares. One newest release is compared, not every pair.
    """
    parsed = releases.select(F.col(release).alias("release"), version_struct(F.col(release), suffix).alias("v")).filter(
        F.col("v").isNotNull() & ~F.col("v.is_dev"))
    best = parsed.agg(F.max(F.struct("v", "release"))).scalar()
    rows = running.withColumn("v", version_struct(F.col(text), suffix)).withColumn("best", best)

    def numbers(of: str):
        return F.struct(F.col(f"{of}.p1").alias("p1"), F.col(f"{of}.p2").alias("p2"), F.col(f"{of}.p3").alias("p3"))

    host = numbers("v") if declared is None else F.coalesce(declared_numbers(F.col(declared)), numbers("v"))
    newer = F.col("best.v") > F.col("v")
    offered = newer & (~F.col("v.is_dev") | (numbers("best.v") > host))
    return rows.filter(F.col("v").isNotNull()).withColumn(
        "update", F.when(offered, F.col("best.release"))).drop("v", "best")
