"""Referential clean-up after a purge. Only rows that can change are joined; the rest pass straight through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions.times import expired, kept
from logtide.operators.stats import union_all


def _keys(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values; duplicates combine before the shuffle, so a hot key is one row."""
    return df.select(F.col(column).alias("key")).filter(F.col("key").isNotNull()).distinct()


def _keys_of_all(children: list[tuple[DataFrame, str]]) -> DataFrame:
    """The distinct non-null values of all children's links, made distinct once."""
    return _keys(union_all([child.select(F.col(fk).alias("key")) for child, fk in children]), "key")


def _parents(parents: DataFrame, pk: str) -> DataFrame:
    return parents.select(F.col(pk).alias("key"))


def dangling(df: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    """Rows with a link to a parent that is gone."""
    linked = df.filter(F.col(fk).isNotNull())
    return linked.join(_parents(parents, pk), F.col(fk) == F.col("key"), "left_anti")


def clear_links(df: DataFrame, fk: str, parents: DataFrame, pk: str) -> DataFrame:
    """Null the link of rows whose parent is gone, whatever their age. Rows without a link skip the join."""
    columns = df.columns
    unlinked = df.filter(F.col(fk).isNull())
    linked = (df.filter(F.col(fk).isNotNull())
              .join(_keys(parents, pk), F.col(fk) == F.col("key"), "left"))
    cleared = F.when(F.col("key").isNotNull(), F.col(fk)).alias(fk)
    return unlinked.unionByName(linked.select(*[cleared if c == fk else F.col(f"`{c}`") for c in columns]))


def clear_all_links(df: DataFrame, links: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """`clear_links` for several links (column, parents, parents' id) at once, in two scans instead of two per link.

    Rows without any link skip the joins. Rows that lack one of several links would share its null in
    a shuffle; each gets a key of its own that no parent can match, so they spread evenly.
    """
    columns = df.columns
    linked_to = [F.col(fk).isNotNull() for fk, _, _ in links]
    some = linked_to[0]
    for one in linked_to[1:]:
        some = some | one
    rows = df.filter(some)
    cleared = {}
    for n, (fk, parents, pk) in enumerate(links):
        spread = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
        rows = rows.withColumn(f"probe{n}", F.coalesce(fk, spread)).withColumn(f"lacks{n}", F.col(fk).isNull())
        found = _keys(parents, pk).select(F.col("key").alias(f"key{n}"), F.lit(False).alias(f"met{n}"))
        rows = rows.join(found, (F.col(f"probe{n}") == F.col(f"key{n}")) & (F.col(f"lacks{n}") == F.col(f"met{n}")), "left")
        cleared[fk] = F.when(F.col(f"key{n}").isNotNull(), F.col(fk)).alias(fk)
    return df.filter(~some).unionByName(rows.select(*[cleared.get(c, F.col(f"`{c}`")) for c in columns]))


def orphans(df: DataFrame, fk: str, parents: DataFrame, pk: str, time: str, cutoff: int) -> DataFrame:
    """Expired rows whose parent is gone; a null link counts as gone and skips the join."""
    old = df.filter(expired(df, time, cutoff))
    linked = old.filter(F.col(fk).isNotNull()).join(_parents(parents, pk), F.col(fk) == F.col("key"), "left_anti")
    return linked.unionByName(old.filter(F.col(fk).isNull()))


def purge_orphans(df: DataFrame, fk: str, parents: DataFrame, pk: str, time: str, cutoff: int) -> DataFrame:
    """Rows left without the orphans. Unexpired rows, usually most of the table, are not joined."""
    owned = (df.filter(expired(df, time, cutoff) & F.col(fk).isNotNull())
             .join(_parents(parents, pk), F.col(fk) == F.col("key"), "left_semi"))
    return df.filter(kept(df, time, cutoff)).unionByName(owned)


def unreferenced(df: DataFrame, pk: str, children: list[tuple[DataFrame, str]], where: Column, time: str,
                 cutoff: int) -> DataFrame:
    """Expired rows that meet `where` and that no child refers to."""
    rows = df.filter(expired(df, time, cutoff) & where)
    return rows.join(_keys_of_all(children), F.col(pk) == F.col("key"), "left_anti") if children else rows


def purge_unreferenced(df: DataFrame, pk: str, children: list[tuple[DataFrame, str]], where: Column, time: str,
                       cutoff: int, keep: Column | None = None) -> DataFrame:
    """Rows left without the unreferenced ones. `keep` spares rows, such as the newest."""
    where = where if keep is None else where & ~keep
    candidate = F.coalesce(expired(df, time, cutoff) & where, F.lit(False))
    spared = df.filter(candidate).join(_keys_of_all(children), F.col(pk) == F.col("key"), "left_semi")
    return df.filter(~candidate).unionByName(spared)
