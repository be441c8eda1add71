"""Versions of a fork: releases and development builds of an upstream version."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UPSTREAM = r"([0-9]{1,9})\.([0-9]{1,9})(?:\.([0-9]{1,9}))?"


def version_struct(text: Column, suffix: str) -> Column:
    """struct(p1, p2, p3, is_dev, revision, commits, dirty) in version order, or null for other texts.

    A release is `<upstream>-<suffix><revision>`, a development build
    `<upstream>-<commits>-g<hex>[-dirty]-<suffix>-dev`.
    """
    release = rf"\A{UPSTREAM}-{suffix}([0-9]{{1,9}})\z"
    dev = rf"\A{UPSTREAM}-([0-9]{{1,9}})-g[0-9a-f]{{7,40}}(-dirty)?-{suffix}-dev\z"

    def number(pattern: str, group: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("int"), F.lit(0))

    def built(pattern: str, is_dev: bool) -> Column:
        return F.struct(
            number(pattern, 1).alias("p1"), number(pattern, 2).alias("p2"), number(pattern, 3).alias("p3"),
            F.lit(is_dev).alias("is_dev"),
            (F.lit(-1) if is_dev else number(pattern, 4)).alias("revision"),
            (number(pattern, 4) if is_dev else F.lit(-1)).alias("commits"),
            (F.regexp_extract(text, pattern, 5) != "" if is_dev else F.lit(False)).alias("dirty"))

    return F.when(text.rlike(release), built(release, False)).when(text.rlike(dev), built(dev, True))


def declared_numbers(text: Column) -> Column:
    """struct(p1, p2, p3) of a declared version, up to its first dash; null if it isn't two or three numbers."""
    own = F.regexp_extract(text, r"\A([^-]*)", 1)
    whole = rf"\A{UPSTREAM}\z"
    parts = [F.coalesce(F.regexp_extract(own, whole, i).try_cast("int"), F.lit(0)).alias(f"p{i}") for i in (1, 2, 3)]
    return F.when(own.rlike(whole), F.struct(*parts))
