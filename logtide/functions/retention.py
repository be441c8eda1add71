"""Retention texts such as `30d`, `1mo2w` or `4w,2d`, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Seconds per unit, the accepted amounts, and the bounds of a retention.
UNIT_SECONDS = {"y": 31_536_000, "mo": 2_592_000, "w": 604_800, "d": 86_400, "h": 3_600, "m": 60, "s": 1}
AMOUNT = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
UNIT = "(?:mo|y|w|d|h|m|s)"
MINIMUM_SECONDS = 30 * 86_400
MAXIMUM_SECONDS = 1000 * 365 * 86_400

_EDGES = r"\A[\x00-\x20]+|[\x00-\x20]+\z"
_SPACE = r"[ \t\n\x0B\f\r]*"
_WHOLE = rf"\A{AMOUNT}{_SPACE}{UNIT}(?:{_SPACE}(?:,{_SPACE})?{AMOUNT}{_SPACE}{UNIT})*\z"
_PART = rf"({AMOUNT}){_SPACE}({UNIT})"


def clean(text: Column) -> Column:
    """Lower case, without surrounding blanks or a trailing comment."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), _EDGES, "")
    bare = F.regexp_replace(bare, r"[ \t\n\x0B\f\r]+#.*$", "")
    return F.lower(F.regexp_replace(bare, _EDGES, ""))


def _seconds(amount: Column, unit: Column) -> Column:
    """One part in decimal seconds. More than 12 whole digits are past the cap whatever the unit."""
    whole = F.length(F.regexp_replace(amount, r"\A0+|\..*\z", ""))
    # 16 decimals are exact; any digit beyond them rounds up, as the total does
    short = F.regexp_replace(amount, r"(\.[0-9]{16})[0-9]+", "$1")
    more = F.when(amount.rlike(r"\.[0-9]{16}[0-9]*[1-9]"), F.lit("0.0000000000000001")).otherwise(F.lit("0"))
    exact = (F.when(whole > 12, F.lit("0")).otherwise(short).cast("decimal(28,16)")
             + more.cast("decimal(28,16)")).cast("decimal(28,16)")
    factor = F.lit(None).cast("decimal(8,0)")
    for name, seconds in UNIT_SECONDS.items():
        factor = F.when(unit == name, F.lit(seconds).cast("decimal(8,0)")).otherwise(factor)
    return F.when(whole > 12, F.lit(MAXIMUM_SECONDS).cast("decimal(36,16)")).otherwise(
        (exact * factor).cast("decimal(36,16)"))


def retention(text: Column) -> Column:
    """struct(seconds, problem): 0 seconds and no problem when turned off, rounded up, capped at 1000 years.

    A text that is no retention, or shorter than 30 days, gives 0 seconds and a problem.
    """
    bare = clean(text)
    off = bare.isin("", "false")
    valid = bare.rlike(_WHOLE)
    parts = F.arrays_zip(F.regexp_extract_all(bare, F.lit(_PART), 1).alias("amount"),
                         F.regexp_extract_all(bare, F.lit(_PART), 2).alias("unit"))
    total = F.aggregate(
        parts, F.lit(0).cast("decimal(36,16)"),
        lambda sum, part: F.least(sum + _seconds(part["amount"], part["unit"]),
                                  F.lit(MAXIMUM_SECONDS).cast("decimal(36,16)")).cast("decimal(36,16)"))
    seconds = F.when(valid & ~off, F.ceil(total).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    problem = (F.when(off, F.lit(None)).when(~valid, "not a retention time")
               .when(seconds < MINIMUM_SECONDS, "below the minimum"))
    return F.struct(F.when(problem.isNull(), seconds).otherwise(F.lit(0).cast("bigint")).alias("seconds"),
                    problem.alias("problem"), seconds.alias("parsed"))
