"""Findings: text scans, drift against a reviewed baseline, allowances and the verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions.choice import first_of
from logtide.functions.texts import abbreviate, header
from logtide.functions.urls import hosts_in

#: Most to least severe.
SEVERITIES = ("FAIL", "REVIEW", "INFO")


@dataclass(frozen=True)
class Allowance:
    rule: str
    site: str
    reason: str


def host_inventory(df: DataFrame, text: str) -> DataFrame:
    """Distinct hosts of the URLs in a text column."""
    return df.select(F.explode(hosts_in(F.col(text))).alias("host")).distinct()


def suspicious_strings(df: DataFrame, site: str, text: str, keywords: list[str], min_run: int = 200,
                       prefixes: list[str] = ()) -> DataFrame:
    """Texts that mention a keyword, hold a long encoded-looking run, or start with a known prefix."""
    value = F.col(text)
    lower = F.lower(value)

    def finding(rule: str, detail: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))

    tests = [F.when(lower.contains(word), finding("keyword", F.concat(
        F.lit(f"mentions '{word}': "), abbreviate(value)))) for word in keywords]
    # Fixed value: the characters of an encoded run
    tests.append(F.when(value.rlike(f"[A-Za-z0-9+/=_-]{{{min_run}}}"), finding("encoded-run", F.concat(
        F.lit("long encoded-looking text: "), abbreviate(value)))))
    tests += [F.when(value.startswith(prefix), finding("prefix", F.concat(
        F.lit(f"starts with '{prefix}': "), abbreviate(value)))) for prefix in prefixes]
    return (df.select(F.col(site).cast("string").alias("site"),
                      F.explode(F.filter(F.array(*tests), lambda f: f.isNotNull())).alias("f"))
            .select("site", "f.rule", "f.detail"))


def header_fingerprint(df: DataFrame, id: str, text: str) -> DataFrame:
    """Distinct header hashes with how many texts share each and the first of them. Texts without a header are left out."""
    heads = df.select(F.col(id).alias("id"), header(F.col(text)).alias("header"))
    # Filter after grouping: before it, the header would be worked out once more for the filter
    return (heads.select("id", F.sha2("header", 256).alias("hash"), (F.col("header") == "").alias("bare")).groupBy("hash")
            .agg(F.count("*").alias("texts"), F.min("id").alias("first_id"), F.bool_or("bare").alias("bare"))
            .filter(~F.col("bare")).drop("bare"))


def inventory_drift(observed: DataFrame, baseline: DataFrame) -> DataFrame:
    """Entries (field, entry) that no baseline line (line, field, entry) has, and accepted ones no longer observed."""
    now = observed.select("field", "entry").distinct()
    accepted = baseline.select("field", "entry").distinct()
    new = now.join(accepted, ["field", "entry"], "left_anti").select(
        F.lit("REVIEW").alias("severity"), "field", "entry", F.lit("new").alias("change"))
    gone = accepted.join(now, ["field", "entry"], "left_anti").select(
        F.lit("INFO").alias("severity"), "field", "entry", F.lit("no longer present").alias("change"))
    return new.unionByName(gone)


def _reviewed(pairs: DataFrame) -> DataFrame:
    """Per key: `v1 (lineA, lineB) or v2 (lineC)`. Baselines are reviewed by hand, so groups are small."""
    values = pairs.groupBy("key", "value").agg(F.array_join(F.array_sort(F.collect_set("line")), ", ").alias("lines"))
    each = F.struct("value", F.concat("value", F.lit(" ("), "lines", F.lit(")")).alias("text"))
    return values.groupBy("key").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(each)), lambda s: s["text"]), " or ").alias("reviewed"))


def keyed_drift(observed: DataFrame, baseline: DataFrame, gone_prefix: str = "") -> DataFrame:
    """Drift of `key=value` entries: observed (key, value) against baseline (line, entry).

    A pair any line has is accepted. Keys and values may hold `=`, so a baseline entry counts under
    every key it could be of. Only baseline keys that start with `gone_prefix` are missed.
    """
    entry = F.concat("key", F.lit("="), "value")
    now = observed.select("key", "value").distinct()
    cuts = F.expr("filter(sequence(1, length(entry)), i -> substring(entry, i, 1) = '=')")
    pairs = (baseline.select("line", "entry", F.explode(cuts).alias("cut"))
             .select("line", F.expr("substring(entry, 1, cut - 1)").alias("key"),
                     F.expr("substring(entry, cut + 1)").alias("value")))
    reviewed = _reviewed(pairs)
    fresh = (now.withColumn("entry", entry)
             .join(baseline.select("entry").distinct(), "entry", "left_anti")
             .join(reviewed, "key", "left")
             .select("key", F.when(F.col("reviewed").isNull(), "new").otherwise("changed").alias("change"),
                     F.when(F.col("reviewed").isNull(), F.concat(F.lit("new: "), "value"))
                     .otherwise(F.concat(F.lit("changed from "), "reviewed", F.lit(" to "), "value")).alias("detail")))
    first_key = F.regexp_extract("entry", r"\A([^=]*)", 1)
    listed = baseline.select(first_key.alias("key")).distinct().filter(F.col("key").startswith(gone_prefix))
    gone = (listed.join(now.select("key").distinct(), "key", "left_anti").join(reviewed, "key", "left")
            .select("key", F.lit("gone").alias("change"),
                    F.concat(F.lit("no longer present; was "), F.coalesce("reviewed", F.lit(""))).alias("detail")))
    return fresh.unionByName(gone)


def apply_allowances(findings: DataFrame, allowances: list[Allowance]) -> DataFrame:
    """Each finding (severity, rule, site, detail) once, as INFO with the reason if an allowance covers its site.

    Allowances are configuration: a trailing `*` matches by prefix, and the first that fits wins.
    A finding reported under several severities counts as the most severe. With a column
    `allowed_site`, an allowance must name that instead of the site; with a column `resolution`,
    what resolves the finding stays with it unless it is allowed or only for the record.
    """
    extra = [c for c in ("allowed_site", "resolution") if c in findings.columns]
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    once = findings.groupBy("rule", "site", "detail").agg(
        F.min(rank).alias("rank"), *[F.min_by(c, rank).alias(c) for c in extra])
    def covers(a: Allowance) -> Column:
        named = F.col("allowed_site" if "allowed_site" in extra else "site")
        site = named.startswith(a.site[:-1]) if a.site.endswith("*") else named == a.site
        return (F.col("rule") == a.rule) & site

    reason = first_of([(covers(a), F.lit(a.reason)) for a in allowances], F.lit(None).cast("string"))
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank").cast("int"))
    resolution = [F.when(F.col("reason").isNull() & (severity != "INFO"), F.col("resolution")).alias("resolution")]
    return once.withColumn("reason", reason).select(
        F.when(F.col("reason").isNotNull(), "INFO").otherwise(severity).alias("severity"), "rule", "site",
        F.when(F.col("reason").isNotNull(), F.concat("detail", F.lit(" (allowed: "), "reason", F.lit(")")))
        .otherwise(F.col("detail")).alias("detail"), *(resolution if "resolution" in extra else []))


def audit_verdict(findings: DataFrame) -> DataFrame:
    """Findings per severity and whether the audit failed or needs a review."""
    once = findings.select("severity", "rule", "site", "detail").distinct()
    counts = once.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    return counts.select("*", (F.col("fail") > 0).alias("failed"), (F.col("review") > 0).alias("review_required"))
