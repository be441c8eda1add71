"""First-match URL routing, redirects and policy summaries. Nothing here shuffles but the summaries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions.choice import first_of
from logtide.functions.patterns import anchored, group_numbers, took_part
from logtide.functions.urls import normalize_url, url_parts

ACTIONS = ("BLOCK", "ANSWER", "REDIRECT", "PASSTHROUGH")


@dataclass(frozen=True)
class Route:
    pattern: str
    action: str
    target: str | None = None

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action}")


# Which known endpoints each preset answers or blocks, in order, and its default.
PRESETS = {
    "privacy-first": ("BLOCK", {"stats": "BLOCK", "license": "BLOCK", "translate": "ANSWER", "update": "BLOCK",
                                "errors": "BLOCK", "metrics": "BLOCK"}),
    "allow-updates": ("BLOCK", {"stats": "BLOCK", "license": "BLOCK", "translate": "ANSWER", "update": "ANSWER",
                                "errors": "BLOCK", "metrics": "BLOCK"}),
    "passthrough": ("PASSTHROUGH", {}),
}


def preset(name: str | None, endpoints: dict[str, str], custom: list[Route] = ()) -> tuple[list[Route], str]:
    """Routes and default action of a preset, after `custom` routes. An unknown name gets the strictest preset.

    `endpoints` maps the presets' endpoint names to URL patterns.
    """
    default, actions = PRESETS.get((name or "").strip().lower(), PRESETS["privacy-first"])
    return [*custom, *[Route(endpoints[e], action) for e, action in actions.items() if e in endpoints]], default


def _match(url: Column, route: Route) -> Column:
    return url.rlike(anchored(route.pattern))


def route_column(url: Column, routes: list[Route], default: str) -> Column:
    """struct(pattern, action, target, is_default) of the first route that matches the whole URL."""
    def decision(pattern, action, target, is_default) -> Column:
        return F.struct(F.lit(pattern).alias("pattern"), F.lit(action).alias("action"),
                        F.lit(target).cast("string").alias("target"), F.lit(is_default).alias("is_default"))

    return first_of([(_match(url, r), decision(r.pattern, r.action, r.target, False)) for r in routes],
                    decision(".*", default, None, True))


def route(df: DataFrame, url: str, routes: list[Route], default: str = "BLOCK") -> DataFrame:
    """Adds `normalized` and the decision's fields. A URL that cannot be read has no decision."""
    df = df.withColumn("normalized", normalize_url(F.col(url)))
    decided = df.withColumn("decision", F.when(F.col("normalized").isNotNull(),
                                               route_column(F.col("normalized"), routes, default)))
    return decided.select(*df.columns, "decision.pattern", "decision.action", "decision.target", "decision.is_default")


def _substituted(url: Column, r: Route) -> Column:
    """The target with `${name}` replaced by captures; groups that took no part stay literal."""
    numbers = group_numbers(r.pattern)
    pieces = re.split(r"(\$\{[a-zA-Z][a-zA-Z0-9]*\})", r.target)
    twice = F.concat(url, F.lit("\n"), url)
    out = []
    for piece in pieces:
        name = piece[2:-1] if piece.startswith("${") else None
        if name in numbers:
            value = F.regexp_extract(url, anchored(r.pattern), numbers[name])
            out.append(F.when((value != "") | twice.rlike(took_part(r.pattern, name)), value).otherwise(piece))
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out)


def redirect(df: DataFrame, url: str, routes: list[Route], default: str = "BLOCK") -> DataFrame:
    """`route`, plus `location`: where a REDIRECT leads, null for other actions or a missing target."""
    routed = route(df, url, routes, default)
    at = F.col("normalized")
    nowhere = F.lit(None).cast("string")
    return routed.withColumn("location", first_of(
        [(_match(at, r), _substituted(at, r) if r.action == "REDIRECT" and r.target else nowhere) for r in routes], nowhere))


def route_summary(df: DataFrame, url: str, policies: dict[str, tuple[list[Route], str]]) -> DataFrame:
    """Requests per host and action under each named policy, in one scan: policy columns per host.

    Unreadable URLs are counted under the empty host, null ones under none.
    """
    at = normalize_url(F.col(url))
    host = url_parts(F.col(url))["host"]
    decided = df.select(host.alias("host"), F.array(*[
        F.struct(F.lit(name).alias("policy"), route_column(at, routes, default).alias("d"))
        for name, (routes, default) in policies.items()]).alias("all"))
    return (decided.select("host", F.explode("all").alias("one"))
            .groupBy("host", F.col("one.policy").alias("policy"), F.col("one.d.action").alias("action"),
                     F.col("one.d.is_default").alias("is_default"))
            .agg(F.count("*").alias("requests")))


def policy_matrix(df: DataFrame, url: str, policies: dict[str, tuple[list[Route], str]]) -> DataFrame:
    """One row per host: the requests each policy blocks, answers, passes through and redirects; the empty host has the unreadable URLs."""
    at = normalize_url(F.col(url))
    decided = df.select(url_parts(F.col(url))["host"].alias("host"),
                        *[route_column(at, routes, default)["action"].alias(name)
                          for name, (routes, default) in policies.items()])
    cells = [F.count_if(F.col(f"`{name}`") == action).alias(f"{name}_{action}".replace("-", "_").lower())
             for name in policies for action in ("BLOCK", "ANSWER", "PASSTHROUGH", "REDIRECT")]
    return decided.groupBy("host").agg(*cells)
