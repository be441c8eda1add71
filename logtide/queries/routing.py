"""URL routing and network audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.functions.urls import classify_endpoint, normalize_url
from logtide.operators.egress import collapse_runs, egress_violations, parse_egress
from logtide.operators.routing import Route, policy_matrix, preset, redirect, route, route_summary
from logtide.queries.registry import query, table

ROUTES = [
    Route(r"https?://www\.[^/]*/en/.*", "BLOCK"),
    Route(r"https?://blog\.(?P<site>[a-z]+)\.example\.(?P<top>com|net|org)/(?P<lang>[a-z]{2})/(?P<n>\d+)(?P<rest>\?.*)?/?", "REDIRECT",
          "https://mirror.example/${top}/${site}/${n}?was=${lang}&${rest}&${nobody}"),
    Route(r"http://.*", "ANSWER"),
    Route(r"https://[^/]*\.example\.org/.*", "PASSTHROUGH"),
]
DEFAULT = "BLOCK"

NORMAL = "regexp_replace(url, '#.*$', '')"
BLOG = r"https?://blog\.([a-z]+)\.example\.(com|net|org)/([a-z]{2})/(\d+)(\?.*)?/?"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def route_sql(field: str) -> str:
    """The value of `field` for the first route that matches `normalized`."""
    plain = [r.pattern.replace("?P<site>", "").replace("?P<top>", "").replace("?P<lang>", "").replace("?P<n>", "")
             .replace("?P<rest>", "") for r in ROUTES]
    values = {"pattern": [r.pattern for r in ROUTES], "action": [r.action for r in ROUTES]}[field]
    last = ".*" if field == "pattern" else DEFAULT
    steps = " ".join(f"WHEN regexp_full_match(normalized, {sql_text(p)}) THEN {sql_text(v)}" for p, v in zip(plain, values))
    return f"CASE {steps} ELSE {sql_text(last)} END"


ROUTED = f"""SELECT page_id, normalized, pattern, action, pattern = '.*' AS is_default FROM (
    SELECT page_id, normalized, {route_sql('pattern')} AS pattern, {route_sql('action')} AS action
    FROM (SELECT page_id, {NORMAL} AS normalized FROM pages))"""


@query("route_first_match", ROUTED)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return route(table(spark, folder, "pages").select("page_id", "url"), "url", ROUTES, DEFAULT).select(
        "page_id", "normalized", "pattern", "action", "is_default")


@query("route_redirect", f"""
    WITH n AS (SELECT page_id, {NORMAL} AS normalized FROM pages), a AS (SELECT *, {route_sql('action')} AS action FROM n),
    g AS (SELECT *, regexp_extract(normalized, '^(?:{BLOG})$', 1) AS site, regexp_extract(normalized, '^(?:{BLOG})$', 2) AS top,
        regexp_extract(normalized, '^(?:{BLOG})$', 3) AS lang, regexp_extract(normalized, '^(?:{BLOG})$', 4) AS n,
        regexp_extract(normalized, '^(?:{BLOG})$', 5) AS rest FROM a)
    SELECT page_id, action, CASE WHEN action = 'REDIRECT' THEN 'https://mirror.example/' || top || '/' || site || '/' || n || '?was='
        || lang || '&' || CASE WHEN rest = '' THEN '${{rest}}' ELSE rest END || '&${{nobody}}' END AS location FROM g""")
def _(spark, folder):
    return redirect(table(spark, folder, "pages").select("page_id", "url"), "url", ROUTES, DEFAULT).select(
        "page_id", "action", "location")


ENDPOINTS = {"stats": r"https?://blog\.tionsh\.example\.net/.*", "license": r"https?://thther\.example\.org/en/.*",
             "translate": r"https?://blog\.ththan\.example\.net/en/\d+/?", "update": r"https?://blog\.tiontion\.example\.com/.*",
             "errors": r"https?://m\.ththth\.example\.net/.*", "metrics": r"https?://ththed\.example\.org/.*"}


def policies() -> dict[str, tuple[list[Route], str]]:
    custom = [Route(r"https?://spam-farm\..*", "BLOCK")]
    return {name: preset(name, ENDPOINTS, custom) for name in ("privacy-first", "allow-updates", "passthrough")}


def policy_sql(name: str) -> str:
    routes, default = policies()[name]
    steps = " ".join(f"WHEN regexp_full_match(u, {sql_text(r.pattern)}) THEN {sql_text(r.action)}" for r in routes)
    return f"CASE {steps} ELSE {sql_text(default)} END"


def matched_sql(name: str) -> str:
    routes, _ = policies()[name]
    return "NOT (" + " OR ".join(f"regexp_full_match(u, {sql_text(r.pattern)})" for r in routes) + ")"


HOSTED = f"(SELECT {NORMAL} AS u, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)"


@query("route_summary", " UNION ALL ".join(
    f"""SELECT host, '{name}' AS policy, {policy_sql(name)} AS action, {matched_sql(name)} AS is_default, count(*) AS requests
        FROM {HOSTED} GROUP BY ALL""" for name in policies()))
def _(spark, folder):
    return route_summary(table(spark, folder, "pages"), "url", policies())


@query("policy_matrix", "SELECT host, " + ", ".join(
    f"count(*) FILTER (WHERE {policy_sql(name)} = '{action}') AS {(name + '_' + action).replace('-', '_').lower()}"
    for name in policies() for action in ("BLOCK", "ANSWER", "PASSTHROUGH", "REDIRECT")) + f" FROM {HOSTED} GROUP BY host")
def _(spark, folder):
    return policy_matrix(table(spark, folder, "pages"), "url", policies())


def spellings(pages: DataFrame) -> DataFrame:
    """Each URL as it is, with user info and capitals, with its default port, and with another port."""
    url = F.col("url")
    capital = F.concat(F.upper(F.regexp_extract(url, r"\A([a-z]+)", 1)), F.lit("://me:secret@"),
                       F.upper(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.regexp_extract(url, r"://[^/?#]*(.*)\z", 1))
    port = F.when(url.startswith("https"), ":443").otherwise(":80")
    return pages.select("page_id", F.posexplode(F.array(
        url, capital, F.regexp_replace(url, r"(://[^/?#]*)", F.concat(F.lit("$1"), port)),
        F.regexp_replace(url, r"(://[^/?#]*)", F.lit("$1:8080")), F.concat(F.lit("no url "), url))).alias("spelling", "url"))


@query("url_normalize", f"""
    SELECT page_id, CAST(s AS INTEGER) AS spelling, CASE WHEN s < 3 THEN n WHEN s = 3
        THEN regexp_replace(n, '(://[^/?#]*)', '\\1:8080') END AS normalized
    FROM (SELECT page_id, {NORMAL} AS n, unnest([0, 1, 2, 3, 4]) AS s FROM pages)""")
def _(spark, folder):
    return spellings(table(spark, folder, "pages")).select("page_id", "spelling", normalize_url(F.col("url")).alias("normalized"))


@query("endpoint_classify", """
    SELECT page_id, CASE WHEN host = 'blog.tionsh.example.net' THEN 'stats'
        WHEN host = 'thther.example.org' AND path IN ('/en/685', '/en/685/', '/en/825.html') THEN 'translation'
        WHEN host = 'thther.example.org' THEN 'update' END AS endpoint
    FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def _(spark, folder):
    endpoints = [("stats", "blog.tionsh.example.net", None),
                 ("translation", "thther.example.org", ["/en/685", "/en/685/", "/en/825.html"]),
                 ("update", "thther.example.org", None)]
    return table(spark, folder, "pages").select("page_id", classify_endpoint(F.col("url"), endpoints).alias("endpoint"))


# Network attempts made of events: who, where to, and from which code

def attempt_lines(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    tab = F.lit("\t")
    host = F.concat(F.lit("h"), F.floor(F.col("user_id") / 10).cast("string"), F.lit(".example.net"))
    target = F.when(kind == "view", host).when(kind == "purchase", F.concat(host, F.lit(":80"))).otherwise(F.concat(host, F.lit(":443")))
    target = F.when(F.col("user_id") == 3, F.lit("localhost:8080")).otherwise(target)
    stack = F.when(F.col("value") < 20, F.lit("java.net.Socket.connect:1|org.acme.plugin.Http.get:12")).otherwise(
        F.lit("java.net.Socket.connect:1|org.acme.server.Main.run:7"))
    whole = F.concat(F.when(kind == "view", "resolve").otherwise("connect"), tab, target, tab, F.lit("?"), tab, F.lit("main"), tab, stack)
    line = F.when(kind == "signup", F.concat(F.lit("connect"), tab, target)).otherwise(whole)
    return events.select("event_id", "user_id", line.alias("value"))


ATTEMPTS = r"""(SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'resolve' ELSE 'connect' END AS kind,
        CASE WHEN user_id = 3 THEN 'localhost:8080' ELSE 'h' || (user_id // 10) || '.example.net'
            || CASE event_type WHEN 'view' THEN '' WHEN 'purchase' THEN ':80' ELSE ':443' END END AS target,
        CASE WHEN event_type = 'signup' THEN '' ELSE '?' END AS attribution, CASE WHEN event_type = 'signup' THEN '' ELSE 'main' END AS thread,
        CASE WHEN event_type = 'signup' THEN '' WHEN value < 20 THEN 'java.net.Socket.connect:1|org.acme.plugin.Http.get:12'
            ELSE 'java.net.Socket.connect:1|org.acme.server.Main.run:7' END AS stack FROM events)"""


@query("egress_parse", f"SELECT * FROM {ATTEMPTS}")
def _(spark, folder):
    return parse_egress(attempt_lines(table(spark, folder, "events")))


@query("egress_runs", rf"""SELECT stream, seq, host FROM (
        SELECT user_id // 8 AS stream, event_id AS seq, regexp_replace(target, ':[0-9]+$', '') AS host,
            lag(regexp_replace(target, ':[0-9]+$', '')) OVER (PARTITION BY user_id // 8 ORDER BY event_id) AS before FROM {ATTEMPTS})
    WHERE before IS DISTINCT FROM host""")
def _(spark, folder):
    log = parse_egress(attempt_lines(table(spark, folder, "events")))
    return collapse_runs(log.withColumn("stream", F.expr("user_id div 8")), "stream", "event_id", "target")


@query("egress_violations", rf"""SELECT event_id, kind, target, host, CASE
        WHEN host NOT IN ('h1.example.net', 'h2.example.net') THEN 'host not allowed'
        WHEN kind <> 'resolve' AND target NOT LIKE '%:443' THEN 'not HTTPS' END AS reason
    FROM (SELECT *, regexp_replace(target, ':[0-9]+$', '') AS host FROM {ATTEMPTS})
    WHERE target NOT LIKE 'localhost%' AND stack LIKE '%|org.acme.plugin.%'
      AND (host NOT IN ('h1.example.net', 'h2.example.net') OR (kind <> 'resolve' AND target NOT LIKE '%:443'))""")
def _(spark, folder):
    log = parse_egress(attempt_lines(table(spark, folder, "events")))
    return egress_violations(log, ["org.acme.plugin."], ["h1.example.net", "h2.example.net"]).select(
        "event_id", "kind", "target", "host", "reason")
