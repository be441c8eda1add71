import pytest
from pyspark.sql import functions as F

from logtide.functions.patterns import group_numbers, java_pattern
from logtide.functions.urls import classify_endpoint, normalize_url
from logtide.operators.egress import collapse_runs, egress_violations, is_local, parse_egress, read_egress_log
from logtide.operators.routing import Route, policy_matrix, preset, redirect, route, route_summary

URLS = {
    "HtTpS://Metrics.Acme.Test/Put/Here": "https://metrics.acme.test/Put/Here", "https://ACME.test/?Q=Up&r=DOWN": "https://acme.test/?Q=Up&r=DOWN",
    "http://bob@acme.test/a": "http://acme.test/a", "https://bob:pw%21@Acme.Test:8443/a": "https://acme.test:8443/a",
    "https://acme.test/a/b?c#d": "https://acme.test/a/b?c", "https://acme.test/#": "https://acme.test/",
    "https://acme.test:443/a": "https://acme.test/a", "http://acme.test:80/a": "http://acme.test/a", "http://acme.test:443/a": "http://acme.test:443/a",
    "http://acme.test:/a": "http://acme.test/a", "http://[2001:db8::7]:81/a?b#c": "http://[2001:db8::7]:81/a?b", "http://acme.test": "http://acme.test",
    "http://acme.test?a": "http://acme.test?a", "http://acme.test/x y|z": "http://acme.test/x y|z", "file:/srv/Logs/One.csv": "file:///srv/Logs/One.csv",
    "file:///srv/Logs/One.csv": "file:///srv/Logs/One.csv", "telnet://acme.test/a": None, "just words": None, "": None,
}


def test_normalize(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in URLS], "u string").select("u", normalize_url(F.col("u"))).collect()}
    assert got == URLS
    again = spark.createDataFrame([(u,) for u in URLS.values() if u], "u string")
    assert again.filter(normalize_url(F.col("u")) != F.col("u")).isEmpty()


def test_patterns():
    assert java_pattern(r"https://(?P<host>.*)/(?<x>.)") == r"https://(?<host>.*)/(?<x>.)"
    assert group_numbers(r"\((?P<a>x)[(](?:(y)(?<b>z(?<c>.)))(?<=q)(?i)\Q(\E(?<d>w)") == {"a": 1, "b": 3, "c": 4, "d": 5}


def decide(spark, url, routes, default="BLOCK"):
    return route(spark.createDataFrame([(url,)], "u string"), "u", routes, default).first()


def test_first_match_wins_and_matches_whole_urls(spark):
    routes = [Route("https://a\\.example/x", "ANSWER"), Route("https://a\\.example/.*|https://b", "PASSTHROUGH"), Route(".*", "REDIRECT", "z")]
    assert decide(spark, "https://a.example/x", routes).action == "ANSWER"
    assert decide(spark, "https://a.example/x/y", routes).action == "PASSTHROUGH"
    assert decide(spark, "https://b/c", routes).action == "REDIRECT"
    none = decide(spark, "https://c/", routes[:2], "PASSTHROUGH")
    assert (none.action, none.pattern, none.is_default) == ("PASSTHROUGH", ".*", True)
    assert decide(spark, "https://c/", []).is_default
    assert decide(spark, "nothing", routes).action is None
    with pytest.raises(ValueError):
        Route(".*", "FORGET")


ENDPOINTS = {"stats": r"https?://stats\.host\.example/.*", "translate": r"https?://host\.example/translate/?", "update": r"https?://update\.host\.example/.*"}


@pytest.mark.parametrize("name,stats,translate,update,other", [
    ("privacy-first", "BLOCK", "ANSWER", "BLOCK", "BLOCK"), (" Allow-Updates ", "BLOCK", "ANSWER", "ANSWER", "BLOCK"),
    ("passthrough", "PASSTHROUGH", "PASSTHROUGH", "PASSTHROUGH", "PASSTHROUGH"), ("no such", "BLOCK", "ANSWER", "BLOCK", "BLOCK"),
    (None, "BLOCK", "ANSWER", "BLOCK", "BLOCK")])
def test_presets(spark, name, stats, translate, update, other):
    routes, default = preset(name, ENDPOINTS)
    urls = ["http://stats.host.example/u/", "https://Host.example:443/translate", "https://update.host.example/", "https://x.example/"]
    df = route(spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1), "u", routes, default)
    assert [r["action"] for r in df.collect()] == [stats, translate, update, other]


def test_custom_routes_come_before_the_preset(spark):
    routes, default = preset("passthrough", ENDPOINTS, [Route(r"https://x\..*", "BLOCK")])
    assert decide(spark, "https://x.example/", routes, default).action == "BLOCK"


@pytest.mark.parametrize("pattern,target,url,want", [
    (r"https://(?P<host>[^/]+)/(?P<path>.*)", "https://m/${path}?h=${host}&${host}", "https://a.example/b/c", "https://m/b/c?h=a.example&a.example"),
    (r"https://a/(?<known>.*)", "${known}/${unknown}", "https://a/v", "v/${unknown}"),
    (r"https://a/(?<one>x)?(?<rest>.*)", "m/${one}-${rest}", "https://a/yz", "m/${one}-yz"),
    (r"https://a/(?<one>x*)(?<rest>.*)", "m/${one}-${rest}", "https://a/yz", "m/-yz"),
    (r"https://a/(?<one>x)?(?<rest>.*)$", "m/${one}-${rest}", "https://a/", "m/${one}-"),
    (r"https://a/(?:(?<l>l)|(?<r>r*))", "${l}|${r}", "https://a/", "${l}|"),
    (r"https://a/(?<p>.*)", r"m/\$1/${p}", "https://a/$2", r"m/\$1/$2"),
])
def test_redirects(spark, pattern, target, url, want):
    df = redirect(spark.createDataFrame([(url,)], "u string"), "u", [Route(pattern, "REDIRECT", target)])
    assert df.first()["location"] == want


def test_only_redirects_lead_somewhere(spark):
    df = spark.createDataFrame([("https://a/",), ("https://b/",), ("https://c/",)], "u string").coalesce(1)
    got = redirect(df, "u", [Route("https://a/", "BLOCK", "x"), Route("https://b/", "REDIRECT")]).collect()
    assert [r["location"] for r in got] == [None, None, None]


def test_endpoints(spark):
    known = [("translation", "host.example", ["/translate", "/translate/"]), ("update", "update.host.example", None)]
    urls = {"http://HOST.example/Translate?x": "translation", "https://host.example/translate/de": None,
            "https://update.host.example/any/path": "update", "https://x.host.example/translate": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", classify_endpoint(F.col("u"), known))
    assert {r[0]: r[1] for r in df.collect()} == urls


def test_summaries(spark):
    policies = {name: preset(name, ENDPOINTS) for name in ("privacy-first", "passthrough")}
    df = spark.createDataFrame([("https://stats.host.example/",)] * 3 + [("https://x.example/",), ("broken",)], "u string")
    got = {(r["host"], r["policy"], r["action"], r["is_default"]): r["requests"] for r in route_summary(df, "u", policies).collect()}
    assert got == {("stats.host.example", "privacy-first", "BLOCK", False): 3, ("stats.host.example", "passthrough", "PASSTHROUGH", True): 3,
                   ("x.example", "privacy-first", "BLOCK", True): 1, ("x.example", "passthrough", "PASSTHROUGH", True): 1,
                   ("", "privacy-first", "BLOCK", True): 1, ("", "passthrough", "PASSTHROUGH", True): 1}
    matrix = {r["host"]: r for r in policy_matrix(df, "u", policies).collect()}
    assert (matrix["stats.host.example"]["privacy_first_block"], matrix["x.example"]["passthrough_passthrough"]) == (3, 1)


def test_egress_lines(spark, tmp_path):
    (tmp_path / "log").write_text("connect\th:443\tplugin\tmain\ta|b\tc\nresolve\th\n\n")
    got = sorted(tuple(r) for r in read_egress_log(spark, str(tmp_path / "log")).collect())
    assert got == [("", "", "", "", ""), ("connect", "h:443", "plugin", "main", "a|b\tc"), ("resolve", "h", "", "", "")]


def test_violations(spark):
    rows = [(1, "resolve", "a.example", "x.Y.z:1|my.plugin.Http.get:2"), (2, "connect", "a.example:443", "my.plugin.Http.get:2"),
            (3, "connect", "a.example:80", "my.plugin.Http.get:2"), (4, "connect", "b.example:443", "my.plugin.Http.get:2"),
            (5, "connect", "b.example:443", "other.Main:1"), (6, "connect", "localhost:1", "my.plugin.X:1"),
            (7, "connect", "127.0.0.1:1", "my.plugin.X:1"), (8, "connect", "x.LOCALHOST:1", "my.plugin.X:1"),
            (9, "resolve", "a.example", "my.plugin.Other:1")]
    log = spark.createDataFrame(rows, "n int, kind string, target string, stack string")
    got = {r["n"]: r["reason"] for r in egress_violations(log, ["my.plugin."], ["a.example"], "my.plugin.Http.").collect()}
    assert got == {3: "not HTTPS", 4: "host not allowed", 9: "not the allowed client"}
    assert log.filter(is_local(F.col("target"))).count() == 3


def test_runs_cross_stretches(spark):
    hosts = ["a:1", "a:2", "b", "b", "a", "a"]
    rows = [("s", i * 40_000, h) for i, h in enumerate(hosts)] + [("t", 5, "a")]
    got = sorted(tuple(r) for r in collapse_runs(spark.createDataFrame(rows, "s string, n bigint, h string"), "s", "n", "h").collect())
    assert got == [("s", 0, "a"), ("s", 80_000, "b"), ("s", 160_000, "a"), ("t", 5, "a")]


def test_parse_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "k\tt")], "n int, value string")
    assert tuple(parse_egress(df).first()) == (1, "k", "t", "", "", "")
