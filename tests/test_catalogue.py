import hashlib

import pytest
from pyspark.sql import functions as F

from logtide.functions.phrases import phrase_name, phrase_text, request_json
from logtide.functions.texts import abbreviate, header
from logtide.functions.versions import declared_numbers, version_struct
from logtide.operators.audit import (Allowance, apply_allowances, audit_verdict, header_fingerprint, host_inventory, inventory_drift,
                                     keyed_drift, suspicious_strings)
from logtide.operators.phrases import (RewriteRules, json_string_entries, layer_phrases, parse_phrases, phrase_coverage,
                                       phrase_differences, read_phrase_files, resolve_languages, rewrite_text, uncustomized)
from logtide.operators.releases import first_source, newest_release, update_candidates, version_rank


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, t string").coalesce(1)


def answers(spark, values, expression):
    return [r[0] for r in texts(spark, values).orderBy("n").select(expression(F.col("t"))).collect()]


LINES = {
    r'HELP: "{0} help"': ("HELP", "{0} help"), r'K: "a \"b\" c\\d"': ("K", r'a "b" c' + "\\d"), r"K: 'it''s \'x\' \\'": ("K", "it's 'x' \\"),
    "name : a: b ": ("NAME", "a: b"), "K: \"": ("K", '"'), "K: 'a\"": ("K", "'a\""), "K:": ("K", ""), "# K: x": (None, None), "no colon": (None, None),
    ": x": ("", "x"), " # K: x": ("# K", "x"),
}


def test_phrase_lines(spark):
    names = answers(spark, LINES, phrase_name)
    values = answers(spark, LINES, phrase_text)
    for (name, text), got_name, got_text in zip(LINES.values(), names, values):
        assert got_name == name and (name is None or got_text == text)


def test_last_line_wins_in_each_file(spark, tmp_path):
    (tmp_path / "de.yml").write_text('# German\r\nA: "eins"\r\nB: zwei\r\na: drei\n', encoding="utf-8")
    (tmp_path / "zh_CN.yml").write_text("A: 一", encoding="utf-8")
    got = sorted(tuple(r) for r in read_phrase_files(spark, str(tmp_path)).select("language", "name", "text").collect())
    assert got == [("de", "A", "drei"), ("de", "B", "zwei"), ("zh-cn", "A", "一")]
    lines = spark.createDataFrame([(1, "A: x"), (3, "A: z"), (2, "A: y")], "at int, line string")
    assert [tuple(r) for r in parse_phrases(lines, "line", "at").collect()] == [("A", "z")]


JSON = {
    '{"a": "x", "b": 1, "c": {"d": "e"}, "f": "é"}': {"a": "x", "f": "é"}, " {} ": {}, '{"a": null, "b": ["x"], "c": ""}': {"c": ""},
    '{"a": "x"} {': None, '{"a": "x"}, {}': None, '["a"]': None, '"a"': None, "1": None, "": None, "{": None, '{"a": "x"}x': None,
    '{"a": "x"}] "y': None, '{"a": "1", "a": "2"}': {"a": "2"},
}


def test_json_entries(spark):
    entries, rejects = json_string_entries(texts(spark, JSON), "n", "t")
    got = {}
    for r in entries.collect():
        got.setdefault(r["n"], {})[r["name"]] = r["text"]
    assert {r["n"] for r in rejects.collect()} == {i for i, v in enumerate(JSON.values()) if v is None}
    assert got == {i: v for i, v in enumerate(JSON.values()) if v}


def test_requests(spark):
    bodies = {'data={"a": "1{PLUS_SIGN}1 %41"}': '{"a": "1+1 %41"}', "data=%7B%22a%22%3A%22b+c%22%7D": '{"a":"b c"}', "data=%7": None,
              "x=1": None, "data=": "", "DATA={}": None}
    assert answers(spark, bodies, request_json) == list(bodies.values())


def test_layers(spark):
    base = spark.createDataFrame([("A", "a"), ("B", "b"), ("D", "d")], "name string, text string")
    over = spark.createDataFrame([("A", "new"), ("B", " \t"), ("C", "c")], "name string, text string")
    got = sorted(tuple(r) for r in layer_phrases(base, over).collect())
    assert got == [("A", "new", "over"), ("B", "b", "base"), ("C", "c", "over"), ("D", "d", "base")]


def test_uncustomized(spark):
    def table(**pairs):
        return spark.createDataFrame(list(pairs.items()), "name string, text string")
    got = uncustomized(table(A="one", B="changed", C="three"), table(A="eins", B="zwei", C=" ", D="vier"), table(A="one", B="two", C="three", D="four"))
    assert [tuple(r) for r in got.collect()] == [("A", "eins")]
    assert [r[0] for r in phrase_differences(table(A="x", B="y"), table(A="x", B="z", C="q")).collect()] == ["B"]


def test_coverage(spark):
    phrases = spark.createDataFrame([("de", "A", "x"), ("de", "B", " "), ("de", "Z", "q"), ("fr", "A", "x"), ("fr", "B", "y"), ("fr", "C", "z")],
                                    "language string, name string, text string")
    names = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    got = sorted(tuple(r) for r in phrase_coverage(phrases, names).collect())
    assert got == [("de", 1, 2, 1, "B, C"), ("fr", 3, 0, 0, "")]


FOUND = {"de": "de", "zh-tw": "zh-tw", "DE": "de", " de ": "de", "De_AT-x-y": "de", "vı": "vi", "ıt": "it", "zh_CN": "zh-cn", "ZH_TW": "zh-tw",
         "zh": "zh-cn", "zh-hans": "zh-cn", "zh-sg": "zh-cn", "zh-hant": "zh-tw", "zh-hk": "zh-tw", "zh-mo": "zh-tw", "zh-hant-tw": "zh-tw",
         "zh-hans-cn": "zh-cn", "iw": "he", "de-at": "de", "de_CH": "de", "ja-jp": "ja"}
NOT_FOUND = ["nl", "pt-br", "english", "", " ", "-", "de-", "../en", "de/../en", "de.yml", "d e", "zh-cn-x-y-z-w-v", "abcdefghi", None]


def test_languages(spark):
    available = spark.createDataFrame([(c,) for c in "de en ja zh-cn zh-tw he vi it".split()], "language string")
    got = {r["asked"]: r["resolved"] for r in resolve_languages(texts(spark, [*FOUND, *NOT_FOUND]), "t", available).collect()}
    assert got == {**FOUND, **{c: None for c in NOT_FOUND}}
    own = spark.createDataFrame([("zh",), ("zh-cn",)], "language string")
    assert resolve_languages(texts(spark, ["zh"]), "t", own).first()["resolved"] == "zh"


def test_rewriting(spark):
    """A name is replaced where a shape of before and after surrounds it, and nowhere else."""
    shapes = (("<", ">"), (r"about (?:the )?", "(?: now|$)"), ("", r" says:? "), (r"^~+", "~*$"))
    rules = RewriteRules("Acme", "Nova", dropped=("GONE",), self_naming=("SELF",), links={"CHAT": ("Website", "https://n")},
                         relinked={"GET": ("https://a/get", "Download", "https://n/get")}, contexts=shapes)
    want = [("GONE", "x", None), ("SELF", "Acme by Acme", "Nova by Nova"), ("CHAT", "Forum: https://a", "Website: https://n"),
            ("GET", "Herunterladen: https://a/get", "Herunterladen: https://n/get"), ("GET", "nothing", "Download: https://n/get"),
            ("T", "<Acme> and Acme", "<Nova> and Acme"), ("T", "<Acme and>", "<Acme and>"), ("T", "about the Acme now", "about the Nova now"),
            ("T", "all about Acme", "all about Nova"), ("T", "about Acme later", "about Acme later"), ("T", "Acme says no", "Nova says no"),
            ("T", "Acme says: no", "Nova says: no"), ("T", "~~Acme~", "~~Nova~"), ("T", "~~Acme~ x", "~~Acme~ x"), ("T", "Acme", "Acme")]
    got = rewrite_text(spark.createDataFrame([w[:2] for w in want], "name string, text string").coalesce(1), "name", "text", rules).collect()
    assert [tuple(r) for r in got] == [(n, t) for n, _, t in want if t is not None]


def build(numbers, word="nova", count=None, dirty=False):
    """The grammar: a release is numbers-wordN, a development build numbers-commits-ghash[-dirty]-word-dev."""
    mark = hashlib.sha256(numbers.encode()).hexdigest()[:7 + len(numbers)]
    return f"{numbers}-{count}-g{mark}{'-dirty' if dirty else ''}-{word}-dev"


RELEASES = [f"{numbers}-nova{n}" for numbers in ("3.7", "3.7.2", "03.07", "418.0") for n in (1, 26)]
BUILDS = [build(numbers, count=n, dirty=d) for numbers in ("3.7", "3.7.2", "0.9") for n, d in ((0, False), (57, False), (57, True))]
VALID = RELEASES + BUILDS


def spoiled(text):
    """The text with one fault each: of its length, its edges, its case, its separators, or a part left out."""
    parts = text.split("-")
    yield from (f"x{text}", f" {text}", f"{text} ", f"{text}\n", f"{text}-more", text.upper(), text.replace("-", "_"), text.replace(".", ".."),
                f"{text[0]}.{text[0]}." + text, "7" * 10 + text[text.index("."):], text.replace("nova", "novu"))
    yield from ("-".join(parts[:k] + parts[k + 1:]) for k in range(len(parts)) if parts[k] != "dirty")
    yield from (text.replace("-g", "-"), text[:text.index("-g") + 8] + text[text.index("-nova"):].replace("nova-dev", "dev-nova")) if "-g" in text else (
        text + "1234567890", text.replace("nova", "nova-"), text[:-1] + "\u0663")


REJECTED = [None, "", "nonsense"] + sorted({bad for text in (RELEASES[0], RELEASES[3], BUILDS[1], BUILDS[5]) for bad in spoiled(text)} - set(VALID))
#: By numbers; then the releases of those numbers, then builds after so many commits, a dirty one behind its clean one.
ORDERED = ["1.9-nova7"] + [text for numbers in ("3.6", "3.7", "3.7.1", "3.10", "12.0")
                           for text in (f"{numbers}-nova2", f"{numbers}-nova11", build(numbers, count=4), build(numbers, count=4, dirty=True), build(numbers, count=31))]


def test_versions(spark):
    got = answers(spark, [*VALID, *REJECTED], lambda t: version_struct(t, "nova").isNotNull())
    assert [t for t, ok in zip([*VALID, *REJECTED], got) if ok] == VALID
    ranked = version_rank(texts(spark, [*reversed(ORDERED), *ORDERED, "3.7.0-nova2", "junk"]), "t", "nova").collect()
    assert {r["version"]: r["rank"] for r in ranked} == {**{v: i for i, v in enumerate(ORDERED, 1)}, "3.7.0-nova2": ORDERED.index("3.7-nova2") + 1}


def test_declared_numbers(spark):
    got = answers(spark, ["24.1", "24.1.3", "24.1-local", "024.01", "25", "24.1.2.3", "v24.1", "unknown", None], declared_numbers)
    assert [None if r is None else tuple(r) for r in got] == [(24, 1, 0), (24, 1, 3), (24, 1, 0), (24, 1, 0), None, None, None, None, None]


@pytest.mark.parametrize("release,running,declared,want", [
    ("24.1-nova2", "24.1-nova1", None, True), ("24.1-nova10", "24.1-nova9", None, True), ("24.1.1-nova1", "24.1-nova5", None, True),
    ("24.1-nova1", "24.1-nova1", None, False), ("24.1-nova1", "24.1-nova2", None, False), ("24.1-nova99", "24.1-5-gabc1234-nova-dev", None, False),
    ("24.1.0-nova1", "24.1-5-gabc1234-nova-dev", None, False), ("24.1.1-nova1", "24.1-5-gabc1234-nova-dev", None, True),
    ("24.1-nova1", "24.0-121-gd5cad31-nova-dev", "24.1", False), ("24.1.1-nova1", "24.0-121-gd5cad31-nova-dev", "24.1", True),
    ("24.2-nova1", "24.0-121-gd5cad31-nova-dev", "24.1", True), ("25.0-3-gabc1234-nova-dev", "24.1-nova1", None, False)])
def test_updates(spark, release, running, declared, want):
    hosts = spark.createDataFrame([(running, declared)], "version string, declared string")
    offers = spark.createDataFrame([(release,), ("1.0-nova1",)], "tag string")
    got = update_candidates(hosts, offers, "version", "tag", "nova", "declared").first()["update"]
    assert got == (release if want else None)


def test_newest_release_and_fallback(spark):
    rows = [("git", 1, "nightly", False, False, None), ("git", 1, "v25.0-nova1", True, False, None), ("rinth", 2, "24.1-nova2", False, False, "listed"),
            ("rinth", 2, "24.1-nova10", None, None, None), ("rinth", 2, "25.0-nova1", False, False, "archived"), ("third", 3, "v26.0-nova1", False, False, None),
            ("third", 3, "27.0-1-gabc1234-nova-dev", False, False, None)]
    newest = newest_release(spark.createDataFrame(rows, "source string, priority int, tag string, draft boolean, prerelease boolean, status string"), "nova")
    assert sorted(tuple(r) for r in newest.collect()) == [("rinth", 2, "24.1-nova10"), ("third", 3, "26.0-nova1")]
    assert [tuple(r) for r in first_source(newest).collect()] == [(2, "rinth", "24.1-nova10")]
    assert first_source(newest.filter("false")).collect() == []


HEADERS = {
    "/* Copyright 2024 A\n * more */ package a;": "Copyright # A more", "// one\n// two\npackage a;": "one two",
    "/* top */ package a; /* mid */ import b.C; /* class doc */ class X {}": "top mid", "// only\nclass X {} // no": "only", "package a; // tail": "",
    "class X {}": "", "/* (c) 2019-2026, 2027 B */ x": "(c) # B", "/* Copyright (C) 2021, 2024 B. Change date: 2030 */ x": "Copyright (C) # B. Change date: 2030",
    "/* open": "open", "﻿ /* bom */ x": "bom", "/* a */ packages b; c": "a", "": "", "/** doc\n ** stars **\n **/ import x;": "doc stars",
}


def test_headers(spark):
    assert answers(spark, HEADERS, header) == list(HEADERS.values())
    long = "".join(f"// line {i}\n" for i in range(3_000)) + "/* " + "word " * 50_000 + "*/ package a;"
    assert len(answers(spark, [long], header)[0]) > 250_000
    got = header_fingerprint(texts(spark, ["/* Copyright 2020 A */ x", "// Copyright 2021 A\ny", "z"]), "n", "t").collect()
    assert [tuple(r) for r in got] == [(hashlib.sha256(b"Copyright # A").hexdigest(), 2, 0)]


def test_scans(spark):
    run = "A" * 210
    df = texts(spark, ["see https://Telemetry.Example/collect and wss://b.example", "x" + run, "mentions ACME", "net.ext.Thing", "y" * 90 + " acme"])
    assert sorted(r[0] for r in host_inventory(df, "t").collect()) == ["b.example", "telemetry.example"]
    got = sorted((r["site"], r["rule"]) for r in suspicious_strings(df, "n", "t", ["acme"], 200, ["net.ext."]).collect())
    assert got == [("1", "encoded-run"), ("2", "keyword"), ("3", "prefix"), ("4", "keyword")]
    assert answers(spark, ["a" * 80, "a" * 81], abbreviate) == ["a" * 80, "a" * 77 + "..."]


def test_drift(spark):
    observed = spark.createDataFrame([("hosts", "a"), ("hosts", "b"), ("hosts", "b"), ("deps", "x")], "field string, entry string")
    baseline = spark.createDataFrame([("r", "hosts", "a"), ("d", "hosts", "c"), ("d", "deps", "a")], "line string, field string, entry string")
    assert sorted(tuple(r) for r in inventory_drift(observed, baseline).collect()) == [
        ("INFO", "deps", "a", "no longer present"), ("INFO", "hosts", "c", "no longer present"), ("REVIEW", "deps", "x", "new"), ("REVIEW", "hosts", "b", "new")]


def test_keyed_drift(spark):
    baseline = spark.createDataFrame([("release", "cap a=1"), ("development", "cap a=2"), ("old", "cap a=1"), ("release", "cap b=x"), ("release", "file k=v=w"),
                                      ("release", "code z=1")], "line string, entry string")
    observed = spark.createDataFrame([("cap a", "3"), ("cap c", "9"), ("file k=v", "u"), ("file k", "v=w")], "key string, value string")
    got = {r["key"]: (r["change"], r["detail"]) for r in keyed_drift(observed, baseline, "cap ").collect()}
    assert got == {"cap a": ("changed", "changed from 1 (old, release) or 2 (development) to 3"), "cap c": ("new", "new: 9"),
                   "file k=v": ("changed", "changed from w (release) to u"), "cap b": ("gone", "no longer present; was x (release)")}
    assert keyed_drift(spark.createDataFrame([("cap a", "2")], "key string, value string"), baseline, "zzz").isEmpty()


def test_allowances_and_verdict(spark):
    findings = spark.createDataFrame([("FAIL", "net", "a/B#run", "socket"), ("FAIL", "net", "a/B#run", "socket"), ("FAIL", "net", "a/C#run", "socket"),
                                      ("REVIEW", "net", "lib/x", "new"), ("INFO", "host", "h", "gone"), ("REVIEW", "other", "a/B#run", "q")],
                                     "severity string, rule string, site string, detail string")
    allowed = apply_allowances(findings, [Allowance("net", "a/B#run", "test"), Allowance("net", "lib/*", "library"), Allowance("net", "a/*x", "no")])
    got = {(r["rule"], r["site"]): (r["severity"], r["detail"]) for r in allowed.collect()}
    assert got == {("net", "a/B#run"): ("INFO", "socket (allowed: test)"), ("net", "a/C#run"): ("FAIL", "socket"), ("net", "lib/x"): ("INFO", "new (allowed: library)"),
                   ("host", "h"): ("INFO", "gone"), ("other", "a/B#run"): ("REVIEW", "q")}
    assert audit_verdict(allowed).first().asDict() == {"fail": 1, "review": 1, "info": 3, "failed": True, "review_required": True}
    assert audit_verdict(allowed.filter("severity = 'INFO'")).first()["failed"] is False


def test_allowances_of_named_entries(spark):
    findings = spark.createDataFrame([("REVIEW", "cap", "key", "changed", "key=1", "ACCEPT"), ("REVIEW", "cap", "key", "changed again", "key=2", "ACCEPT"),
                                      ("INFO", "cap", "key", "gone", "key", "ACCEPT")],
                                     "severity string, rule string, site string, detail string, allowed_site string, resolution string")
    got = {(r["severity"], r["detail"], r["resolution"]) for r in apply_allowances(findings, [Allowance("cap", "key=1", "seen")]).collect()}
    assert got == {("INFO", "changed (allowed: seen)", None), ("REVIEW", "changed again", "ACCEPT"), ("INFO", "gone", None)}
