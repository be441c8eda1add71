"""Near-copies, decontamination and top-k search against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logtide.llm import decontaminate, topk_search
from logtide.llm.jaccard_join import components, near_copies
from logtide.llm.words import LETTERS, NOT_SPACE, shingles, words
from logtide.llm.common import flat, slices

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(pattern, text):
    return re.findall(pattern, (text or "").translate(LOW))


def shingle_set(text, n=5):
    w = split(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[top(a)] = top(b)
    least = defaultdict(lambda: float("inf"))
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least[top(k)], i)
    return sorted((i, len(s), least[top(k)]) for k, (i, s) in enumerate(sets))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def varied(rng, base, share, vocabulary):
    return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in base)


def test_words_as_the_pattern_says():
    texts = ["A b\tc", None, "", "é É x1-y2 \x00z", " lead", "trail \n", "\x1cq\xa0r"]
    data, offsets = flat(pa.array(texts))
    for inside, pattern in ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = words(data, offsets, inside)
        low = bytes(data).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        for i, text in enumerate(texts):
            own = [low[a:b].decode() for a, b in zip(found.start[found.first[i]:found.first[i + 1]], found.end[found.first[i]:found.first[i + 1]])]
            assert own == split(pattern, text)


def test_shingles_are_distinct_and_short_texts_are_one():
    found = words(*flat(pa.array(["a b c d e a b c d e", "a b", "A B", "", "b a"])), NOT_SPACE)
    sets = shingles(found, 5)
    assert [len(s) for s in sets] == [5, 1, 1, 0, 1]
    assert sets[1] == sets[2] and sets[1] != sets[4]


def test_slices_keep_rows_and_order():
    batch = pa.record_batch([pa.array(range(6)), pa.array(["x" * 50, None, "", "y" * 500, "z", "w" * 60])], ["i", "text"])
    parts = list(slices(batch, limit=100))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(6)) and len(parts) > 2


def test_near_copies_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 5, 12, 40, 90]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 9)):
            rows.append((i, varied(rng, base, rng.choice([0, 0.01, 0.03, 0.06]), vocabulary)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one two"), (i + 4, "ONE two"), (i + 5, "two one"), (i + 6, "é"), (i + 7, "É")]
    rows += [(2000 + k, varied(rng, passage, 0.02, vocabulary)) for k in range(60)]  # more than the leaders of a shingle
    rng.shuffle(rows)
    assert sorted(map(tuple, near_copies(spark, documents(spark, rows)).collect())) == brute_components(rows)


def test_near_copies_of_odd_tables(spark):
    assert near_copies(spark, documents(spark, [])).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, "x " * 30_000), (5, "X " * 30_001)]
    df = documents(spark, rows).selectExpr("*", "text AS key", "1 AS size", "doc_id AS component_id")
    found = sorted(map(tuple, near_copies(spark, df).collect()), key=str)
    assert found == [(1, 2, 1), (1, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (None, 2, None)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.key: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k for k, v in got.items() if v == got[0]} == set(range(41))
    assert len({got[k] for k in range(100, 130)}) == 1 and got[200] == got[201] and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_hits(docs, items, window=10):
    found = defaultdict(set)
    for i, t in items:
        w = split(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            found[tuple(w[k:k + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, seen = split(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in found:
                    hit.update(range(k, k + n))
                    seen |= found[x]
        out.append((i, len(w), len(hit), sorted(x for x in seen if x is not None)))
    return sorted(out, key=str)


def hits(df):
    return sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), list(r["items"])) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(8)] + ["É", "x9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(30) if i % 7]
    items += [(100, "…"), (101, None), (None, "nobody knows this"), (5, "repeated id with other words"), (5, "repeated id with other words")]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary + ["u1", "u2"]) for _ in range(rng.choice([0, 2, 30, 200]))]
        if rng.random() < 0.6:
            w[len(w) // 2:len(w) // 2] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, "-".join(w) if rng.random() < 0.5 else " ".join(w)))
    return docs + [(60, None), (61, "nobody, knows: THIS"), (61, "nobody, knows: THIS"), (None, "nobody knows this"), (62, "Repeated id with other words!")], items


@pytest.mark.parametrize("limits", [{}, {"block_words": 8, "shard_words": 50}])
def test_decontamination_matches_brute_force(spark, leaks, limits):
    docs, items = leaks
    df = documents(spark, docs).selectExpr("*", "1 AS spans", "2 AS items")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, items)
    assert hits(decontaminate.marked(spark, df, benchmark, **limits)) == want and sum(bool(w[2]) for w in want) > 20
    clean = decontaminate.cleaned(spark, df, benchmark, **limits)
    assert clean.columns == df.columns and clean.count() == len(docs)
    assert not any(h[2] for h in brute_hits([(r.doc_id, r.text) for r in clean.collect()], items)), "what a cut joins is searched again"
    untouched = {i: t for (i, t), h in zip(sorted(docs, key=str), want) if not h[2]}
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert all(kept[i] == t for i, t in untouched.items())


def test_decontamination_sets_lengths_and_takes_empty_tables(spark):
    rows = spark.createDataFrame([(1, "keep a b c d keep", 99, "s"), (2, "a b", None, None)], "doc_id long, text string, n_chars long, source string")
    benchmark = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.cleaned(spark, rows, benchmark).collect()}
    assert (got[1].text, got[1].n_chars, got[1].source) == ("keep   keep", 11, "s") and (got[2].text, got[2].n_chars) == ("a b", None)
    assert decontaminate.marked(spark, rows.limit(0), benchmark).collect() == []
    assert hits(decontaminate.marked(spark, rows, benchmark.limit(0))) == [(1, 6, 0, []), (2, 2, 0, [])]


def test_index_counts_and_places_every_phrase():
    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 4, 300).astype(np.int32)
    symbols[rng.choice(300, 40, replace=False)] = 0
    symbols[-1] = 0
    index = decontaminate.ShardIndex(symbols, 3)
    text = symbols.tolist()
    for n in (1, 2, 4):
        start = [i for i in range(0, 300 - n) if 0 not in text[i:i + n]][:60]
        found = decontaminate.Phrases(np.zeros(0), symbols, np.array(start), np.full(len(start), n), np.arange(len(start) + 1), np.arange(len(start)))
        which, low, high = index.search(found)
        assert sorted(which.tolist()) == list(range(len(start)))
        for w, a, b in zip(which, low, high):
            want = [i for i in range(300 - n + 1) if text[i:i + n] == text[start[w]:start[w] + n]]
            assert sorted(index.positions(np.arange(a, b)).tolist()) == want


def test_items_digest_is_of_sorted_strings(spark):
    from logtide.llm.decontaminate import digest
    assert digest([10, 9]) == hashlib.sha256(b"10,9").hexdigest() and digest([]) == hashlib.sha256(b"").hexdigest()


def brute_top(rows, every, k):
    sound = [(i, [int(np.floor(np.float64(256) * np.float64(np.float32(x)))) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sound:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_top_k_matches_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("QUERIES", 3), ("SAMPLE", 4), ("BLOCK", 4), ("SEGMENT", 16)):
            monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.2, 6), 1)]) for i in range(-5, 80)]
    rows += [(90 + i, rows[20][1]) for i in range(6)] + [(100, None), (105, [0.1, None, 1.0, 1.0, 1.0, 1.0]), (110, [float("nan")] * 6), (115, []), (None, rows[0][1])]
    rows += [(120, [1.0, 2.0]), (121, [3.0, -2.0]), (15, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS score")
    got = sorted(map(tuple, topk_search.top_k(spark, df, every=5, k=4).collect()))
    assert got == brute_top(rows, 5, 4)


def test_top_k_of_few_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk_search.top_k(spark, spark.createDataFrame([], kind), 5, 3).collect() == []
    assert topk_search.top_k(spark, spark.createDataFrame([(5, [1.0])], kind), 5, 3).collect() == []
    got = topk_search.top_k(spark, spark.createDataFrame([(5, [1.0]), (6, [2.0])], kind), 5, 3).collect()
    assert [tuple(r) for r in got] == [(5, 1, 6, 256 * 512)]
    assert dict(topk_search.top_k(spark, spark.createDataFrame([], kind), 5, 3).dtypes)["rank"] == "int"


def test_held_out_folds(spark):
    import zlib
    from logtide.llm.common import fold
    rows = spark.range(50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in rows)
