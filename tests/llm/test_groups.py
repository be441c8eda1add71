"""SimHash groups, conversation tries and collocations against brute force, small blocks and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logtide.llm import collocations as co
from logtide.llm import conversation_trie as trie
from logtide.llm import simhash_join as sim

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=2):
    """The least id reachable; ids and fingerprints in pairs."""
    prints = list(prints)
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= radius:
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(prints))]


def near_texts(rng):
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 9, 200, 400)))]
        for copy in range(4):
            changed = [rng.choice(vocabulary) if rng.random() < 0.01 * (copy > 1) else w for w in base]
            rows.append((k * 10 + copy, " ".join(changed)))
    return rows


def test_simhash_against_all_pairs(spark):
    rng = random.Random(3)
    rows = near_texts(rng) + [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "oNE"), (905, "É  é\x0bX"), (906, "é É x"), (5, "again, an id"), (5, "again, an id")]
    want = [(i, f"{fingerprint(t):016x}", c) for (i, t), c in zip(rows, groups((i, fingerprint(t)) for i, t in rows))]
    docs = spark.createDataFrame(rows + [(None, "no id"), (None, None)], "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS component_id", "2 AS mask")
    got = [tuple(r) for r in sim.near_duplicates(spark, docs).collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted(want)
    assert sorted(x[1:] for x in got if x[0] is None) == sorted([(f"{fingerprint('no id'):016x}", None), ("0" * 16, None)])
    assert len({c for *_, c in want}) < len(want) - 30


def test_simhash_of_a_very_long_text(spark, monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice(("a", "bb", "Ccc", "ñ")) + str(rng.randint(0, 99)) for _ in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 300_000), (3, "a b " + "y" * 70_000 + " c d")], "doc_id long, text string")
    monkeypatch.setattr(sim, "TEXT_BLOCK", 1000)
    found = [np.concatenate(list(sim.shingle_hashes(t, 3))) for _, t in docs.collect()]
    assert [len(x) for x in found] == [29_998, 1, 3]
    monkeypatch.undo()
    assert {r.doc_id: r.fingerprint for r in sim.near_duplicates(spark, docs).collect()} == {r.doc_id: f"{fingerprint(r.text):016x}" for r in docs.collect()}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_planes_against_counted_bits(radius):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for x in list(prints):
        prints.update(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(12))
    prints = sorted(prints)
    label = sim.close(np.array(prints, np.uint64).view(np.int64), radius)
    want = groups(enumerate(prints), radius)
    assert [int(x) for x in label] == want


def test_hot_buckets_are_dealt_again(spark):
    """Fingerprints round one centre share most parts: with small blocks the buckets are dealt again, several times."""
    rng = random.Random(11)
    prints = set()
    for centre in (0, rng.getrandbits(64)):
        for _ in range(400):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
        prints.update(centre ^ x for x in range(64))
    prints = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    classes = spark.createDataFrame([(x,) for x in prints], "fp long")
    links = sim.links(classes, 2, block=16).collect()
    top = {x: x for x in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 64
        top[find(a)] = find(b)
    want = groups([(x, x & (1 << 64) - 1) for x in prints])
    least = {}
    for x in prints:
        least[find(x)] = min(least.get(find(x), x), x)
    assert [least[find(x)] for x in prints] == want


def test_empty_tables(spark):
    assert sim.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert trie.prefix_trie(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert co.collocations(spark, spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def brute_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), role.encode(), digest, text))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    saved, leaves, children = Counter(), Counter(), Counter()
    for p in nodes:
        children[p[:-1]] += bool(p)
    for p, members in nodes.items():
        own_saved = (len(members) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += not children[p]
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items()))


def talks(rng):
    said = [f"{w} said  {k}" for k, w in enumerate("once twice thrice four".split())] + ["", None, "\ta b"]
    rows = []
    for c in [*range(-45, 160), 10**12, 2**62]:
        for turn in range(rng.choice((0, 1, 2, 3, 5, 9))):
            rows.append((c, turn, rng.choice(("user", "assistant", None)), rng.choice(said)))
    rows += [(7, None, "user", "no turn"), (7, None, None, None), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (None, 1, "user", "nobody")]
    rows += [(c, t, "user", "same") for c in range(500, 900) for t in range(4)]
    rows += [(1000, t, "user", f"long {t % 50}") for t in range(700)]
    return rows


@pytest.mark.parametrize("shard,text", [(1 << 16, 1 << 16), (50, 40)])
def test_trie_against_brute_force(spark, monkeypatch, shard, text):
    rows = talks(random.Random(2))
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "TEXT_KEPT", text)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "'y' AS base", "2 AS depth")
    found = trie.rebuilt(table)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks, so nodes go on in others
    try:
        got = trie.prefix_trie(spark, table)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        got = sorted(tuple(-1 if x is None else x for x in r) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.count() == len({r[0] for r in rows} - {None})
    assert got == brute_trie(rows)


def test_trees_are_balanced():
    tree = trie.Tree()
    for k in trie.medians(1000):
        tree.insert([k, 5], k)

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))
    assert height(tree.next[0]) == 10
    assert [e for _, _, e in tree.nodes() if e >= 0] == list(range(1000))


def brute_phrases(rows, least, most=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    frequent = {p: n for p, n in counts.items() if n >= least}
    longer = Counter()
    for (lang, p), n in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i:i + k]] = max(longer[lang, p[i:i + k]], n)
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) > 1 and not 100 * longer[lang, p] >= 80 * a:
            score, _, l, r = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, totals[lang], -score) for lang, found in out.items() for k, (score, a, p, l, r) in enumerate(sorted(found)[:most], 1))


def prose(rng):
    words = [f"{c}{k}" for k in range(4) for c in ("Ab", "cd", "é", "\"x\"", "z-z", "日本")]
    rows = []
    for i in range(240):
        text = "".join(rng.choice(words[:1 + int(rng.random() ** 2 * len(words))]) + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b")) for _ in range(rng.randint(0, 60)))
        rows.append((i, text + (" new york city hall" if i % 3 else " New  York;City"), rng.choice(("en", "fr", None, "und", ""))))
    return rows + [(900, None, "en"), (901, "", None), (902, " .,; ", "xx"), (None, "new york city hall " * 40, None), (5, "cd0 cd0 cd0", "en"), (5, "cd0 cd0 cd0", "en")]


@pytest.mark.parametrize("shards,bits", [(1, 26), (3, 26), (4, 18)])
def test_phrases_against_brute_force(spark, monkeypatch, shards, bits):
    """With a table of few bits, phrases are counted too early; counts stay right."""
    monkeypatch.setattr(co, "FILTER_BITS", bits)
    monkeypatch.setattr(co, "HELD", 500)
    monkeypatch.setattr(co, "REMEMBERED", 50)
    rows = prose(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS n", "3 AS rank", "'s' AS shard", "4 AS score")
    got = sorted(tuple(r) for r in co.collocations(spark, docs, least=12, shards=shards).collect())
    want = brute_phrases(rows, 12)
    assert got == want and len(want) > 30
    some = co.collocations(spark, docs, least=12, most=3, shards=shards).where(F.col("rank") > 3)
    assert some.count() == 0


def test_phrases_that_no_task_alone_counts_often(spark):
    """The triples begin in a cycle's last step and reach the threshold only with the next one's first, after which no new bit is set."""
    made = spark.createDataFrame([(i, t) for i in range(3000) for t in ("w x", "x y", "y z", "w x y z")], "doc_id long, text string")
    parts = defaultdict(list)
    for row in made.select("doc_id", "text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(co.SHARDS * co.PARTS)).alias("part")).collect():
        parts[row.part, row.text].append(row.doc_id)
    dealt = [((0, "w x"), 35), ((0, "x y"), 35), ((0, "y z"), 35), ((0, "w x y z"), 20), ((1, "w x y z"), 20)]
    rows = [(i, key[1], "en") for key, n in dealt for i in parts[key][:n]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    got = sorted(tuple(r) for r in co.collocations(spark, docs).collect())
    assert got == brute_phrases(rows, 30) and "w x y z" in [r[2] for r in got]


def test_phrases_of_a_very_long_text(spark):
    rng = random.Random(9)
    rows = [(1, " ".join(rng.choice(("one", "two", "three", "four.", "five")) for _ in range(60_000)), "en"), (2, "q" * 500_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in co.collocations(spark, docs).collect()) == brute_phrases(rows, 30)


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**18
    phrases = spark.createDataFrame([(1, big, [(1, 2, 3)])], "id long, a long, cuts array<struct<k:int,left:long,right:long>>")
    counts = spark.createDataFrame([(2, big), (3, big + 5)], "id long, n long")
    assert [tuple(r) for r in co.scored(phrases, counts).collect()] == [(1, 2_000_000 * big // (2 * big + 5), big, big + 5)]
