"""Long, huge, hot and blank-free inputs: nothing is left out, crashes or grows without bound."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtide.llm import jaccard_join, language_id, quality_fm, topk_search, toxicity
from logtide.llm.structure import learned_span


def prose(rng, parts, words):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words))


def test_a_language_of_long_texts_alone_is_learned(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, ["ka", "lo", "mi"], 30), "aa") for i in range(60)] + [(100 + i, prose(rng, ["sch", "ung", "zu"], 9000), "bb") for i in range(30)]
    assert min(len(t) for _, t, lang in rows if lang == "bb") > 20_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.languages == ["aa", "bb"]
    got = {r.doc_id: r.lang_pred for r in language_id.identified(spark, docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_many_values_of_lang_are_bounded_by_their_frequency(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rng = random.Random(2)
    rows = [(i, prose(rng, ["ka", "lo"], 20), "aa") for i in range(40)] + [(50 + i, prose(rng, ["sch", "zu"], 20), "bb") for i in range(30)] + [(100 + i, "x y", f"dirt{i}") for i in range(50)]
    assert language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["aa", "bb"]


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_fm, "quality")])
def test_labels_of_long_texts_alone_are_learned(spark, module, label):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(160):
        marked = i % 2
        words = prose(rng, ["ta", "ren", "sk"], 14_000 if marked else 40).split()
        if marked:
            words = [w if k % 7 else "zorgvil" for k, w in enumerate(words)]
        rows.append((i, " ".join(words)))
        labels.append((i, marked, marked))
    assert min(len(t) for i, t in rows if i % 2) > 70_000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = module.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in module.scored(spark, docs, model).collect()}
    assert np.mean([got[i] > 0.5 for i in range(1, 160, 2)]) > 0.9 > 0.1 > np.mean([got[i] > 0.5 for i in range(0, 160, 2)])


def test_learned_spans(spark):
    rows = spark.createDataFrame([(i, "é" * 30 + f"{i:02d}" + "x" * i) for i in range(90)] + [(900, None), (901, "")], "doc_id long, text string")
    got = rows.select("doc_id", "text", learned_span(F.col("text"), F.col("doc_id"), 40).alias("s")).collect()
    assert all(r.s == r.text if r.text is None or len(r.text) <= 40 else len(r.s) == 40 and r.s in r.text for r in got)
    assert len({r.text.index(r.s) for r in got if r.text and len(r.text) > 80}) > 8


def test_huge_components_are_held_to_62_bits(spark):
    cut = lambda v: max(-2**62, min(2**62, v))
    rows = [(5, [1.0, 2.0]), (10, [1e300, -1.0]), (11, [1.7e308, 0.0]), (12, [-1e17, 1e16]), (13, [0.5, -0.25]), (14, [3e15, 3e15]), (15, [-1e300, 1e300]), (16, [0.0, 0.0])]
    ints = {i: [cut(int(np.floor(x * 256)) if abs(x) < 1e300 else (2**62 if x > 0 else -2**62)) for x in v] for i, v in rows}
    want = []
    for q, v in ints.items():
        if q % 5 == 0:
            scored = sorted((-max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ints.items() if i != q)[:4]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk_search.top_k(spark, df, 5, 4).collect())) == sorted(want)


def test_bounds_are_over_every_score():
    rng = np.random.default_rng(3)
    for size in (1 << 20, 1 << 40, 1 << 61):
        rows, queries = (rng.integers(-size, size, (30, 5)) for _ in range(2))
        bound = topk_search.bounds(queries, rows.max(axis=0)[None, :], rows.min(axis=0)[None, :])
        assert (bound >= topk_search.products(queries, rows)).all()


def test_sets_of_queries_are_searched_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERIES", 8)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(int(i), [float(x) for x in rng.normal(0, 1, 4)]) for i in range(120)], "vec_id long, embedding array<double>")
    few = sorted(map(tuple, topk_search.top_k(spark, df, 3, 2).collect()))
    monkeypatch.undo()
    assert few == sorted(map(tuple, topk_search.top_k(spark, df, 3, 2).collect())) and len(few) == 80


def test_indented_texts_are_handed_on_by_their_size(spark, monkeypatch):
    """A text with white space in a row is one chunk; a task hands its chunks on by their size, and counts stay right."""
    import tokenizers
    from logtide.llm import token_counts
    from logtide.llm.queries import tokenizer_path
    rng = random.Random(9)
    rows = [(i, "\n".join("    " * rng.randint(1, 3) + f"x{i} = {rng.randint(0, 99)}" for _ in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = tokenizer_path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
    for held in (1000, token_counts.HELD_CHARS):
        monkeypatch.setattr(token_counts, "HELD_CHARS", held)
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark, docs, path).collect()} == want


def test_chunks_of_white_space_at_every_place():
    """Texts are cut at every blank but where white space meets at one; a text of single blanks is told from others at the blanks alone."""
    import time
    from itertools import product
    from logtide.llm.token_counts import Cutter
    for length in range(7):
        for letters in product(" \na\0", repeat=length):
            text = "".join(letters)
            meets = any(x == " " and (i == 0 or text[i - 1].isspace()) and (i + 1 == length or text[i + 1].isspace()) for i, x in enumerate(text))
            blanks = [i for i, x in enumerate(text) if x == " " and i]
            want = [text] if meets else [x for x in (text[a:b] for a, b in zip([0, *blanks], [*blanks, length])) if x]
            assert (Cutter.chunks_of(text) == want) if text else Cutter.chunks_of(text) in ([], [""])
    text = " ".join(["word"] * 400_000)

    def took(work):
        times = []
        for _ in range(5):
            began = time.process_time()
            work()
            times.append(time.process_time() - began)
        return min(times)
    assert took(lambda: Cutter.chunks_of(text)) < 6 * took(lambda: text.split(" "))  # 2.1 times; 9.6 before


# near copies ----------------------------------------------------------------

def sharing(rng, rows, shared, own):
    """Texts that all hold one passage and are else different: linked with none, but of one prefix."""
    passage = [f"p{k}" for k in range(shared)]
    return [(i, " ".join(passage + [f"o{i}x{k}" for k in range(own)])) for i in range(rows)]


def brute(rows, n=5, percent=75):
    sets = []
    for _, text in rows:
        w = text.split()
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("cells", [(1 << 14, 16 << 20), (6, 4000)])
def test_groups_that_share_a_passage(spark, monkeypatch, cells):
    """Many unlinked sets behind few shared shingles, some linked pairs among them; large groups dealt over cells."""
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", cells[0])
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", cells[1])
    monkeypatch.setattr(jaccard_join, "PARTNERS", 3)
    rng = random.Random(4)
    rows = sharing(rng, 50, 40, 16)
    rows += [(100 + k, rows[k][1] + f" tail{k}") for k in range(0, 50, 7)] + [(200 + k, " ".join(rows[k][1].split()[3:])) for k in range(0, 50, 5)]
    base = [f"c{k}" for k in range(60)]
    rows += [(300 + k, " ".join(base[:k % 9] + [f"z{k}"] + base[k % 9:])) for k in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, jaccard_join.near_copies(spark, docs).collect()))
    assert got == brute(rows)


def test_what_leaves_a_group_does_not_grow_with_its_square(spark):
    """Of n unlinked sets behind one passage, at most n rows leave each shingle's task, and no more links than sets."""
    out = {}
    for n in (40, 160):
        docs = spark.createDataFrame(sharing(random.Random(1), n, 40, 12), "doc_id long, text string")
        seen = []
        watched, joins = jaccard_join.suspects, jaccard_join.joined
        try:
            jaccard_join.suspects = lambda rows, *told: seen.append((rows.count(), (found := watched(rows, *told)).count())) or found
            jaccard_join.joined = lambda rows, *told: seen.append((rows.count(), (found := joins(rows, *told)).count())) or found
            assert jaccard_join.near_copies(spark, docs).where("component_id <> doc_id").count() == 0
        finally:
            jaccard_join.suspects, jaccard_join.joined = watched, joins
        out[n] = seen
        assert all(left <= came for came, left in seen) and all(left == 0 for _, left in seen[1:])
    if out[40] and out[160]:
        assert out[160][0][1] <= 6 * out[40][0][1]


def test_sets_travel_as_the_shorter_of_text_and_set():
    """Prose as its compressed text, well under eight bytes a shingle; a text of few distinct shingles as these."""
    rng = random.Random(3)
    prose = [" ".join(rng.choice(["Alpha", "bEta", "gamma", "delta", "\u00e9psilon", "zeta\n"]) + str(rng.randrange(50)) for _ in range(400)) for _ in range(40)]
    texts = [*prose, "", "one two", " ".join(rng.choice("abcdefgh") * 40 for _ in range(7)), "x " * 30_000, None, *prose[:3]]
    sets = [jaccard_join.shingles(jaccard_join.words(*jaccard_join.flat(pa.array([x])), jaccard_join.NOT_SPACE), 5)[0] for x in texts]
    sent = [jaccard_join.packed((x or "").encode(), y) for x, y in zip(texts, sets)]
    assert all(len(x) <= y.nbytes + 8 for x, y in zip(sent, sets)) and 2 * sum(map(len, sent[:40])) < sum(y.nbytes for y in sets[:40])
    for size in (1, 5000, 2 << 20):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(jaccard_join, "CHUNK_BYTES", size)
            got = list(jaccard_join.unpacked(pa.chunked_array([pa.array(sent[:7], pa.binary()), pa.array(sent[7:], pa.binary())]), 5))
        assert len(got) == len(sets) and all(a.tolist() == b.tolist() for a, b in zip(got, sets))


def test_shingles_of_the_same_classes_are_one(spark):
    """Thirty shingles of one passage leave a row a class, not thirty; shingles of one component none; few are remembered."""
    rows = [(h, 100, a, 5 + h, a) for h in range(30) for a in range(8)] + [(50, 100, a, 60, a) for a in range(5)]
    rows += [(60, 100, a, 70, 1) for a in range(9)] + [(100 + h, 100, a, 100 + h, a) for h in range(40) for a in (7, 100 + h)]
    out = jaccard_join.unjoined(spark.createDataFrame(rows, "h long, size long, a long, pos long, root long")).collect()
    by = {}
    for r in out:
        by.setdefault(r.h, {})[r.a] = r.before
    passage = next(h for h in by if h < 30)
    assert sorted(by) == [passage, 50, *range(100, 140)] and set(by[passage]) == set(range(8)) and set(by[50]) == set(range(5))
    assert by[50][0] == [passage] and by[139][7] == list(range(139 - jaccard_join.REMEMBERED_BEFORE, 139)) and by[139][139] == []


@pytest.mark.parametrize("remembered", [0, 1, 16])
def test_links_of_groups_that_share_several_passages(spark, monkeypatch, remembered):
    """However few earlier shingles a row remembers, no pair is left out: passages overlap in part, in all and not at all."""
    monkeypatch.setattr(jaccard_join, "REMEMBERED_BEFORE", remembered)
    rng = random.Random(8)
    parts = [[f"p{k}_{i}" for i in range(14)] for k in range(5)]
    rows = []
    for k in range(70):
        shared = [x for part in rng.sample(parts, rng.randint(1, 4)) for x in part]
        own = [f"o{k}_{i}" for i in range(rng.choice([1, 6, 20, 40]))]
        rows.append((k, " ".join(own + shared if k % 2 else shared + own)))
    rows += [(100 + k, rows[k][1] + f" t{k}") for k in range(0, 70, 6)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_join.near_copies(spark, docs).collect())) == brute(rows)


def test_slot_counts_do_not_carry(spark):
    counts = np.full((jaccard_join.SLOTS // jaccard_join.SLOT_BLOCK, jaccard_join.SLOT_BLOCK), 65535, np.uint16)
    one = [(None, b, bytearray(counts[b].tobytes())) for b in range(2)]
    seen = spark.createDataFrame(one * 3, "doc_id long, block int, counts binary")
    total = jaccard_join.slot_counts(seen)
    assert set(total[:2 * jaccard_join.SLOT_BLOCK].tolist()) == {3 * 65535} and total[2 * jaccard_join.SLOT_BLOCK:].max() == 0


def test_one_of_each_by_id_and_set(spark):
    """Repeated ids with different texts: what is linked leaves one row, whatever ids the rows carry; other rows stay."""
    rng = random.Random(6)
    t, u = ([f"{c}{k}" for k in range(60)] for c in "tu")
    near = lambda w, k: " ".join(w[:k] + ["new"] + w[k:])
    rows = [(2, " ".join(t), "a"), (5, near(t, 30), "b"), (5, " ".join(u), "c"), (2, near(u, 10), "d"), (9, near(u, 59), "e"), (7, " ".join(t), "f"),
            (11, "alone here", "g"), (11, "alone here", "g"), (12, None, "h"), (13, "", "i"), (13, "", "i"), (None, " ".join(t), "j"), (None, None, "k"), (14, prose(rng, ["q", "rs"], 50), "l")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").selectExpr("*", "1L AS set_key_", "'x' AS component_id").repartition(4)
    left = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert left.columns == docs.columns
    got = sorted((r.source for r in left.collect()))
    # (5, near t) and 7 go with (2, t); of the u texts the one with id 2 stays; one of the equal rows of 11
    assert got == ["a", "d", "g", "h", "i", "i", "j", "k", "l"]
