"""Classifiers, extraction, tokens, chats and segmentations: brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logtide.llm import chat_format, html_extract, language_id, quality_fm, toxicity
from logtide.llm import sentencepiece_sampling as sampling
from logtide.llm.common import flat
from logtide.llm.queries import tokenizer_path
from logtide.llm.structure import STATISTICS, Texts, statistics
from logtide.llm.token_counts import Cutter, token_counts

ODD = [None, "", " ", "…", "x", "\n\n", "word " * 20_000, "É" * 3000, "1234 !!", "家族"]


def odd_documents(spark, rows=()):
    texts = [*rows, *((9000 + i, t) for i, t in enumerate(ODD)), (9001, ""), (None, "no id here"), (9004, "x")]
    return spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'q' AS score", "1 AS label", "'z' AS accepted")


# language ------------------------------------------------------------------

TONGUES = {"aa": "ka lo mi nu te ra", "bb": "sch ung keit lich ber zu", "cc": "eau oux ment tion que é"}


def tongue_texts(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        parts = TONGUES[lang].split()
        yield i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 60))), lang


def test_languages_are_learned_and_odd_texts_are_unknown(spark):
    rows = list(tongue_texts(1, 400))
    docs = spark.createDataFrame([(*r, 5) for r in rows] + [(1000, "some text", None, 5), (1001, None, "aa", 5)], "doc_id long, text string, lang string, score int")
    model = language_id.learn(docs)
    assert model.languages == sorted(TONGUES)
    held_out = list(tongue_texts(2, 200))
    got = {r.doc_id: r for r in language_id.identified(spark, spark.createDataFrame([r[:2] for r in held_out], "doc_id long, text string"), model).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held_out]) > 0.97
    odd = odd_documents(spark)
    found = language_id.identified(spark, odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    unknown = {9000, 9001, 9002, 9003, 9005, 9008}
    assert {r.doc_id for r in found if r.lang_pred == "und"} == unknown and not any(r.accepted for r in found if r.doc_id in unknown)
    kept = language_id.accepted(spark, odd, model)
    assert kept.columns == odd.columns and not {r.doc_id for r in kept.collect()} & unknown


def test_language_model_is_the_same_from_any_partitions_and_takes_no_rows(spark):
    docs = spark.createDataFrame(list(tongue_texts(3, 120)), "doc_id long, text string, lang string")
    a, b = language_id.learn(docs.repartition(7)), language_id.learn(docs.coalesce(1))
    assert np.array_equal(a.table, b.table) and a.temperature == b.temperature
    assert language_id.learn(docs.limit(0)) is None
    assert [r.lang_pred for r in language_id.identified(spark, docs.limit(2), None).collect()] == ["und", "und"]


def test_many_languages_use_the_embeddings():
    labels = [f"l{i % 20:02d}" for i in range(200)]
    model = language_id.trained([f"{'xyzwv'[int(k[1:]) % 5] * 2}{k} {k}{k}" for k in labels], labels)
    assert model.weights is not None and len(model.languages) == 20


# toxicity and quality ------------------------------------------------------

def marked_texts(seed, n):
    rng = random.Random(seed)
    plain = ["".join(rng.choice(["ta", "lo", "mi", "ren", "sk"]) for _ in range(3)) for _ in range(300)]
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["zorg", "ZORG!", "z0rg", "vilpo", "you vilpo"]))
        good = rng.random() < 0.8
        yield i, " ".join(w) if good else " | ".join(x.upper() + "!!" for x in w), int(toxic), int(good)


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers_hold_out_well_and_score_every_row(spark, kind):
    rows = list(marked_texts(1, 700))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[3], r[2]) for r in rows] + [(5000, 1, 1), (None, 0, 0), (3, None, None), (1, 1 - rows[1][3], 1 - rows[1][2])],
                                   "doc_id long, quality int, toxic int")
    module, at = (toxicity, 2) if kind == "toxic" else (quality_fm, 3)
    model = module.learn(docs, labels)
    new = list(marked_texts(2, 300))
    got = {r.doc_id: r.score for r in module.scored(spark, spark.createDataFrame([r[:2] for r in new], "doc_id long, text string"), model).collect()}
    assert np.mean([(got[r[0]] >= (0.3 if kind == "toxic" else 0.5)) == bool(r[at]) for r in new]) > 0.95
    found = module.scored(spark, odd_documents(spark), model).collect()
    assert len(found) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in found)
    if kind == "toxic":
        odd = odd_documents(spark, [(1, "zorg vilpo zorg talomi")])
        clean = module.clean(spark, odd, model)
        assert clean.columns == odd.columns and {r.doc_id for r in odd.collect()} - {r.doc_id for r in clean.collect()} == {1}


@pytest.mark.parametrize("module", [toxicity, quality_fm])
def test_classifiers_without_labels_give_their_share(spark, module):
    docs = spark.createDataFrame([(i, "a b") for i in range(9)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.scored(spark, docs, module.learn(docs, none)).collect()} == {0.0}
    assert {r.score for r in module.scored(spark, docs, module.learn(docs, one)).collect()} == {1.0}


def test_factorisation_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    texts = Texts(*flat(pa.array(["a b a c!", "", "D e"])))
    edges = np.tile(np.linspace(0, 5, quality_fm.BINS - 1), (len(STATISTICS) + 1, 1))
    model = quality_fm.Model(0.3, edges, rng.normal(size=quality_fm.INPUTS), rng.normal(size=(quality_fm.INPUTS, 3)))
    number, value, first = quality_fm.inputs(texts, edges)
    for i, margin in enumerate(model.margins(texts)):
        own = list(zip(number[first[i]:first[i + 1]], value[first[i]:first[i + 1]]))
        pairs = sum(model.factors[a] @ model.factors[b] * x * y for (a, x), (b, y) in itertools.combinations(own, 2))
        assert math.isclose(margin, 0.3 + sum(model.linear[a] * x for a, x in own) + pairs, abs_tol=1e-9)


def test_statistics_of_a_text():
    rows = dict(zip(STATISTICS, statistics(Texts(*flat(pa.array(["Ab AB ab! | 12", ""]))))[0]))
    assert rows["all_capitals"] == 1 / 4 and rows["distinct_words"] == 2 / 4 and rows["largest_share"] == 3 / 4 and rows["pipes"] == 1 / 4


def test_isotonic_is_the_best_rising_fit():
    raw, p = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(p) == [0, 0.5, 1] and list(raw) == [1, 2.5, 4]


# pages ---------------------------------------------------------------------

PAGES = [
    ("<body><nav><a>x</a></nav><article><h1>T &amp; t</h1><p>a<b>b</b>\n c<p>d<br>e</article><footer>f</footer>", "T & t\nab c\nd e"),
    ("<article><p>x<div class='adBox ad'>no</div><ul><li>1<li>2</ul><section id=comments>c</section><form>q</form>tail", "x\n1\n2\ntail"),
    ("<script>if (a < b) '</p>'</script><style>p{}</style><div class=cookie-consent>no</div><div>yes</div><div><a>all</a> <a>links</a></div>", "yes"),
    ("<main><p>one &lt;b&gt; &#233; &nbsp; two</p><!-- <p>no</p> --><aside>s</aside></main><p>outside", "one <b> é two"),
    ("a < b and c > d", "a < b and c > d"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
    ("<div hidden>no</div><p style='display: none'>no</p><p>yes", "yes"),
    ("", ""), ("<article></article>", ""), ("<p", ""),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text_of_a_page(html, text):
    assert html_extract.extracted(html_extract.parsed(html), set()) == text


def test_templates_of_hosts(spark):
    body = "<html><body><div class=top>Site name</div><div class=page>{}<div class=end>Read on at our shop</div></div><footer>f</footer></body></html>"
    rows = [(i, f"http://a.example/{i}", body.format(f"<p>Own text number {i} " + "and more words " * 9 + "</p><p>shared line</p>" * (i % 2))) for i in range(12)]
    rows += [(100 + i, f"http://same.example/{i}", "<article><p>One article</p><p>twice</p></article>") for i in range(6)]
    rows += [(200, None, "<p>no address</p>"), (201, "http://a.example/x", None), (202, "", ""), (3, "http://a.example/3", rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS host", "2 AS part")
    got = html_extract.main_texts(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all("Site name" not in by[i].text and "our shop" not in by[i].text and f"number {i} " in by[i].text for i in range(12))
    assert by[1].text.endswith("shared line"), "a line on some of the pages is no template"
    assert by[100].text == "One article\ntwice" and (by[200].text, by[201].text, by[202].n_chars) == ("no address", "", 0)
    assert html_extract.main_texts(df.limit(0)).collect() == []


def test_templates_nest_and_bound_slots(spark):
    page = "<body><div class=top><p>Menu of this site with many words</p></div><div class=page><p>{}</p></div><div class=end>Note</div></body>"
    rows = [(i, "http://plain.example/", page.format(f"Text {i} " + "and more " * (40 * (i > 0)))) for i in range(8)]
    rows += [(100 + i, "http://news.example/", f"<body><article><h1>Title {i} {'of a story ' * 20}</h1><p>Read by all.</p></article></body>") for i in range(8)]
    stamped = "<body><div class=story><p>One story {}</p></div><div class=when>{}</div></body>"
    rows += [(200 + i, "http://again.example/", stamped.format("told on every page " * 9, i)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(df).collect()}
    assert got[0] == "Text 0" and got[1].startswith("Text 1 and more"), "a short page loses the menu as a long one does"
    assert all(got[100 + i] == f"Title {i} {'of a story ' * 20}".strip() for i in range(8)), "a fixed slot of an article goes"
    assert all(got[200 + i] == ("One story " + "told on every page " * 9).strip() for i in range(8)), "one repeated article is kept, the stamp beside it is not"
    found = {r.host: r for r in html_extract.templates(df).collect()}
    paths = {b[1].split()[0]: b[0] for b in html_extract.parsed(rows[0][2]).blocks}
    assert set(found["plain.example"].fixed) == {paths["Menu"], paths["Note"]} < set(found["plain.example"].elements)
    assert found["again.example"].main and not found["again.example"].fixed, "most of its main element is on every page"
    assert len(found["news.example"].fixed) == 1


def scrambled(html):
    """The page with elements and classes whose names mean nothing, or mislead."""
    for tag, name in (("nav", "k1 content"), ("article", "k2 sidebar"), ("footer", "k3 main"), ("header", "k5")):
        html = html.replace(f"<{tag}>", f'<div class="{name}">').replace(f"</{tag}>", "</div>")
    return html.replace('class="ad"', 'class="k4"')


def test_the_template_decides_whatever_names_mean(spark):
    """Menus, notices, adverts and footers differ from page to page here; the main element is found by what it holds."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(("ta", "lo", "mi", "ren")) for _ in range(3))
    rows = []
    for host in range(4):
        for i in range(9):
            links = "".join(f'<li><a href="/{word()}">{word()} {word()}</a></li>' for _ in range(6))
            paragraphs = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(rng.randint(2, 9))]
            html = (f'<html><body><nav><ul>{links}</ul></nav><header>{word()} {word()}</header><div class="ad">{word()} buy {word()}.</div><article><h1>{word()}</h1>'
                    f'{"".join(f"<p>{p}</p>" for p in paragraphs)}<div class="k7">Join our list today</div></article><footer>(c) {word()} {i}</footer></body></html>')
            rows.append((100 * host + i, f"http://h{host}.example/{i}", html))
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "\n".join(b[1] for b in html_extract.parsed(html).blocks if b[2] and b[1] != "Join our list today") for i, _, html in rows}
    assert {r.page_id: r.text for r in html_extract.main_texts(frame(rows)).collect()} == want, "as tags say, without the fixed slot"
    got = {r.page_id: r.text for r in html_extract.main_texts(frame([(i, u, scrambled(html)) for i, u, html in rows])).collect()}
    assert got == want, "and the same where no name says so"


def brute_classes(pages):
    """Occurrence vectors written out: the tokens with the same number of occurrences in the same pages."""
    vectors = {}
    for k, page in enumerate(pages):
        for path in page.elements:
            vectors.setdefault((path, True), [0] * len(pages))[k] += 1
        for path, words, *_ in page.blocks:
            vectors.setdefault((html_extract.text_token(path, words), False), [0] * len(pages))[k] += 1
    classes = {}
    for token, vector in vectors.items():
        classes.setdefault(tuple(vector), set()).add(token)
    least = max(html_extract.LEAST_PAGES, html_extract.LEAST_SHARE * len(pages))
    return [tokens for vector, tokens in classes.items() if sum(map(bool, vector)) >= least and sum(e for _, e in tokens) >= 2]


def test_classes_against_written_out_vectors(spark):
    rng = random.Random(5)
    bits = ["<div class=a><p>one</p></div>", "<div class=b><p>two</p><p>two</p></div>", "<div class=c>three <i>x</i></div>", "<ul><li>4<li>5</ul>"]
    rows = [(i, "http://h.example/", "<body>" + "".join(b for b in bits if rng.random() < 0.7) + f"<p>{i}</p>" * rng.randint(1, 3) + "</body>") for i in range(14)]
    found = html_extract.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    want = brute_classes([html_extract.parsed(html) for *_, html in rows])
    assert set(found.elements) == {t for tokens in want for t, element in tokens if element} and len(want) > 1
    assert set(found.words) == {t for tokens in want for t, element in tokens if not element}


def test_hot_hosts_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "PAGES_A_PART", 3)
    rows = [(i, "http://h.example/", f"<body><div>menu of the site</div><div class=x><p>{'text %d ' % i * 30}</p></div></body>") for i in range(20)]
    got = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 20 and not any("menu" in r.text for r in got)


# tokens --------------------------------------------------------------------

@pytest.fixture(scope="module")
def cutter():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return Cutter(file.read())


def library_count(cutter, text):
    return len(cutter.tokenizer.encode(text or "", add_special_tokens=False).ids)


def chunk_count(cutter, text):
    chunks, special = cutter.chunks(text)
    return special + sum(sum(cutter.pieces(cutter.cut(c))) for c in chunks)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t\x1c\xa0'stlled1²aéÉ!_Ж家　<|endoftext|>"), max_size=20) | st.text(max_size=12) | st.just(" a<|endoftext|> b"))
def test_pieces_of_chunks_add_up(cutter, text):
    assert chunk_count(cutter, text) == library_count(cutter, text)


def test_written_out_classes_are_the_library_s(cutter):
    for c in range(0x250):
        for text in (f"a{chr(c)}1 {chr(c)}b", f"{chr(c)}{chr(c)} !"):
            assert cutter.cut(text) == [text[a:b] for _, (a, b) in cutter.tokenizer.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_token_counts_match_the_library(spark, cutter, monkeypatch):
    from logtide.llm import token_counts as module
    monkeypatch.setattr(module, "FREQUENT", 5)
    df = odd_documents(spark, [(1, "It's a test, isn't it? <|endoftext|> the the the"), (2, "the rare  words\n\n"), (2, "the rare  words\n\n")])
    df = df.selectExpr("*", "'r' AS row", "'t' AS tokens")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(spark, df, tokenizer_path("byte_bpe_50k.json")).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), library_count(cutter, r.text)) for r in df.collect()]
    assert got == sorted(((*w, w[2] > 1024) for w in want), key=str)
    assert token_counts(spark, df.limit(0), tokenizer_path("byte_bpe_50k.json")).collect() == []


# chats ---------------------------------------------------------------------

@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a]\nb", "\\", ""]), st.text(st.sampled_from("</s>[INST]\\\n]ax"), max_size=30)), max_size=5))
def test_chats_read_back(turns):
    text, spans = chat_format.rendered(turns)
    assert chat_format.read_back(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]
    inner = [chat_format.escape(t) for _, t in turns]
    assert not any(c in t for t in inner for c in chat_format.CONTROL)


def test_events_fold_to_final_messages():
    log = [(1, 1, "start", "user", None), (1, 1, "delta", None, "he"), (1, 2, "start", "assistant", None), (1, 1, "delta", None, "y"),
           (1, 2, "delta", None, "draft"), (1, 2, "regenerate", None, None), (1, 2, "delta", None, "final"), (1, 1, "edit", None, "hello"),
           (None, 3, "delta", "x", "unopened")]
    assert list(chat_format.folded(iter(log))) == [(1, [("user", "hello"), ("assistant", "final")]), (None, [("x", "unopened")])]
    with pytest.raises(ValueError):
        list(chat_format.folded(iter([(1, 1, "vanish", None, None)])))


def test_conversations_through_their_log(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "assistant", None), (None, 0, "user", "z"), (3, 5, "user", "x" * 9000),
            (4, 0, "user", "same"), (4, 0, "user", "same"), (4, None, "system", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS message")
    log = chat_format.logged(df.select("conv_id", "turn", "role", "text"))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(log, *chat_format.LOG_ORDER)).collect()}

    def digest(*turns):
        return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest(("user", "a"), ("assistant", "b</s>")) and (got[1].loss_chars, got[1].n_turns) == (5, 2)
    assert got[1].loss_sha256 == hashlib.sha256(b"b</s>").hexdigest()
    assert got[2].turns_sha256 == digest(("", ""), ("assistant", "")) and got[None].n_turns == 1
    assert got[4].turns_sha256 == digest(("system", "first"), ("user", "same"), ("user", "same"))
    assert chat_format.formatted(log.limit(0), *chat_format.LOG_ORDER).collect() == []


# segmentations -------------------------------------------------------------

@pytest.fixture(scope="module")
def known():
    return sampling.pieces(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def samples_of(known, texts, k, seed=3, ids=None):
    batch = pa.record_batch([pa.array(ids or range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return sampling.encoded(batch, known, k, seed).to_pylist()


def every_segmentation(known, library, text):
    """All of a short text, with their probabilities."""
    data = (" " + text).encode()
    weight = {}
    for i, w in zip(known.ids.tolist(), known.weights.tolist()):
        weight[library.id_to_piece(i).replace("▁", " ").encode()] = (i, w)

    def rest(at):
        if at == len(data):
            yield (), 0.0
        for end in range(at + 1, len(data) + 1):
            if data[at:end] in weight:
                i, w = weight[data[at:end]]
                for ids, p in rest(end):
                    yield (i, *ids), w + p
    found = dict(rest(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {ids: p - total for ids, p in found.items()}


@pytest.mark.parametrize("text", ["the cat", "a", "  in"])
def test_samples_follow_the_lattice(known, library, text):
    want = every_segmentation(known, library, text)
    n, k = 4000, 3
    rows = samples_of(known, [text] * n, k)
    first, inclusion = {}, {}
    for row in rows:
        ids = [tuple(s["ids"]) for s in row["samples"]]
        assert len(set(ids)) == len(ids) == min(k, len(want))
        assert [s["perturbed"] for s in row["samples"]] == sorted((s["perturbed"] for s in row["samples"]), reverse=True)
        first[ids[0]] = first.get(ids[0], 0) + 1 / n
        for name, s in zip(ids, row["samples"]):
            assert math.isclose(s["log_prob"], want[name], abs_tol=1e-9)
            inclusion[name] = inclusion.get(name, 0) + 1 / s["inclusion"] / n
    for ids, p in want.items():
        if p > math.log(0.05):
            assert abs(first.get(ids, 0) - math.exp(p)) < 0.03 and abs(inclusion[ids] - 1) < 0.12


def test_long_chunks_follow_the_lattice(known):
    rows = samples_of(known, ["stationer" * 40] * 600, 2)
    first, second = ([row["samples"][i] for row in rows] for i in (0, 1))
    assert min(len(s["ids"]) for s in second) > 3 * sampling.STEPS
    spread = [np.std([s["log_prob"] for s in samples]) for samples in (first, second)]
    assert abs(spread[1] / spread[0] - 1) < 0.2, "steps that share a random number vary together"
    assert abs(np.mean([s["log_prob"] for s in first]) - np.mean([s["log_prob"] for s in second])) < 0.3 * spread[0]
    a, b = sampling.samples(*flat(pa.array(["stationer" * 40])), np.array([7], np.uint64), known, 2), sampling.samples(*flat(pa.array(["stationer" * 40] * 2)), np.array([3, 7], np.uint64), known, 2)
    ids = a[0][1][2], b[0][1][2][b[0][1][1][1]:]
    assert np.array_equal(*ids), "numbers depend on the row's key alone"


def test_samples_decode_to_their_texts(known, library):
    texts = ["hello world", None, "", " two  blanks ", "家 and \U0001F600\n\ttabs", "mark ▁ itself", "x" * 300, "a" * 5 + "é" * 40]
    rows = samples_of(known, texts, 4)
    assert [len(r["samples"]) for r in rows[1:3]] == [0, 0] and all(r["round_trip"] for r in rows)
    for text, row in zip(texts, rows):
        for s in row["samples"]:
            assert sampling.decode(np.array(s["ids"]), known).tobytes().decode() == " " + text
            if "▁" not in text:
                assert library.decode(s["ids"]) == text


def test_samples_depend_on_the_key_alone(spark, known):
    df = odd_documents(spark, [(1, "the same text"), (2, "the same text"), (1, "the same text")])
    path = tokenizer_path("piece_bpe_32k.model")
    def told(d):
        rows = sampling.sampled_segmentations(spark, d, path, k=2).collect()
        return sorted(((r.doc_id, str([(s.ids, round(s.log_prob, 6), round(s.perturbed, 6)) for s in r.samples])) for r in rows), key=str)
    a, b = told(df.coalesce(1)), told(df.repartition(5))
    assert a == b and len(a) == df.count()
    same = [s for i, s in a if i in (1, 2)]
    assert same[0] == same[1] != same[2]
    assert sampling.sampled_segmentations(spark, df.limit(0), path).collect() == []
