"""The pipeline's stages on planted documents, each against what brute force expects of its own input."""

import random
import re
from functools import reduce

import pytest

import __spark_entry__ as contract
import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, parts):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    tongues = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["sch", "ung", "keit", "zu"]}
    rows, labels = [], []
    for i in range(300):
        lang = rng.choice(list(tongues))
        text = sentence(rng, rng.randint(20, 60), tongues[lang])
        toxic = i % 5 == 0
        if toxic:
            text = " ".join(w + (" zorgvil" if k % 8 == 0 else "") for k, w in enumerate(text.split()))
        labels.append((i, 1, int(toxic)))
        rows.append([i, text, lang, f"s{i % 3}", len(text)])
    items = [(k, sentence(rng, 14, ["qua", "pri", "sto"] + tongues["aa"])) for k in range(5)]
    clean = [r for r in rows if r[0] % 5]
    copies = [[1000 + k, clean[k][1] + " tail", "aa", None, None] for k in range(6)] + [[1010 + k, clean[10][1], "aa", "x", 1] for k in range(4)]
    leaks = [[1100 + k, sentence(rng, 30, tongues["bb"]) + "\n" + items[k][1].upper() + "! " + sentence(rng, 20, tongues["bb"]), "bb", "x", 1] for k in range(5)]
    odd = [[1200, None, "aa", "x", None], [1201, "", "aa", "x", 0], [1202, "12 34 !!", None, None, None], [clean[20][0], *clean[20][1:]],
           [None, sentence(rng, 40, tongues["aa"]), "aa", "x", 1]]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([tuple(r) for r in rows + copies + leaks + odd], COLUMNS).selectExpr("*", "doc_id AS component_id", "1.5 AS score").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {"copies": copies, "leaks": leaks, "items": items, "clean": clean}


def test_stages_take_effect(spark, folder, tmp_path):
    path, planted = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{number}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{number}")
        after = docs.collect()
        if name != "encode":
            assert docs.columns == columns
        ids, gone = [r.doc_id for r in after], {r.doc_id for r in before} - {r.doc_id for r in after}
        seen.append(name)
        if name == "language":
            assert gone == {1200, 1201, 1202}
        elif name == "toxicity":
            assert gone == set(range(0, 300, 5))
        elif name == "near_copies":
            assert gone == {r[0] for r in planted["copies"]} and len(ids) == len(set(ids))
        elif name == "decontaminate":
            assert not gone
            texts = {r.doc_id: r for r in after}
            old = {r.doc_id: r.text for r in before}
            assert {i for i in texts if texts[i].text != old[i]} == {r[0] for r in planted["leaks"]}
            for k in range(5):
                words = re.findall(r"\w+", texts[1100 + k].text.lower())
                assert planted["items"][k][1].split()[3] not in words and texts[1100 + k].n_chars == len(texts[1100 + k].text)
        else:
            assert not gone and all(r.round_trip and r.samples for r in after)
    assert seen == ["language", "toxicity", "near_copies", "decontaminate", "encode"]
    assert reduce(lambda n, _: n + 1, after, 0) == len(before)


def test_an_empty_table_passes_through(spark, folder, tmp_path):
    path, _ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_its_query():
    names = contract.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(contract.oracle_sql()) <= set(names)
