"""The corpus pipeline on planted cases, and the registered queries."""

import random

import corpus_pipeline
from tests.llm.conftest import DOCS
from tests.llm.test_documents import brute_components, prose


def write(spark, path, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_on_planted_cases(spark, tmp_path):
    rng = random.Random(21)
    passage = ". ".join(prose(rng, 10).capitalize() for _ in range(6)) + "."
    item = prose(rng, 30).capitalize() + "."
    texts = [prose(rng, 60) for _ in range(60)]
    for i in range(10):
        texts[i] += " zorgle " * (1 + i % 3)
    texts += [texts[20], texts[21] + " one more"]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(3)]
    texts += [f"{prose(rng, 20)} {item} {prose(rng, 20)}"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (None, "lone words", "en", "s", 10)]
    write(spark, tmp_path, docs, [(i, 1, int(i < 8)) for i in range(40) if i not in (8, 9)], [(1, item), (2, None)])
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == {*range(10, 60), 62, 63, 64, 900, None}
    assert passage in rows[62].text and passage not in rows[63].text + rows[64].text
    assert all(rows[i].text == texts[i] for i in range(10, 63)
               if i in rows) and rows[63].n_chars == len(rows[63].text)
    assert rows[900].ids == [] and rows[900].n_tokens == 0 and all(len(r.ids) == r.n_tokens for r in rows.values())


def test_near_dedup_stage_equals_brute_force(spark, tmp_path):
    rng = random.Random(22)
    texts = {i: prose(rng, 50) for i in range(30)}
    for i in range(30, 60):
        w = texts[i % 7].split()
        w[rng.randrange(50)] = "changed"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, (_, c) in brute_components(texts, 80).items() if c == i}


def test_stages_on_odd_and_empty_tables(spark, tmp_path, odd_docs, no_docs):
    write(spark, tmp_path, [], [], [])
    for docs, n in ((odd_docs, 12), (no_docs, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() == (n if name != "near_dedup" else min(n, 11)), name
            if name != "tokenization":
                assert out.columns == docs.columns, name


def test_queries_are_registered():
    import __spark_entry__
    names = [n.split("_")[0] for n in __spark_entry__.queries()]
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
