"""The pipeline against plain Python over a small table with every kind of document that its stages act on."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline
from prosodia.llm import bpe, decontam

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone_id long"


def tables(spark, folder):
    draw = random.Random(12)
    words = {lang: [f"{lang}{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)] for lang in ("ba", "ol", "um")}
    prose = lambda lang, n: " ".join(draw.choices(words[lang], k=n))
    items = [prose("ba", 30) for _ in range(5)]
    clean = [prose(lang, draw.randint(60, 300)) for lang in words for _ in range(12)]
    rows = list(clean)
    copies = [t.upper() for t in clean[:4]]
    near = [t.split() for t in clean[4:10]]
    for w in near:
        w[len(w) // 2] = "another"
    near = [" ".join(w) for w in near]
    leaks = [f"{prose('ba', 40)} {x} {prose('ba', 20)}" for x in items]
    junk = [None, "", "12 34 !?", "\n"]
    rows += copies + near + leaks + junk
    documents = [(i, t, "ba" if i < 12 else None if i % 7 == 0 else "xx", "s", len(t or ""), 0) for i, t in enumerate(rows)]
    documents = [(i, t, (None if t is None or i >= len(clean) else t[:2]), s, n, g) for i, t, _, s, n, g in documents]
    spark.createDataFrame(documents, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    expected = {i: t for i, t in enumerate(rows)}
    for i in range(len(rows) - 4, len(rows)):
        del expected[i]  # no letters
    for i in range(4):
        del expected[i]  # the copy has the larger id
    for i in range(len(clean) + 4, len(clean) + 10):
        del expected[i]  # near copies of documents with smaller ids
    return {i: t for i, t in expected.items() if not any(x in t for x in items)}


def test_run(spark, tmp_path):
    expected = tables(spark, tmp_path)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(expected)
    coder = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for i, text in expected.items():
        ids = coder.encode(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["exact"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), True)
    assert not any(decontam.tokens(t) == [] for t in expected.values())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, tmp_path, name, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    out = stage(spark, docs, str(tmp_path))
    assert out.collect() == []
    assert name == "byte_bpe" or out.columns == docs.columns


def test_stages_keep_columns_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "some words", "en", "s", 1, 7), (1, "other words here", "en", "s", 1, 7), (None, "no id but words", None, None, None, None), (2, "some words", "en", "t", 1, 8), (2, "some words", "en", "t", 1, 8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.exact(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "no id but words"), (1, "other words here"), (2, "some words")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_very_long_texts_go_through(spark, tmp_path):
    draw = random.Random(6)
    words = [f"wo{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    long = " ".join(draw.choices(words, k=60_000))
    item = " ".join(draw.choices(words, k=40))
    near = long.replace(" ", "  ", 5) + " one more"
    rows = [(1, long, "en", "s", 1, 0), (2, near, "en", "s", 1, 0), (3, long.upper(), "en", "s", 1, 0), (4, " ".join(draw.choices(words, k=50_000)) + " " + item, "en", "s", 1, 0), (5, "x" * 200_000, None, "s", 1, 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 2 in got and not {1, 3, 4} & set(got) and got[2]["exact"]


def test_near_copies_of_one_text_in_hundreds(spark):
    draw = random.Random(7)
    words = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(500):
        copy = list(words)
        copy[draw.randrange(400)] = f"n{i}"
        rows.append((1000 - i, " ".join(copy), "en", "s", 1, 0))
    rows.append((5000, " ".join(draw.choices(words, k=400)), "en", "s", 1, 0))
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [501, 5000]
