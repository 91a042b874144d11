import random
import zlib

from prosodia.llm import lang_id

SCHEMA = "score string, doc_id long, text string, lang string, held_out int"
WORDS = {
    "en": "the of and to in is that it was for on are with as his they be at one have this from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo como más".split(),
}


def corpus(n=240):
    draw = random.Random(3)
    langs = sorted(WORDS)
    rows = []
    for i in range(n):
        lang = langs[i % 4]
        rows.append(("", i, " ".join(draw.choices(WORDS[lang], k=draw.randint(8, 60))), None if i % 11 == 0 else lang, 0))
    return rows


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus()
    odd = [(1001, None), (1002, ""), (1003, "1234 -- !?"), (1004, "а"), (1005, "The And Of " * 60_000), (None, "the and of to in")]
    docs = spark.createDataFrame(rows + [("", i, t, None, 0) for i, t in odd], SCHEMA).repartition(4)
    found = lang_id.predict(docs, *lang_id.learn(docs)).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) + len(odd)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {*WORDS, "und"}
    true = {i: sorted(WORDS)[i % 4] for i in range(len(rows))}
    assert all(got[i]["lang_pred"] == lang for i, lang in true.items())
    assert [got[i]["lang_pred"] for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1001]["score"] == 0
    assert got[1004]["lang_pred"] != "und" and got[1005]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"


def test_labels_of_held_out_documents_are_not_learnt(spark):
    rows = [(a, i, t, lang if zlib.crc32(str(i).encode()) % 5 else "xx", b) for a, i, t, lang, b in corpus()]
    langs, _ = lang_id.learn(spark.createDataFrame(rows, SCHEMA))
    assert langs == sorted(WORDS)


def test_held_out_fifth_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    found = lang_id.predict(docs, *lang_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    tried = found.where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(tried) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in tried) / len(tried) > 0.95


def test_empty_and_unlabelled(spark):
    empty = spark.createDataFrame([], SCHEMA)
    langs, prototypes = lang_id.learn(empty)
    assert langs == [] and lang_id.predict(empty, langs, prototypes).collect() == []
    bare = spark.createDataFrame([("", 1, "some words", None, 0), ("", 2, "12", None, 0)], SCHEMA)
    learnt = lang_id.learn(bare)
    assert [r["lang_pred"] for r in lang_id.predict(bare, *learnt).collect()] == ["und", "und"]
    kept = lang_id.recognised(bare, *learnt)
    assert [r["doc_id"] for r in kept.collect()] == [1] and kept.columns == bare.columns
