import random
from collections import Counter

import pytest

from prosodia.llm import decontam

DOCS, ITEMS = "item_id string, doc_id long, text string, n_words int", "item_id long, text string, doc_id int"


def brute(docs, items, similarity=0.8, shingle=5):
    out = {}
    known = {w for _, text in items for w in decontam.tokens(text)}
    for doc_id, text in docs:
        words = decontam.tokens(text)
        if not known & {*words}:
            continue
        for item, item_text in items:
            wanted = decontam.tokens(item_text)
            n, width = len(wanted), min(len(wanted), shingle)
            cut = lambda w, width=width: Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
            target = cut(wanted)
            for start in range(len(words) - n + 1) if n else []:
                window = cut(words[start : start + n])
                common = sum((window & target).values())
                score = common / (2 * sum(target.values()) - common)
                if score >= similarity and score > out.get((doc_id, item), (0,))[0]:
                    out[doc_id, item] = (score, start, n)
    return {(*k, round(s, 9), start, n) for k, (s, start, n) in out.items()}


def corpus():
    draw = random.Random(7)
    prose = lambda n: [f"w{draw.randrange(60)}" for _ in range(n)]
    items = [(i, prose(draw.choice([1, 3, 4, 5, 6, 12, 40, 90]))) for i in range(30)]
    docs = []
    for i in range(80):
        words = prose(draw.randint(0, 80))
        if i % 2:
            passage = list(draw.choice(items)[1])
            for _ in range(draw.randrange(3)):
                passage[draw.randrange(len(passage))] = "new"
            words[10:10] = [w.upper() + draw.choice(["", ",", " - "]) for w in passage]
        docs.append((i, " ".join(words)))
    items = [(i, " ".join(w)) for i, w in items] + [(100, None), (101, ""), (102, "..."), (103, "w1 " * 9), (104, " ".join(items[6][1]))]
    return docs + [(900, None), (901, ""), (902, "w1 " * 400), (903, "word " * 60_000)], items


@pytest.mark.parametrize("chunk", [5000, 7])
def test_as_brute_force(spark, chunk):
    docs, items = corpus()
    frame = spark.createDataFrame([("", i, t, 0) for i, t in docs], DOCS).repartition(3)
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    got = decontam.contaminated(frame, benchmark, chunk=chunk).collect()
    want = brute(docs, items)
    assert len(want) > 20
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["start_word"], r["n_words"]) for r in got} == want and len(got) == len(want)
    kept = decontam.clean(frame, benchmark, chunk=chunk)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, _ in docs} - {w[0] for w in want})


def test_empty_tables_and_repeated_rows(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([("", 1, "a b c d e f", 0), ("", 1, "a b c d e f", 0), ("", None, "x a b c d e f", 0)], DOCS)
    item = spark.createDataFrame([(5, "a b c d e f", 0), (5, "a b c d e f", 0)], ITEMS)
    assert decontam.contaminated(docs, item).collect() == [] and decontam.contaminated(one, items).collect() == []
    assert decontam.clean(one, items).count() == 3 and decontam.clean(one, item).count() == 0
    assert len(decontam.contaminated(one, item).collect()) == 6


def test_documents_shorter_than_an_item(spark):
    draw = random.Random(8)
    items = [(i, [f"w{draw.randrange(300)}" for _ in range(n)]) for i, n in enumerate([6, 20, 50, 50, 90])]
    docs, want = [], set()
    for item, words in items:
        for first in range(0, 6):
            for last in range(0, 16, 3):
                part = words[first : len(words) - last]
                docs.append((len(docs), " ".join(part)))
                cut = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
                a, b = cut(part), cut(words)
                score = sum((a & b).values()) / sum((a | b).values())
                if score >= 0.8:
                    want.add((docs[-1][0], item, round(score, 9), 0, len(part)))
    frame = spark.createDataFrame([("", i, t, 0) for i, t in docs], DOCS).repartition(3)
    benchmark = spark.createDataFrame([(i, " ".join(w), 0) for i, w in items], ITEMS)
    got = decontam.contaminated(frame, benchmark).collect()
    assert len(want) > 30
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["start_word"], r["n_words"]) for r in got} == want
    assert {r["doc_id"] for r in decontam.clean(frame, benchmark).collect()} == {i for i, _ in docs} - {w[0] for w in want}
