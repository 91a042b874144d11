import hashlib
import random
import time

import numpy as np
import pytest

from prosodia.llm import shared
from prosodia.llm import suffix_dedup as sd


def brute(rows, length=50):
    first = {}
    for doc_id, text in rows:
        t = (text or "").encode()
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < doc_id:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdeé", k=draw.randint(2, 6))) for _ in range(40)]
    prose = lambda k: " ".join(draw.choices(words, k=k))
    passages = [prose(30) for _ in range(6)] + ["x" * 130, "-" * 60, "common line of text that every third document has in it, word by word."]
    rows = []
    for i in range(n):
        parts = [prose(draw.randint(0, 25)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, passages[-1])
        parts.insert(draw.randint(0, 3), draw.choice(passages))
        rows.append((i, " ".join(parts)))
    rows += [(n, rows[0][1]), (n + 1, rows[1][1][:-3] + "abc"), (n + 2, ""), (n + 3, None), (n + 4, "z" * 49), (n + 5, "z" * 50), (n + 6, "z" * 51), (n + 7, prose(3000) + rows[5][1])]
    return rows


def found(frame):
    return sorted(tuple(r)[:5] for r in frame.collect())


@pytest.mark.parametrize("options", [{}, {"chunk": 300, "bucket_bytes": 500}, {"crowd": 1}, {"least_crowded": 3, "chunk": 500, "bucket_bytes": 2000}])
def test_as_brute_force(spark, options):
    rows = corpus(len(str(options)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(sd.remove_repeats(docs, **options)) == brute(rows)


def test_odd_tables(spark):
    schema = "bucket string, doc_id long, text string, rows int, m int"
    empty = spark.createDataFrame([], schema)
    assert found(sd.remove_repeats(empty)) == []
    line = "the same line of more than fifty bytes in documents that have no id at all"
    rows = [("b", None, line, 1, 1), ("b", 3, line, 1, 1), ("b", 3, line, 1, 1), ("b", 7, line + "!", 1, 1)]
    got = sd.remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("3", 0), ("3", 0), ("7", len(line)), ("None", 0)]


def test_ids_that_are_strings(spark):
    rows = corpus(3, 30)
    named = {i: f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i, _ in rows}
    docs = spark.createDataFrame([(named[i], t) for i, t in rows] + [(None, rows[0][1])], "doc_id string, text string").repartition(5)
    got = sd.remove_repeats(docs)
    assert sorted(tuple(r)[:5] for r in got.where("doc_id is not null").collect()) == sorted((named[i], *rest) for i, *rest in brute(rows))
    assert [r["n_removed"] for r in got.where("doc_id is null").collect()] == [0]


def test_minimizers_of_long_texts_come_in_parts(spark, monkeypatch):
    slim = spark.createDataFrame([(i, f"{i} " + "the same words again and again in each of them, " * 50) for i in range(80)], "doc_id long, text string")
    whole = sd.crowded_minimizers(slim, 50, 24, least=40)
    monkeypatch.setattr(sd, "CHUNK", 300)
    assert len(whole) and set(whole) == set(sd.crowded_minimizers(slim, 50, 24, least=40))


def shuffled(spark):
    """Bytes of shuffles on disk, once they no longer change: Spark deletes them in the background."""
    size, last = -1, -2
    while size != last:
        time.sleep(0.5)
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        last, size = size, 0
        while files.hasNext():
            file = files.next()
            size += file.length() if file.getName().startswith("shuffle_") else 0
    return size


def test_what_a_step_has_moved_is_deleted_before_the_next(spark, monkeypatch):
    monkeypatch.setattr(sd, "crowded_minimizers", lambda *_, **__: np.zeros(0, np.uint64))  # its look is bounded and stays
    draw = random.Random(6)
    rows = [(i, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=8000))) for i in range(200)]
    rows += [(200 + i, rows[i][1][100:3000] + "." + rows[i + 1][1]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    docs.count()
    before = shuffled(spark)
    out = sd.remove_repeats(docs)
    assert shuffled(spark) - before < 0.1 * sum(len(t) for _, t in rows)
    assert found(out) == brute(rows)
    assert spark.conf.get(shared.CLEANUP) == "false"
    docs.unpersist()


def test_transform_sorts_all_suffixes():
    draw = random.Random(4)
    strings = [bytes(draw.choices(b"ab", k=draw.randint(0, 30))) for _ in range(20)] + [b"abab" * 9] * 3
    bwt, suffixes = sd.transform(strings)
    joined = [(c + 1, 0) for s in strings for c in s]
    flat, end = [], 0
    for s in strings:
        flat += [(c + 1, 0) for c in s] + [(0, end)]
        end += 1
    assert len(flat) == len(joined) + len(strings)
    want = sorted(range(len(flat)), key=lambda i: flat[i : i + 200])
    keyed = [next(flat[i : j + 1] for j in range(i, len(flat)) if flat[j][0] == 0) for i in suffixes]
    assert keyed == sorted(keyed) and sorted(suffixes.tolist()) == sorted(want)
    assert bwt.tolist() == [flat[i - 1][0] for i in suffixes]


def test_merge_is_one_transform():
    draw = random.Random(5)
    strings = [bytes(draw.choices(b"abc", k=draw.randint(1, 40))) for _ in range(30)]
    whole, _ = sd.transform(strings)
    parts = [sd.transform(strings[i : i + 7])[0] for i in range(0, 30, 7)]
    place, _ = sd.merge(parts, 45)
    at, merged = [0] * len(parts), []
    for p in place:
        merged.append(parts[p][at[p]])
        at[p] += 1
    assert np.array_equal(np.array(merged), whole)
