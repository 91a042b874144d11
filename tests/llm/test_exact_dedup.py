import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosodia.llm import exact_dedup, fuse

SCHEMA = "digest string, doc_id long, text string, n int, keep_id int"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def corpus():
    draw = random.Random(1)
    texts = ["".join(draw.choices("abcÉé ", k=draw.randint(0, 4))) for _ in range(300)] + ["long " * 50_000] * 3
    rows = [(i, t.upper() if i % 3 == 0 else t) for i, t in enumerate(texts)] + [(400, None), (401, ""), (None, "a"), (None, "only here"), (7, texts[7])]
    return rows + [(1000 + i, "copy") for i in range(1500)]


@pytest.mark.parametrize("snapshot", ["pmod(doc_id, 2) = 0", "true", "false", "cast(null as boolean)"])
def test_as_brute_force(spark, snapshot):
    rows = corpus()
    docs = spark.createDataFrame([("", i, t, 0, 0) for i, t in rows], SCHEMA).repartition(4)
    got = exact_dedup.exact_classes(docs, F.expr(snapshot)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("rows_a_task, groups", [(4, 1), (4, 10**9)])
def test_hot_groups(spark, monkeypatch, rows_a_task, groups):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", rows_a_task)
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", groups)
    rows = corpus()
    docs = spark.createDataFrame([("", i, t, 0, 0) for i, t in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, exact_dedup.exact_classes(docs, exact_dedup.older_half()).collect()), key=str) == brute(rows)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus()[:120])]
    docs = spark.createDataFrame([("", i, t, 0, 0) for i, t in rows], SCHEMA)
    weak = lambda norm: F.substring(F.sha2(norm.cast("binary"), 256), 1, 1)
    got = exact_dedup.exact_classes(docs, exact_dedup.older_half(), digest=weak).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert exact_dedup.exact_classes(spark.createDataFrame([], SCHEMA), exact_dedup.older_half()).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 200_000])
def test_fuse_filter_holds_all_and_few_others(n):
    draw = np.random.default_rng(n)
    keys = draw.integers(0, 1 << 64, n, dtype=np.uint64)
    held = fuse.build(np.concatenate([keys, keys[:2]]))
    assert fuse.contains(held, keys).all()
    others = draw.integers(0, 1 << 64, 100_000, dtype=np.uint64)
    assert fuse.contains(held, others).mean() < 1e-3


def moved_bytes(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("words", [1 << 18, 1])
def test_only_texts_with_copies_are_moved(spark, tmp_path, monkeypatch, words):
    monkeypatch.setattr(exact_dedup, "MARK_WORDS", words, raising=False)
    draw = random.Random(2)
    rows = [(i, "".join(draw.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=20_000))) for i in range(300)]
    rows += [(300 + i, t.upper()) for i, (_, t) in enumerate(rows[:10])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    before, threshold = moved_bytes(spark), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")  # a table of any size worth the name is not sent whole
    try:
        got = exact_dedup.exact_classes(spark.read.parquet(f"{tmp_path}/docs"), exact_dedup.older_half()).collect()
    finally:
        spark.conf.unset(threshold)
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert moved_bytes(spark) - before < 0.5 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("words, passes", [(1 << 18, 0.15), (4, 1.0)])
def test_marks_pass_every_copied_digest(spark, monkeypatch, words, passes):
    monkeypatch.setattr(exact_dedup, "MARK_WORDS", words)
    digests = spark.range(5000).select(F.col("id").cast("string").alias("digest"))
    got = {r[0] for r in exact_dedup.marked(digests, digests.where("int(digest) < 1000"), 1000).collect()}
    assert {str(i) for i in range(1000)} <= got
    assert len(got) - 1000 <= passes * 4000


def test_digests_that_are_null_lose_no_row(spark):
    rows = [(1, "a"), (2, "A"), (3, "b"), (4, "c"), (5, "B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_classes(docs, F.lit(False), digest=lambda norm: F.when(norm == "c", F.lit("c"))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
