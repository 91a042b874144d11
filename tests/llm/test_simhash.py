import random
from itertools import combinations

import pytest
import xxhash

from prosodia.llm import shared, simhash

SCHEMA = "fp string, doc_id long, text string, component_id int"


def roots(nodes, links):
    least = {n: n for n in nodes}

    def find(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    return {n: find(n) for n in nodes}


def brute_fingerprint(text):
    words, word = [], ""
    for c in (text or "").translate({i: i + 32 for i in range(65, 91)}) + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def prose(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed):
    draw = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One word É"), (4, "one word É"), (5, "ONE two"), (6, "a b c"), (7, "a b c")]
    for i in range(40):
        words = prose(draw, draw.choice([5, 60, 300, 900]))
        for _ in range(3):
            copy = list(words)
            for _ in range(draw.randrange(3)):
                copy[draw.randrange(len(copy))] = "other"
            rows.append((len(rows) + 5, " ".join(copy)))
    rows.append((999, "x y " * 40_000))
    return rows


@pytest.mark.parametrize("crowd", [32, 1])
def test_as_brute_force(spark, crowd):
    rows = corpus(crowd)
    docs = spark.createDataFrame([(str(i), i, t, 0) for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, crowd=crowd).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    linked = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert got == {i: (f"{prints[i]:016x}", linked[i]) for i in prints}


@pytest.mark.parametrize("crowd", [32, 2])
def test_links_of_close_fingerprints(spark, crowd):
    draw = random.Random(3)
    prints = [draw.getrandbits(64) for _ in range(30)]
    for _ in range(150):
        base = draw.choice(prints)
        for _ in range(draw.randrange(4)):
            base ^= 1 << draw.randrange(64)
        prints.append(base)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    close = [(a, b) for a, b in combinations(prints, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), crowd=crowd).collect()
    assert roots(prints, [tuple(r) for r in got]) == roots(prints, close)


def test_odd_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("x", None, "a b c d", 1), ("x", 4, "a b c d", 1), ("x", 4, "a b c d", 1), ("x", None, "z", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]


def shingles(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("side, hot", [(1024, 512), (4, 2)])
def test_near_copies_by_similarity(spark, monkeypatch, side, hot):
    monkeypatch.setattr(simhash, "SIDE", side)
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    monkeypatch.setattr(shared, "HOT_ROWS", hot)
    draw = random.Random(9)
    rows, family = [], {}
    for i in range(60):
        words = prose(draw, draw.choice([80, 300, 2000]), 2000)
        for k in range(draw.choice([1, 1, 2, 6])):
            copy = list(words)
            for at in draw.sample(range(len(copy)), int(k and len(copy) * 0.01)):
                copy[at] = f"new{draw.randrange(10**6)}"
            family[len(rows)] = i
            rows.append((len(rows), " ".join(copy)))
    for k in (0.1, 0.2):  # not similar enough: at least a third of the shingles differ
        words = prose(draw, 400, 2000)
        for _ in range(8):
            copy = [f"new{draw.randrange(10**6)}" if draw.random() < k else w for w in words]
            family[len(rows)] = len(rows) + 1000
            rows.append((len(rows), " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    for a, b in combinations(sets, 2):
        alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert alike > 0.8 if family[a] == family[b] else alike < 0.62
    rows += [(5000, None), (5001, ""), (5002, " ")]
    docs = spark.createDataFrame([("", i, t, 0) for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    least = {}
    for i, f in family.items():
        least.setdefault(f, i)
    want = {i: least[f] for i, f in family.items() if list(family.values()).count(f) > 1}
    assert got == want


def test_copies_of_an_original_that_is_not_the_smallest_id(spark):
    draw = random.Random(4)
    words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(600):
        copy = list(words)
        for at in range(6):
            copy[10 + 48 * at + draw.randrange(30)] = f"new{draw.randrange(10**9)}"
        rows.append((i, " ".join(copy)))
    rows.append((600, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    assert all(len(s & sets[600]) / len(s | sets[600]) > 0.8 for s in sets)
    assert sum(len(s & sets[0]) / len(s | sets[0]) >= 0.8 for s in sets) < 30
    docs = spark.createDataFrame([("", i, t, 0) for i, t in rows], SCHEMA).repartition(4)
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()} == {(i, 0) for i in range(601)}


def test_near_copies_are_those_of_similarity_080(spark):
    draw = random.Random(5)
    rows, want = [], set()
    for i in range(150):
        words = [f"w{draw.randrange(10**6)}" for _ in range(204)]
        copy, changed = list(words), 0
        while True:
            a, b = shingles(" ".join(words)), shingles(" ".join(copy))
            if len(a & b) / len(a | b) < (0.83, 0.79)[i % 2]:
                break
            copy[changed * 5 + 4], changed = f"new{i}", changed + 1
        if len(a & b) / len(a | b) >= 0.8:
            want |= {(2 * i, 2 * i), (2 * i + 1, 2 * i)}
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    assert len(want) == 150
    rows += [(900, "a b c d e f g h i j " * 40), (901, "a b c d e f g h i j " * 40 + "a b c d e f g h i k")]  # as sets 10 of 11
    want |= {(900, 900), (901, 900)}
    docs = spark.createDataFrame([("", i, t, 0) for i, t in rows], SCHEMA).repartition(4)
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(docs).collect()} == want
