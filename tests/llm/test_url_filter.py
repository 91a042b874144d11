import random

from prosodia.llm import url_filter as uf

SCHEMA = "host string, page_id long, url string, rule string, b_length int"


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:]
        end = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
        path = path[:end]
    fits = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def urls():
    draw = random.Random(5)
    hosts = ["org", "ORG", "example.org", "a.example.org", "notexample.org", "com", "x.com", "xcom", "net", "Exämple.com", "b.c.net", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q=/fr/", "/fr/a", "/de/x#y", "/de/", "/x/de/", "?q=1", "#/fr/", "/fr/ä?a=1&b=2"]
    made = [f"{draw.choice(['http', 'https', 'ftp', ''])}://{h}{p}" for h in hosts for p in paths]
    return made + [None, "", "no scheme", "a://b://c/d", "http:/one", "http://h\nx/y", "http://x.com/" + "a1-" * 20_000]


def test_as_brute_force(spark):
    rows = [("", i, u, "", 0) for i, u in enumerate(urls())] + [("", 1, "http://x.com/fr/", "", 0)] * 2 + [("", None, "http://org/", "", 0)]
    got = uf.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *brute(u)) for _, i, u, *_ in rows), key=str)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got), key=str) == want
    assert {r["verdict"] for r in got} <= {"allow", "block"} and all(0 <= r["block_score"] <= 1 for r in got)


def test_trees_learn_and_carry_over(spark):
    draw = random.Random(6)
    rows = []
    for i in range(3000):
        bad = i % 2
        host = f"{'-'.join(draw.choices(['win', 'buy', 'x'], k=3))}{draw.randrange(10**5)}.biz" if bad else f"{draw.choice(['news', 'blog', 'docs'])}.example.edu"
        rows.append((host, i, f"http://{host}/a{draw.randrange(9)}", "", bad))
    frame = spark.createDataFrame(rows, "h string, page_id long, url string, rule string, block int")
    known = frame.select("page_id", "url", "block", uf.host(frame.url).alias("host"), uf.path(frame.url).alias("path"))
    model = uf.fit(known.where("page_id % 3 != 0"))
    got = model.apply(known.where("page_id % 3 = 0")).collect()
    assert sum((r["block_score"] >= 0.5) == r["block"] for r in got) / len(got) > 0.98


def test_no_python_on_the_main_path(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = uf.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rare_and_unknown_suffixes(spark, monkeypatch):
    monkeypatch.setattr(uf, "HEAD_SUFFIXES", 1)
    rows = [("", i, f"http://s{i % 7}.a{i % 5}.net/x{i}", "", int(i % 5 < 2)) for i in range(400)]
    frame = spark.createDataFrame(rows, "h string, page_id long, url string, rule string, block int")
    known = frame.select("page_id", "url", "block", uf.host(frame.url).alias("host"), uf.path(frame.url).alias("path"))
    model = uf.fit(known)
    assert model.suffixes.count() == 5 and model.suffixes.where("rank = 1").count() == 1
    got = uf.with_suffix(known.unionByName(known.limit(1).withColumn("host", uf.F.lit("other.org"))), model.suffixes).collect()
    assert len(got) == 401 and all((r["suffix"] > 0) == bool(r["block"]) for r in got if r["host"] != "other.org")
    assert [r["suffix"] for r in got if r["host"] == "other.org"] == [0.0]
    assert all((r["block_score"] >= 0.5) == bool(r["block"]) for r in model.apply(known).collect())


def test_empty_tables_and_one_class(spark):
    assert uf.judge(spark.createDataFrame([], SCHEMA)).collect() == []
    got = uf.judge(spark.createDataFrame([("", 1, "http://q.net/", "", 0), ("", 2, "http://a.org/", "", 0)], SCHEMA)).collect()
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(1, "allow"), (2, "allow")]
