"""Every registered query of the engine against its SQL twin in DuckDB, and those without one against their schema."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from prosodia.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda f: as_rows(list(f.columns), f.astype(object).where(f.notna(), None).values.tolist())
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_without_the_optional_parts(tmp_path):
    root = Path(__file__).resolve().parents[1]
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    (tmp_path / "prosodia").mkdir()
    for part in (root / "prosodia").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "prosodia" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'source_breakdown' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_word_distance_over_whole_turns(spark, tmp_path):
    said = [" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" if i < 45 else f"x{i}" for i in range(58)), ""]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(said)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.QUERIES["word_distance"](spark, str(tmp_path)).collect()
    assert {(r["turn"], r["distance"]) for r in got} == {(1, 15), (2, 58)}


def test_functions_need_no_package_on_the_executors(tmp_path):
    """The driver alone has the package on its path: workers start in a folder without it."""
    code = f"""
import sys, os
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
import __spark_entry__ as e
from prosodia.session import session
spark = session("apart", "local[2]", 2)
for name in ("sounded_words", "diagnose_text", "phonemize_templates", "wav_round_trip", "structural_flags", "timeline_joins"):
    assert e.queries()[name](spark, {SF!r}).count() > 0
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)


def _as_twin(spark, duck, folder, name, table):
    con = duck.cursor()
    con.execute(f"CREATE OR REPLACE TEMP VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    con.execute("SET TimeZone = 'UTC'")
    got = {tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).collect()}
    want = con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    con.execute(f"DROP VIEW temp.{table}")
    return got, {tuple(r) for r in want.itertuples(index=False)}


def test_numbers_beyond_a_thousand_million(spark, duck, tmp_path):
    keys = [1_003_009, 1_003_008, 2_006_018_054, 5, 1_003_010, 3_000_000]
    rows = [(k, 27 if k == 1_003_009 else 3) for k in keys] + [(1_003_009, 1_000_000_000 - 1_003_009 * 997)]
    spark.createDataFrame([r for r in rows if r[1] >= 0], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = _as_twin(spark, duck, tmp_path, "number_words", "lineitem")
    assert got == want and any(k * 997 > 10**9 for k, *_ in got)


def test_numerals_beside_letters_whose_capitals_are_two(spark, duck, tmp_path):
    said = ["Großim ßIV x", "ﬁx ıv ſi iſ vﬁ", "the mix IX, xiv_ é​VI İI mdcı"]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").selectExpr("*", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    got, want = _as_twin(spark, duck, tmp_path, "roman_numerals", "documents")
    assert got == want and "IV" in {r[0] for r in got}
