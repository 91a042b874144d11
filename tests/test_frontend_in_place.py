"""What is said of a paragraph where it is against the joined path, and what a task holds."""

import numpy as np
import pandas as pd
import pytest

from prosodia.functions import arrow, normalizer
from prosodia.operators import frontend, lexicon, text
from prosodia.plans import catalog, spoken

SF = "/root/testdata/sf0.001"
ODD = [
    "The cat's that'll sang. We'll read it aloud! Read on, “and-is” - to-of -- the-cat a-b.", "", None, " \n \n He had closed it.\n\nWind… winded, wasing; buses' by'll ısın İs.",
    "Class III of PCBs & 42% at 3:05, St. and Dr. no. FBI / A/B GHz pH $5 ± 2 °C `x` *y* _z_ # h", "they're 'll and'll it'll's isies ied ying ed s ss ing that-s",
]


def rows_of(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture
def docs(spark):
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return catalog._docs(spark, SF, english=True).select("doc_id", "text").limit(40).unionByName(odd).localCheckpoint()


def test_in_place_as_joined(spark, docs, monkeypatch):
    """A lexicon that is too large to be sent is joined; both paths say the same."""
    front = spoken._front(spark)
    made = lambda: [
        rows_of(f)
        for f in (frontend.diagnose_text(docs, front), frontend.phonemize(docs, front), frontend.phonemize(docs, front, emphasis=True), frontend.tokenize_text(docs, front, most=60, columns=("tokens", "segments", "n_tokens", "n_segments", "clause_places", "sentence_samples", "paragraph_samples")))
    ]
    here = made()
    monkeypatch.setattr(lexicon, "is_small", lambda _: False)
    joined = made()
    assert all(here) and here == joined


def test_in_place_moves_nothing(spark, docs):
    plan = frontend.tokenize_text(docs, spoken._front(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_cascade_of_words_as_joined(spark, docs):
    words = text.words(docs).selectExpr("lower(word) AS word").distinct()
    words = words.unionByName(spark.createDataFrame([(w,) for w in "that's buses bying byed boring andies and-is a the a-the -is is- in'll han'll'll wasted ted".split()], "word string")).distinct()
    rows = lexicon.cascade(words, lexicon.small_lexicon(spark)).collect()
    one = lexicon.Cascade(lexicon.SMALL)
    assert rows and {r["word"]: tuple(r)[1:] for r in rows} == {r["word"]: one(r["word"]) for r in rows}


def test_groups_in_place_as_grouped(spark, docs):
    sentences = text.sentences(text.paragraphs(docs)).withColumnRenamed("sentence", "phonemes")
    plan = frontend.voiced_plan(frontend.token_groups(sentences)).drop("paragraph_silence")
    columns = ("tokens", "segments", "clause_places", "sentence_samples", "paragraph_samples")
    assert rows_of(frontend.sentence_groups(docs, *columns)) == rows_of(plan.select("doc_id", "para", "grp", "n_sentences", *columns))


def test_texts_are_worked_on_in_parts():
    texts = pd.Series(["x" * 1000] * 5000 + [None, "y" * (3 << 20), ""])
    parts = list(arrow.in_parts(iter([texts])))
    assert pd.concat(parts).equals(texts) and max(sum(len(t or "") for t in p) for p in parts) < (3 << 20) + arrow.PART


def test_skipped_steps_would_have_changed_nothing():
    """Signs that are looked for first, against the rewrites themselves."""
    rng = np.random.default_rng(3)
    bits = [*"`*_°±&/=#.…—'’ABhz ", "  ", "\n", "\t", "St. ", "Dr. ", "GHz", "pH", "PCBs", "FBI", "Class III", "part IV", "°C", "U.S.A.", "...", " ", "ß", "wort", "Ab", "x1"]
    plain = {
        "headings": lambda t: normalizer._HEADING.sub("", t), "code ticks": lambda t: normalizer._TICKS.sub(r"\1", t),
        "emphasis marks": lambda t: normalizer._MARKS[2].sub(normalizer._both, normalizer._MARKS[1].sub(normalizer._both, normalizer._MARKS[0].sub(normalizer._both, t))),
        "paragraphs": lambda t: normalizer._BLANK_LINE.sub(".\n", t).replace("\n", " "), "plus or minus": lambda t: normalizer._PLUS_MINUS.sub(" plus or minus ", t),
        "collapse": lambda t: normalizer._SPACES.sub(" ", t).strip(), "finish": lambda t: normalizer._SPACES.sub(" ", t.replace("..", ".")).strip(),
        "abbreviations": lambda t: " ".join(normalizer.ABBREVIATIONS.get(w.lower()) or normalizer.name_ending(w) for w in t.split()),
        "dotted capitals": lambda t: normalizer._DOTTED.sub(lambda m: m[0][:-1].replace(".", " "), t), "slashes": lambda t: normalizer._SLASH.sub(r"\1 \2", t),
        "mixed case": lambda t: normalizer._MIXED.sub(lambda m: normalizer.MIXED_CASE[m[0]], t), "plural acronyms": lambda t: normalizer._PLURAL_CAPS.sub(normalizer._spelled_plural, t),
        "roman numerals": lambda t: normalizer.romans(t), "acronyms": lambda t: normalizer.acronyms(t),
    }
    steps = dict(normalizer.STEPS)
    for _ in range(3000):
        t = "".join(rng.choice(bits, rng.integers(0, 12)))
        for name, whole in plain.items():
            assert steps[name](t, None) == whole(t), (name, t)
