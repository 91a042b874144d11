"""Further registered queries: the text frontend, speech measurements, timelines, files and services, with their SQL twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.functions import sounding
from prosodia.functions.arrow import arrow
from prosodia.functions.constants import ABBREVIATIONS, ARPABET, LETTERS, NUCLEI, VOCABULARY
from prosodia.functions.normalizer import normalized
from prosodia.operators import frontend, homographs, lexicon, signal, speech, text
from prosodia.plans.catalog import _SMALL_SQL, ALIGNED_SQL, _alignment, _clips, _dealt_docs, _docs, _listed, _occurrences, _rounded, _values, query
from prosodia.session import spread, table
from prosodia.sources import files
from prosodia.streaming import serving

# --- normalisation of sentences whose reading is known -----------------------------------------------------------------

_ORDINALS = ["zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]
#: Templates with {n} a number below 1000, {m} one below 60, {y} a year from 1100 on, and what is said for them.
_TEMPLATES = (
    ("We counted {n} apples", "We counted ", "small[n + 1]", " apples"),
    ("a share of {n}% now", "a share of ", "small[n + 1]", " percent now"),
    ("it cost ${n} then", "it cost ", "small[n + 1] || CASE WHEN n = 1 THEN ' dollar' ELSE ' dollars' END", " then"),
    ("pi is 3.{m} or so", "pi is three point ", "array_to_string(list_transform(string_split(m::VARCHAR, ''), lambda c: small[c::INT + 1]), ' ')", " or so"),
    ("see Q{n} there", "see Q ", "small[n + 1]", " there"),
    ("the {k}th one", "the ", "CASE WHEN k <= 12 THEN ord[k + 1] WHEN k % 10 = 0 THEN regexp_replace(small[k + 1], 'y$', 'ieth') WHEN k < 20 THEN small[k + 1] || 'th' ELSE small[k - k % 10 + 1] || ' ' || ord[k % 10 + 1] END", " one"),
    ("in {y} it was", "in ", "CASE WHEN y // 100 = 20 AND y % 100 = 0 THEN 'two thousand' WHEN y // 100 = 20 AND y % 100 < 10 THEN 'two thousand ' || small[y % 100 + 1] WHEN y % 100 = 0 THEN small[y // 100 + 1] || ' hundred' WHEN y % 100 < 10 THEN small[y // 100 + 1] || ' oh ' || small[y % 100 + 1] ELSE small[y // 100 + 1] || ' ' || small[y % 100 + 1] END", " it was"),
    ("at 3:{p} we met", "at three ", "CASE WHEN m = 0 THEN 'o''clock' WHEN m < 10 THEN 'oh ' || small[m + 1] ELSE small[m + 1] END", " we met"),
    ("# **Dr. Smith** and Jr. {n}", "doctor Smith and junior ", "small[n + 1]", ""),
    ("Class III has {n} & 2 ± 1", "Class three has ", "small[n + 1]", " and two plus or minus one"),
    ("the FBI and PCBs at {n} GHz", "the eff bee eye and pee see bees at ", "small[n + 1]", " gigahertz"),
    ("on High St. by the U.S.A. {n} times… yes", "on High street by the U S A ", "small[n + 1]", " times … yes"),
)
_TEMPLATE_ROWS = [(i, "'" + head.replace("'", "''") + "'", said, "'" + tail.replace("'", "''") + "'") for i, (_, head, said, tail) in enumerate(_TEMPLATES)]
_TEMPLATE_SQL = "CASE o_orderkey % " + str(len(_TEMPLATES)) + " " + " ".join(f"WHEN {i} THEN {head} || {said} || {tail}" for i, head, said, tail in _TEMPLATE_ROWS) + " END"


@query(
    f"""WITH s AS (SELECT {_SMALL_SQL} AS small, [{', '.join(repr(o) for o in _ORDINALS)}] AS ord),
o AS (SELECT o_orderkey, (o_orderkey * 7 % 1000)::INT AS n, (o_orderkey * 11 % 60)::INT AS m, (4 + o_orderkey * 13 % 96)::INT AS k, (1100 + o_orderkey * 17 % 1000)::INT AS y FROM orders)
SELECT o_orderkey, {_TEMPLATE_SQL} AS said FROM o, s"""
)
def normalize_templates(spark, sf_dir):
    """The exact normaliser over sentences made up from orders, whose readings SQL can put together."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    key = F.col("o_orderkey")
    m = key * 11 % 60
    values = {"{n}": key * 7 % 1000, "{m}": m, "{k}": 4 + key * 13 % 96, "{y}": 1100 + key * 17 % 1000}
    made = F.element_at(F.array(*(F.lit(t[0]) for t in _TEMPLATES)), (key % len(_TEMPLATES) + 1).cast("int"))
    made = F.replace(made, F.lit("{p}"), F.lpad(m.cast("string"), 2, "0"))
    for name, value in values.items():
        made = F.replace(made, F.lit(name), value.cast("string"))
    # Ordinals end as their numbers do.
    ends = F.when((values["{k}"] % 100).between(11, 13), "th").when(values["{k}"] % 10 == 1, "st").when(values["{k}"] % 10 == 2, "nd").when(values["{k}"] % 10 == 3, "rd").otherwise("th")
    made = F.regexp_replace(made, r"^the ([0-9]+)th", F.concat(F.lit("the $1"), ends))
    return o.select("o_orderkey", normalized(made).alias("said"))


_LETTER_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LETTERS.items()) + " END"


@query(
    rf"""WITH w AS (SELECT unnest(regexp_extract_all(text, '\b[A-Z]{{2,4}}s\b')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT word, n, array_to_string(list_transform(string_split(left(word, length(word) - 1), ''), lambda c: {_LETTER_SQL}), ' ') || 's' AS said FROM n"""
)
def acronym_plurals(spark, sf_dir):
    pattern = F.lit("(?<![0-9A-Za-z_])[A-Z]{2,4}s(?![0-9A-Za-z_])")
    found = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", pattern, F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).withColumn("said", normalized(F.col("word")))


@query(
    f"""WITH a AS (SELECT * FROM {_values(sorted(ABBREVIATIONS.items()), 'short, said')}), w AS (SELECT lower(unnest(regexp_split_to_array(text, '\\s+'))) AS word FROM documents)
SELECT a.short, any_value(a.said) AS said, count(w.word) AS n FROM a LEFT JOIN w ON w.word = a.short GROUP BY a.short"""
)
def abbreviation_counts(spark, sf_dir):
    """How often each abbreviation stands in the documents, and what the normaliser says for it."""
    short = spark.createDataFrame([(s,) for s in ABBREVIATIONS], "short string")
    words = text.words(_docs(spark, sf_dir)).select(F.lower("word").alias("short")).groupBy("short").agg(F.count("*").alias("n"))
    rows = short.join(words, "short", "left").withColumn("said", F.lower(normalized(F.concat(F.lit("be "), F.col("short")))))
    return rows.select("short", F.regexp_replace("said", "^be ", "").alias("said"), F.coalesce("n", F.lit(0)).alias("n"))


# --- context readings whose answer is known ----------------------------------------------------------------------------

#: Sentences around a name, the place of the ruled word, and its reading by the rules of homographs.SMALL.
_READINGS = (
    ("{} had read the letter.", 2, "ɹˈɛd"), ("Please read it aloud, {}.", 1, "ɹˈid"), ("Read the sign now.", 0, "ɹˈid"), ("We read it with {}.", 1, "ɹˈɛd"),
    ("The wind blew {} down.", 1, "wˈɪnd"), ("{} will wind up the clock.", 2, "wˈInd"), ("Let us wind down, {}.", 2, "wˈInd"), ("A warm wind.", 2, "wˈɪnd"),
    ("They stood very close to {}.", 3, "klˈOs"), ("Please close the door.", 1, "klˈOz"), ("It was, and we closed up.", 4, "klˈOzd"), ("It was, so we closed up.", 4, "klˈOst"), ("She closes it.", 1, "klˈOzɪz"),
    ("To {}, wind is cold.", 2, "wˈɪnd"), ("He said: read on.", 2, "ɹˈɛd"),
)


@query(
    "SELECT o_orderkey, CASE o_orderkey % " + str(len(_READINGS)) + " " + " ".join(f"WHEN {i} THEN {p}" for i, (_, p, _) in enumerate(_READINGS))
    + " END::INT AS pos, CASE o_orderkey % " + str(len(_READINGS)) + " " + " ".join(f"WHEN {i} THEN '{r}'" for i, (_, _, r) in enumerate(_READINGS)) + " END AS reading FROM orders"
)
def homograph_templates(spark, sf_dir):
    """Readings in sentences made up from orders; their names are no triggers."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    sentence = F.element_at(F.array(*(F.lit(t) for t, _, _ in _READINGS)), (F.col("o_orderkey") % len(_READINGS) + 1).cast("int"))
    name = F.concat(F.lit("name"), F.col("o_orderkey").cast("string"))
    words = F.split(F.replace(sentence, F.lit("{}"), name), " ")
    return homographs.readings(o.select("o_orderkey", words.alias("words")), homographs.SMALL).select("o_orderkey", "pos", "reading")


# --- frontend -----------------------------------------------------------------------------------------------------------


def _front(spark: SparkSession) -> frontend.Frontend:
    nodes, roots = sounding.small_trees()
    return frontend.load(spark, lexicon.small_lexicon(spark), homographs.SMALL, nodes, roots)


@query()
def diagnose_text(spark, sf_dir):
    return frontend.diagnose_text(_dealt_docs(spark, sf_dir, english=True), _front(spark))


@query()
def diagnosis_report(spark, sf_dir):
    return speech.diagnosis_report(frontend.diagnose_text(_dealt_docs(spark, sf_dir, english=True), _front(spark)), "small", sources="gold")


@query()
def phonemize(spark, sf_dir):
    return frontend.phonemize(_dealt_docs(spark, sf_dir, english=True), _front(spark), emphasis=True)


@query()
def tokenize_text(spark, sf_dir):
    return frontend.tokenize_text(_dealt_docs(spark, sf_dir, english=True), _front(spark), columns=("n_tokens", "n_segments"))


#: Words of which each stage of the cascade knows one, between punctuation, and what is said for them.
_SAID = {"a": "ə", "The": "ðə", "that's": "ðˈæts", "to": "tu", "wind": "wˈɪnd", "and-is": "ænd ɪz", "hans": "hænz", "cat": "kˈæt"}


@query(
    "SELECT o_orderkey AS doc_id, 0 AS para, 0 AS sent, '“' || CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{ipa}'" for i, ipa in enumerate(_SAID.values()))
    + " END || ',” tu ðə kˈæt' AS phonemes FROM orders"
)
def phonemize_templates(spark, sf_dir):
    """One sentence for each order through the whole frontend: every source of the cascade, punctuation kept in place."""
    o = table(spark, sf_dir, "orders", "o_orderkey")
    word = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("“"), word, F.lit(",” to the cat")).alias("text"))
    return frontend.phonemize(spread(docs), _front(spark))


# --- symbols, letters and sounds ----------------------------------------------------------------------------------------

_SYMBOLS_SQL = "".join("\\" + c if c in "\\[]^-&" else c for c in sorted(VOCABULARY)).replace("'", "''")


@query(
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(regexp_replace(text, '[{_SYMBOLS_SQL}]', '', 'g'), ''))), '') AS lossy FROM documents"""
)
def lossy_symbols(spark, sf_dir):
    """The characters of each text that the vocabulary would lose, taking the text as a reading."""
    sorted_runes = F.array_sort(text.lossy_runes(F.col("text")))
    return _dealt_docs(spark, sf_dir).select("doc_id", F.array_join(sorted_runes, "").alias("lossy"))


@arrow("array<string>")
def _flags(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(sounding.structural_flags)


_WORDS_SQL = "w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents), distinct_words AS (SELECT word FROM w WHERE word <> '')"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.words(_docs(spark, sf_dir)).select("word").distinct()


@query(
    f"""WITH {_WORDS_SQL}, t AS (SELECT word, regexp_replace(word, '[ˈˌː]', '', 'g') AS plain, regexp_replace(regexp_extract(word, '[^{NUCLEI}ɹ]*$'), '[ˈˌː]', '', 'g') AS tail FROM distinct_words)
SELECT word, concat_ws(',', CASE WHEN length(plain) >= 2 AND NOT regexp_matches(plain, '[{NUCLEI}]') THEN 'NO-NUCLEUS' END, CASE WHEN len(string_split(word, 'ˈ')) > 2 THEN 'DOUBLE-STRESS' END,
CASE WHEN (regexp_matches(tail, '(^|[^l])[mnŋ]$') OR ends_with(tail, 'l')) AND length(tail) >= 2 AND NOT (length(tail) = 2 AND left(tail, 1) = 'ʔ') THEN 'NO-VOWEL-TAIL(' || tail || ')' END) AS flags FROM t"""
)
def structural_flags(spark, sf_dir):
    """What the filter of badly built readings says of the documents' words, each taken as a reading."""
    return _words(spark, sf_dir).select("word", F.array_join(_flags("word"), ",").alias("flags"))


@arrow("string")
def _sounded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    nodes, roots = sounding.small_trees()
    for batch in batches:
        yield batch.map(lambda w: sounding.sound_out(w, nodes, roots))


@query(
    f"""WITH {_WORDS_SQL}, plain AS (SELECT word FROM distinct_words WHERE regexp_matches(word, '^[\\x00-\\x7F]*$')),
one AS (SELECT * FROM {_values([(k, v) for k, v in sorted(sounding._ONE.items())], 'letter, phones')}), ipa AS (SELECT * FROM {_values(sorted(ARPABET.items()), 'phone, symbol')}),
letters AS (SELECT word, unnest(string_split(lower(word), '')) AS letter, unnest(range(1, length(word) + 1)) AS i FROM plain),
said AS (SELECT l.word, l.i, CASE WHEN l.letter = 'e' AND substr(l.word, l.i + 1, 1) IN ('', '#') THEN NULL WHEN l.letter = 'c' AND substr(lower(l.word), l.i + 1, 1) IN ('e', 'i', 'y') THEN 's' ELSE o.phones END AS phones FROM letters l JOIN one o USING (letter)),
phones AS (SELECT word, i, unnest(string_split(phones, '-')) AS phone, unnest(range(1, len(string_split(phones, '-')) + 1)) AS j FROM said WHERE phones IS NOT NULL),
symbols AS (SELECT p.word, p.i, p.j, CASE right(p.phone, 1) WHEN '1' THEN 'ˈ' WHEN '2' THEN 'ˌ' ELSE '' END || a.symbol AS symbol FROM phones p JOIN ipa a ON a.phone = upper(regexp_replace(p.phone, '[0-9]$', '')))
SELECT d.word, coalesce(string_agg(s.symbol, '' ORDER BY s.i, s.j), '') AS ipa FROM plain d LEFT JOIN symbols s USING (word) GROUP BY d.word"""
)
def sounded_words(spark, sf_dir):
    """Letter-to-sound trees, folding and phone symbols over the words of ASCII letters."""
    return _words(spark, sf_dir).where(F.col("word").rlike(r"^[\x00-\x7F]*$")).select("word", _sounded("word").alias("ipa"))


@arrow("string")
def _slugs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(files.slug)


@query(
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' - ' || p_brand || '_' || p_type), '[^\p{L}\p{N} _-]', '', 'g'), '[ _-]', '-', 'g'), '-+', '-', 'g'), '-') AS slug FROM part"""
)
def slugs(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return p.select("p_partkey", _slugs(F.concat("p_name", F.lit(" - "), "p_brand", F.lit("_"), "p_type")).alias("slug"))


@query(
    f"""WITH l AS (SELECT * FROM {_values(lexicon.SMALL, 'tier, word, ipa')}), v AS (SELECT * FROM {_values([(c,) for c in sorted(VOCABULARY)], 'ch')}),
more AS (SELECT * FROM l UNION ALL SELECT 'silver', 'g' || o_orderkey, 'gɡ' || o_orderkey FROM orders), c AS (SELECT DISTINCT tier, word, ipa, unnest(string_split(ipa, '')) AS ch FROM more)
SELECT c.tier, c.word, c.ipa, count(*)::INT AS n_lossy FROM c ANTI JOIN v USING (ch) GROUP BY c.tier, c.word, c.ipa"""
)
def lexicon_violations(spark, sf_dir):
    """Entries that the vocabulary can't speak: those made up from orders have an ASCII g and digits."""
    key = F.col("o_orderkey").cast("string")
    bad = table(spark, sf_dir, "orders", "o_orderkey").select(F.lit("silver").alias("tier"), F.concat(F.lit("g"), key).alias("word"), F.concat(F.lit("gɡ"), key).alias("ipa"))
    rows = lexicon.violations(lexicon.small_lexicon(spark).unionByName(bad), most=None)
    return rows.select("tier", "word", "ipa", F.size("code_points").alias("n_lossy"))


# --- words and sentences in clips ---------------------------------------------------------------------------------------

#: Vectors as clips at 100 samples a second; four words of 150 ms, 10 ms apart; pitch is the size of each sample.
_HEARD = ("alpha", "banana,", "the", "Opera.")
_HEARD_SQL = f"""a AS (SELECT vec_id AS clip_id, embedding AS e, unnest(range(0, 4))::INT AS pos FROM embeddings),
words AS (SELECT clip_id, e, pos, list_extract([{', '.join(repr(w) for w in _HEARD)}], pos + 1) AS word, pos * 160 AS start_ms, pos * 160 + 150 AS end_ms, list_transform(e, lambda x: round(100 * abs(x::DOUBLE), 6)) AS f0 FROM a)"""


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f0 = F.transform("samples", lambda x: F.round(100 * F.abs(x.cast("double")), 6))
    clips = _clips(spark, sf_dir).select("clip_id", "samples", F.lit(100).alias("rate"), f0.alias("given"), "label")
    pos = F.explode(F.sequence(F.lit(0), F.lit(3)))
    word = F.element_at(F.array(*map(F.lit, _HEARD)), F.col("pos") + 1)
    placed = clips.select("clip_id", pos.alias("pos"))
    return clips, placed.select("clip_id", "pos", word.alias("word"), (F.col("pos") * 160).alias("start_ms"), (F.col("pos") * 160 + 150).alias("end_ms"), F.lit(1.0).alias("confidence"))


@query(
    f"""WITH {_HEARD_SQL} SELECT clip_id, pos, word, round(sqrt(list_sum(list_transform(e[pos * 16 + 1:pos * 16 + 15], lambda x: x::DOUBLE * x::DOUBLE)) / 15), 6) AS rms,
round(coalesce(list_avg(list_filter(f0[pos * 16 + 1:pos * 16 + 15], lambda x: x > 0)), 0), 6) AS f0, 0.15::DOUBLE AS duration FROM words"""
)
def word_prominence(spark, sf_dir):
    clips, words = _spoken(spark, sf_dir)
    return _rounded(speech.prominence(clips, words, F.col("given")), "rms", "f0")


@query(f"WITH {_HEARD_SQL} SELECT clip_id, pos, round(coalesce(list_avg(list_filter(f0[pos * 16 + 1:pos * 16 + 15], lambda x: x > 0)), 0), 6) AS f0 FROM words")
def word_pitch(spark, sf_dir):
    """The same means by an interval join of frames and words on equal frame numbers."""
    clips, words = _spoken(spark, sf_dir)
    frames = clips.select("clip_id", F.posexplode("given").alias("frame", "f0"))
    return _rounded(speech.word_pitch(words, frames), "f0")


#: The first sentence is the first two words, the second the other two; one of no heard word lies between.
_SOURCE = "Alpha banana! Unheard words here. The opera"


@query(
    f"""WITH {_HEARD_SQL}, s AS (SELECT clip_id, f0, sent, CASE sent WHEN 0 THEN 'Alpha banana!' ELSE 'The opera' END AS text, CASE sent WHEN 0 THEN 0 ELSE 320 END::BIGINT AS start_ms, CASE sent WHEN 0 THEN 310 ELSE 630 END::BIGINT AS end_ms
  FROM (SELECT DISTINCT clip_id, f0, unnest([0, 2])::INT AS sent FROM words)),
v AS (SELECT *, list_filter(f0[start_ms // 10 + 1:end_ms // 10], lambda x: x > 0) AS xs FROM s), k AS (SELECT *, list_max(xs) - list_min(xs) AS r, list_avg(xs[1:3]) AS a, list_avg(xs[-3:]) AS z, list_avg(xs[len(xs) - 5:len(xs) - 3]) AS p FROM v WHERE len(xs) >= 2),
m AS (SELECT *, avg(r) OVER (PARTITION BY clip_id) AS avg_range FROM k)
SELECT clip_id, sent, start_ms, end_ms, 'uptalk' AS type, 'low' AS severity, round(r, 6) AS f0_range, round(a, 6) AS f0_start, round(z, 6) AS f0_end, round(avg_range, 6) AS avg_range, text AS context FROM m WHERE len(xs) >= 6 AND z - p > 15"""
)
def intonation_issues(spark, sf_dir):
    clips, words = _spoken(spark, sf_dir)
    sources = clips.select("clip_id", F.lit(_SOURCE).alias("text"))
    return _rounded(speech.intonation(clips, words, sources, F.col("given")), "f0_range", "f0_start", "f0_end", "avg_range")


_PEAK_SQL = "(list_position({0}, list_max({0})) - 0.5::DOUBLE) / {1}"


def _slices_sql(e: str, pos: int, parts: int) -> str:
    n = 15 // parts
    spans = [(pos * 16 + i * n, pos * 16 + (15 if i == parts - 1 else (i + 1) * n)) for i in range(parts)]
    return "[" + ", ".join(f"sqrt(list_sum(list_transform({e}[{a + 1}:{z}], lambda x: x::DOUBLE * x::DOUBLE)) / {z - a})" for a, z in spans) + "]"


_COMPARED = ((0, "alpha", 2, "ALPHA banana! Unheard words here...."), (1, "banana", 3, "Alpha BANANA! Unheard words here. The..."), (6, "opera", 3, "...Unheard words here. The OPERA"))
_COMPARED_SQL = " UNION ALL ".join(
    f"SELECT x.vec_id AS clip_id, {i} AS source, '{w}' AS word, {n} AS parts, {160 * p} AS start_ms, {_PEAK_SQL.format(_slices_sql('x.embedding', p, n), n)} AS one_peak, {_PEAK_SQL.format(_slices_sql('list_reverse(x.embedding)', p, n), n)} AS two_peak, {c!r} AS context FROM embeddings x"
    for (i, w, n, c), p in zip(_COMPARED, (0, 1, 3), strict=True)
)


@query(
    f"""WITH c AS ({_COMPARED_SQL}), d AS (SELECT *, abs(one_peak - two_peak) AS diff FROM c)
SELECT clip_id, source, word, parts, start_ms, round(one_peak, 6) AS one_peak, round(two_peak, 6) AS two_peak, context, CASE WHEN diff > 0.5 THEN 'high' WHEN diff > 0.35 THEN 'medium' ELSE 'low' END AS severity FROM d WHERE diff > CASE WHEN parts >= 3 THEN 0.25 ELSE 0.3 END"""
)
def stress_mismatches(spark, sf_dir):
    """Clips against themselves said backwards."""
    clips, words = _spoken(spark, sf_dir)
    other = clips.withColumn("samples", F.reverse("samples"))
    sources = clips.select("clip_id", F.lit(_SOURCE).alias("text"))
    return _rounded(speech.stress(speech.compared_words(clips, other, words, words, sources)), "one_peak", "two_peak")


# --- timelines ----------------------------------------------------------------------------------------------------------


@arrow("array<double>")
def _joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Two clips crossfaded over 8 samples, with 6 samples of silence put into the softest spot near the middle."""
    for ones, twos in batches:
        out = []
        for a, b in zip(ones, twos, strict=True):
            x = signal.crossfade(a, b, 8)
            out.append(signal.insert_silence(x, signal.quietest(x, len(x) // 2, 16, 4, 4), 6, 4).astype(float).tolist())
        yield pd.Series(out)


_TIMELINE_SQL = """WITH p AS (SELECT vec_id, embedding AS a, list_reverse(embedding) AS b FROM embeddings),
x AS (SELECT vec_id, list_concat(list_concat(a[1:56]::DOUBLE[], list_transform(range(0, 8), lambda i: (a[57 + i] * (0.5 * (1 + cos(pi() * i / 8))) + b[1 + i] * (1 - 0.5 * (1 + cos(pi() * i / 8))))::FLOAT::DOUBLE)), b[9:64]::DOUBLE[]) AS x FROM p),
q AS (SELECT vec_id, x, list_transform(range(44, 77, 4), lambda s: list_sum(list_transform(x[s + 1:s + 4], lambda v: v * v)) / 4) AS levels FROM x),
c AS (SELECT vec_id, x, 44 + 4 * (list_position(levels, list_min(levels)) - 1) + 2 AS spot FROM q),
f AS (SELECT vec_id, list_concat(list_concat(list_concat(x[1:spot - 4], list_transform(range(0, 4), lambda i: x[spot - 3 + i] * (3 - i) / 4)), [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), list_concat(list_transform(range(0, 4), lambda i: x[spot + 1 + i] * i / 4), x[spot + 5:])) AS y FROM c)"""


@query(_TIMELINE_SQL + " SELECT vec_id AS clip_id, len(y)::INT AS n, round(list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i] * i)), 3) AS moment FROM f")
def timeline_joins(spark, sf_dir):
    """Crossfade, softest spot, silence and fades, by a sum over samples and their places."""
    rows = _clips(spark, sf_dir).select("clip_id", _joined(F.col("samples"), F.reverse("samples")).alias("y"))
    moment = F.aggregate(F.zip_with("y", F.sequence(F.lit(1), F.size("y")), lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return rows.select("clip_id", F.size("y").alias("n"), F.round(moment, 3).alias("moment"))


@arrow("array<double>")
def _heard(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda b: [float(x) for x in files.decode_wav(bytes(b))["samples"]])


@query(
    """SELECT vec_id AS clip_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * trunc(greatest(least(embedding[i]::DOUBLE * 3, 1), -1) * 32767)))::BIGINT AS moment,
len(embedding) / 24000.0::DOUBLE AS seconds, (44 + 2 * len(embedding))::INT AS n_bytes FROM embeddings"""
)
def wav_round_trip(spark, sf_dir):
    """Clips written as 16-bit files and read again; values beyond one are clamped."""
    loud = F.transform("samples", lambda x: x.cast("double") * 3)
    rows = _clips(spark, sf_dir).select("clip_id", files.wav_of(loud).alias("wav")).select("clip_id", "wav", _heard("wav").alias("y"))
    moment = F.aggregate(F.zip_with("y", F.sequence(F.lit(1), F.size("y")), lambda v, i: F.round(v * 32767).cast("long") * i), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("clip_id", moment.alias("moment"), (F.size("y") / F.lit(24000.0)).alias("seconds"), F.octet_length("wav").alias("n_bytes"))


@query(
    """WITH l AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, embedding FROM embeddings),
r AS (SELECT event_id, (event_id % 11)::INT AS label, (event_id % 97)::INT AS n_tokens FROM events), w AS (SELECT r.*, least(n_tokens + 2, l.n - 1) AS row FROM r LEFT JOIN l USING (label))
SELECT w.event_id, w.row::INT AS row, v.embedding[1]::DOUBLE AS first FROM w LEFT JOIN v ON v.label = w.label AND v.row = w.row"""
)
def voice_styles(spark, sf_dir):
    """The style row of each request's voice for its padded length; a voice that there is not has none."""
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy("clip_id")
    voices = _clips(spark, sf_dir).select(F.col("label").cast("string").alias("name"), (F.row_number().over(order) - 1).alias("row"), F.col("samples").alias("style"))
    e = table(spark, sf_dir, "events", "event_id")
    requests = e.select("event_id", (F.col("event_id") % 11).cast("string").alias("voice"), (F.col("event_id") % 97).cast("int").alias("n_tokens"))
    return files.style_for(requests, voices).select("event_id", "row", F.get("style", F.lit(0)).cast("double").alias("first"))


@query("SELECT count(DISTINCT label) AS n, string_agg(DISTINCT 'voice' || label, ', ' ORDER BY 'voice' || label) AS names, '{\"voices\":[' || string_agg(DISTINCT '{\"name\":\"voice' || label || '\"}', ',' ORDER BY '{\"name\":\"voice' || label || '\"}') || ']}' AS body FROM embeddings")
def voice_list(spark, sf_dir):
    return serving.voice_list(_clips(spark, sf_dir).select(F.concat(F.lit("voice"), F.col("label").cast("string")).alias("name")))


# --- recognised words ---------------------------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT event_id, list_filter(string_split(props, ' '), lambda x: x <> '') AS ws FROM events), u AS (SELECT event_id, unnest(ws) AS word, unnest(range(len(ws)))::INT AS pos FROM w)
SELECT event_id AS clip_id, pos, word, pos * 400 AS start_ms, CASE WHEN length(word) = 1 THEN pos * 400 + 300 ELSE pos * 400 + 200 END AS end_ms, CASE WHEN length(word) = 1 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM u"""
)
def recognised_words(spark, sf_dir):
    """Tokens as a recogniser gives them, two for each word, between marks and unlikely ones, put together again."""
    words = F.filter(F.split("props", " "), lambda w: w != "")
    token = lambda t, a, z, p: F.struct(t.alias("text"), F.struct(a.cast("int").alias("from"), z.cast("int").alias("to")).alias("offsets"), F.lit(p).alias("p"))

    def tokens(w, i):
        at = i * 400
        head = token(F.concat(F.lit(" "), F.left(w, F.lit(1))), at, F.when(F.char_length(w) == 1, at).otherwise(at + 100), 0.9)
        rest = token(F.substring(w, F.lit(2), F.char_length(w)), at + 100, at + 200, 0.7)
        return F.array(head, rest, token(F.lit(" unsure"), at + 200, at + 210, 0.1), token(F.lit("[_TT_1]"), at, at, 1.0))

    e = table(spark, sf_dir, "events", "event_id", "props")
    raw = e.select(F.col("event_id").alias("clip_id"), F.transform(words, lambda w, i: F.struct(tokens(w, i).alias("tokens"))).alias("transcription"))
    return _rounded(files.words_from_tokens(raw), "confidence")


# --- reports ------------------------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT vec_id AS clip_id, len(embedding) / 100.0::DOUBLE AS total_s, label FROM embeddings),
p AS (SELECT clip_id, unnest(CASE WHEN label % 3 = 0 THEN [0.1, 0.25] WHEN label % 3 = 1 THEN [0.5] ELSE [] END::DOUBLE[]) AS d FROM l),
s AS (SELECT l.clip_id, any_value(total_s) AS total_s, coalesce(sum(d), 0)::DOUBLE AS silence_s, count(d)::DOUBLE AS pauses, coalesce(avg(d), 0)::DOUBLE AS avg_pause, coalesce(max(d), 0)::DOUBLE AS max_pause FROM l LEFT JOIN p USING (clip_id) GROUP BY l.clip_id),
m AS (SELECT clip_id, unnest(['total_s', 'speech_s', 'silence_s', 'silence_ratio', 'pauses', 'avg_pause', 'max_pause']) AS metric, unnest([total_s, total_s - silence_s, silence_s, silence_s / total_s, pauses, avg_pause, max_pause]) AS ref FROM s)
SELECT a.clip_id, a.metric, round(a.ref, 6) AS ref, round(b.ref, 6) AS test, round(b.ref - a.ref, 6) AS diff,
printf('%-24s %10.3f %10.3f %9s%.3f', a.metric, a.ref, b.ref, CASE WHEN b.ref - a.ref < 0 THEN '' ELSE '+' END, b.ref - a.ref) AS line FROM m a LEFT JOIN m b ON b.clip_id = a.clip_id + 1 AND b.metric = a.metric"""
)
def pause_comparison(spark, sf_dir):
    """Pauses of each clip against those of the next, as rows and as lines of a report."""
    clips = _clips(spark, sf_dir).select("clip_id", (F.size("samples") / F.lit(100.0)).alias("total_s"), "label")
    ends = F.when(F.col("label") % 3 == 0, F.array(F.lit(0.1), F.lit(0.25))).when(F.col("label") % 3 == 1, F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>"))
    pauses = clips.select("clip_id", F.explode(ends).alias("end_s")).withColumn("start_s", F.lit(0.0))
    summary = speech.pause_summary(pauses, clips.select("clip_id", "total_s"))
    both = speech.versus(summary, summary.withColumn("clip_id", F.col("clip_id") - 1), speech.PAUSE_METRICS).where("ref is not null")
    line = speech.report_row(F.col("metric"), F.col("ref"), F.col("test"))
    return _rounded(both.withColumn("line", F.when(F.col("test").isNotNull(), line)), "ref", "test", "diff")


@query(
    """SELECT event_id % 50 AS clip_id, count(*) AS glitches, count(*) FILTER (value >= 35) AS severe, coalesce(string_agg(CASE WHEN value >= 35 THEN event_id || ':' || event_type END, ',' ORDER BY event_id), '') AS worst FROM events GROUP BY event_id % 50"""
)
def glitch_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    found = e.select((F.col("event_id") % 50).alias("clip_id"), F.col("event_id").alias("sample"), F.col("event_type").alias("type"), F.col("value").alias("severity"))
    rows = speech.glitch_summary(found)
    return rows.withColumn("worst", F.array_join(F.transform("worst", lambda x: F.concat_ws(":", x["sample"].cast("string"), x["type"])), ","))


@query(
    """SELECT c_nationkey AS story_id, count(*) AS sections, round(sum(abs(c_acctbal)), 2) AS audio_s, round(sum(abs(c_acctbal) / 4 + 1), 4) AS generation_s, round(sum(abs(c_acctbal)) / sum(abs(c_acctbal) / 4 + 1), 6) AS real_time_factor FROM customer GROUP BY c_nationkey"""
)
def generation_summary(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    s = F.abs("c_acctbal").cast("double")
    rows = speech.generation_summary(c.select(F.col("c_nationkey").alias("story_id"), F.col("c_custkey").alias("position"), s.alias("audio_s"), (s / 4 + 1).alias("generation_s")))
    return rows.withColumns({"audio_s": F.round("audio_s", 2), "generation_s": F.round("generation_s", 4), "real_time_factor": F.round("real_time_factor", 6)})


@query(f"{ALIGNED_SQL} SELECT clip_id, pos, printf('%02d:%02d.%03d', start_ms // 60000, start_ms // 1000 % 60, start_ms % 1000) AS at FROM alignment")
def word_timestamps(spark, sf_dir):
    return _alignment(spark, sf_dir).select("clip_id", "pos", speech.timestamp(F.col("start_ms")).alias("at"))


# --- services -----------------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' ELSE props END AS text, CASE event_id % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN NULL WHEN 2 THEN 'flac' ELSE 'wav' END AS form, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS voice FROM events)
SELECT event_id, coalesce(voice, 'af_sarah') AS voice, coalesce(form, 'wav') AS format, CASE WHEN coalesce(text, '') = '' THEN 'input is required' WHEN coalesce(form, 'wav') NOT IN ('wav', 'mp3') THEN 'unsupported response_format: "' || form || '" (must be "wav" or "mp3")' END AS error,
CASE WHEN coalesce(text, '') <> '' AND coalesce(form, 'wav') IN ('wav', 'mp3') THEN CASE WHEN coalesce(form, 'wav') = 'mp3' THEN 'audio/mpeg' ELSE 'audio/wav' END END AS content_type FROM r"""
)
def speech_requests(spark, sf_dir):
    """Requests of the other shape: input and response_format in JSON bodies."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    form = F.when(F.col("event_id") % 4 == 0, "mp3").when(F.col("event_id") % 4 == 2, "flac").when(F.col("event_id") % 4 == 3, "wav")
    body = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("input"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("voice"), form.alias("response_format")))
    return serving.speech_requests(e.select("event_id", body.alias("body"))).select("event_id", "voice", "format", "error", "content_type")


@query(
    """WITH r AS (SELECT event_id, props AS text, event_type AS voice, round(0.5 + value / 200, 6) AS speed FROM events WHERE coalesce(props, '') <> ''),
n AS (SELECT *, floor(len(string_split(text, ' ')) * 0.08::DOUBLE / speed * 24000)::INT AS n_samples FROM r)
SELECT event_id AS job_id, n_samples, (23 + 4 * ((44 + 2 * n_samples + 2) // 3))::INT AS format_at FROM n"""
)
def job_results(spark, sf_dir):
    """Jobs through validation, a stand-in synthesiser and envelopes."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value", "props")
    jobs = e.select(F.col("event_id").alias("job_id"), F.col("props").alias("text"), F.col("event_type").alias("voice"), F.round(0.5 + F.col("value") / 200, 6).alias("speed"), F.lit("wav").alias("format"))
    done = serving.responses(serving.synthesised(serving.validated(jobs), lambda: serving.tone, encoded=True))
    # Where the format comes in the envelope says how long the audio before it is.
    return done.select("job_id", F.round(F.col("seconds") * 24_000).cast("int").alias("n_samples"), F.instr("body", '"format"').alias("format_at"))
