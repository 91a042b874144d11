"""From text to phonemes and token ids: sentences, normalisation, context readings and the lexicon cascade put together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from prosodia.functions.arrow import Memo, arrow, in_parts
from prosodia.functions.constants import VOCABULARY
from prosodia.functions.normalizer import normalize, normalized
from prosodia.functions.sounding import Node, sound_out, stem_and_ending
from prosodia.operators import homographs, lexicon, text
from prosodia.operators.homographs import Rule
from prosodia.session import once

PLACE = ["doc_id", "para", "sent"]


@dataclass
class Frontend:
    """The tables that decide how words are said: lexicon rows (tier, word, ipa), context rules and letter-to-sound trees."""

    lexicon: DataFrame
    rules: dict[str, Rule] = field(default_factory=dict)
    nodes: list[Node] = field(default_factory=list)
    roots: dict[str, int] = field(default_factory=dict)
    #: Whole words of gold and silver, for telling shouted prose from acronyms; never custom ones.
    words: frozenset[str] = frozenset()


def load(spark: SparkSession, tables: DataFrame, rules: dict[str, Rule] | None = None, nodes=None, roots=None, most_words: int = 2_000_000) -> Frontend:
    """A front end from its tables, or an error: no gold or silver entries, or a reading that the vocabulary can't speak.

    A custom tier may be absent. The words of gold and silver go to each task for normalisation, ``most_words`` at most.
    """
    tables = lexicon.with_lower_case(tables)
    held = {r["tier"] for r in tables.select("tier").distinct().limit(10).collect()}
    if missing := {"gold", "silver"} - held:
        raise ValueError(f"no entries in {', '.join(sorted(missing))}")
    bad = [f"{r['tier']} {r['word']}: {' '.join(r['code_points'])}" for r in lexicon.violations(tables).collect()]
    bad += rule_violations(rules or {})
    if bad:
        raise ValueError("readings that the vocabulary can't speak: " + "; ".join(bad))
    known = tables.where("tier in ('gold', 'silver')").select("word").distinct().limit(most_words + 1).collect()
    if len(known) > most_words:
        raise ValueError(f"more than {most_words} words")
    return Frontend(tables, rules or {}, nodes or [], roots or {}, frozenset(r["word"] for r in known))


def rule_violations(rules: dict[str, Rule]) -> list[str]:
    """Readings of context rules with a character that the vocabulary lacks: defaults, imperatives and all in ``readings``."""
    out = []
    for word in sorted(rules):
        rule = rules[word]
        for ipa in dict.fromkeys((rule.default, rule.imperative, rule.inflected_default, *rule.readings)):
            lost = [c for c in dict.fromkeys(ipa) if c not in VOCABULARY]
            if lost:
                out.append(f"homograph {word}: " + " ".join(f"U+{ord(c):04X}" for c in lost))
    return out


@arrow("array<struct<sentence:string,hint:boolean>>")
def _told(paragraphs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in in_parts(paragraphs):
        split = part.map(lambda t: text.split_sentences(t or ""))
        yield split.map(lambda ss: [{"sentence": s, "hint": h} for s, h in zip(ss, text.hints(ss), strict=True)])


@arrow("string")
def emphasised(sentences: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in sentences:
        yield batch.map(lambda s: None if s is None else text.inject_emphasis(s))


def hinted_sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, para, sent, sentence, hint): sentences of blank-line paragraphs, and whether the ones before narrate the past."""
    rows = text.paragraphs(docs, text_col).select("doc_id", "para", F.posexplode(_told(F.col("paragraph"))).alias("sent", "s"))
    return rows.select(*PLACE, "s.sentence", "s.hint")


_STRIPPED = text.char_class(text.STRIPPED)


def split_punctuation(word: Column) -> Column:
    """struct<prefix, core, suffix>: punctuation before and behind; a word of nothing else is all prefix."""
    prefix = F.regexp_extract(word, f"^({_STRIPPED}*)", 1)
    rest = F.substring(word, F.char_length(prefix) + 1, F.char_length(word))
    core = F.regexp_replace(rest, f"{_STRIPPED}+$", "")
    return F.struct(prefix.alias("prefix"), core.alias("core"), F.substring(rest, F.char_length(core) + 1, F.char_length(rest)).alias("suffix"))


def spoken_words(sentences: DataFrame, front: Frontend) -> DataFrame:
    """(place, pos, prefix, core, suffix, reading) of each word of the normalised sentences; ``reading`` is what context
    rules say of it, null where none does."""
    spoken = sentences.select(*PLACE, "hint", normalized(F.col("sentence"), front.words).alias("spoken"))
    rows = spoken.select(*PLACE, "hint", F.filter(F.split("spoken", r"\s+"), lambda w: w != "").alias("words"))
    if front.rules:
        rows = rows.withColumn("told", homographs.readings_of(F.col("words"), front.rules, F.col("hint")))
    else:
        rows = rows.withColumn("told", F.array().cast("array<struct<pos:int,word:string,reading:string>>"))
    placed = rows.select(*PLACE, "told", F.posexplode("words").alias("pos", "word"))
    reading = F.get(F.filter("told", lambda t: t["pos"] == F.col("pos")), F.lit(0))["reading"]
    return placed.select(*PLACE, "pos", split_punctuation(F.col("word")).alias("s"), reading.alias("reading")).select(*PLACE, "pos", "s.*", "reading")


def said_words(cores: DataFrame, front: Frontend) -> DataFrame:
    """(core, source, ipa, rule) for distinct words as they are written: the cascade, then letter-to-sound for what it lacks."""
    cores = once(cores.withColumn("word", F.lower("core")))
    # Tables of distinct words, cut off from what made them: the plans of the cascade and of the sentences grow apart.
    resolved = once(cores.join(lexicon.cascade(cores.select("word").distinct(), front.lexicon), "word"))
    if not front.nodes:
        return resolved.select("core", "source", "ipa", "rule")
    nodes, roots = front.nodes, front.roots

    @arrow("struct<ipa:string,rule:string>")
    def sounded(words: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in words:
            said = [("", "") if w is None else stem_and_ending(w, lambda x: sound_out(x, nodes, roots)) for w in batch]
            yield pd.DataFrame(said, columns=["ipa", "rule"])

    skipped = F.col("source") == "skip"
    rows = resolved.withColumn("said", sounded(F.when(skipped, F.col("core"))))
    new = skipped & (F.col("said.ipa") != "")
    pick = lambda a, b, name: F.when(new, a).otherwise(b).alias(name)
    return once(rows.select("core", pick(F.lit("lts"), F.col("source"), "source"), pick(F.col("said.ipa"), F.col("ipa"), "ipa"), pick(F.col("said.rule"), F.col("rule"), "rule")))


def diagnosed(sentences: DataFrame, front: Frontend) -> DataFrame:
    """(doc_id, para, sent, pos, prefix, core, suffix, source, ipa, rule) of each word, stand-alone punctuation included with
    an empty core. Words are decided once each, occurrences by context rules within their sentence: the sentences are made
    twice, once for the words that there are and once to be joined with them."""
    placed = spoken_words(sentences, front)
    said = said_words(placed.where("core != ''").select("core").distinct(), front).withColumnRenamed("core", "key")
    # Punctuation has no word to meet; its rows are spread instead of meeting at one empty key.
    apart = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*PLACE, "pos"), F.lit(4096)).cast("string"))
    rows = placed.withColumn("key", F.when(F.col("core") == "", apart).otherwise(F.col("core"))).join(said, "key", "left")
    # Gold owns a word that it holds whole, unless the word is a bare homograph.
    bare = F.lower("core").isin(*sorted(front.rules))
    owned = F.col("source").isin("builtin", "custom") | ((F.col("source") == "gold") & (F.col("rule") == "") & ~bare)
    told = F.col("reading").isNotNull() & ~owned
    pick = lambda value, name: F.when(told, value).otherwise(F.col(name)).alias(name)
    return rows.select(*PLACE, "pos", "prefix", "core", "suffix", pick(F.lit("homograph"), "source"), pick(F.col("reading"), "ipa"), pick(F.lit(""), "rule"))


class Speaker:
    """A front end whose lexicon every task holds: what diagnosed() says of a paragraph's sentences, one after the other,
    without a join. Words are decided once as long as they are remembered."""

    def __init__(self, entries: list[tuple[str, str, str]], front: Frontend):
        self.rules, self.is_word, self.nodes, self.roots = front.rules, front.words.__contains__, front.nodes, front.roots
        self.cascade = lexicon.Cascade(entries)
        self.words, self.cores = Memo(self._word), Memo(self._core)

    def _word(self, w: str) -> tuple:
        """(prefix, core, suffix, source, ipa, rule, whether a context rule may decide) of a word as it is written."""
        rest = w.lstrip(text.STRIPPED)
        core = rest.rstrip(text.STRIPPED)
        prefix, suffix = w[: len(w) - len(rest)], rest[len(core) :]
        if not core:
            return prefix, core, suffix, None, None, None, False
        source, ipa, rule, owned = self.cores[core]
        key = homographs.core(w).lower() if not owned else ""
        return prefix, core, suffix, source, ipa, rule, bool(key) and (key in self.rules or bool(homographs.stem(key, self.rules)))

    def _core(self, core: str) -> tuple[str, str, str, bool]:
        """(source, ipa, rule, whether context rules have no say)."""
        source, ipa, rule = self.cascade(core.lower())
        if source == "skip" and self.nodes:
            said, how = stem_and_ending(core, lambda x: sound_out(x, self.nodes, self.roots))
            if said:
                source, ipa, rule = "lts", said, how
        # Gold owns a word that it holds whole, unless the word is a bare homograph.
        owned = source in ("builtin", "custom") or source == "gold" and rule == "" and core.lower() not in self.rules
        return source, ipa, rule, owned

    def sentences(self, paragraph: str, emphasis: bool) -> Iterator[tuple[int, list[tuple]]]:
        """(sent, words) of the sentences that have a word; words as those of _word()."""
        split = text.split_sentences(paragraph)
        for sent, (sentence, hint) in enumerate(zip(split, text.hints(split), strict=True)):
            ws = normalize(text.inject_emphasis(sentence) if emphasis else sentence, self.is_word).split()
            words = [self.words[w] for w in ws]
            for i, word in enumerate(words):
                if word[6] and (reading := homographs.resolve(ws, i, self.rules, hint)) is not None:
                    words[i] = (*word[:3], "homograph", reading, "", True)
            if words:
                yield sent, words

    def phonemes(self, paragraph: str, emphasis: bool) -> Iterator[tuple[int, str]]:
        for sent, words in self.sentences(paragraph, emphasis):
            yield sent, " ".join([w[0] + (w[4] or "") + w[2] for w in words])


def speaker(front: Frontend) -> Speaker | None:
    """None where the lexicon is too large to be sent to every task; words are joined with it then."""
    if not lexicon.is_small(front.lexicon):
        return None
    return Speaker([tuple(r) for r in front.lexicon.select("tier", "word", "ipa").collect()], front)


#: Rows that a task makes before it hands them on.
ROWS = 1 << 13


def by_paragraph(docs: DataFrame, rows_of: Callable[[str], Iterator[tuple]], schema: str, text_col: str = "text") -> DataFrame:
    """``rows_of`` each paragraph of the documents, behind (doc_id, para): what is made of a paragraph is made where it is."""
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, para int, {schema}"
    made = to_arrow_schema(docs.sparkSession.createDataFrame([], kinds).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        put = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), made, strict=True)], names=made.names)
        for batch in batches:
            ids, paras, said = (batch.column(c) for c in ("doc_id", "para", "paragraph"))
            for i in range(batch.num_rows):
                place = ids[i].as_py(), paras[i].as_py()
                for row in rows_of(said[i].as_py()):
                    held.append((*place, *row))
                    if len(held) >= ROWS:
                        yield put()
                        held = []
        if held:
            yield put()

    return text.paragraphs(docs, text_col).select("doc_id", "para", "paragraph").mapInArrow(run, kinds)


def _made_groups(ids: list[np.ndarray], most: int, columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows (grp, n_sentences, ``columns``) of the groups of a paragraph's sentences."""
    groups = text.packed([x for x in ids if len(x)], most)
    made = {
        "tokens": lambda i, t: t,
        "segments": lambda i, t: text.segments(t.tolist(), MOST),
        "n_tokens": lambda i, t: len(t),
        "n_segments": lambda i, t: len(text.segments(t.tolist(), MOST)),
        "clause_places": lambda i, t: text.pause_places(t),
        "sentence_samples": lambda i, t: text.silence_after(t) if i < len(groups) - 1 else 0,
        "paragraph_samples": lambda i, t: int((0.85 if len(groups) <= 2 else 0.80 if len(groups) == 3 else 0.70) * 24_000),
    }
    for i, (n, tokens) in enumerate(groups):
        yield i, n, *(made[c](i, tokens) for c in columns)


MOST = text.MAX_TOKENS
_GROUP_KINDS = {"tokens": "array<long>", "segments": "array<array<long>>", "clause_places": "array<int>"}


def _group_schema(columns: tuple[str, ...]) -> str:
    return ", ".join(["grp int, n_sentences int", *(f"{c} {_GROUP_KINDS.get(c, 'int')}" for c in columns)])


def sentence_groups(docs: DataFrame, *columns: str, text_col: str = "text", most: int = text.MAX_TOKENS) -> DataFrame:
    """(doc_id, para, grp, n_sentences, ...) of sentences as they are spelled: ``columns`` of token_groups() and voiced_plan(),
    or n_tokens and n_segments."""
    return by_paragraph(docs, lambda p: _made_groups([text.ids_of(s) for s in text.split_sentences(p)], most, columns), _group_schema(columns), text_col)


def diagnose_text(docs: DataFrame, front: Frontend, text_col: str = "text") -> DataFrame:
    """(doc_id, para, sent, pos, word, phonemes, source, rule): where each word's reading comes from, in the windows that
    synthesis uses. Emphasis is never injected, and stand-alone punctuation has no row."""
    if said := speaker(front):
        rows_of = lambda p: ((sent, pos, w[1], w[4], w[3], w[5]) for sent, words in said.sentences(p, False) for pos, w in enumerate(words) if w[1])
        return by_paragraph(docs, rows_of, "sent int, pos int, word string, phonemes string, source string, rule string", text_col)
    rows = diagnosed(hinted_sentences(docs, text_col), front).where("core != ''")
    return rows.select(*PLACE, "pos", F.col("core").alias("word"), F.col("ipa").alias("phonemes"), "source", "rule")


def phonemize(docs: DataFrame, front: Frontend, emphasis: bool = False, text_col: str = "text") -> DataFrame:
    """(doc_id, para, sent, phonemes): punctuation stays where it is, words are one blank apart. Hints are those of the raw
    sentences, before emphasis changes them."""
    if words := speaker(front):
        return by_paragraph(docs, lambda p: words.phonemes(p, emphasis), "sent int, phonemes string", text_col)
    sentences = hinted_sentences(docs, text_col)
    if emphasis:
        sentences = sentences.withColumn("sentence", emphasised(F.col("sentence")))
    said = F.concat("prefix", F.coalesce("ipa", F.lit("")), "suffix")
    ordered = F.array_sort(F.collect_list(F.struct("pos", said.alias("said"))))
    rows = diagnosed(sentences, front).groupBy(*PLACE).agg(ordered.alias("words"))
    return rows.select(*PLACE, F.array_join(F.transform("words", lambda w: w["said"]), " ").alias("phonemes"))


def token_groups(phonemes: DataFrame, most: int = text.MAX_TOKENS) -> DataFrame:
    """(doc_id, para, grp, n_sentences, tokens, segments): sentences with tokens, packed in order into groups of at most
    ``most`` tokens, a space between two; a sentence that is longer is a group of several segments."""
    sized = phonemes.select(*PLACE, text.token_ids(F.col("phonemes")).alias("ids")).where(F.size("ids") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("sent", "ids")))
    paras = sized.groupBy("doc_id", "para").agg(F.transform(ordered, lambda x: x["ids"]).alias("ids"))
    sizes = F.transform("ids", lambda x: F.size(x))
    groups = paras.select("doc_id", "para", "ids", F.posexplode(text.group_sizes(sizes, most)).alias("grp", "g"))
    own = F.slice("ids", F.col("g.first") + 1, F.col("g.n"))
    space = F.array(F.lit(text.SPACE).cast("long"))
    tokens = F.aggregate(own, F.array().cast("array<long>"), lambda acc, x: F.when(F.size(acc) == 0, x).otherwise(F.concat(acc, space, x)))
    made = groups.select("doc_id", "para", "grp", F.col("g.n").alias("n_sentences"), tokens.alias("tokens"))
    return made.withColumn("segments", text.segments_of(F.col("tokens")))


def tokenize_text(docs: DataFrame, front: Frontend, emphasis: bool = False, text_col: str = "text", most: int = text.MAX_TOKENS, columns: tuple[str, ...] = ("tokens", "segments")) -> DataFrame:
    """token_groups() of phonemize(): text to what a synthesiser is given. ``columns`` as for sentence_groups()."""
    if words := speaker(front):
        return by_paragraph(docs, lambda p: _made_groups([text.ids_of(s) for _, s in words.phonemes(p, emphasis)], most, columns), _group_schema(columns), text_col)
    groups = token_groups(phonemize(docs, front, emphasis, text_col), most)
    groups = voiced_plan(groups) if {"clause_places", "sentence_samples", "paragraph_samples"} & set(columns) else groups
    groups = groups.withColumns({"n_tokens": F.size("tokens"), "n_segments": F.size("segments")})
    return groups.select("doc_id", "para", "grp", "n_sentences", *columns)


def voiced_plan(groups: DataFrame) -> DataFrame:
    """Adds what is put between the groups of a text: clause places, silence behind each group, silence behind its
    paragraph, and whether it is the last of either."""
    para = Window.partitionBy("doc_id", "para")
    rows = groups.withColumns({"n_groups": F.count("*").over(para), "last_grp": F.max("grp").over(para)})
    return rows.select(
        *groups.columns,
        text.clause_pauses(F.col("tokens")).alias("clause_places"),
        F.when(F.col("grp") < F.col("last_grp"), text.sentence_silence(text.terminal(F.col("tokens")), F.size("tokens"))).otherwise(0).alias("sentence_samples"),
        text.paragraph_silence(F.col("n_groups")).alias("paragraph_samples"),
    )
