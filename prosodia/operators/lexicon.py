"""Tiered pronunciation lexicons: look-up with suffix rules, the cascade, validation and fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.functions.phonology import VOWELS, bases_of, candidates, suffixed, suffixed_ipa, will_column
from prosodia.operators.text import lossy_runes
from prosodia.session import once

TIERS = ("custom", "gold", "silver")
#: Rows and bytes of words and readings that may be sent to every task; longer lexicons are joined on their keys.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 1 << 26
#: Entries of a tier that are put in order in one place for its fingerprint.
FINGERPRINT_ROWS = 5_000_000
SCHWA, THE = "ə", "ðə"


def with_lower_case(lexicon: DataFrame) -> DataFrame:
    """Adds a lower-case entry where none is claimed: that of the first word in order which folds to it."""
    folded = lexicon.where("word != lower(word)").groupBy("tier", F.lower("word").alias("low")).agg(F.min_by("ipa", "word").alias("ipa"))
    free = folded.join(lexicon.select("tier", F.col("word").alias("low")), ["tier", "low"], "left_anti")
    return lexicon.unionByName(free.select("tier", F.col("low").alias("word"), "ipa"))


def _sent(lexicon: DataFrame) -> DataFrame:
    """Broadcast only where its rows and bytes say that it is small; else Spark picks a join by size."""
    return F.broadcast(lexicon) if is_small(lexicon) else lexicon


def is_small(lexicon: DataFrame) -> bool:
    """Whether its rows and bytes may be sent to every task."""
    size = F.sum(F.octet_length("word") + F.octet_length("ipa"))
    rows, size = lexicon.limit(BROADCAST_ROWS + 1).agg(F.count("*"), size).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def look_up(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, tier, ipa, rule) for distinct lower-case words: each tier's best suffix candidate.

    Candidates are generated and joined on equality, so the plan grows with words, not with words times entries.
    """
    tried = words.select("word", F.explode(candidates(F.col("word"))).alias("c")).select("word", "c.rank", "c.base", "c.rule")
    hits = tried.join(lexicon.select("tier", F.col("word").alias("base"), "ipa"), "base")
    best = hits.groupBy("word", "tier").agg(F.min_by(F.struct("ipa", "rule"), "rank").alias("b"))
    return best.select("word", "tier", suffixed(F.col("b.ipa"), F.col("b.rule")).alias("ipa"), F.col("b.rule").alias("rule"))


def resolve(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """look_up() with the rule for 'll: the stem's own reading, whatever rule found it, and l or a syllable before it.

    The rule comes after 's and before the others, so it wins over what the other rules say of the same word.
    """
    return _resolved(words, _sent(lexicon))


def _resolved(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    direct = look_up(words, lexicon)
    stems = words.where("word like '%''ll'").select("word", F.expr("substring(word, 1, char_length(word) - 3)").alias("stem"))
    found = look_up(stems.select(F.col("stem").alias("word")).distinct(), lexicon).withColumnRenamed("word", "stem")
    willed = stems.join(found, "stem").select("word", "tier", F.concat("ipa", will_column(F.col("ipa"))).alias("ipa"), F.lit("'ll").alias("rule"))
    rank = F.when(F.col("rule") == "", 0).when(F.col("rule") == "'ll", 1).otherwise(2)
    both = direct.unionByName(willed).groupBy("word", "tier").agg(F.min_by(F.struct("ipa", "rule"), rank).alias("b"))
    return both.select("word", "tier", "b.ipa", "b.rule")


def cascade(words: DataFrame, lexicon: DataFrame, homographs: DataFrame | None = None, sounded: Column | None = None) -> DataFrame:
    """(word, source, ipa, rule) for distinct lower-case words, the first source that knows one.

    builtin (a, the), custom, homograph (unless gold holds the word whole and it is no bare homograph; a word of
    ``homographs`` keeps its default reading here, the occurrence decides elsewhere), gold, silver, hyphenated parts that
    all resolve, ``sounded`` (a letter-to-sound column over ``word``), skip.
    """
    lexicon, words = _sent(lexicon), once(words)
    found = _resolved(words, lexicon)
    wide = found.groupBy("word").pivot("tier", list(TIERS)).agg(F.first(F.struct("ipa", "rule")))
    parts = words.where("instr(word, '-') > 0").select("word", F.posexplode(F.split("word", "-")).alias("i", "part"))
    known = _resolved(parts.select(F.col("part").alias("word")).distinct(), lexicon)
    order = F.when(F.col("tier") == "custom", 0).when(F.col("tier") == "gold", 1).otherwise(2)
    first = known.groupBy(F.col("word").alias("part")).agg(F.min_by("ipa", order).alias("ipa"))
    joined = parts.join(first, "part", "left").groupBy("word").agg(
        F.every(F.col("ipa").isNotNull()).alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ipa"))), lambda x: x["ipa"]), " ").alias("ipa"),
    )
    hyphen = joined.where("whole and ipa != ''").select("word", F.struct("ipa", F.lit("").alias("rule")).alias("hyphenated"))
    out = words.join(wide, "word", "left").join(hyphen, "word", "left")
    none = F.lit(None).cast("struct<ipa:string,rule:string>")
    pair = lambda ipa: F.struct(ipa.alias("ipa"), F.lit("").alias("rule"))
    builtin = F.when(F.col("word") == "a", pair(F.lit(SCHWA))).when(F.col("word") == "the", pair(F.lit(THE)))
    homograph = none
    if homographs is not None:
        defaults = homographs.select("word", F.col("default").alias("reading")).distinct()
        out = out.join(F.broadcast(defaults) if defaults.limit(10_001).count() <= 10_000 else defaults, "word", "left")
        homograph = F.when(F.col("reading").isNotNull(), pair(F.col("reading")))
    sources = [("builtin", builtin), ("custom", F.col("custom")), ("homograph", homograph), ("gold", F.col("gold")), ("silver", F.col("silver")), ("hyphenated", F.col("hyphenated"))]
    if sounded is not None:
        sources.append(("lts", F.when(sounded != "", pair(sounded))))
    best = F.coalesce(*(c for _, c in sources))
    name = F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in sources), F.lit("skip"))
    return out.select("word", name.alias("source"), F.coalesce(best["ipa"], F.lit("")).alias("ipa"), F.coalesce(best["rule"], F.lit("")).alias("rule"))


class Cascade:
    """cascade() of single words, for a lexicon that every task holds: (source, ipa, rule) of a lower-case word."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.tiers: dict[str, dict[str, str]] = {t: {} for t in TIERS}
        for tier, word, ipa in entries:
            if tier in self.tiers:
                self.tiers[tier].setdefault(word, ipa)

    def _direct(self, bases: list[tuple[str, str]], tier: dict[str, str]) -> tuple[str, str] | None:
        for base, rule in bases:
            if (ipa := tier.get(base)) is not None:
                return suffixed_ipa(ipa, rule), rule
        return None

    def _tiers(self, word: str) -> Iterator[tuple[str, str, str]]:
        """resolve() of a word: (tier, ipa, rule) of each tier that has it, the first one first."""
        bases = bases_of(word)
        for name in TIERS:
            if found := self._tier(word, bases, self.tiers[name]):
                yield name, *found

    def _tier(self, word: str, bases: list[tuple[str, str]], tier: dict[str, str]) -> tuple[str, str] | None:
        """Whole words, 'll with its stem's reading, then the other endings."""
        found = self._direct(bases, tier)
        if word.endswith("'ll") and not (found and found[1] == ""):
            stem = self._direct(bases_of(word[:-3]), tier)
            if stem:
                return stem[0] + ("l" if stem[0][-1:] and stem[0][-1] in VOWELS else "ᵊl"), "'ll"
        return found

    def __call__(self, word: str) -> tuple[str, str, str]:
        if word in ("a", "the"):
            return "builtin", SCHWA if word == "a" else THE, ""
        if found := next(self._tiers(word), None):
            return found
        if "-" in word:
            parts = [next((x[1] for x in self._tiers(p)), None) for p in word.split("-")]
            if None not in parts and (ipa := " ".join(parts)):
                return "hyphenated", ipa, ""
        return "skip", "", ""


def diagnose(occurrences: DataFrame, lexicon: DataFrame, homographs: DataFrame | None = None) -> DataFrame:
    """Adds (source, ipa, rule) to rows with a lower-case ``word``: distinct words are resolved once and joined back."""
    resolved = cascade(occurrences.select("word").distinct(), lexicon, homographs)
    return occurrences.join(resolved, "word", "left")


def inventory(diagnosed: DataFrame, order: list[str]) -> DataFrame:
    """The first occurrence of each word of each source."""
    at = F.struct(*order)
    firsts = diagnosed.groupBy("source", "word").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    return firsts.select("source", "word", "n", *(F.col(f"at.{c}").alias(f"first_{c}") for c in order))


def violations(lexicon: DataFrame, most: int | None = 10) -> DataFrame:
    """Entries whose reading the vocabulary can't speak, with the code points; the first ``most`` by word, or all."""
    lossy = lexicon.withColumn("lossy", lossy_runes(F.col("ipa"))).where(F.size("lossy") > 0)
    points = F.transform("lossy", lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.unhex(F.hex(F.encode(c, "UTF-32")))), 8, "0")))
    rows = lossy.select("tier", "word", "ipa", points.alias("code_points"))
    return rows if most is None else rows.orderBy("word", "tier").limit(most)


def fingerprint(lexicon: DataFrame) -> DataFrame:
    """(tier, entries, digest): sixteen hex digits over the sorted entries of each tier, independent of row order.

    Entries are put in order in one array for each tier, so more than FINGERPRINT_ROWS are refused.
    """
    entry = F.concat("word", F.lit("\0"), "ipa", F.lit("\0"))
    counted = lexicon.groupBy("tier").agg(F.count("*").alias("entries"))
    if not counted.where(F.col("entries") > FINGERPRINT_ROWS).isEmpty():
        raise ValueError(f"a tier has more than {FINGERPRINT_ROWS} entries")
    joined = F.array_join(F.array_sort(F.collect_list(entry)), "")
    return lexicon.groupBy("tier").agg(F.count("*").alias("entries"), F.substring(F.sha2(joined, 256), 1, 16).alias("digest"))


def _digest(count: int, parts: list[bytes]) -> dict:
    return {"entries": count, "digest": hashlib.sha256(b"".join(p + b"\0" for p in parts)).hexdigest()[:16]}


def rules_fingerprint(rules: dict) -> dict:
    """Entries and digest of context rules, over all their fields, words and readings in the order of their bytes."""
    parts: list[str] = []
    for word in sorted(rules, key=str.encode):
        rule = rules[word]
        parts += [word, rule.default, rule.imperative, rule.narrated_past, rule.subject_name, rule.inflected_default]
        for ipa in sorted(rule.readings, key=str.encode):
            reading = rule.readings[ipa]
            parts += [ipa, "before", *reading.before, "after", *reading.after, "immediately before", *reading.immediately_before]
    return _digest(len(rules), [p.encode() for p in parts])


def vocabulary_fingerprint(vocabulary: dict[str, int]) -> dict:
    """Entries and digest of symbols and their ids, by symbol: an id that changes is a change."""
    return _digest(len(vocabulary), [x for c in sorted(vocabulary) for x in (c.encode(), vocabulary[c].to_bytes(8, "big"))])


def data_fingerprint(lexicon: DataFrame, rules: dict, vocabulary: dict[str, int]) -> dict[str, dict]:
    """What was loaded: gold, silver, custom, homographs and vocabulary; an absent bank has no entries."""
    found = {r["tier"]: {"entries": r["entries"], "digest": r["digest"]} for r in fingerprint(lexicon).collect()}
    banks = {tier: found.get(tier, _digest(0, [])) for tier in ("gold", "silver", "custom")}
    return {**banks, "homographs": rules_fingerprint(rules), "vocab": vocabulary_fingerprint(vocabulary)}


def files_fingerprint(spark: SparkSession, pattern: str) -> str:
    """Twelve hex digits over the names and contents of data files, by name. Files are hashed where they are read; their
    digests, one short row a file, are put together in order."""
    files = spark.read.format("binaryFile").load(pattern)
    each = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
    return hashlib.sha256("".join(f"{r['name']}\0{r['sha']}\0" for r in each.orderBy("name").collect()).encode()).hexdigest()[:12]


def small_lexicon(spark: SparkSession) -> DataFrame:
    """A lexicon of frequent words and some stems, for demonstration and tests; users supply their own."""
    return spark.createDataFrame([(t, w, i) for t, w, i in SMALL], "tier string, word string, ipa string")


def _tier(tier: str, entries: str) -> list[tuple[str, str, str]]:
    return [(tier, *entry.split("=")) for entry in entries.split()]


SMALL = [
    *_tier("custom", "that=ðˈæt with=wɪð for=fɔɹ of=ʌv"),
    *_tier("gold", "and=ænd to=tu in=ɪn is=ɪz it=ɪt was=wʌz on=ɔn be=bi by=bI as=æz this=ðɪs are=ɑɹ at=æt from=fɹʌm an=ən ing=ɪŋ her=hɜɹ on=ɔn"),
    *_tier("silver", "re=ɹi st=st nd=nd th=θ wh=w ent=ɛnt ion=iən ea=i or=ɔɹ er=ɜɹ ou=u ble=bəl ly=li han=hæn"),
]
SMALL = list(dict.fromkeys(SMALL))
