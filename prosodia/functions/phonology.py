"""Suffix phonology and suffix candidates, in Python and as columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SIBILANTS, VOICELESS, VOWELS = "szʃʒʧʤ", "ptkfθ", "aeiouɑæɛɪʊʌɔəᵊɜɐAIOWY"


def last_symbol(ipa: str) -> str:
    """The last letter or symbol; once a non-ASCII byte is met on the way back, the very last character."""
    for c in reversed(ipa):
        if ord(c) >= 128:
            return ipa[-1]
        if c.isalpha() or unicodedata.category(c)[0] == "S":
            return c
    return ""


def _in(c: str, group: str) -> bool:
    return bool(c) and c in group


def possessive(ipa: str) -> str:
    last = last_symbol(ipa)
    return "ɪz" if _in(last, SIBILANTS) else "s" if _in(last, VOICELESS) else "z"


def will(ipa: str) -> str:
    return "l" if _in(last_symbol(ipa), VOWELS) else "ᵊl"


def past(ipa: str) -> str:
    last = last_symbol(ipa)
    return "ᵻd" if _in(last, "td") else "t" if _in(last, "pkfθsʃʧ") else "d"


def _doubled(stem: str) -> list[str]:
    b = stem.encode()
    return [stem[:-1]] if len(b) >= 2 and b[-1] == b[-2] else []


def past_bases(word: str) -> list[str]:
    stem = word[:-2]
    return [stem + "e", stem, *_doubled(stem), *([word[:-3] + "y"] if word.endswith("ied") and len(word.encode()) > 4 else [])]


def present_bases(word: str) -> list[str]:
    stem = word[:-3]
    return [stem + "e", stem, *([word[:-4] + "y"] if word.endswith("ying") and len(word.encode()) > 5 else []), *_doubled(stem)]


def _ends(group: str) -> str:
    return f"[{group}]$"


def possessive_column(ipa: Column) -> Column:
    return F.when(ipa.rlike(_ends(SIBILANTS)), "ɪz").when(ipa.rlike(_ends(VOICELESS)), "s").otherwise("z")


def will_column(ipa: Column) -> Column:
    return F.when(ipa.rlike(_ends(VOWELS)), "l").otherwise("ᵊl")


def past_column(ipa: Column) -> Column:
    return F.when(ipa.rlike(_ends("td")), "ᵻd").when(ipa.rlike(_ends("pkfθsʃʧ")), "t").otherwise("d")


def suffixed(ipa: Column, rule: Column) -> Column:
    """A base's reading with the ending of the rule that found it."""
    return (
        F.when(rule.isin("'s", "-s", "-es"), F.concat(ipa, possessive_column(ipa)))
        .when(rule == "-ies", F.concat(ipa, F.lit("z")))
        .when(rule == "-ing", F.concat(ipa, F.lit("ɪŋ")))
        .when(rule == "-ed", F.concat(ipa, past_column(ipa)))
        .otherwise(ipa)
    )


def candidates(word: Column) -> Column:
    """array<struct<rank, base, rule>>: what a lower-case word may be in a lexicon, the best first.

    Length guards count bytes. A word in 'll is resolved by its stem and handled apart, see lexicon.resolve().
    """
    n, size = F.char_length(word), F.octet_length(word)
    cut = lambda k, put="": F.concat(F.substring(word, F.lit(1), n - k), F.lit(put))
    same = lambda k: F.substring(word, n - k, F.lit(1)) == F.substring(word, n - k - 1, F.lit(1))
    ends = lambda s, least: word.endswith(s) & (size > least)
    rows = [
        (F.lit(True), word, ""),
        (word.endswith("'s"), cut(2), "'s"),
        (ends("ies", 4), cut(3, "y"), "-ies"),
        (ends("s", 1), cut(1), "-s"),
        (ends("ing", 4), cut(3, "e"), "-ing"),
        (ends("ing", 4), cut(3), "-ing"),
        (ends("ying", 5), cut(4, "y"), "-ing"),
        (ends("ing", 4) & (n >= 5) & same(3), cut(4), "-ing"),
        (ends("es", 3), cut(2), "-es"),
        (ends("ed", 3), cut(2, "e"), "-ed"),
        (ends("ed", 3), cut(2), "-ed"),
        (ends("ed", 3) & (n >= 4) & same(2), cut(3), "-ed"),
        (ends("ied", 4), cut(3, "y"), "-ed"),
    ]
    made = [F.when(cond, F.struct(F.lit(i).alias("rank"), base.alias("base"), F.lit(rule).alias("rule"))) for i, (cond, base, rule) in enumerate(rows)]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def bases_of(word: str) -> list[tuple[str, str]]:
    """candidates() of one word: (base, rule), the best first."""
    n, size, out = len(word), len(word.encode("utf-8", "surrogatepass")), [(word, "")]
    last = word[-1:]
    if last == "s":
        if word.endswith("'s"):
            out.append((word[:-2], "'s"))
        if size > 4 and word.endswith("ies"):
            out.append((word[:-3] + "y", "-ies"))
        if size > 1:
            out.append((word[:-1], "-s"))
        if size > 3 and word.endswith("es"):
            out.append((word[:-2], "-es"))
    elif last == "g" and size > 4 and word.endswith("ing"):
        out += [(word[:-3] + "e", "-ing"), (word[:-3], "-ing")]
        if size > 5 and word.endswith("ying"):
            out.append((word[:-4] + "y", "-ing"))
        if n >= 5 and word[-4] == word[-5]:
            out.append((word[:-4], "-ing"))
    elif last == "d" and size > 3 and word.endswith("ed"):
        out += [(word[:-2] + "e", "-ed"), (word[:-2], "-ed")]
        if n >= 4 and word[-3] == word[-4]:
            out.append((word[:-3], "-ed"))
        if size > 4 and word.endswith("ied"):
            out.append((word[:-3] + "y", "-ed"))
    return out


def suffixed_ipa(ipa: str, rule: str) -> str:
    """suffixed() of one reading, by its very last character as there."""
    last = ipa[-1:]
    if rule in ("'s", "-s", "-es"):
        return ipa + ("ɪz" if _in(last, SIBILANTS) else "s" if _in(last, VOICELESS) else "z")
    if rule == "-ed":
        return ipa + ("ᵻd" if _in(last, "td") else "t" if _in(last, "pkfθsʃʧ") else "d")
    return ipa + {"-ies": "z", "-ing": "ɪŋ"}.get(rule, "")


def syllables(word: Column) -> Column:
    """Vowel groups of the letters; a last e counts only after l; at least one."""
    letters = F.regexp_replace(F.lower(word), r"[^\p{L}]", "")
    groups = F.regexp_count(letters, F.lit("[aeiouy]+"))
    silent = (groups > 1) & (F.octet_length(letters) > 2) & letters.rlike("[^l]e$")
    return F.greatest(F.lit(1), groups - silent.cast("int"))
