"""Words with several readings, told apart by the words around them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.functions.constants import STRIPPED_FOR_CONTEXT
from prosodia.functions.phonology import past, past_bases, possessive, present_bases

WINDOW = 3
_NOT_SUBJECTS = frozenset(
    "again also always and anyone as but can could did do does don't don’t ever everyone finally first he how i if it just let may "
    "might must never next not now once or people please shall she should so someone that then they to we what when where which "
    "while who whoever why will would you".split()
)
_BEFORE_PLURALS = frozenset("all both few her his its many my our some the their these those your".split())


@dataclass
class Reading:
    before: tuple[str, ...] = ()
    after: tuple[str, ...] = ()
    immediately_before: tuple[str, ...] = ()


@dataclass
class Rule:
    """``readings`` by pronunciation; ``default`` where nothing decides."""

    default: str
    readings: dict[str, Reading] = field(default_factory=dict)
    imperative: str = ""
    narrated_past: str = ""
    subject_name: str = ""
    inflected_default: str = ""


def core(word: str) -> str:
    return word.strip(STRIPPED_FOR_CONTEXT)


def ends_clause(word: str) -> bool:
    left = word.rstrip("\"')]}”’")
    return left[-1:] in tuple(",;:—.!?")


def bounds(ws: list[str], i: int, window: int = WINDOW) -> tuple[int, int]:
    """The window around a word, cut at clause ends on either side."""
    low, high = max(0, i - window), min(len(ws) - 1, i + window)
    low = next((j + 1 for j in range(i - 1, low - 1, -1) if ends_clause(ws[j])), low)
    return low, next((j for j in range(i, high) if ends_clause(ws[j])), high)


def stem(word: str, rules: dict[str, Rule]):
    """(key, ending) of an inflected form of a rule's word."""
    n = len(word.encode())
    if word.endswith("ed") and n > 3:
        for base in past_bases(word):
            if base in rules:
                return base, past
    if word.endswith("ing") and n > 4:
        for base in present_bases(word):
            if base in rules:
                return base, lambda _: "ɪŋ"
    if word.endswith("s") and n > 1 and word[:-1] in rules:
        return word[:-1], possessive
    return None


def _named_subject(ws: list[str], i: int) -> bool:
    if not i or ends_clause(ws[i - 1]):
        return False
    name = core(ws[i - 1])
    low = name.lower()
    if not name[:1].isupper() or "'" in name or "’" in name:
        return False
    plural = low.endswith("s") and not low.endswith("ss")
    if plural and i >= 2 and not ends_clause(ws[i - 2]) and core(ws[i - 2]).lower() in _BEFORE_PLURALS:
        return False
    return low not in _NOT_SUBJECTS


def _imperative(ws: list[str], i: int) -> bool:
    return core(ws[i])[:1].isupper() and (not i or ws[i - 1][-1:] in tuple(".!?:;\"”’)—"))


def resolve(ws: list[str], i: int, rules: dict[str, Rule], hint: bool = False) -> str | None:
    """The reading of the i-th word of one sentence; None if no rule has it, or none decides for an inflected form."""
    key, ending = core(ws[i]).lower(), None
    if key not in rules:
        found = stem(key, rules)
        if not found:
            return None
        key, ending = found
    rule = rules[key]
    put = (lambda ipa: ipa + ending(ipa)) if ending else (lambda ipa: ipa)
    may = lambda reading: ending is None or reading != rule.default
    low, high = bounds(ws, i)
    near = {j: core(ws[j]).lower() for j in range(low, high + 1)}
    names = sorted(rule.readings, key=str.encode)
    if i and not ends_clause(ws[i - 1]):
        previous = core(ws[i - 1]).lower()
        for name in names:
            if previous in rule.readings[name].immediately_before and may(name):
                return put(name)
    if ending is None and rule.subject_name and _named_subject(ws, i):
        others = {t for n, r in rule.readings.items() if n != rule.subject_name for t in r.before}
        if not any(near[j] in others for j in range(low, i - 1)):
            return rule.subject_name
    best, far = "", WINDOW + 1

    def offer(name: str, places) -> None:
        nonlocal best, far
        for j in places:
            d = abs(i - j)
            if d < far or d == far and name == rule.default != best:
                best, far = name, d

    for name in names:
        r = rule.readings[name]
        offer(name, [j for t in r.before for j in range(low, i) if near[j] == t])
        offer(name, [j for t in r.after for j in range(i + 1, high + 1) if near[j] == t])
    if best and may(best):
        return put(best)
    if ending is None and rule.imperative and _imperative(ws, i):
        quoted = ws[i][:1] in ('"', "“")
        return rule.narrated_past if hint and rule.narrated_past and not quoted else rule.imperative
    for name in names:
        r = rule.readings[name]
        offer(name, [j for t in (*r.before, *r.after) for j in range(low, high + 1) if j != i and near[j] == t])
    if best and may(best):
        return put(best)
    if ending is None:
        return rule.default
    return put(rule.inflected_default) if rule.inflected_default else None


def readings_of(words: Column, rules: dict[str, Rule], hint: Column) -> Column:
    """array<struct<pos, word, reading>> of the ruled words of a sentence, empty where the plan sees that there are none: only
    the words of likely sentences reach Python."""
    stems = "|".join(sorted({k[:-1] if k.endswith(("e", "y")) else k for k in rules}))

    @F.pandas_udf("array<struct<pos:int,word:string,reading:string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ws, hints in batches:
            rows = []
            for sentence, told in zip(ws, hints, strict=True):
                ws_ = list(sentence)
                found = ((i, w, resolve(ws_, i, rules, bool(told))) for i, w in enumerate(ws_))
                rows.append([{"pos": i, "word": w, "reading": r} for i, w, r in found if r is not None])
            yield pd.Series(rows)

    likely = F.lower(F.array_join(words, " ")).rlike(rf"(?:^|[^\p{{L}}])(?:{stems})")
    return run(F.when(likely, words).otherwise(F.array().cast("array<string>")), hint)


def readings(sentences: DataFrame, rules: dict[str, Rule], hint_col: str | None = None) -> DataFrame:
    """One row for each occurrence of a ruled word in rows with an array column ``words``: (..., pos, word, reading)."""
    hint = F.col(hint_col) if hint_col else F.lit(False)
    rest = [c for c in sentences.columns if c != "words"]
    return sentences.select(*rest, F.explode(readings_of(F.col("words"), rules, hint)).alias("r")).select(*rest, "r.*")


#: Rules for demonstration; users supply their own.
SMALL: dict[str, Rule] = {
    "read": Rule(
        "ɹˈɛd",
        {"ɹˈid": Reading(("will", "to", "can", "could", "please", "let"), ("aloud", "about")), "ɹˈɛd": Reading(("had", "was", "she", "he"))},
        imperative="ɹˈid",
        narrated_past="ɹˈɛd",
    ),
    "wind": Rule("wˈɪnd", {"wˈInd": Reading(("to", "will"), ("up", "down")), "wˈɪnd": Reading(("the", "cold"), ("blew",))}),
    "close": Rule("klˈOz", {"klˈOs": Reading(("very", "so", "too"), ("to",)), "klˈOz": Reading(("please", "will"))}, inflected_default="klˈOz"),
}
