"""Prose into speakable text: ordered rewrites, exact in Python, and the static ones as column expressions.

Word boundaries are those of ASCII words throughout: a digit or letter next to an accented letter does have a boundary
between. Java and Python see Unicode words by default, so boundaries are spelled out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prosodia.functions import numbers as say
from prosodia.functions.arrow import in_parts
from prosodia.functions.constants import ABBREVIATIONS, BEFORE_ROMAN, BEFORE_YEAR, CAPITAL_WORDS, LETTERS, MIXED_CASE, NAME_ENDINGS

IsWord = Callable[[str], bool]
_A = re.ASCII
_HEADING = re.compile(r"(?m)^#{1,6}[ \t\n\r\f]+")
_TICKS = re.compile(r"`+([^`]+)`+")
_MARKS = [re.compile(rf"\*{{{n}}}([^*]+)\*{{{n}}}|_{{{n}}}([^_]+)_{{{n}}}") for n in (3, 2, 1)]
_BLANK_LINE = re.compile(r"\n[ \t\n\r\f]*\n")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_ODD_SPACE = re.compile(r"[\t\n\v\f\r\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_DEGREE = re.compile(r"\s*°\s*([CF])\b", _A)
_PLUS_MINUS = re.compile(r"\s*±\s*", _A)
_STREET = re.compile(r"((?<![0-9A-Za-z_])(?=[A-Za-z_])[^\W\d_'][^\W\d_']*(?:'[^\W\d_]*)*|(?<=[0-9A-Za-z_])'[^\W\d_']*)([ \t\n\r\f]+)[Ss]t\.([ \t\n\r\f]+((?:[^\W\d_]|')+))?")
_DOTTED = re.compile(r"\b(?:[A-Z]\.){2,}", _A)
_SLASH = re.compile(r"\b([A-Z])/([A-Z])\b", _A)
_MIXED = re.compile(r"\b(?:" + "|".join(sorted(MIXED_CASE, key=len, reverse=True)) + r")\b", _A)
_PLURAL_CAPS = re.compile(r"\b([A-Z]{2,4})s\b", _A)
_ROMAN = re.compile(rf"(?i:\b({'|'.join(BEFORE_ROMAN)})\s+([IVXLCDM]{{2,}})\b)", _A)
_CAPS = re.compile(r"\b[A-Z]{2,4}\b", _A)
_CAPS_RUN = re.compile(r"\b[A-Z]{2,}\b", _A)
_DECADE = re.compile(r"\b([0-9]{4})s\b", _A)
_YEAR = re.compile(rf"(?i:\b({'|'.join(BEFORE_YEAR)})\s+(1[1-9][0-9]{{2}}|20[0-9]{{2}})\b)", _A)
_STAMP = re.compile(r"\b([0-9]{1,2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?\b", _A)
_CLOCK = re.compile(r"\b([0-9]{1,2}):([0-9]{2})\b", _A)
_ORDINAL = re.compile(r"\b([0-9]+)(?:st|nd|rd|th)\b", _A)
_MONEY = re.compile(r"\$([0-9]+(?:\.[0-9]{2})?)")
_PERCENT = re.compile(r"\b([0-9]+)%", _A)
_LETTER_NUMBER = re.compile(r"\b([A-Za-z])([0-9]+)\b", _A)
_DECIMAL = re.compile(r"\b([0-9]+)\.([0-9]+)\b", _A)
_NUMBER = re.compile(r"\b[0-9]+\b", _A)


def _street(m: re.Match) -> str:
    before, gap, tail, after = m[1], m[2], m[3] or "", m[4] or ""
    if not before[:1].isupper() or after[:1].isupper():
        return m[0]
    return f"{before}{gap}street{tail}"


def name_ending(word: str) -> str:
    """Jr., Sr. and Esq. inside punctuation, possessives kept."""
    dot = word.find(".")
    if dot < 0:
        return word
    start = len(word[:dot]) - len(word[:dot].lstrip("\"'(["))
    key = word[start : dot + 1].lower()
    rest = word[dot + 1 :]
    if key not in NAME_ENDINGS or rest.removeprefix("'s").strip(",;:!?\"')]"):
        return word
    return word[:start] + ABBREVIATIONS[key] + rest


def abbreviations(text: str) -> str:
    return " ".join((ABBREVIATIONS.get(w.lower()) or name_ending(w)) if "." in w else w for w in text.split())


def spelled(capitals: str) -> str:
    """Names of the letters, unless the capitals are a word."""
    return capitals.lower() if capitals in CAPITAL_WORDS else " ".join(LETTERS[c] for c in capitals)


def plural(word: str) -> str:
    return word + ("es" if word.endswith(("s", "z", "x", "ch", "sh")) else "s")


def _spelled_plural(m: re.Match) -> str:
    head, space, last = spelled(m[1]).rpartition(" ")
    return head + space + plural(last)


def acronyms(text: str, is_word: IsWord | None = None) -> str:
    """Spells acronyms; with a word oracle, all-caps runs of words and lone ones of four letters are lower-cased instead."""
    if is_word is None:
        return _CAPS.sub(lambda m: spelled(m[0]), text)
    found, in_run = list(_CAPS_RUN.finditer(text)), set()
    for one, two in zip(found, found[1:], strict=False):
        if not re.search("[a-z.!?]", text[one.end() : two.start()]):
            in_run |= {one.start(), two.start()}

    def put(m: re.Match) -> str:
        low = m[0].lower()
        return low if (len(low) >= 4 or m.start() in in_run) and is_word(low) else spelled(m[0])

    return _CAPS.sub(put, text)


def romans(text: str, is_word: IsWord | None = None) -> str:
    def put(m: re.Match) -> str:
        n = say.roman(m[2]) if say.is_roman(m[2]) and not (is_word and is_word(m[2].lower())) else 0
        return f"{m[1]} {say.cardinal(n)}" if n > 0 else m[0]

    return _ROMAN.sub(put, text)


def _count(m: re.Match, group: int, form: str) -> str:
    n = say.parse(m[group])
    return m[0] if n < 0 else form.format(say.cardinal(n))


def _ordinal(m: re.Match) -> str:
    n = say.parse(m[1])
    return m[0] if n < 0 else say.ordinal(n)


_two_capitals = re.compile("[A-Z]{2}").search


def _collapsed(text: str) -> str:
    if "  " in text or "\n" in text or "\t" in text or "\r" in text or "\f" in text:
        text = _SPACES.sub(" ", text)
    return text.strip()


#: The rewrites in order; some need what an earlier one did or left. Each takes (text, word oracle). Where a rewrite can only
#: find something in a text with a certain sign, that is looked for first, which takes a small part of the time.
STEPS: list[tuple[str, Callable[[str, IsWord | None], str]]] = [
    ("headings", lambda t, _: _HEADING.sub("", t) if "#" in t else t),
    ("code ticks", lambda t, _: _TICKS.sub(r"\1", t) if "`" in t else t),
    ("emphasis marks", lambda t, _: _MARKS[2].sub(_both, _MARKS[1].sub(_both, _MARKS[0].sub(_both, t))) if "*" in t or "_" in t else t),
    ("apostrophes", lambda t, _: t.replace("’", "'").replace("‘", "'")),
    ("paragraphs", lambda t, _: _BLANK_LINE.sub(".\n", t).replace("\n", " ") if "\n" in t else t),
    ("spaces", lambda t, _: _ODD_SPACE.sub(" ", t)),
    ("degrees", lambda t, _: _DEGREE.sub(lambda m: " degrees " + ("Fahrenheit" if m[1] == "F" else "Celsius"), t) if "°" in t else t),
    ("plus or minus", lambda t, _: _PLUS_MINUS.sub(" plus or minus ", t) if "±" in t else t),
    ("symbols", lambda t, _: _symbols(t)),
    ("collapse", lambda t, _: _collapsed(t)),
    ("dashes", lambda t, _: t.replace("—", " — ").replace("–", " — ")),
    ("ellipses", lambda t, _: t.replace("...", " … ").replace("…", " … ")),
    ("street", lambda t, _: _STREET.sub(_street, t) if "St." in t or "st." in t else t),
    ("abbreviations", lambda t, _: abbreviations(t)),
    ("dotted capitals", lambda t, _: _DOTTED.sub(lambda m: m[0][:-1].replace(".", " "), t) if t.count(".") > 1 else t),
    ("slashes", lambda t, _: _SLASH.sub(r"\1 \2", t) if "/" in t else t),
    ("mixed case", lambda t, _: _MIXED.sub(lambda m: MIXED_CASE[m[0]], t) if any(map(t.__contains__, MIXED_CASE)) else t),
    ("plural acronyms", lambda t, _: _PLURAL_CAPS.sub(_spelled_plural, t) if _two_capitals(t) else t),
    ("roman numerals", lambda t, is_word: romans(t, is_word) if any(map(t.lower().__contains__, BEFORE_ROMAN)) else t),
    ("acronyms", lambda t, is_word: acronyms(t, is_word) if _two_capitals(t) else t),
    ("decades", lambda t, _: _DECADE.sub(lambda m: say.decade(m[1]), t)),
    ("years", lambda t, _: _YEAR.sub(lambda m: f"{m[1]} {say.year(m[2])}", t)),
    ("timestamps", lambda t, _: _STAMP.sub(lambda m: say.timestamp(m.groups()[:3], m[4]), t)),
    ("clock", lambda t, _: _CLOCK.sub(lambda m: say.clock(m[1], m[2]), t)),
    ("ordinals", lambda t, _: _ORDINAL.sub(_ordinal, t)),
    ("currency", lambda t, _: _MONEY.sub(lambda m: say.currency(m[1]) or m[0], t)),
    ("percent", lambda t, _: _PERCENT.sub(lambda m: _count(m, 1, "{} percent"), t)),
    ("letter and number", lambda t, _: _LETTER_NUMBER.sub(lambda m: _count(m, 2, m[1].upper() + " {}"), t)),
    ("split digits", lambda t, _: re.sub("([A-Za-z])([0-9])", r"\1 \2", re.sub("([0-9])([A-Za-z])", r"\1 \2", t))),
    ("decimals", lambda t, _: _DECIMAL.sub(lambda m: say.decimal(m[1], m[2]) or m[0], t)),
    ("numbers", lambda t, _: _NUMBER.sub(lambda m: _count(m, 0, "{}"), t)),
    ("finish", lambda t, _: _collapsed(t.replace("..", "."))),
]


def _both(m: re.Match) -> str:
    return (m[1] or "") + (m[2] or "")


def _symbols(text: str) -> str:
    for sign, said in (("=", " "), ("_", " "), ("&", " and "), ("≈", " approximately "), ("§", " section ")):
        text = text.replace(sign, said)
    return text


#: Steps that change nothing in a text without ASCII digits; no step before them makes any.
NUMERIC = frozenset(
    ("decades", "years", "timestamps", "clock", "ordinals", "currency", "percent", "letter and number", "split digits", "decimals", "numbers")
)
_digit = re.compile("[0-9]").search


def normalize(text: str, is_word: IsWord | None = None) -> str:
    numeric = _digit(text)
    for name, step in STEPS:
        if numeric or name not in NUMERIC:
            text = step(text, is_word)
    return text


def normalized(text: Column, words: frozenset[str] | None = None) -> Column:
    """normalize() as one Arrow-batched function; ``words`` is the word oracle. Null stays null."""
    is_word = None if words is None else words.__contains__

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in in_parts(batches):
            yield part.map(lambda t: None if t is None else normalize(t, is_word))

    return run(text)


_LEFT, _RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def static_steps(text: Column) -> Column:
    """The rewrites that need no computed replacement, inside generated code: marks, spaces, symbols, dashes, slashes."""
    for pattern, put in (
        (r"(?m)^#{1,6}[ \t\n\r\f]+", ""),
        ("`+([^`]+)`+", "$1"),
        (r"\*{3}([^*]+)\*{3}", "$1"),
        (r"\*{2}([^*]+)\*{2}", "$1"),
        (r"\*([^*]+)\*", "$1"),
        ("[’‘]", "'"),
        (r"\n[ \t\n\r\f]*\n", ".\n"),
        (r"[\t\n\f\r]", " "),
        (r"[ ]*±[ ]*", " plus or minus "),
        ("[=_]", " "),
        ("&", " and "),
        ("≈", " approximately "),
        ("§", " section "),
        (" +", " "),
        ("[—–]", " — "),
        (r"\.\.\.|…", " … "),
        (f"{_LEFT}([A-Z])/([A-Z]){_RIGHT}", "$1 $2"),
        ("([0-9])([A-Za-z])", "$1 $2"),
        ("([A-Za-z])([0-9])", "$1 $2"),
        (r"\.\.", "."),
        (" +", " "),
    ):
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)
