"""From documents to words, sentences and token segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.functions.arrow import Memo, arrow, in_parts
from prosodia.functions.constants import ABBREVIATIONS, CLOSING, FUNCTION_WORDS, STRIPPED, STRIPPED_FOR_CONTEXT, VOCABULARY

MAX_TOKENS, SPACE = 509, 16


def char_class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-&\"" else c for c in chars) + "]"


def strip_edges(word: Column, chars: str = STRIPPED) -> Column:
    return F.regexp_replace(word, f"^{char_class(chars)}+|{char_class(chars)}+$", "")


def paragraphs(docs: DataFrame, text_col: str = "text", pattern: str = r"\n[ \t\n\r\f]*\n") -> DataFrame:
    """(doc_id, para, paragraph): trimmed, empty ones left out; ``para`` counts all that the split gives."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.col(text_col), pattern, -1)).alias("para", "paragraph"))
    return parts.withColumn("paragraph", F.regexp_replace("paragraph", r"^\s+|\s+$", "")).where("paragraph != ''")


def words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, pos, word): blank-separated words of the whole text, in order."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.col(text_col), r"\s+", -1)).alias("pos", "word"))
    return parts.where("word != ''")


# --- sentences ------------------------------------------------------------------------------------------------------

_PREFIXES = frozenset(a[:-1] for a in ABBREVIATIONS)
_LONGEST = max(map(len, _PREFIXES))
_BLANKS = re.compile("[ \t]*")


_END = re.compile(f"[.!?][{re.escape(CLOSING)}]*")


def _closes(text: str, at: int) -> bool:
    """Whether the dot at ``at`` ends a sentence. Looks no further than the word before and the blanks behind."""
    before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
    if before.isdecimal() and after.isdecimal():
        return False
    if before.isalpha() and after.isalpha() and not (at > 1 and text[at - 2].isalpha()):
        return False
    low = max(at - _LONGEST - 1, 0)
    token = text[max(text.rfind(" ", low, at), text.rfind("\t", low, at), low - 1) + 1 : at].lower()
    if token in _PREFIXES:
        return False
    if token in ("a.m", "p.m"):
        following = _BLANKS.match(text, at + 1).end()
        return not (text[following : following + 1].islower() or text[following : following + 1] in (",", ":"))
    return True


def split_sentences(text: str) -> list[str]:
    """At . ! and ?, closing marks included; dots of abbreviations, decimals and initials do not count. Linear in the text."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m[0][0] != "." or _closes(text, m.start()):
            out.append(text[start : m.end()].strip())
            start = m.end()
    out.append(text[start:].strip())
    return [s for s in out if s]


@arrow("array<string>")
def sentences_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in in_parts(texts):
        yield part.map(lambda t: None if t is None else split_sentences(t))


def sentences(frame: DataFrame, text_col: str = "paragraph") -> DataFrame:
    """One row for each sentence, ``sent`` its place; other columns stay."""
    rest = [c for c in frame.columns if c != text_col]
    return frame.select(*rest, F.posexplode(sentences_of(F.col(text_col))).alias("sent", "sentence"))


# --- emphasis -------------------------------------------------------------------------------------------------------

MARK, LEAST_WORDS, LEAST_HEAD, SPACING, EDGE = "…", 8, 5, 5, 2


def emphasis_places(ws: list[str]) -> list[int]:
    """Word places after which an emphasis mark goes: a function word before a long content word, away from the edges and
    from the last mark."""
    out, last = [], -SPACING
    if len(ws) < LEAST_WORDS:
        return out
    for i in range(EDGE, len(ws) - 1 - EDGE):
        if i - last >= SPACING and _emphatic[ws[i]] == 1 and _emphatic[ws[i + 1]] == 2:
            out.append(i)
            last = i
    return out


def _emphasis_kind(w: str) -> int:
    """1 for a bare function word, 2 for a bare long content word without digits, else 0."""
    if w[0] in STRIPPED or w[-1] in STRIPPED:
        return 0
    if w.lower() in FUNCTION_WORDS:
        return 1
    return 2 if len(w) >= LEAST_HEAD and not re.search("[0-9]", w) else 0


_emphatic = Memo(_emphasis_kind)


def inject_emphasis(sentence: str) -> str:
    ws = sentence.split()
    if len(ws) < LEAST_WORDS:
        return sentence
    marked = set(emphasis_places(ws))
    return " ".join(f"{w} {MARK}" if i in marked else w for i, w in enumerate(ws))


def emphasis_beats(sentence_words: Column) -> Column:
    """emphasis_places() as a fold over an array of words, inside the plan. Each word is looked at once; where a place fits,
    neither word has punctuation at its ends, so that what is stripped for context is the word itself."""
    n = F.size(sentence_words)
    edge = f"^{char_class(STRIPPED)}|{char_class(STRIPPED)}$"
    functions = sorted(FUNCTION_WORDS)

    def seen(w: Column) -> Column:
        plain, function = ~w.rlike(edge), F.lower(w).isin(functions)
        head = plain & ~function & (F.char_length(w) >= LEAST_HEAD) & ~w.rlike("[0-9]")
        return F.struct((plain & function).alias("opens"), head.alias("head"))

    # One fold over neighbours; the array of what was seen is bound once, since each mention of it would make it anew.
    looked = F.array(F.transform(sentence_words, seen))
    pairs = F.transform(looked, lambda l: F.zip_with(l, F.slice(l, 2, F.greatest(F.size(l) - 1, F.lit(0))), lambda a, b: a["opens"] & F.coalesce(b["head"], F.lit(False))))
    start = F.struct(F.lit(0).alias("i"), F.lit(-SPACING).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, fits: Column) -> Column:
        i = acc["i"]
        take = fits & (i >= EDGE) & (i < n - 1 - EDGE) & (i - acc["last"] >= SPACING)
        return F.struct(
            (i + 1).alias("i"), F.when(take, i).otherwise(acc["last"]).alias("last"), F.when(take, F.concat(acc["out"], F.array(i))).otherwise(acc["out"]).alias("out")
        )

    found = F.aggregate(F.element_at(pairs, 1), start, step, lambda acc: acc["out"])
    return F.when(n >= LEAST_WORDS, found).otherwise(F.array().cast("array<int>"))


# --- narration ------------------------------------------------------------------------------------------------------

PAST = frozenset(
    "began bought broke brought built came caught chose cut drew dug fell felt flew fought found gave got grew heard held hit hung "
    "kept knew lay led left lit made met paid put ran rang rose said sang sat saw sent set shook shut slept sought spent spoke stole "
    "stood struck swam swept taught thought threw told took tore went wept woke wore wrote".split()
)
NOT_PAST = frozenset(
    "bed bleed bored breed creed exceed feed greed hatred heed hundred indeed kindred led naked need proceed ragged red reed "
    "sacred scared seed shed sled speed succeed tired weed wicked wired".split()
)
INFINITIVE = frozenset(
    "and can could did didn't do does don't i'll let may might must not please shall should then to we'll will would you'll".split()
)
PERFECT = frozenset("had hadn't has hasn't have haven't having".split())
_EDGES = ".,;:!?'’"


def starts_with_read(sentence: str) -> bool:
    return bool(ws := sentence.split()) and ws[0].strip(_EDGES).lower() == "read"


def narrates_past(sentence: str) -> bool:
    """No quotation, colon or perfect, and a past form."""
    if any(c in sentence for c in "\"“”:"):
        return False
    kinds = [_telling[w] for w in sentence.split()]
    if any(k & 1 for k in kinds):
        return False
    return any(k & 2 or k & 4 and i and not kinds[i - 1] & 8 for i, k in enumerate(kinds))


def _telling_kind(w: str) -> int:
    """What a word says of its sentence's time, as a sum: 1 a perfect, 2 a past form, 4 read, 8 what an infinitive follows."""
    edge, core = w.strip(_EDGES).lower(), re.sub("^[^A-Za-z'’]+|[^A-Za-z'’]+$", "", w).lower()
    past = core != "read" and (core in PAST or len(core.encode()) >= 4 and core.endswith("ed") and core not in NOT_PAST)
    return (edge in PERFECT) + 2 * past + 4 * (core == "read") + 8 * (edge in INFINITIVE)


_telling = Memo(_telling_kind)


def hints(paragraph: list[str]) -> list[bool]:
    """For each sentence, whether what precedes it narrates the past; sentences that start with read pass it on."""
    out = [False] * len(paragraph)
    for i in range(1, len(paragraph)):
        out[i] = narrates_past(paragraph[i - 1]) or out[i - 1] and starts_with_read(paragraph[i - 1])
    return out


# --- tokens ---------------------------------------------------------------------------------------------------------


_IDS = np.zeros(max(map(ord, VOCABULARY)) + 2, np.int64)
_IDS[[ord(c) for c in VOCABULARY]] = list(VOCABULARY.values())


@arrow("array<long>")
def token_ids(phonemes: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ids of the characters that the vocabulary has; the others vanish, see lossy_runes(). One look-up for all characters of
    a text; functions over arrays would go through them one at a time."""
    for batch in phonemes:
        out = []
        for said in batch:
            out.append(None if said is None else ids_of(said))
        yield pd.Series(out, index=batch.index)


def lossy_runes(phonemes: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(phonemes, "".join(sorted(VOCABULARY)), ""), ""), lambda c: c != ""))


def split_point(tokens: list[int], start: int, end: int) -> int:
    """Looking back over the last 30 %: behind a sentence end, else a clause end, else a space, else at the end."""
    best = {}
    for i in range(end - 1, start + (end - start) * 7 // 10 - 1, -1):
        if tokens[i] in (4, 5, 6):
            return i + 1
        kind = "clause" if tokens[i] in (1, 2, 3) else "space" if tokens[i] == SPACE else ""
        if kind:
            best.setdefault(kind, i + 1)
    return best.get("clause") or best.get("space") or end


def segments(tokens: list[int], most: int = MAX_TOKENS) -> list[list[int]]:
    out, start = [], 0
    while len(tokens) - start > most:
        end = split_point(tokens, start, start + most)
        out.append(tokens[start:end])
        start = end
    if start < len(tokens) or not out:
        out.append(tokens[start:])
    return out


@arrow("array<array<long>>")
def segments_of(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in tokens:
        yield batch.map(lambda t: None if t is None else segments(list(map(int, t))))


def group_sizes(lengths: Column, most: int = MAX_TOKENS) -> Column:
    """Greedy packing of sentence lengths in order, a space between two: array<struct<first, n, tokens>>."""
    kind = "array<struct<first:int,n:int,tokens:long>>"
    start = F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("tokens"))
    group = lambda acc: F.array(F.struct(acc["first"].alias("first"), acc["n"].alias("n"), acc["tokens"].alias("tokens")))

    def step(acc: Column, size: Column) -> Column:
        fresh = F.struct(acc["done"].alias("done"), acc["first"].alias("first"), F.lit(1).alias("n"), size.cast("long").alias("tokens"))
        longer = F.struct(acc["done"].alias("done"), acc["first"].alias("first"), (acc["n"] + 1).alias("n"), (acc["tokens"] + 1 + size).alias("tokens"))
        closed = F.struct(F.concat(acc["done"], group(acc)).alias("done"), (acc["first"] + acc["n"]).alias("first"), F.lit(1).alias("n"), size.cast("long").alias("tokens"))
        return F.when(size == 0, acc).when(acc["n"] == 0, fresh).when(acc["tokens"] + 1 + size <= most, longer).otherwise(closed)

    return F.aggregate(lengths, start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], group(acc))).otherwise(acc["done"]))


def packed(ids: list[np.ndarray], most: int = MAX_TOKENS) -> list[tuple[int, np.ndarray]]:
    """group_sizes() of sentences that have tokens: (sentences, tokens with a space between two) of each group."""
    out, held, size = [], [], 0
    for x in ids:
        if held and size + 1 + len(x) > most:
            out.append(held)
            held, size = [], 0
        size += len(x) + (1 if held else 0)
        held.append(x)
    space = np.array([SPACE], np.int64)
    return [(len(g), np.concatenate([y for x in g for y in (space, x)][1:])) for g in [*out, *([held] if held else [])]]


def ids_of(said: str) -> np.ndarray:
    points = np.frombuffer(said.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = _IDS[np.minimum(points, len(_IDS) - 1)]
    return ids[ids > 0]


def pause_places(tokens: np.ndarray) -> list[int]:
    """clause_pauses() of an array: only signs of clauses are looked at one by one."""
    spaces, out, last = np.cumsum(tokens == SPACE), [], 0
    for i in np.flatnonzero((tokens == 3) | (tokens == 1) | (tokens == 9)).tolist():
        if spaces[i] - last >= 3:
            out.append(i)
            last = spaces[i]
    return out


def silence_after(tokens: np.ndarray, rate: int = 24_000) -> int:
    """sentence_silence() of an array of tokens by its terminal()."""
    last = next((t for t in tokens[:-6:-1].tolist() if t not in (11, 13, 15)), 0)
    base = {5: 0.32, 6: 0.30, 10: 0.35}.get(last, 0.25)
    seconds = base + 0.03 if len(tokens) <= 50 else base - 0.03 if len(tokens) >= 200 else base
    return int(min(max(seconds, 0.20), 0.35) * rate)


def clause_pauses(tokens: Column) -> Column:
    """Places of commas, semicolons and dashes with at least three spaces since the last accepted one."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("spaces"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        take = t.isin(3, 1, 9) & (acc["spaces"] >= 3)
        spaces = F.when(t == SPACE, acc["spaces"] + 1).when(take, 0).otherwise(acc["spaces"])
        return F.struct((acc["i"] + 1).alias("i"), spaces.alias("spaces"), F.when(take, F.concat(acc["out"], F.array(acc["i"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def terminal(tokens: Column) -> Column:
    """The last of the last five tokens but closing marks, if it is . ! ? or an ellipsis, else 0."""
    tail = F.filter(F.slice(tokens, F.greatest(F.size(tokens) - 4, F.lit(1)), 5), lambda t: ~t.isin(11, 13, 15))
    last = F.try_element_at(tail, F.lit(-1))
    return F.when(last.isin(4, 5, 6, 10), last).otherwise(0)


def sentence_silence(last: Column, n_tokens: Column, rate: int = 24_000) -> Column:
    """Samples of silence after a sentence, by its terminal and length."""
    d = lambda x: F.lit(float(x))
    base = F.when(last == 5, d(0.32)).when(last == 6, d(0.30)).when(last == 10, d(0.35)).otherwise(d(0.25))
    seconds = F.when(n_tokens <= 50, base + d(0.03)).when(n_tokens >= 200, base - d(0.03)).otherwise(base)
    return (F.least(F.greatest(seconds, d(0.20)), d(0.35)) * rate).cast("int")


def paragraph_silence(n_groups: Column, rate: int = 24_000) -> Column:
    return (F.when(n_groups <= 2, F.lit(0.85)).when(n_groups == 3, F.lit(0.80)).otherwise(F.lit(0.70)) * rate).cast("int")
