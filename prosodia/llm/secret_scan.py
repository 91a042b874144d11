"""Secret scanning: base patterns, and character Markov models that tell random strings from ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.llm.shared import LOWER, UPPER

KINDS = ("assign", "access", "hex", "random")
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: The tails of the other two are at least as long as asked for, which drops the same matches: a shorter run has none.
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
#: What the models judge: whole runs of 20 characters or more of a token alphabet that hold a digit.
CANDIDATE = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_-"
_RANDOM_IN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})"""


def _found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of all matches, leftmost and non-overlapping: array of (start, kind, end), ends exclusive, in code points.

    A match starts behind all pieces and matches before it, and split() and regexp_extract_all() give both.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["match"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        kept = span if keep is None else F.when(keep(pair["match"]), span).otherwise(none)
        return F.struct(end.alias("at"), F.concat(acc["spans"], kept).alias("spans"))

    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("match"))
    found = F.aggregate(pairs, start, step, lambda acc: acc["spans"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, rf"[:=]\x20*[\"']?({VALUE})$", 1)) >= 8


def base_spans(text: Column) -> Column:
    return F.concat(_found(text, ASSIGN, 0, _long_value), _found(text, ACCESS, 1), _found(text, HEX, 2))


def _pairs(token: Column) -> Column:
    """Codes of the character pairs of a token, in one pass."""
    k = len(ALPHABET) + 1
    spots = F.transform(F.split(F.translate(token, UPPER, LOWER), ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.length(token) - 1
    return F.zip_with(F.slice(spots, F.lit(1), n), F.slice(spots, F.lit(2), n), lambda a, b: a * k + b)


def fit(docs: DataFrame, max_rows: int = 20_000, text_col: str = "text", id_col: str = "doc_id", max_chars: int = 200) -> list[float]:
    """Log-likelihood ratios of character pairs, random strings against ordinary identifiers.

    Labelled samples come from the documents themselves: values of assignments, access keys and hex strings are random,
    words of letters joined by nothing, ``_`` or ``-`` are ordinary; tokens of more than ``max_chars``, which are
    judged all the same, are neither. Learns from about ``max_rows`` documents chosen by a
    hash of the id; counts of character pairs, 41 x 41 for each class, are all that reaches the driver.
    """
    k = len(ALPHABET) + 1
    n = docs.select(id_col).count()
    share = min(1_000_000, max(1, round(1_000_000 * max_rows / max(n, 1))))
    rows = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("secrets")), F.lit(1_000_000)) < share)
    text = F.coalesce(F.col(text_col), F.lit(""))
    random = F.concat(
        F.regexp_extract_all(text, F.lit(_RANDOM_IN), F.lit(1)),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
    )
    plain = F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9])[A-Za-z]{3,}(?:[_-][A-Za-z]{2,})*(?![A-Za-z0-9])"), F.lit(0))
    both = rows.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), random.alias("tokens")), F.struct(F.lit(0).alias("random"), plain.alias("tokens")))).alias("c"))
    tokens = both.select("c.random", F.explode("c.tokens").alias("token")).where(F.length("token").between(2, max_chars))
    tokens = tokens.groupBy("random", "token").agg(F.count("*").alias("times"))
    pairs = tokens.select("random", "times", F.explode(_pairs(F.col("token"))).alias("pair"))
    counts = pairs.groupBy("random", "pair").agg(F.sum("times").alias("n")).collect()
    return ratios({(r["random"], r["pair"]): r["n"] for r in counts}, k)


def ratios(counts: dict[tuple[int, int], int], k: int) -> list[float]:
    """Each class's transition chances, smoothed by half a count with a flat prior; their log ratio by pair code.

    With no random sample at all, random strings are taken as uniform over letters and digits.
    """
    out = []
    flat = sum(n for (c, _), n in counts.items() if c == 1) == 0
    for a in range(k):
        sums = [sum(counts.get((c, a * k + b), 0) for b in range(k)) for c in (0, 1)]
        for b in range(k):
            p = [(counts.get((c, a * k + b), 0) + 0.5) / (sums[c] + 0.5 * k) for c in (0, 1)]
            out.append(math.log((1 / 37 if flat else p[1]) / p[0]))
    return out


def scan(docs: DataFrame, llr: list[float] | None = None, threshold: float = 1.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans an array of (start, kind, end) by start, then kind; kinds as in KINDS, one row per input row.

    Base spans come from the patterns and always stay. A candidate token becomes a ``random`` span when the mean
    log-likelihood ratio of its character pairs reaches ``threshold`` and no base span overlaps it.

    Null counts as empty. Spans that start together are in the order of KINDS. Repeated rows come out as often as they came
    in, null ids too. Very long texts and runs are read whole. An empty table gives no rows; further columns are ignored.
    """
    llr = fit(docs, id_col=id_col, text_col=text_col) if llr is None else llr
    table = F.array(*(F.lit(round(x, 4)) for x in llr))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def unlikely(token: Column) -> Column:
        codes = _pairs(token)
        total = F.aggregate(codes, F.lit(0.0), lambda s, c: s + F.element_at(table, c + 1))
        return total / F.size(codes) >= threshold

    rows = docs.select(F.col(id_col).alias("doc_id"), base_spans(text).alias("base"), _found(text, CANDIDATE, 3, unlikely).alias("more"))
    clear = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", clear)).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from what scan() gives; counts are of base spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
