"""Personal data: base patterns, and a skip-chain conditional random field over each document's candidate tokens."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosodia.llm.shared import lean

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_LEFT = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGNS = re.compile(r"[\W_]+")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")
#: Outlines are counted by a hash in so many slots, which bounds the model and drops none of them.
SLOTS = 1 << 16
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _octet(part: str) -> bool:
    """At most 255; leading zeros may be many."""
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def _emails(text: str) -> Iterator[Span]:
    """As the pattern's leftmost matches, found from the signs outward: a run that no domain follows is read once."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, 0, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind. Linear in the text but for what one failing match covers."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int, str]]:
    """Candidates: blank-free runs with a digit or an at sign, without the punctuation around them. All other words are
    outside for certain and are no nodes of the field."""
    out = []
    if "@" not in text and not _DIGIT.search(text):
        return out
    for m in _TOKEN.finditer(text):
        body = m[0].rstrip(".,;:!?)]}\"'")
        lead = len(body) - len(body.lstrip("([{\"'"))
        if len(body) > lead:
            out.append((m.start() + lead, m.start() + len(body), body[lead:]))
    return out


def shape(token: str) -> str:
    """The token's outline: letters a, digits by how many, other characters themselves."""
    return _DIGITS.sub(lambda m: f"<{len(m[0])}>", _LETTERS.sub("a", token))


def slot(token: str) -> int:
    """Where the field keeps what it knows of the token's outline; outlines of any length and number fit."""
    return zlib.crc32(shape(token).encode()) % SLOTS


def labels(found: list[tuple[int, int, str]], spans: list[Span]) -> np.ndarray:
    """0 for outside, else 1 + the kind of the first base span that a token overlaps."""
    out, k = np.zeros(len(found), np.int64), 0
    by_start = sorted(spans)
    for i, (start, end, _) in enumerate(found):
        while k < len(by_start) and by_start[k][2] <= start:
            k += 1
        for s, kind, e in by_start[k:]:
            if s >= end:
                break
            if e > start:
                out[i] = 1 + kind
                break
    return out


def edges(found: list[tuple[int, int, str]], near: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbours at most ``near`` characters apart, and skip edges from each token to the next one
    that repeats or resembles it: the same letters and digits in either case, or the same first six characters. One edge
    to the next, so that a token that is repeated n times has n - 1 edges and not n squared."""
    chain = [(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= near]
    skip, last = set(), {}
    for i, (_, _, token) in enumerate(found):
        low = token.lower()
        for key in (("=", _SIGNS.sub("", low)), ("^", low[:6])):
            if len(key[1]) >= 6:
                if key in last:
                    skip.add((last[key], i))
                last[key] = i
    return np.array(chain, np.int64).reshape(-1, 2), np.array(sorted(skip), np.int64).reshape(-1, 2)


class Field:
    """Log potentials: of outlines by slot, of neighbours and of distant repeated or similar tokens."""

    def __init__(self, slots: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.slots, self.chain, self.skip = slots.astype(np.float32), chain, skip

    def marginals(self, found: list[tuple[int, int, str]], known: np.ndarray, rounds: int = 6, damping: float = 0.3, part: int = 1 << 15) -> np.ndarray:
        """Beliefs after loopy sum-product message passing; tokens that base spans cover are clamped to their kind.

        Messages are renewed ``part`` edges at a time from the beliefs of the round before, so what a very long document
        needs beyond its messages, ten numbers an edge, does not grow with it.
        """
        node = self.slots[np.fromiter((slot(t) for _, _, t in found), np.int64, len(found))].astype(np.float64)
        clamped = np.nonzero(known)[0]
        node[clamped] = -20.0
        node[clamped, known[clamped]] = 0.0
        kinds = [(pairs, table) for pairs, table in zip(edges(found), (self.chain, self.skip), strict=True) if len(pairs)]
        if not kinds:
            return _normal(node)
        size = node.shape[1]
        messages = [np.zeros((2, len(pairs), size), np.float32) for pairs, _ in kinds]  # to the later token, to the earlier one

        def beliefs() -> np.ndarray:
            belief = node.copy()
            for (pairs, _), sent in zip(kinds, messages, strict=True):
                for k in range(size):
                    belief[:, k] += np.bincount(pairs[:, 1], sent[0, :, k], len(node)) + np.bincount(pairs[:, 0], sent[1, :, k], len(node))
            return belief

        for _ in range(rounds):
            belief = beliefs()
            for (pairs, table), sent in zip(kinds, messages, strict=True):
                for at in range(0, len(pairs), part):
                    some = slice(at, at + part)
                    before = sent[:, some].copy()
                    for way, source, potentials in ((0, pairs[some, 0], table), (1, pairs[some, 1], table.T)):
                        inward = belief[source] - before[1 - way]
                        new = np.logaddexp.reduce(inward[:, :, None] + potentials[None], axis=1)
                        new -= new.max(axis=1, keepdims=True)
                        sent[way, some] = damping * before[way] + (1 - damping) * new
        return _normal(beliefs())


def _normal(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Piecewise training from the base spans as labels, on about ``max_rows`` documents chosen by a hash of the id.

    With indicator features each piece has its maximum-likelihood potentials in closed form, smoothed: an outline's are the
    log chances of the labels, a pair's the log of how much more often two labels stand together than apart. Executors
    count; the driver gets SLOTS rows at most and two 5 x 5 tables, whatever the documents hold. An outline that was never
    seen has the chances of the labels over all tokens. No documents or no tokens: nothing is ever added.
    """
    n = docs.select(id_col).count()
    share = min(1_000_000, max(1, round(1_000_000 * max_rows / max(n, 1))))
    rows = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("pii")), F.lit(1_000_000)) < share).select(F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = tokens(text or "")
                if not found:
                    continue
                known = labels(found, base_spans(text))
                counts.update(("node", slot(t), int(k), 0) for (_, _, t), k in zip(found, known, strict=True))
                for name, pairs in zip(("chain", "skip"), edges(found), strict=True):
                    counts.update((name, 0, int(known[a]), int(known[b])) for a, b in pairs)
            columns = list(zip(*((*key, v) for key, v in counts.items()), strict=True)) or [[], [], [], [], []]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["piece", "slot", "a", "b", "n"])

    counted = rows.mapInArrow(lean(run), "piece string, slot int, a int, b int, n long").groupBy("piece", "slot", "a", "b").agg(F.sum("n").alias("n"))
    size = len(KINDS) + 1
    seen, tables = np.zeros((SLOTS, size)), {"chain": np.zeros((size, size)), "skip": np.zeros((size, size))}
    for r in counted.collect():
        if r["piece"] == "node":
            seen[r["slot"], r["a"]] += r["n"]
        else:
            tables[r["piece"]][r["a"], r["b"]] += r["n"]
    prior = seen.sum(axis=0) + np.array([100.0, *[0.5] * len(KINDS)])
    prior /= prior.sum()
    edge = {}
    for name, table in tables.items():
        both = (table + table.T) / 2 + np.outer(prior, prior)
        chance = both / both.sum()
        side = chance.sum(axis=1)
        edge[name] = np.clip(np.log(chance / np.outer(side, side)), -3.0, 3.0)
    # An outline that is rare says little by itself: its counts are joined by five of the prior's.
    logs = np.log((seen + 5 * prior) / (seen.sum(axis=1, keepdims=True) + 5))
    return Field(logs, edge["chain"], edge["skip"])


def all_spans(text: str, base: list[Span], field: Field, threshold: float = 0.9) -> list[Span]:
    """The base spans and the tokens that the field is sure of, as far as no base span overlaps them."""
    found = tokens(text)
    if not found:
        return base
    known = labels(found, base)
    if known.all():
        return base
    chances = field.marginals(found, known)
    more = []
    for i in np.nonzero((known == 0) & (chances[:, 1:].max(axis=1) >= threshold))[0]:
        more.append((found[i][0], int(chances[i, 1:].argmax()), found[i][1]))
    return sorted(base + more)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, field: Field | None = None, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): one row per input row.

    Counts and base_sha256 are of the base spans; ``spans`` has those and what the field adds, by start, then kind, in
    code points with exclusive ends. Without a ``field`` one is trained on the documents themselves. Null counts as
    empty. Repeated rows come out as often as they came in; spans that start together are in the order of KINDS. Very long
    texts are read whole. An empty table gives no rows; further columns of ``docs`` are ignored.
    """
    field = fit(docs, id_col=id_col, text_col=text_col) if field is None else field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = all_spans(text or "", base, field, threshold)
                counts = Counter(k for _, k, _ in base)
                rows.append((*(counts[k] for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    types = [docs.schema[id_col].dataType, *[T.LongType()] * 4, T.StringType(), T.StringType(), T.LongType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(run), schema)
