"""Language identification by hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosodia.llm.shared import lean, process_store

UNKNOWN, KEPT_GRAMS = "und", 40_000


class Space:
    """Random letter vectors of +1 and -1, and the n-gram vectors bound from them.

    A letter's vector is drawn from its code point, so all workers agree without exchanging any. A trigram's vector is
    the product of its letters' vectors, each rotated by its place; runs of other characters count as one blank.
    """

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((4096, dimensions), np.float32)
        self.alphabetic = np.array([not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x10000)])

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            draw = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, dtype=np.int8)
            self.letters[code] = draw * np.int8(2) - np.int8(1)
        return self.letters[code]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams of the whole text and their counts; None if it has no letter."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = codes < 0x10000
        is_letter = np.zeros(len(codes), bool)
        is_letter[low] = self.alphabetic[codes[low]]
        for i in np.nonzero(~low)[0]:
            is_letter[i] = chr(codes[i]).isalpha()
        if not is_letter.any():
            return None
        padded = np.zeros(len(codes) + 2, np.int64)
        padded[1:-1] = np.where(is_letter, codes, 0)
        kept = padded[np.concatenate(([True], (padded[1:] != 0) | (padded[:-1] != 0)))]
        if len(kept) < 3:
            return None
        return np.unique((kept[:-2] << 42) | (kept[1:-1] << 21) | kept[2:], return_counts=True)

    def at(self, grams: list[int]) -> np.ndarray:
        """Where the trigrams' vectors are in ``table``."""
        if len(self.rows) > KEPT_GRAMS:
            self.rows.clear()
        new = [g for g in grams if g not in self.rows]
        need = len(self.rows) + len(new)
        if need > len(self.table):
            grown = np.empty((max(need, 2 * len(self.table)), self.dimensions), np.float32)
            grown[: len(self.rows)] = self.table[: len(self.rows)]
            self.table = grown
        for gram in new:
            a, b, c = self.letter(gram >> 42), self.letter(gram >> 21 & 0x1FFFFF), self.letter(gram & 0x1FFFFF)
            self.table[len(self.rows)] = np.roll(a, 2) * np.roll(b, 1) * c
            self.rows[gram] = len(self.rows)
        return np.fromiter((self.rows[g] for g in grams), np.int64, len(grams))

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the vectors of a text's trigrams."""
        found = self.grams(text) if text else None
        if found is None:
            return None
        grams, counts = found
        at, counts = self.at(grams.tolist()), counts.astype(np.float32)
        out = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(at), 2048):
            out += counts[i : i + 2048] @ self.table[at[i : i + 2048]]
        return out


def space(dimensions: int, seed: int) -> Space:
    return process_store(("space", dimensions, seed), lambda: Space(dimensions, seed))


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the documents, by their id's CRC-32; a null id is not held out, and not learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame, max_rows: int = 20_000, dimensions: int = 512, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[str], np.ndarray]:
    """Prototypes: the normalised bundles of all training documents of each language.

    Learns from text and non-null lang of documents that are not held out; where these are more than ``max_rows``, from
    about so many, chosen by a hash of the id. Each partition bundles its documents and sends one vector for each
    language, so the driver gets languages x dimensions numbers. A table with nothing to learn from gives none.
    """
    rows = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    n = rows.count()
    share = min(1_000_000, max(1, round(1_000_000 * max_rows / max(n, 1))))
    rows = rows.where(F.pmod(F.xxhash64(id_col, F.lit("train")), F.lit(1_000_000)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sums = space(dimensions, seed), {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = here.bundle(text)
                if one is not None:
                    sums[lang] = sums.get(lang, 0) + one / np.linalg.norm(one)
        if sums:
            lists = pa.array([v.astype(np.float64).tolist() for v in sums.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), lists], ["lang", "sums"])

    partial = rows.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(lean(run), "lang string, sums array<double>")
    summed = partial.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s")).collect()
    langs = sorted({r["lang"] for r in summed})
    out = np.zeros((len(langs), dimensions), np.float32)
    for r in summed:
        out[langs.index(r["lang"]), r["pos"]] = r["s"]
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _judged(texts: list[str | None], langs: list[str], prototypes: np.ndarray, seed: int) -> tuple[list[str], list[float]]:
    here, names, scores = space(prototypes.shape[1], seed), [], []
    for text in texts:
        one = here.bundle(text) if langs else None
        if one is None:
            names.append(UNKNOWN)
            scores.append(0.0)
            continue
        near = prototypes @ one / max(float(np.linalg.norm(one)), 1e-9)
        best = int(np.argmax(near))
        names.append(langs[best])
        scores.append(min(1.0, max(0.0, float(near[best]))))
    return names, scores


def predict(
    docs: DataFrame, langs: list[str], prototypes: np.ndarray, seed: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per input row.

    score is the cosine of the whole text's bundle with the nearest prototype, 0 at least. Null texts, texts without a
    letter and all texts where nothing was learnt are ``und`` with score 0; equal cosines take the first language in
    order. Repeated rows come out as often as they came in, null ids too; very long texts are read whole. An empty table
    gives no rows. Further columns of ``docs`` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = _judged(batch.column(2).to_pylist(), langs, prototypes, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return docs.select(F.col(id_col), held_out(id_col), F.col(text_col).cast("string")).mapInArrow(lean(run), schema)


def recognised(docs: DataFrame, langs: list[str], prototypes: np.ndarray, least: float = 0.1, seed: int = 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has letters and is at least ``least`` like some learnt language. Rows
    are filtered where they are read; nothing is shuffled. Where nothing was learnt, texts with a letter stay."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            if langs:
                names, scores = _judged(texts, langs, prototypes, seed)
                keep = [n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)]
            else:
                keep = [any(map(str.isalpha, t or "")) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
