"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prosodia.llm import fuse
from prosodia.llm.shared import lean, materialise

#: Items that one task holds with their index, and items whose shingles one screening pass holds.
SHINGLE, SIMILARITY, CHUNK, SCREENED = 5, 0.8, 5_000, 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
words_of = re.compile(r"[^\W_]+").findall


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits: what is left when layout and punctuation change."""
    return words_of((text or "").lower())


def _hash(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` word ids."""
    n = len(ids) - width + 1
    with np.errstate(over="ignore"):
        h = np.zeros(max(n, 0), np.uint64)
        for i in range(width):
            h = (h ^ ids[i : i + n]) * _MIX
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return h


def _signs(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _pack(margins: np.ndarray) -> np.ndarray:
    return np.packbits(margins > 0, axis=1, bitorder="little")


class Index:
    """Benchmark items by length in words, with a multi-index over the eight blocks of their fingerprints.

    A window at least ``similarity`` like an item of m shingles has as many shingles, so at least (2 s / (1 + s)) m in
    common, and the sums behind the two fingerprints differ by at most 2 (1 - s) / (1 + s) m in each bit. A bit whose sum
    in the item is larger than that is the same in every such window; the others are free. How many are free is the
    item's radius. Each block has a table from its 256 values to the set of items that agree with it in the bits that are
    not free, so the intersection of eight look-ups has every item within reach: nothing similar enough is lost.
    """

    def __init__(self, items: list[tuple[int, str | None]], shingle: int = SHINGLE, similarity: float = SIMILARITY):
        self.shingle, self.similarity = shingle, similarity
        split = [(item, tokens(text)) for item, text in items]
        split = [(item, w) for item, w in split if w]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, ws in split:
            by_length.setdefault(len(ws), []).append((item, self.shingles(self.codes(ws), len(ws))))
        self.groups = {n: self._group(found) for n, found in by_length.items()}
        widths = sorted({min(n, shingle) for n in by_length})
        self.widths = widths
        self.known = {
            w: np.unique(np.concatenate([h for n, found in by_length.items() if min(n, shingle) == w for _, h in found])) for w in widths
        }

    def codes(self, ws: list[str]) -> np.ndarray:
        """The ids of words; a word of no item is zero."""
        get = self.ids.get
        return np.fromiter((get(w, 0) for w in ws), np.uint64, len(ws))

    def shingles(self, codes: np.ndarray, n_words: int) -> np.ndarray:
        return _hash(codes, min(n_words, self.shingle))

    def _group(self, found: list[tuple[int, np.ndarray]]) -> dict:
        m = len(found[0][1])
        slack = 2 * (1 - self.similarity) / (1 + self.similarity) * m + 1e-9
        margins = np.stack([_signs(h).sum(axis=0) for _, h in found])
        fixed = np.packbits(np.abs(margins) > slack, axis=1, bitorder="little")
        prints = _pack(margins)
        table = np.zeros((8, 256, (len(found) + 7) // 8), np.uint8)
        values = np.arange(256, dtype=np.uint8)
        for block in range(8):
            agrees = (values[:, None] ^ prints[None, :, block]) & fixed[None, :, block] == 0
            table[block] = np.packbits(agrees, axis=1, bitorder="little")
        counts = [Counter(h.tolist()) for _, h in found]
        return {"items": [i for i, _ in found], "m": m, "table": table, "counts": counts, "radius": 64 - int(np.unpackbits(fixed, axis=1).sum(axis=1).min())}

    def matches(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """For each index of an item that the text contains: the best similarity, where it starts and how many words."""
        ws = tokens(text)
        if not ws:
            return {}
        codes = self.codes(ws)
        out: dict = {}
        for width in self.widths:
            if len(codes) < width:
                continue
            hashes = _hash(codes, width)
            known = self.known[width]
            at = np.searchsorted(known, hashes)
            hit = known[np.minimum(at, len(known) - 1)] == hashes
            if not hit.any():
                continue  # no window shares a shingle with any item
            for n, group in self.groups.items():
                if min(n, self.shingle) != width:
                    continue
                if n <= len(codes):
                    self._windows(hashes, hit, n, width, group, out)
                else:
                    self._whole(hashes, hit, len(codes), group, out)
        return out

    def _whole(self, hashes: np.ndarray, hit: np.ndarray, n_words: int, group: dict, out: dict) -> None:
        """A text with fewer words than the items, as one window: exact for each item that shares a shingle."""
        m, here = group["m"], len(hashes)
        if here < self.similarity * m - 1e-9 or hit.sum() < self.similarity * (m + here) / (1 + self.similarity) - 1e-9:
            return
        if "holders" not in group:
            group["holders"] = {}
            for k, counts in enumerate(group["counts"]):
                for h in counts:
                    group["holders"].setdefault(h, []).append(k)
        window = Counter(hashes.tolist())
        for k in sorted({k for h in window for k in group["holders"].get(h, ())}):
            common = sum((window & group["counts"][k]).values())
            score = common / (m + here - common)
            if score >= self.similarity:
                out[group["items"][k]] = (score, 0, n_words)

    def _windows(self, hashes: np.ndarray, hit: np.ndarray, n: int, width: int, group: dict, out: dict) -> None:
        m = group["m"]
        need = self.similarity * 2 / (1 + self.similarity) * m - 1e-9
        seen = np.concatenate(([0], np.cumsum(hit)))
        starts = np.nonzero(seen[m:] - seen[:-m] >= need)[0]  # fewer shingles of items than any similar window has
        for at in range(0, len(starts), 4096):
            part = starts[at : at + 4096]
            for lo in range(0, len(part), 512):
                some = part[lo : lo + 512]
                low, high = int(some[0]), int(some[-1]) + m
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_signs(hashes[low:high]), axis=0, dtype=np.int32)))
                prints = _pack(sums[some - low + m] - sums[some - low])
                reach = group["table"][0][prints[:, 0]]
                for block in range(1, 8):
                    reach = reach & group["table"][block][prints[:, block]]
                for row in np.nonzero(reach.any(axis=1))[0]:
                    start = int(some[row])
                    window = Counter(hashes[start : start + m].tolist())
                    for k in np.nonzero(np.unpackbits(reach[row], bitorder="little"))[0]:
                        common = sum((window & group["counts"][k]).values())
                        score = common / (2 * m - common)
                        item = group["items"][k]
                        if score >= self.similarity and score > out.get(item, (0.0,))[0]:
                            out[item] = (score, start, n)


class Screen:
    """A binary-fuse filter of all shingles of some items: what no shingle of a text passes holds none of the items."""

    def __init__(self, texts: list[str | None], shingle: int):
        split = [ws for ws in map(tokens, texts) if ws]
        self.widths = sorted({min(len(ws), shingle) for ws in split})
        found = [np.zeros(0, np.uint64), *(_hash(self.codes(ws), min(len(ws), shingle)) for ws in split)]
        self.held = fuse.build(np.unique(np.concatenate(found)))

    @staticmethod
    def codes(ws: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))

    def passes(self, text: str | None) -> bool:
        codes = self.codes(tokens(text))
        return any(len(codes) >= w and bool(fuse.contains(self.held, _hash(codes, w)).any()) for w in self.widths)


def _chunks(benchmark: DataFrame, chunk: int, item_col: str, item_text_col: str) -> Iterator[list[tuple]]:
    """The items in order, ``chunk`` at a time; one empty list for an empty benchmark."""
    held: list[tuple] = []
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    for row in rows.orderBy("item", "text").toLocalIterator():
        if len(held) == chunk:
            yield held
            held = []
        held.append((row["item"], row["text"]))
    yield held


def _screened(docs: DataFrame, benchmark: DataFrame, shingle: int, screened: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """The rows of ``docs`` that have a shingle of some item in common, and a few more."""
    column, kept = docs.columns.index(text_col), None
    for part in _chunks(benchmark, screened, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(Screen([t for _, t in part], shingle))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(list(map(sent.value.passes, batch.column(column).to_pylist())), pa.bool_()))

        some = materialise(docs.mapInArrow(lean(run), docs.schema))
        sent.unpersist()
        kept = some if kept is None else kept.unionByName(some)
    return kept


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    chunk: int = CHUNK,
    screened: int = SCREENED,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): one row for each document and item that it contains.

    An item is contained when some window of the document with as many words has a weighted Jaccard similarity of
    ``shingle``-word shingles (repeats count) of ``similarity`` or more; the row has the best window, the first of equal
    ones. A document with fewer words than the item is one window as a whole. Items with fewer words are one shingle.

    Null and wordless texts and items match nothing, and so does all with an empty table on either side; items with the
    same text each get their rows, repeated documents too. Very long texts are read whole; their windows are taken some
    hundred at a time. Further columns are ignored.

    Items are indexed in chunks of ``chunk``, so that what each task holds is bounded whatever the size of the benchmark.
    With more items than one chunk, documents are first screened by filters of the shingles of ``screened`` items each, so
    that all documents are read once for so many items, and only those with a shingle in common once for each chunk.
    """
    item_kind = benchmark.schema[item_col].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("item_id", item_kind),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("start_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
        ]
    )
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    several = benchmark.limit(chunk + 1).count() > chunk
    if several:
        # A document comes out of each screen that it passes, and is looked at once.
        slim = slim.withColumn("row", F.monotonically_increasing_id())
        slim = materialise(slim)
        slim = materialise(_screened(slim, benchmark, shingle, screened, "text", item_col, item_text_col).dropDuplicates(["row"]).drop("row"))
    arrow_item = to_arrow_type(item_kind)
    out = None
    for part in _chunks(benchmark, chunk, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names = [item for item, _ in sent.value]
            index = Index(list(enumerate(text for _, text in sent.value)), shingle, similarity)
            for batch in batches:
                columns: list[list] = [[], [], [], [], []]
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for k, found in sorted(index.matches(text).items()):
                        for column, value in zip(columns, (i, names[k], *found), strict=True):
                            column.append(value)
                ids = batch.column(0).take(pa.array(columns[0], pa.int64()))
                kinds = [pa.from_numpy_dtype("int64")] * 2
                rest = [pa.array(columns[2], pa.float64()), *(pa.array(c, k) for c, k in zip(columns[3:], kinds, strict=True))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], type=arrow_item), *rest], [f.name for f in schema.fields])

        found = slim.mapInArrow(lean(run), schema)
        if several:
            found = materialise(found)
            sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    chunk: int = CHUNK,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item in the sense of contaminated(). Nothing is shuffled; each
    chunk of items is one pass over the documents that are left."""
    column = docs.columns.index(text_col)
    several = benchmark.limit(chunk + 1).count() > chunk
    for part in _chunks(benchmark, chunk, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(list(enumerate(text for _, text in sent.value)), shingle, similarity)
            screen = Screen([t for _, t in sent.value], shingle) if several else None
            for batch in batches:
                texts = batch.column(column).to_pylist()
                yield batch.filter(pa.array([(screen is not None and not screen.passes(t)) or not index.matches(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(lean(run), docs.schema)
        if several:
            docs = materialise(docs)
            sent.unpersist()
    return docs
