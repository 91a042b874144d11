"""Repeated byte strings across documents, by merging Burrows-Wheeler transforms of shards.

Every string of ``length`` bytes has one minimizer, the least hash of the ``ANCHOR``-byte strings in it, so equal strings
lie in pieces around equal minimizers. Pieces (maximal runs of strings with one minimizer) are dealt by minimizer: what a
task never sees can hold no repeat of what it has. Pieces that repeat whole are settled by their hashes; where different
pieces share a minimizer, their bytes are fetched, and the transforms of shards of them are merged to find the repeated
intervals.

Two kinds of minimizers have too many pieces for that and are taken string by string, which is exact as well and spreads
over all tasks. Those of one document in a thousand or more are known beforehand from a look at some documents, which
decides where rows go and nothing else; those of more than ``CROWD`` different pieces are seen when pieces are settled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosodia.llm.shared import lean, materialise, utf8

LENGTH, ANCHOR, CHUNK, SHARD, CROWD, LOOKED_AT = 50, 24, 1 << 21, 1 << 16, 2_000, 20_000
_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xBF58476D1CE4E5B9)
_POS = _U((1 << 24) - 1)


def _anchor_hashes(buffer: np.ndarray, anchor: int) -> np.ndarray:
    """A hash of the ``anchor`` bytes at each place; places near the end see zeros."""
    n = len(buffer)
    padded = np.zeros(n + anchor + 8, np.uint8)
    padded[:n] = buffer
    words = np.ndarray((n + anchor + 1,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(0, anchor, 8):
            at = min(i, max(anchor - 8, 0))
            word = words[at : at + n]
            h = (h + (word & _U((1 << (8 * anchor)) - 1) if anchor < 8 else h + word)) * _C1
        h ^= h >> _U(29)
        h *= _C3
        return h ^ (h >> _U(32))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    out, span = keys, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def _string_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of substrings that depend on their bytes only."""
    draw = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    factor = 0xD6E8FEB86659FD93
    inverse = pow(factor, -1, 1 << 64)
    with np.errstate(over="ignore"):
        powers = np.full(len(buffer) + 1, factor, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(draw[buffer] * powers[:-1], out=sums[1:])
        back = np.full(len(buffer) + 1, inverse, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        h = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _C2
        h ^= h >> _U(31)
        h *= _C3
        return h ^ (h >> _U(32))


def pieces(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR, crowded: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text, start, end, minimizer, hash) of the pieces of some texts, starts and ends in bytes of their text. Pieces of
    ``crowded`` minimizers come as their strings, each for itself."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buffer) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    keys = (_anchor_hashes(buffer, anchor) & ~_POS) | np.arange(len(buffer), dtype=np.uint64) & _POS
    least = _sliding_least(keys[: len(buffer) - anchor + 1], length - anchor + 1)
    whole = owner[:n] == owner[length - 1 :]
    opens = whole.copy()
    opens[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    closes = whole.copy()
    closes[:-1] &= ~whole[1:] | (least[1:] != least[:-1])
    starts, ends = np.nonzero(opens)[0], np.nonzero(closes)[0] + length
    minimizers = least[starts] >> _U(24)
    if crowded is not None and len(crowded):
        many = np.where(np.isin(minimizers, crowded), ends - starts - length, 0)
        last = np.cumsum(many + 1)
        within = np.arange(last[-1] if len(last) else 0) - np.repeat(last - many - 1, many + 1)
        apart = np.repeat(many > 0, many + 1)
        starts, ends, minimizers = np.repeat(starts, many + 1) + within, np.repeat(ends, many + 1), np.repeat(minimizers, many + 1)
        ends = np.where(apart, starts + length, ends)
    text = owner[starts]
    hashes = _string_hashes(buffer, starts, ends)
    return text, starts - offsets[text], ends - offsets[text], minimizers, hashes


def _cut(rows: Iterator[tuple[int, int, bytes]], size: int, length: int) -> Iterator[tuple[int, int, bytes]]:
    """Texts longer than ``size`` in parts that overlap by ``length - 1`` bytes: each string is in exactly one part."""
    for doc_id, base, text in rows:
        for at in range(0, max(len(text) - length + 1, 1), size):
            yield doc_id, base + at, text[at : at + size + length - 1]


def _parts(rows: Iterator[tuple[int, int, bytes]], size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows in lists of ``size`` bytes or one row."""
    part, held = [], 0
    for row in rows:
        if part and held + len(row[2]) > size:
            yield part
            part, held = [], 0
        part.append(row)
        held += len(row[2])
    if part:
        yield part


# --- merging transforms ---------------------------------------------------------------------------------------------


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, suffixes) of some strings, each followed by an end sign that sorts before all bytes, ends in order.

    Symbols are bytes plus one, 0 is the end sign. Suffixes are places in the strings joined with their end signs. They
    are sorted by their first seven symbols, then by prefix doubling among those that are still alike.
    """
    flat = np.zeros(sum(map(len, strings)) + len(strings), np.int64)
    at = 0
    for s in strings:
        flat[at : at + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + 1
        at += len(s) + 1
    n, step = len(flat), 7
    padded = np.concatenate([flat, np.zeros(step, np.int64)])
    key, runs = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(step):
        symbol = padded[i : i + n] * runs
        key = key << 9 | symbol
        runs &= symbol > 0
    order = np.argsort(key, kind="stable")  # of suffixes that end alike the earlier string's comes first
    opens = np.ones(n, bool)
    opens[1:] = (key[order][1:] != key[order][:-1]) | ~runs[order][1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    while True:
        alike = ~opens
        alike[:-1] |= ~opens[1:]
        places = np.nonzero(alike)[0]
        if not len(places):
            break
        some = order[places]
        key = rank[some] * (n + 1) + rank[some + step]
        again = np.argsort(key, kind="stable")
        some, key = some[again], key[again]
        order[places] = some
        new = np.ones(len(places), bool)
        new[1:] = key[1:] != key[:-1]
        opens[places] = new
        rank[some] = np.maximum.accumulate(np.where(new, places, 0))
        step *= 2
    return flat[order - 1].astype(np.uint16), order


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, blocks): from which transform each merged suffix comes, and which suffixes share ``depth`` symbols.

    Interleave refinement: an interleave that is right for the first k symbols of the suffixes becomes right for k + 1
    when each suffix goes, in order, to the next free place of the symbol before it. Two neighbours share k + 1 symbols
    when they got the same symbol and their sources shared k, which gives the common prefixes along the way. Suffixes
    themselves are never sorted again: the stable sorts here are counting sorts of small numbers.
    """
    sizes = [len(t) for t in transforms]
    symbols = np.concatenate(transforms)
    used = np.unique(symbols)
    if len(used) <= 256:
        symbols = np.searchsorted(used, symbols).astype(np.uint8)
    small = np.uint8 if len(transforms) <= 256 else np.uint16 if len(transforms) <= 1 << 16 else np.uint32
    place = np.repeat(np.arange(len(transforms), dtype=small), sizes)
    ends = np.concatenate([np.full(int((t == 0).sum()), i, small) for i, t in enumerate(transforms)])
    blocks = np.zeros(len(symbols), np.int32)
    spread = np.empty_like(symbols)
    first = np.ones(len(symbols), bool)
    sorted_symbols = np.sort(symbols, kind="stable")
    first[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    first[: len(ends)] = True
    opens = np.empty_like(first)
    for _ in range(depth):
        spread[np.argsort(place, kind="stable")] = symbols
        order = np.argsort(spread, kind="stable")
        source = blocks[order]
        place = place[order]
        place[: len(ends)] = ends  # suffixes that start with an end sign keep the order of the ends
        opens[:] = first
        opens[1:] |= source[1:] != source[:-1]
        np.cumsum(opens, dtype=np.int32, out=blocks)
        blocks -= 1
    return place, blocks


def repeated_windows(strings: list[bytes], docs: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> list[np.ndarray]:
    """For each string, the places of its ``length``-byte substrings that also occur in a string of a smaller document."""
    groups, held, size = [], [], 0
    for i, s in enumerate(strings):
        held.append(i)
        size += len(s)
        if size >= shard:
            groups.append(held)
            held, size = [], 0
    if held:
        groups.append(held)
    made = [transform([strings[i] for i in g]) for g in groups]
    place, blocks = merge([bwt for bwt, _ in made], length)
    owner, at = [], []
    for g, (_, suffixes) in zip(groups, made, strict=True):
        sizes = np.array([len(strings[i]) + 1 for i in g])
        begin = np.cumsum(sizes) - sizes
        k = np.searchsorted(begin, suffixes, side="right") - 1
        owner.append(np.array(g)[k])
        at.append(suffixes - begin[k])
    order = np.argsort(place, kind="stable")
    which, where = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    which[order], where[order] = np.concatenate(owner), np.concatenate(at)
    sizes = np.array([len(s) for s in strings])
    inside = where + length <= sizes[which]
    doc = docs[which]
    least = np.full(blocks[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, blocks[inside], doc[inside])
    hit = inside & (least[blocks] < doc)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    which, where = which[hit], where[hit]
    order = np.lexsort((where, which))
    which, where = which[order], where[order]
    cuts = np.nonzero(np.diff(which))[0] + 1
    if len(which):
        for i, found in zip(which[np.concatenate(([0], cuts))].tolist(), np.split(where, cuts), strict=True):
            out[i] = found
    return out


# --- over Spark -----------------------------------------------------------------------------------------------------

_ROW = np.dtype([("m", "<u8"), ("h", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("size", "<i4")])
_SPANS = ["doc_id", "start", "end", "ask"]
_SPAN_SCHEMA = "doc_id long, start int, end int, ask long"


def _spans(doc, start, end, ask) -> pa.RecordBatch:
    arrays = [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(ask, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, _SPANS)


def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces with minimizer, hash and document: those of documents that are not the first with such a piece, and the
    others. Of the others in one document all stay."""
    rows = rows[np.lexsort((rows["doc"], rows["h"], rows["m"]))]
    opens = np.ones(len(rows), bool)
    opens[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["m"][1:] != rows["m"][:-1])
    first = rows["doc"][opens][np.cumsum(opens) - 1]
    return rows[rows["doc"] > first], rows[rows["doc"] == first]


def joined(rows: np.ndarray) -> np.ndarray:
    """Spans of one document that touch or overlap as one; minimizers and hashes no longer mean anything."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    step = np.int64(1) << 33  # documents far apart, so that one running maximum serves all
    other = np.cumsum(np.concatenate(([False], rows["doc"][1:] != rows["doc"][:-1])))
    start = other * step + rows["start"]
    reach = np.maximum.accumulate(start + rows["size"])
    opens = np.concatenate(([True], start[1:] > reach[:-1]))
    out = rows[opens]
    out["size"] = reach[np.append(np.nonzero(opens)[0][1:] - 1, len(rows) - 1)] - start[opens]
    return out


def _deal(length: int, anchor: int, buckets: int, chunk: int, crowded: np.ndarray):
    """Pieces by bucket of minimizers, packed, and the strings of crowded ones by their hash, in as many buckets again;
    whole repeats within a chunk are settled where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                rows = zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)
                yield from _cut(((d, 0, t) for d, t in rows if d is not None and t and len(t) >= length), chunk, length)

        for part in _parts(cut(), chunk):
            text, start, end, minimizer, h = pieces([t for _, _, t in part], length, anchor, crowded)
            rows = np.empty(len(text), _ROW)
            rows["m"], rows["h"] = minimizer, h
            rows["doc"] = np.array([d for d, _, _ in part], np.int64)[text]
            rows["start"] = np.array([b for _, b, _ in part], np.int64)[text] + start
            rows["size"] = end - start
            again, rows = settle(rows)
            again = joined(again)
            bucket = (rows["m"] % _U(buckets)).astype(np.int64)
            alone = np.isin(rows["m"], crowded)
            bucket[alone] = buckets + (rows["h"][alone] % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], rows[order]
            cuts = np.nonzero(np.diff(bucket))[0] + 1
            blobs = [x.tobytes() for x in np.split(rows, cuts)] if len(rows) else []
            keys = bucket[np.concatenate(([0], cuts))].tolist() if len(rows) else []
            for at in range(0, len(again), 1 << 16):
                blobs.append(again[at : at + (1 << 16)].tobytes())
                keys.append(int(again["h"][at] % _U(buckets)))
            whole = [False] * (len(blobs) - -(-len(again) // (1 << 16))) + [True] * -(-len(again) // (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(whole, pa.bool_()), pa.array([_pack(b) for b in blobs], pa.binary())], ["bucket", "settled", "rows"])

    return run


def _pack(rows: bytes) -> bytes:
    """Columns apart, so that small numbers compress."""
    import zstandard

    rows = np.frombuffer(rows, _ROW)
    columns = b"".join(np.ascontiguousarray(rows[n]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for n in _ROW.names)
    return zstandard.ZstdCompressor(level=1).compress(columns)


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at = len(flat) // _ROW.itemsize, 0
    rows = np.empty(n, _ROW)
    for name in _ROW.names:
        width = _ROW[name].itemsize
        rows[name] = np.ascontiguousarray(flat[at : at + n * width].reshape(width, n).T).view(_ROW[name]).ravel()
        at += n * width
    return rows


def _settle_buckets(buckets: int, crowd: int):
    """Whole repeats of each bucket as spans, and a question for each first piece whose minimizer other pieces have.

    A question is the minimizer, or less than -1 if more than ``crowd`` pieces have it. Strings of crowded minimizers are
    settled when they are met.
    """

    def answer(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        again, rows = settle(np.concatenate([_unpack(b) for b in blobs]))
        if len(again):
            yield _spans(again["doc"], again["start"], again["start"] + again["size"], np.full(len(again), -1))
        if bucket >= buckets:
            return
        opens = np.ones(len(rows), bool)
        opens[1:] = rows["m"][1:] != rows["m"][:-1]
        group = np.cumsum(opens) - 1
        other = np.concatenate(([False], (rows["h"][1:] != rows["h"][:-1]) & ~opens[1:]))
        others = np.bincount(group, weights=other)[group]
        asked = rows[others > 0]
        if len(asked):
            ask = asked["m"].astype(np.int64)
            ask = np.where(others[others > 0] >= crowd, -2 - ask, ask)
            yield _spans(asked["doc"], asked["start"], asked["start"] + asked["size"], ask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for bucket, settled, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if settled:
                    rows = _unpack(blob)
                    yield _spans(rows["doc"], rows["start"], rows["start"] + rows["size"], np.full(len(rows), -1))
                    continue
                if bucket != now and blobs:
                    yield from answer(now, blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from answer(now, blobs)

    return run


def _lists(column: pa.Array) -> list[tuple[np.ndarray, ...]]:
    """(start, end, ask) arrays of each row of a column of lists of spans."""
    offsets, flat = column.offsets.to_numpy(), column.values
    arrays = [flat.field(n).to_numpy(zero_copy_only=False) for n in ("start", "end", "ask")]
    return [tuple(x[a:z] for x in arrays) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]


def _fetch(length: int):
    """The bytes of the pieces asked for; for a crowded minimizer their strings, each a group of its own by its hash."""
    import xxhash

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, docs, starts, found = [], [], [], []
            for doc_id, text, asked in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), _lists(batch.column(2)), strict=True):
                for start, end, ask in zip(*(x.tolist() for x in asked), strict=True):
                    if ask < -1:
                        strings = [text[i : i + length] for i in range(start, end - length + 1)]
                        m += [1 << 62 | xxhash.xxh64_intdigest(x, -2 - ask) >> 2 for x in strings]
                        starts += range(start, end - length + 1)
                        found += strings
                        docs += [doc_id] * len(strings)
                    else:
                        m.append(ask)
                        starts.append(start)
                        found.append(text[start:end])
                        docs.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((m, docs, starts, found), kinds, strict=True)], ["m", "doc_id", "start", "piece"])

    return run


def _merge_groups(length: int, least_bytes: int = 1 << 19):
    """Repeated intervals among pieces that share minimizers: some groups of pieces at a time, each group whole.

    Rows come by group, then document. Groups of single strings have their first document first and are never held.
    """

    def settle_group(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, int] = {}
        for _, doc, _, piece in rows:
            if piece not in first or doc < first[piece]:
                first[piece] = doc
        strings = sorted(first)
        windows = dict(zip(strings, repeated_windows(strings, np.array([first[s] for s in strings], np.int64), length), strict=True))
        doc_ids, starts, ends = [], [], []
        for _, doc, start, piece in rows:
            if doc > first[piece]:
                doc_ids.append(doc)
                starts.append(start)
                ends.append(start + len(piece))
                continue
            at = windows[piece]
            if len(at):
                cuts = np.nonzero(np.diff(at) > 1)[0]
                lows, highs = at[np.concatenate(([0], cuts + 1))], at[np.concatenate((cuts, [len(at) - 1]))] + length
                doc_ids += [doc] * len(lows)
                starts += (start + lows).tolist()
                ends += (start + highs).tolist()
        yield _spans(doc_ids, starts, ends, [-1] * len(doc_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, first = [], 0, None, {}
        for batch in batches:
            single: list[tuple[int, int]] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[0] >> 62:
                    if row[0] != now:
                        now, first = row[0], {}
                    if row[1] > first.setdefault(row[3], row[1]):
                        single.append((row[1], row[2]))
                    continue
                if size >= least_bytes and row[0] != now:
                    yield from settle_group(held)
                    held, size = [], 0
                now = row[0]
                held.append(row)
                size += len(row[3])
            if single:
                doc, start = (np.array(x) for x in zip(*single, strict=True))
                yield _spans(doc, start, start + length, np.full(len(doc), -1))
        if held:
            yield from settle_group(held)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, (start, end, _) in zip(utf8(batch.column(1)), _lists(batch.column(2)), strict=True):
            text = text or b""
            runs: list[tuple[int, int]] = []
            if len(start):
                order = np.argsort(start)
                start, reach = start[order], np.maximum.accumulate(end[order])
                cuts = np.nonzero(start[1:] > reach[:-1])[0]
                runs = list(zip(start[np.concatenate(([0], cuts + 1))].tolist(), reach[np.concatenate((cuts, [len(start) - 1]))].tolist(), strict=True))
            kept, at = hashlib.sha256(), 0
            for a, z in runs:
                kept.update(text[at:a])
                at = z
            kept.update(text[at:])
            out.append((len(text), sum(z - a for a, z in runs), len(runs), kept.hexdigest(), ",".join(f"{a}:{z}" for a, z in runs)))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], _OUT)


_OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]


def crowded_minimizers(slim: DataFrame, length: int, anchor: int, looked_at: int = LOOKED_AT, least: int = 64) -> np.ndarray:
    """Minimizers that one in a thousand or more of about ``looked_at`` documents have, chosen by a hash of the id.

    Their number is at most a thousand times the pieces of a mean document, whatever the size of the table. What is found
    decides where rows go and never what is removed.
    """
    n = slim.count()
    share = min(1_000_000, max(1, round(1_000_000 * looked_at / max(n, 1))))
    some = slim.where(F.pmod(F.xxhash64("doc_id", F.lit("minimizers")), F.lit(1_000_000)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for t in utf8(batch.column(0)) if t and len(t) >= length]
            for at in range(0, len(texts), 256):
                each = []
                for part in _parts(_cut(((i, 0, t) for i, t in enumerate(texts[at : at + 256])), CHUNK, length), CHUNK):
                    text, _, _, minimizer, _ = pieces([t for _, _, t in part], length, anchor)
                    doc = np.array([i for i, _, _ in part], np.int64)[text]
                    each.append(np.unique(minimizer.astype(np.int64) << 8 | doc))
                m, docs = np.unique(np.unique(np.concatenate(each)) >> 8, return_counts=True) if each else (np.zeros(0, np.int64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(docs.astype(np.int64))], ["m", "docs"])

    counts = some.where("doc_id is not null").select("text").mapInArrow(lean(run), "m long, docs long").groupBy("m").agg(F.sum("docs").alias("docs"))
    bound = max(least, min(n, looked_at) // 1000)
    return np.array(sorted(r["m"] for r in counts.where(F.col("docs") >= bound).collect()), np.uint64)


def numbered(docs: DataFrame, id_col: str) -> DataFrame:
    """(given, doc_id): a long for each distinct id, in the order of the ids, by a distributed sort."""
    ids = docs.select(F.col(id_col).alias("given")).where("given is not null").distinct()
    return materialise(ids.sort("given").withColumn("doc_id", F.monotonically_increasing_id()))


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    anchor: int = ANCHOR,
    bucket_bytes: int = 1 << 22,
    chunk: int = CHUNK,
    crowd: int = CROWD,
    least_crowded: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): one row per input row.

    Each byte goes that is covered by a ``length``-byte string which also starts in a document with a smaller id; strings
    are judged on the input, and never reach across documents. ``spans`` are the removed runs as start:end in bytes.
    Null counts as empty. Rows with a null id have no smaller or larger one and keep all; rows that repeat an id count as
    one document each and are cut alike where their texts are the same (texts that differ under one id are not defined
    as before or after each other, but get spans found in any of them). Ids that are no integers, such as strings, are
    ordered as Spark orders them. Very long texts are cut into parts that share ``length - 1`` bytes. An empty table gives
    no rows; further columns of ``docs`` are ignored.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        numbers = numbered(docs, id_col)
        slim = docs.select(F.col(id_col).alias("given"), F.col(text_col).cast("string").alias("text")).join(numbers, "given", "left")
        out = remove_repeats(slim.select("doc_id", "text"), length, anchor, bucket_bytes, chunk, crowd, least_crowded)
        named = numbers.select("doc_id", F.col("given").alias("_given"))
        return out.join(named, "doc_id", "left").select(F.col("_given").alias("doc_id"), *_OUT[1:])
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 26)))
    crowded = crowded_minimizers(slim, length, anchor, least=least_crowded)
    dealt = slim.mapInArrow(_deal(length, anchor, buckets, chunk, crowded), "bucket long, settled boolean, rows binary")
    # Buckets are even in size and numbered, so each task is given as many of them instead of what hashes to it.
    n = min(tasks, 2 * buckets)
    dealt = dealt.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")
    # Each of the three steps moves about as much as the table has; what one has moved goes before the next begins.
    found = materialise(dealt.mapInArrow(_settle_buckets(buckets, crowd), _SPAN_SCHEMA), free=True)

    texts = slim.repartition(tasks, "doc_id")
    each = lambda frame: frame.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "ask")).alias("found"))
    asked = each(found.where("ask != -1"))
    fetched = texts.join(asked, "doc_id").select("doc_id", "text", "found").mapInArrow(_fetch(length), "m long, doc_id long, start int, piece binary")
    fetched = fetched.repartition(tasks, "m").sortWithinPartitions("m", "doc_id")
    merged = materialise(fetched.mapInArrow(_merge_groups(length), _SPAN_SCHEMA), free=True)
    spans = each(found.where("ask = -1").unionByName(merged))
    schema = T.StructType([T.StructField(n, T.StringType() if n in ("kept_sha256", "spans") else T.LongType()) for n in _OUT])
    return texts.join(spans, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(_remove, schema)
