"""SimHash near-duplicate detection: pigeonhole blocks, then Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosodia.llm.components import connected_components
from prosodia.llm.shared import HOT_KEYS, HOT_ROWS, lean, materialise, spread_join, unused, utf8

SEED = 42
#: Members of a bucket, and bytes of their shingle sets, that one task compares with as many others.
SIDE, SIDE_BYTES = 1024, 1 << 24


def _again(hashes: np.ndarray, table: int) -> np.ndarray:
    """Another hash for each further table, mixed from the first."""
    if not table:
        return hashes
    with np.errstate(over="ignore"):
        h = hashes ^ np.uint64(0x9E3779B97F4A7C15 * table & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def fingerprint(text: bytes | None, width: int = 3) -> int:
    return fingerprint_tables(text, width, 1)[0]


def fingerprint_tables(text: bytes | None, width: int = 3, tables: int = 1) -> list[int]:
    """64-bit SimHashes of the word shingles of one UTF-8 text, as unsigned integers, one for each table.

    Words are runs of bytes other than space and \\t-\\r after lower-casing A-Z; repeated shingles count each time. Fewer
    words than ``width`` make one shingle, no word (or a null) makes zero.
    """
    return _bundled(shingle_hashes(text, width), tables)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    words = (text or b"").lower().split()
    if len(words) <= width:
        shingles, n = iter([b" ".join(words)]), min(len(words), 1)
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), len(words) - width + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def _bundled(hashes: np.ndarray, tables: int) -> list[int]:
    n = len(hashes)
    ones = np.zeros((tables, 64), np.int64)
    for at in range(0, n, 1 << 16):
        for table in range(tables):
            part = _again(hashes[at : at + (1 << 16)], table).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[table] += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(2 * ones > n, axis=1, bitorder="little")]


def fingerprints(docs: DataFrame, width: int = 3, tables: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fp1, ...): one row per input row, the fingerprint of each table's 64 bits as a signed long."""
    names = ["fp", *(f"fp{t}" for t in range(1, tables))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_tables(t, width, tables) for t in utf8(batch.column(1))], np.uint64).reshape(-1, tables).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, t])) for t in range(tables))], ["doc_id", *names])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(run), schema)


def _masks(blocks: int, equal: int) -> list[int]:
    """Every choice of ``equal`` of ``blocks`` contiguous blocks of 64 bits, as signed masks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (z - a)) - 1) << a for a, z in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(block, equal))]


def _flips(radius: int) -> Column:
    """An array of all masks with at most ``radius`` bits set."""
    one = F.array(F.lit(0), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))).cast("array<long>")
    out = one
    for _ in range(radius - 1):
        out = F.flatten(F.transform(out, lambda x: F.transform(one, lambda y: x.bitwiseXOR(y))))
    return F.array_distinct(out) if radius > 1 else out


def links(fps: DataFrame, radius: int = 2, blocks: int = 4, crowd: int = 32) -> DataFrame:
    """(a, b): edges whose components are exactly those of "at most ``radius`` bits differ", over distinct ``fp``.

    Fingerprints within the radius agree on ``blocks - radius`` of the blocks, so each goes under every such choice of
    blocks. Where at most ``crowd`` fingerprints share blocks, all of them are compared and verified. A crowded bucket is
    never expanded into pairs: two fingerprints within an even radius share a midpoint within half of it, and any two
    around one midpoint are within the radius, so each crowded fingerprint is hung on the smallest around each of its
    midpoints. That is exact as well, and linear.
    """
    if radius % 2 or not 0 < radius < blocks:
        raise ValueError("the radius must be even and smaller than the number of blocks")
    masks = _masks(blocks, blocks - radius)
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.i", "k.key")
    sizes = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    near = materialise(spread_join(keyed, sizes, ["i", "key"], "n", len(masks) * fps.count()))
    small = near.where(F.col("n") <= crowd)
    pairs = (
        small.alias("x")
        .join(small.alias("y"), ["i", "key"])
        .where(F.expr(f"x.fp < y.fp and bit_count(x.fp ^ y.fp) <= {radius}"))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    crowded = near.where(F.col("n") > crowd).select("fp").distinct()
    around = crowded.select("fp", F.explode(_flips(radius // 2)).alias("flip")).select("fp", F.expr("fp ^ flip").alias("mid"))
    # A midpoint has at most as many fingerprints around it as it has flips, so no key is frequent here.
    heads = around.groupBy("mid").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    hung = around.join(heads, "mid").where("fp != head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    return pairs.unionAll(hung)


def near_duplicates(
    docs: DataFrame, radius: int = 2, width: int = 3, blocks: int = 4, tables: int = 1, crowd: int = 32, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    Documents are linked when their fingerprints differ in at most ``radius`` bits, in any of ``tables`` independent
    SimHashes (a pair that one of them just misses is caught by another); fingerprint is the first. component_id is the smallest doc_id
    that links reach, the document's own included. Null and blank texts have fingerprint zero and are linked like any
    other. Rows with a null id keep their row; component_id is null only if no document of the component has an id.
    Repeated rows come out as often as they came in; further columns of ``docs`` are ignored. Very long texts are read
    whole. An empty table gives none.
    """
    printed = materialise(fingerprints(docs, width, tables, id_col, text_col))
    prints = materialise(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges = links(prints.select("fp"), radius, blocks, crowd)
    for table in range(1, tables):
        here = printed.select("fp", F.col(f"fp{table}").alias("other")).distinct()
        heads = materialise(here.groupBy("other").agg(F.min("fp").alias("head")))
        hung = here.join(heads, "other").select(F.col("head").alias("a"), F.col("fp").alias("b"))
        met = links(heads.select(F.col("other").alias("fp")), radius, blocks, crowd)
        for side in ("a", "b"):
            met = met.join(heads.select(F.col("other").alias(side), F.col("head").alias(f"head_{side}")), side)
        edges = edges.unionAll(hung).unionAll(met.select(F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    roots = connected_components(edges)
    member = materialise(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    classes = spread_join(member, lowest, ["root"], "members", member.count()).select("fp", "component_id", "n")
    return spread_join(printed, classes, ["fp"], "n", printed.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies by similarity --------------------------------------------------------------------------------------


def split_fingerprint(hashes: np.ndarray, blocks: int = 16, least: int = 4) -> np.ndarray:
    """A SimHash for each of ``blocks`` parts of a text's distinct shingles, of the ``least`` smallest hashes in the part.

    A shingle's part is the head of its hash, so that fewer than ``blocks`` edits leave a part as it was, and texts of any
    length that are similar share some. A part without shingles is zero.
    """
    distinct = np.unique(hashes)
    shift = np.uint64(64 - int(blocks).bit_length() + 1)
    start = np.searchsorted(distinct, np.arange(blocks, dtype=np.uint64) << shift)
    size = np.minimum(np.diff(np.append(start, len(distinct))), least)
    out = np.zeros(blocks, np.int64)
    full = np.nonzero(size)[0]
    if len(full):
        first = np.cumsum(size[full]) - size[full]
        taken = np.repeat(start[full] - first, size[full]) + np.arange(size.sum())
        bits = np.unpackbits(distinct[taken].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > size[full][:, None], axis=1, bitorder="little").view("<i8").ravel()
    return out


def sketches(docs: DataFrame, width: int, tables: int, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fps, parts): the fingerprints of ``tables`` times 64 bits of the distinct shingles and the split
    fingerprint, null if it has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, parts = [], []
            for text in utf8(batch.column(1)):
                hashes = np.unique(shingle_hashes(text, width))
                fps.append(np.array(_bundled(hashes, tables), np.uint64).view(np.int64) if len(hashes) else None)
                parts.append(split_fingerprint(hashes, blocks) if len(hashes) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, longs), pa.array(parts, longs)], ["doc_id", "fps", "parts"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("fps", "parts"))])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(run), schema)


def shingle_sets(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rep, shingles): the sorted distinct shingle hashes of each row, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text, width)).astype("<u8").tobytes() for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    schema = T.StructType([T.StructField("rep", docs.schema[id_col].dataType), T.StructField("shingles", T.BinaryType())])
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(lean(run), schema)


def alike(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets of shingle hashes is ``similarity`` or more."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def within(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the rows of (a, b, x, y) whose shingle sets x and y are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3), strict=True)
            keep = [alike(x.as_buffer(), y.as_buffer(), similarity) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(lean(run), pairs.select("a", "b").schema)


def _distances(fps: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bits that differ, for each of some fingerprints and each of others."""
    out = np.zeros((len(fps), len(others)), np.uint16)
    for table in range(fps.shape[1]):
        out += np.bitwise_count(fps[:, None, table] ^ others[None, :, table])
    return out


def spanning(fps: np.ndarray, parts: np.ndarray, block: int, roots: np.ndarray, sets: list, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links among the members of a bucket that join all that are linked with each other: two members are compared if
    nothing has joined them yet, their fingerprints are within ``radius`` and ``block`` is the first that they share.

    ``roots`` are the components that the members are in already. Close pairs come first, so that copies of one text are
    joined by as many links as there are copies, and only members that are alike but not enough are compared in pairs.
    """
    _, group = np.unique(roots, return_inverse=True)
    least = list(range(int(group.max()) + 1)) if len(group) else []

    def find(x: int) -> int:
        while least[x] != x:
            least[x] = least[least[x]]
            x = least[x]
        return x

    found: list[tuple[int, int]] = []
    for low, high in ((0, radius // 2), (radius // 2, radius)):
        for at in range(0, len(fps), 128):
            here = np.array([find(g) for g in group], np.int64)
            d = _distances(fps[at : at + 128], fps)
            near = (d <= high) & ((d > low) | (low == 0)) & (here[at : at + 128, None] != here[None, :])
            x, y = np.nonzero(near)
            x += at
            later = x < y
            x, y = x[later], y[later]
            earlier = (parts[x, :block] == parts[y, :block]) & (parts[x, :block] != 0)
            first = ~earlier.any(axis=1)
            x, y = x[first], y[first]
            order = np.argsort(d[x - at, y], kind="stable")
            for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
                one, two = find(int(group[a])), find(int(group[b]))
                if one != two and alike(sets[a], sets[b], similarity):
                    least[max(one, two)] = min(one, two)
                    found.append((a, b))
    return found


def bucket_links(members: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): spanning links of the members (i, key, n, size, rep, fps, parts, root, shingles) of each bucket.

    Members are dealt to sides by a hash, of about SIDE members and SIDE_BYTES of shingles, and each two sides of a bucket
    meet in a group of their own, so no task holds a bucket that grows with the table.
    """
    sides = F.greatest(F.ceil(F.col("n") / SIDE), F.ceil(F.col("size") / SIDE_BYTES)).cast("int")
    dealt = members.withColumn("sides", sides).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("sides")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("sides") - 1), lambda t: (F.col("sides") == 1) | (t != F.col("side")))
    dealt = dealt.withColumn("other", F.explode(other))
    dealt = dealt.select("i", "key", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "rep", "fps", "parts", "root", "shingles")
    kind = members.schema["rep"].dataType

    def run(table: pa.Table) -> pa.Table:
        reps, sets = table["rep"].combine_chunks(), [x.as_buffer() for x in table["shingles"]]
        matrix = lambda name: np.array(table[name].combine_chunks().flatten()).reshape(len(sets), -1)
        roots = np.array(table["root"].to_pylist())
        found = spanning(matrix("fps").view(np.uint64), matrix("parts"), table["i"][0].as_py(), roots, sets, radius, similarity)
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": reps.take(pa.array(found[:, 0])), "b": reps.take(pa.array(found[:, 1]))})

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return dealt.groupBy("i", "key", "p", "q").applyInArrow(run, schema)


def near_copies(
    docs: DataFrame,
    radius: int = 64,
    width: int = 5,
    tables: int = 4,
    blocks: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
) -> DataFrame:
    """(doc_id, component_id): the documents that are near copies of others, and the smallest id of their group.

    Two texts are linked when the Jaccard similarity of their sets of ``width``-word shingles is ``similarity`` or more.
    Those are compared that share a block of their split fingerprints and whose whole fingerprints of ``tables`` times 64
    bits differ in at most ``radius`` bits: 0.8 alike are about 39 of 256 bits, and 48 for the shortest texts, give or
    take 6. Documents without words and null ids are near copies of none. Rows that repeat an id are one document. Very
    long texts are read whole. An empty table gives no rows; further columns are ignored.

    Equal fingerprints are one class from the start. Each member of a bucket is first compared with the smallest one,
    which joins most copies by one link each. Buckets whose members are not all joined then compare all that are in
    different components, in parts of bounded size; what comes out of a part is a spanning forest, never all its pairs.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    seen = materialise(sketches(docs, width, tables, blocks, id_col, text_col).where("fps is not null"))
    classes = seen.groupBy("fps").agg(F.min("doc_id").alias("rep"), F.min_by("parts", "doc_id").alias("parts"), F.count("*").alias("rows"))
    classes = materialise(classes)
    keyed = classes.select("rep", "fps", F.posexplode("parts").alias("i", "key")).where("key != 0")
    sizes = keyed.groupBy("i", "key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "fps")).alias("head")).where("n > 1")
    total = classes.count()
    met = materialise(spread_join(keyed, sizes, ["i", "key"], "n", blocks * total))

    name = unused("rep", docs)
    wanted = met.select(F.col("rep").alias(name)).distinct()
    texts = docs.join(wanted, F.col(id_col) == F.col(name), "left_semi").select(id_col, text_col)
    sets = materialise(shingle_sets(texts, width, id_col, text_col).dropDuplicates(["rep"]))

    apart = F.expr("aggregate(zip_with(fps, head.fps, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)")
    pairs = met.where((F.col("rep") != F.col("head.rep")) & (apart <= radius)).select(F.col("head.rep").alias("a"), F.col("rep").alias("b"))
    pairs = materialise(pairs.distinct())
    left = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"))
    heads = counted.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    # A head of very many members is met in parts: its set is repeated for each, and the members' sets are dealt to them.
    parts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    split = counted.where(F.col("n") > HOT_ROWS).select("a", parts.alias("parts"))
    few = split.limit(HOT_KEYS + 1).count() <= HOT_KEYS
    left = left.join(F.broadcast(split) if few else split, "a", "left")
    left = left.withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    heads = heads.select("a", "x", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    edges = materialise(within(left.join(heads, ["a", "part"]), similarity))

    roots = materialise(connected_components(edges))
    now = met.join(roots, F.col("rep") == F.col("node"), "left").select("i", "key", "rep", "fps", F.coalesce("root", "rep").alias("root"))
    now = materialise(now)
    open_ = now.groupBy("i", "key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    open_ = materialise(spread_join(now, open_.select("i", "key", "n"), ["i", "key"], "n", blocks * total))
    if not open_.isEmpty():
        held = sets.join(classes.select("rep", "parts"), "rep")
        members = materialise(open_.drop("n").join(held, "rep"))
        measured = members.groupBy("i", "key").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("size"))
        members = spread_join(members, measured, ["i", "key"], "n", blocks * total)
        more = materialise(bucket_links(members, radius, similarity))
        roots = materialise(connected_components(edges.unionAll(more)))
    least = classes.join(roots, F.col("rep") == F.col("node"), "left").select("fps", "rows", F.coalesce("root", "rep").alias("component_id"))
    grouped = materialise(spread_join(seen, least, ["fps"], "rows", total).select("doc_id", "component_id"))
    crowds = grouped.groupBy("component_id").agg(F.count_distinct("doc_id").alias("n"), F.count("*").alias("rows")).where("n > 1")
    return spread_join(grouped, crowds, ["component_id"], "rows", grouped.count()).select("doc_id", "component_id").distinct()
