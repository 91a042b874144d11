"""Exact deduplication of incoming batches against immutable snapshots, screened by static binary-fuse filters."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.llm import fuse
from prosodia.llm.shared import ascii_lower, materialise

BUCKET_KEYS = 400_000
#: Rows of a group of copies that one task takes.
SALT_ROWS = 512
#: Groups with more than one in so many of all rows are fewer than this, so they may be sent to every task.
HOT_GROUPS = 100_000
#: Words of 64 bits that mark copied digests, at most (a power of two). Beyond it more texts are moved in vain, none is lost.
MARK_WORDS = 1 << 18


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _key(digest: Column) -> Column:
    return F.xxhash64(digest)


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(7)), F.lit(buckets))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter): one binary-fuse filter for each bucket of a snapshot's distinct digests."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "filter": [fuse.build(part["key"].to_numpy().view("uint64"))]})

    keyed = groups.select(_bucket(F.col("digest"), buckets).alias("bucket"), _key(F.col("digest")).alias("key"))
    return keyed.groupBy("bucket").applyInPandas(build, "bucket long, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming digests with a boolean ``hit``; false means that the snapshot surely lacks the digest."""

    def probe(part: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        one = held["filter"].iloc[0] if len(held) else None
        return pd.DataFrame({"digest": part["digest"], "hit": fuse.contains(one, part["key"].to_numpy().view("uint64"))})

    keyed = incoming.select("digest", _bucket(F.col("digest"), buckets).alias("bucket"), _key(F.col("digest")).alias("key"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest string, hit boolean")


def marked(texts: DataFrame, digests: DataFrame, count: int) -> DataFrame:
    """The texts whose digest may be one of ``count`` ``digests``, where they lie: no text is moved.

    Each digest sets one bit in a table that is sent to every task, with sixteen bits for each up to ``MARK_WORDS`` words. A
    digest that is among them always passes; another does by chance, about one in sixteen, more beyond that bound.
    """
    words = min(MARK_WORDS, 1 << max(0, math.ceil(count / 4) - 1).bit_length())
    # Neither a remainder nor another expression that may be null: a check for null would hash the whole texts once more.
    spot = F.xxhash64(F.col("digest"), F.lit(11)).bitwiseAND(F.lit(64 * words - 1))
    bit = F.col("_spot").bitwiseAND(F.lit(63)).cast("int")
    marks = digests.select(spot.alias("_spot")).groupBy(F.shiftright("_spot", 6).alias("_word"))
    marks = marks.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    seen = (F.shiftright("_spot", 6) == F.col("_word")) & (F.getbit("_bits", bit) == 1)
    return texts.withColumn("_spot", spot).join(F.broadcast(marks), seen, "left_semi").drop("_spot")


def exact_classes(
    docs: DataFrame,
    in_snapshot: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per input row.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. ``in_snapshot`` marks rows of
    the immutable snapshot, the rest is the incoming batch. The snapshot's distinct digests are held in one binary-fuse
    filter per bucket; incoming digests are grouped among themselves first, the filters screen the groups, and only
    positives meet the snapshot's exact buckets. Whatever shares a digest is then compared byte by byte with the row that
    stays; texts that only share the digest (``digest`` may be any function) are told apart by their bytes.

    Of equal texts the largest id stays. Rows that repeat both id and text are all marked as kept, and count in
    group_size; null ids stay only where a group has no other (then keep_id is null). Very long texts are compared whole.
    Further columns are ignored. An empty table gives no rows.

    A group of copies may hold any share of the rows. Groups above ``SALT_ROWS`` rows and one in ``HOT_GROUPS`` of all rows
    are fewer than ``HOT_GROUPS``, meet their rows where these are and never in one task; texts are compared, and results
    given back, in parts of about ``SALT_ROWS`` rows of a group.
    """
    norm = ascii_lower(F.col(text_col))
    known = lambda text: F.coalesce(digest(text), F.lit(""))  # noqa: E731  never null, or joins would hash each text twice to see
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), known(norm).alias("digest"), F.coalesce(in_snapshot, F.lit(False)).alias("old"))
    )
    group = lambda side: side.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    old = materialise(group(rows.where("old")))
    new = materialise(group(rows.where("not old")))
    buckets = max(1, math.ceil(old.count() / BUCKET_KEYS))
    hits = screen(new, snapshot_filters(old, buckets), buckets)
    screened = materialise(new.join(hits, "digest"))
    met = old.unionByName(screened.where("hit").drop("hit")).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    classes = materialise(met.unionByName(screened.where("not hit").drop("hit")))

    several = classes.where("n > 1").withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int")).select("digest", "keep_id", "salts", "n")
    total, copied = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    least = max(SALT_ROWS, total // HOT_GROUPS)
    hot = several.where(F.col("n") > least)
    # Ids meet their classes first, without texts; texts that may have copies then meet ids, whose keys no group of copies
    # makes frequent.
    ids = rows.select("doc_id", "digest").distinct()
    cold = ids.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(several.where(F.col("n") <= least), "digest")
    wanted = ids.join(F.broadcast(hot), "digest").unionByName(cold)
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "keep_id", "salts")
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("digest", known(F.col("norm")))
    member = marked(texts, several, copied).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).drop("_id", "_digest")
    member = materialise(member.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")))
    stays = member.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "salts").agg(F.min("norm").alias("stays"))
    stays = stays.select("digest", "stays", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    checked = member.join(stays, ["digest", "salt"]).select(
        "doc_id", "digest", "salt", "salts", F.when(F.col("norm") == F.col("stays"), "").otherwise(F.concat(F.lit("="), "norm")).alias("apart"), "norm"
    )
    # Only texts that differ from the one that stays keep their bytes from here on; with SHA-256 there are none.
    checked = materialise(checked.select("doc_id", "digest", "salt", "salts", "apart", sha256(F.col("norm")).alias("text_sha256")))
    equal = checked.groupBy("digest", "apart").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("salts").alias("salts"))
    equal = equal.select("digest", "apart", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    shared = checked.drop("salts").join(equal, ["digest", "apart", "salt"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    single = rows.join(classes.where("n = 1").select("digest"), "digest", "left_semi")
    if digest is not sha256:
        single = texts.join(classes.where("n = 1").select("digest"), "digest", "left_semi").withColumn("digest", sha256(F.col("norm")))
    alone = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("digest").alias("text_sha256"))
    return shared.unionByName(alone).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def older_half(id_col: str = "doc_id") -> Column:
    """A split of one table into snapshot and batch where the caller has no batches of their own: by a bit of the id's
    hash. Every row is in one of the two."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
