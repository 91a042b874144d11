"""Readers of audio, voice, recogniser, story and lexicon files, and encoders of what the engine writes."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosodia.functions.arrow import arrow
from prosodia.operators.signal import blend, hot_colour

RATE = 24_000

# --- audio ----------------------------------------------------------------------------------------------------------


def decode_wav(content: bytes) -> dict:
    """Sample rate, channels, first channel as floats and duration of a 16-bit PCM file; errors for all else."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(content) and data is None:
        name, size = struct.unpack_from("<4sI", content, at)
        body = content[at + 8 : at + 8 + size]  # a size beyond the end is cut to what is there
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            data = body
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("format or data chunk is missing")
    kind, channels, rate, _, _, bits = form
    if kind != 1 or bits != 16:
        raise ValueError("only 16-bit PCM is read")
    frames = np.frombuffer(data[: len(data) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels)
    samples = frames[:, 0].astype(np.float32) / np.float32(32767)
    return {"sample_rate": rate, "channels": channels, "samples": samples.tolist(), "duration": len(samples) / rate}


def encode_wav(samples, rate: int = RATE, software: str = "", artist: str = "", comment: str = "", title: str = "") -> bytes:
    """A mono 16-bit file: samples are clamped to one and cut towards zero; texts go to an INFO list if there are any."""
    x = np.clip(np.asarray(samples if samples is not None else [], np.float64), -1.0, 1.0)
    data = np.trunc(x * 32767).astype("<i2").tobytes()
    info = b""
    for name, text in (("ISFT", software), ("IART", artist), ("ICMT", comment), ("INAM", title)):
        if text:
            body = text.encode() + b"\0"
            info += name.encode() + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    listed = b"LIST" + struct.pack("<I", 4 + len(info)) + b"INFO" + info if info else b""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
    body = head + listed + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def comment_of(speed: float, form: str) -> str:
    return f"speed={speed:.2f} format={form}"


_WAV = "path string, sample_rate int, channels int, samples array<float>, duration double, error string"


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file; files that can't be read have their reason in ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append({"path": name, **decode_wav(bytes(content)), "error": None})
                except (ValueError, struct.error) as e:
                    rows.append({"path": name, "sample_rate": None, "channels": None, "samples": None, "duration": None, "error": str(e)})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _WAV.split(", ")]).astype({"sample_rate": "Int32", "channels": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _WAV)


@arrow("binary")
def wav_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(encode_wav)


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of height x width x 3 bytes."""
    high, wide, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def spectrogram_png(levels: np.ndarray) -> bytes:
    """Frames by bins in decibels from -80 to 0, low frequencies at the bottom."""
    ramp = np.array([hot_colour(i / 255) for i in range(256)], np.uint8)
    shade = np.clip((np.asarray(levels) + 80) / 80 * 255, 0, 255).astype(np.uint8)
    return encode_png(ramp[shade.T[::-1]])


# --- voices ---------------------------------------------------------------------------------------------------------


def decode_npy(name: str, content: bytes) -> np.ndarray:
    """A matrix of little-endian floats; (N, 1, M) is squeezed; infinite and undefined values are errors."""
    made = np.load(io.BytesIO(content), allow_pickle=False)
    if made.dtype != np.dtype("<f4"):
        raise ValueError(f"{name}: only <f4 is read")
    if made.ndim == 3 and made.shape[1] == 1:
        made = made[:, 0]
    if made.ndim != 2:
        raise ValueError(f"{name}: two dimensions are needed")
    if not np.isfinite(made).all():
        raise ValueError(f"{name}: values must be finite")
    return made


def read_voices(spark: SparkSession, path: str) -> DataFrame:
    """(name, row, style) from archives of .npy members; an archive without any is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    members = [m for m in archive.namelist() if m.endswith(".npy")]
                    if not members:
                        raise ValueError("no voice in the archive")
                    for member in members:
                        made = decode_npy(member, archive.read(member))
                        yield pd.DataFrame({"name": member[:-4], "row": np.arange(len(made), dtype=np.int32), "style": list(made)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, row int, style array<float>")


def style_for(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Joins requests (voice, n_tokens) with the style row of the padded length, the last row at most."""
    last = voices.groupBy(F.col("name").alias("voice")).agg(F.max("row").alias("last"))
    wanted = requests.join(last, "voice", "left").withColumn("row", F.least(F.greatest(F.col("n_tokens") + 2, F.lit(0)), F.col("last")))
    return wanted.join(voices.withColumnRenamed("name", "voice"), ["voice", "row"], "left").drop("last")


def blended(voices: DataFrame, one: str, two: str, weight: float) -> DataFrame:
    """A further voice ``A+B@P`` of two, P the share of the second in percent."""
    a = voices.where(F.col("name") == one).select("row", F.col("style").alias("a"))
    b = voices.where(F.col("name") == two).select("row", F.col("style").alias("b"))
    name = f"{one}+{two}@{round(weight * 100)}"
    return a.join(b, "row").select(F.lit(name).alias("name"), "row", blend(F.col("a"), F.col("b"), F.lit(weight)).alias("style"))


def parse_blend(name: str) -> tuple[str, str, float] | None:
    """The two voices and the weight of ``A+B@N``; 20 per cent without N."""
    m = re.fullmatch(r"([^+@]+)\+([^+@]+)(?:@([0-9]+))?", name)
    return (m[1], m[2], min(int(m[3] or 20), 100) / 100) if m else None


# --- JSON -----------------------------------------------------------------------------------------------------------

_RECOGNISED = "transcription array<struct<tokens: array<struct<text: string, offsets: struct<`from`: int, `to`: int>, p: double>>>>"
_MARKS = ("[_BEG_]", "[_EOT_]", "[_NOT_]", "[_PREV_]", "[_SOLM_]", "[_SOT_]", "[_TT_0]", "[_TT_1]", "[_TT_2]", "[BLANK_AUDIO]")


def read_recognised(spark: SparkSession, path: str) -> DataFrame:
    """Alignments from a recogniser's full JSON: one clip for each file."""
    raw = spark.read.schema(_RECOGNISED).json(path, multiLine=True).withColumn("clip_id", F.input_file_name())
    return words_from_tokens(raw)


def words_from_tokens(raw: DataFrame, least: float = 0.3) -> DataFrame:
    """(clip_id, pos, word, start_ms, end_ms, confidence) from rows (clip_id, transcription).

    Marks and unlikely tokens go first; then a token with a leading blank starts a word. Confidence is the tokens' mean;
    a word without length lasts until the next one starts, 300 ms at most.
    """
    flat = raw.select("clip_id", F.posexplode(F.flatten(F.transform("transcription", lambda s: s["tokens"]))).alias("i", "t"))
    kept = flat.select("clip_id", "i", F.col("t.text").alias("text"), F.trim("t.text").alias("clean"), F.col("t.p").alias("p"), F.col("t.offsets.from").alias("a"), F.col("t.offsets.to").alias("z"))
    kept = kept.where(~F.col("clean").isin(*_MARKS) & (F.col("p") >= least) & (F.col("clean") != ""))
    order = Window.partitionBy("clip_id").orderBy("i")
    starts = (F.col("text").startswith(" ") | (F.row_number().over(order) == 1)).cast("int")
    marked = kept.withColumn("starts", starts).withColumn("w", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "clean"))), lambda x: x["clean"]), "")
    made = marked.groupBy("clip_id", F.col("w").cast("int").alias("pos")).agg(word.alias("word"), F.min_by("a", "i").alias("start_ms"), F.max_by("z", "i").alias("end_ms"), F.avg("p").alias("confidence"))
    following = F.lead("start_ms").over(Window.partitionBy("clip_id").orderBy("pos"))
    filled = F.least(F.coalesce(following, F.col("start_ms") + 300), F.col("start_ms") + 300)
    return made.withColumn("end_ms", F.when(F.col("end_ms") <= F.col("start_ms"), filled).otherwise(F.col("end_ms")))


_STORY = "id string, title string, author string, sections array<struct<id: string, position: int, name: string, content: string>>"


def read_story(spark: SparkSession, path: str, positions: list[int] | None = None) -> DataFrame:
    """(story_id, title, author, position, name, content): one row for each section, or for those asked for."""
    raw = spark.read.schema(_STORY).json(path, multiLine=True).select(F.col("id").alias("story_id"), "title", "author", F.explode("sections").alias("s"))
    rows = raw.select("story_id", "title", "author", "s.position", "s.name", "s.content")
    return rows.where(F.col("position").isin(*positions)) if positions else rows


def read_lexicon(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """(tier, word, ipa) from a JSON object of words: a reading, or readings by part of speech, of which DEFAULT counts."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("word", "value"))
    by_part = F.from_json("value", "map<string,string>")
    ipa = F.when(F.col("value").startswith("{"), F.try_element_at(by_part, F.lit("DEFAULT"))).otherwise(F.col("value"))
    return raw.select(F.lit(tier).alias("tier"), "word", ipa.alias("ipa")).where("ipa is not null")


def read_homographs(spark: SparkSession, path: str):
    """Rules by word from a JSON object; keys that start with an underscore are remarks. A dictionary of some dozen rules."""
    import json

    from prosodia.operators.homographs import Reading, Rule

    made = {}
    for key, raw in json.loads(spark.read.text(path, wholetext=True).first()[0]).items():
        if not key.startswith("_"):
            found = {ipa: Reading(*(tuple(r.get(n, ())) for n in ("context_before", "context_after", "immediately_before"))) for ipa, r in raw.get("pronunciations", {}).items()}
            made[key] = Rule(raw["default"], found, *(raw.get(n, "") for n in ("imperative", "narrated_past", "subject_name", "inflected_default")))
    return made


def slug(title: str) -> str:
    kept = "".join(c if c.isalnum() else "-" if c in " -_" else "" for c in title.lower())
    return re.sub("-+", "-", kept).strip("-")
