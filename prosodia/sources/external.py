"""What other programs do, as callables that the caller hands over: codecs, recognisers and aligners.

Each takes a factory that is called once in a task, so a model is loaded once for many rows; what a call raises goes to an
``error`` column and fails no other row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.sources import files

ALIGNED = "array<struct<word:string,start_ms:int,end_ms:int,confidence:double>>"


def mapped(frame: DataFrame, column: str, factory: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """Adds ``name``, what the factory's function gives for ``column``, and ``error``, why it gave nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for batch in batches:
            made, errors = [], []
            for value in batch[column]:
                try:
                    made.append(call(bytes(value) if isinstance(value, (bytes, bytearray, memoryview)) else value))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a row that fails must not fail the others
                    made.append(None)
                    errors.append(str(e))
            yield batch.assign(**{name: made, "error": errors})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInPandas(run, f"{kinds}, `{name}` {kind}, error string")


def extracted(sources: DataFrame, codec: Callable[[], Callable[[bytes], bytes]], column: str = "content") -> DataFrame:
    """Adds ``wav``: any audio file's bytes as those of a 16-bit file, at the rate that the codec was made for."""
    return mapped(sources, column, codec, "wav", "binary")


def encoded(clips: DataFrame, codec: Callable[[], Callable[[bytes], bytes]], column: str = "wav") -> DataFrame:
    """Adds ``audio``: 16-bit files in another format."""
    return mapped(clips, column, codec, "audio", "binary")


def transcribed(clips: DataFrame, recogniser: Callable[[], Callable[[bytes], str]], column: str = "wav") -> DataFrame:
    """Adds ``text``, without blanks at its ends."""
    return mapped(clips, column, recogniser, "text", "string").withColumn("text", F.trim("text"))


def aligned(clips: DataFrame, aligner: Callable[[], Callable[[bytes], list]], column: str = "wav") -> DataFrame:
    """(clip_id, pos, word, start_ms, end_ms, confidence): word times of clips by an aligner, which gives (word, start_ms,
    end_ms, confidence) for each. A clip that fails has one row of nulls with its ``error``."""

    def listed() -> Callable[[bytes], list]:
        align = aligner()
        return lambda content: [dict(zip(("word", "start_ms", "end_ms", "confidence"), w, strict=True)) for w in align(content)]

    rows = mapped(clips.select("clip_id", column), column, listed, "words", ALIGNED)
    return rows.select("clip_id", "error", F.posexplode_outer("words").alias("pos", "w")).select("clip_id", "pos", "w.*", "error")


def resampled(samples, rate: int, wanted: int):
    """Samples at another rate by straight lines between them, for where no codec is at hand."""
    import numpy as np

    x = np.asarray(samples, np.float64)
    n = int(len(x) * wanted / rate)
    return np.interp(np.arange(n) * rate / wanted, np.arange(len(x)), x).astype(np.float32) if len(x) else x.astype(np.float32)


def at_rate(wanted: int) -> Callable[[], Callable[[bytes], bytes]]:
    """A codec for extracted() that reads 16-bit files only and writes them at another rate."""

    def factory() -> Callable[[bytes], bytes]:
        def convert(content: bytes) -> bytes:
            made = files.decode_wav(content)
            return files.encode_wav(resampled(made["samples"], made["sample_rate"], wanted), wanted)

        return convert

    return factory


def save_images(images: DataFrame, folder: str) -> int:
    """Writes (name, png) rows as files of their own through Spark's file systems, one partition at a time; says how many."""
    spark = images.sparkSession
    conf = {e.getKey(): e.getValue() for e in spark._jsc.hadoopConfiguration().iterator()} if folder.startswith("s3") else {}
    if conf or not (folder.startswith("file:") or folder.startswith("/")):
        raise ValueError("images go to a folder that all executors mount")
    path = folder.removeprefix("file://")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(path, exist_ok=True)
        for batch in batches:
            for name, png in zip(batch["name"], batch["png"], strict=True):
                with open(f"{path}/{name}.part", "wb") as file:
                    file.write(bytes(png))
                os.replace(f"{path}/{name}.part", f"{path}/{name}")
            yield pd.DataFrame({"n": [len(batch)]})

    return images.select("name", "png").mapInPandas(run, "n int").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
