"""From groups of tokens to one waveform for each text: inference, trims, crossfades, pauses and silences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosodia.functions.arrow import arrow
from prosodia.operators import frontend, signal
from prosodia.sources import files

#: Samples of a crossfade, of a fade at a silence, and of a pause in a clause, at 24,000 a second; width of a style.
CROSSFADE, FADE, CLAUSE, STYLE = 480, 120, 1200, 256


def waveforms(groups: DataFrame, styles: DataFrame, model: Callable[[], Callable], speed: float = 1.0) -> DataFrame:
    """Adds ``samples`` to groups (doc_id, voice, tokens, segments, ...): segments inferred one by one, trimmed, and
    crossfaded to one waveform with clause pauses. ``failed`` says what the model raised.

    ``model`` is called once in a task and gives a function of padded tokens, style and speed. ``styles`` has (voice, row,
    style); each segment takes the row of its padded length.
    """
    placed = groups.withColumn("g", F.monotonically_increasing_id()).select("*", F.posexplode("segments").alias("s", "segment"))
    wanted = placed.select("g", "s", "voice", "segment", F.size("segment").alias("n_tokens"))
    styled = files.style_for(wanted, styles).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("s", "segment", "style"))).alias("parts"))
    rows = groups.withColumn("g", F.monotonically_increasing_id()).join(styled, "g", "left").drop("g")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = model()
        for batch in batches:
            made, failed = [], []
            for parts, tokens, places in zip(batch["parts"], batch["tokens"], batch["clause_places"], strict=True):
                try:
                    made.append(group_waveform(parts if parts is not None else [], list(tokens), list(places), infer, speed).tolist())
                    failed.append(None)
                except Exception as e:  # noqa: BLE001  a text that fails must not fail the others
                    made.append(None)
                    failed.append(str(e))
            yield batch.drop(columns=["parts"]).assign(samples=made, failed=failed)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "parts")
    return rows.mapInPandas(run, f"{kinds}, samples array<float>, failed string")


def padded(tokens, style) -> tuple[np.ndarray, np.ndarray]:
    """Tokens between two zeros and their style, or an error for a style of another width."""
    if style is None:
        raise ValueError("there is no such voice")
    if len(style) != STYLE:
        raise ValueError(f"a style has {STYLE} values, not {len(style)}")
    return np.concatenate(([0], tokens, [0])).astype(np.int64), np.asarray(style, np.float32)


def group_waveform(parts, tokens: list[int], places: list[int], infer: Callable, speed: float) -> np.ndarray:
    out = np.zeros(0, np.float32)
    for part in parts:
        if not len(part["segment"]):
            continue
        wave = np.asarray(infer(*padded(part["segment"], part["style"]), speed), np.float32)
        first, last = signal.trim_bounds(wave)
        wave = wave[first:last]
        if len(wave):
            out = signal.crossfade(out, wave, CROSSFADE) if len(out) else wave
    return signal.insert_clause_pauses(out, len(tokens), places, CLAUSE) if len(out) else out


def assembled(groups: list[dict]) -> np.ndarray:
    """One waveform from a text's groups in order (para, grp, samples, sentence_samples, paragraph_samples)."""
    out, para, now, behind, silence = np.zeros(0, np.float32), None, np.zeros(0, np.float32), 0, 0

    def close() -> None:
        nonlocal out
        if not len(now):
            return
        if len(out):
            out = np.concatenate([signal.fade_out(out, FADE), np.zeros(silence, np.float32), signal.fade_in(now, FADE)])
        else:
            out = now

    for g in groups:
        if g["para"] != para:
            close()
            if len(now):
                silence = behind
            para, now, first = g["para"], np.zeros(0, np.float32), True
        wave = np.asarray(g["samples"], np.float32)
        if not first and len(now):
            now = np.concatenate([signal.fade_out(now, FADE), np.zeros(gap, np.float32)])
        if len(wave):
            now = np.concatenate([now, wave if first else signal.fade_in(wave, FADE)])
        gap, behind, first = g["sentence_samples"], g["paragraph_samples"], False
    close()
    return finished(out)


def finished(x: np.ndarray) -> np.ndarray:
    """A soft start, wider dynamics and no silence at the ends."""
    if not len(x):
        return x
    x = signal.expand_dynamics(signal.fade_in(x, FADE))
    first, last = signal.trim_bounds(x)
    return x[first:last]


@arrow("array<float>")
def _assembled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda groups: assembled(list(groups)).tolist())


def synthesize(docs: DataFrame, front: frontend.Frontend, styles: DataFrame, model: Callable[[], Callable], voice: str, speed: float = 1.0, emphasis: bool = False) -> DataFrame:
    """(doc_id, samples, seconds, error): texts said in one voice.

    A text is said as a whole, so one row holds its waveform: some hundred megabytes for a book. A run is cancelled as all
    Spark work is, by its tag, before the next batch of groups. ``error`` is the first reason why nothing could be said.
    """
    groups = frontend.voiced_plan(frontend.tokenize_text(docs, front, emphasis)).withColumn("voice", F.lit(voice))
    made = waveforms(groups, styles, model, speed)
    part = F.struct("para", "grp", "samples", "sentence_samples", "paragraph_samples")
    each = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("failed").isNull(), part))).alias("groups"), F.min("failed").alias("failed"))
    said = docs.select("doc_id", "text").join(each, "doc_id", "left")
    empty = F.when(F.coalesce("text", F.lit("")) == "", "text is empty").when(F.col("groups").isNull(), "no tokens produced from text")
    rows = said.select("doc_id", F.coalesce(empty, F.col("failed")).alias("error"), F.when(empty.isNull() & F.col("failed").isNull(), F.col("groups")).alias("groups"))
    spoken = rows.where("groups is not null").select("doc_id", "error", _assembled(F.col("groups")).alias("samples"))
    none = rows.where("groups is null").select("doc_id", "error", F.lit(None).cast("array<float>").alias("samples"))
    error = F.coalesce("error", F.when(F.size("samples") == 0, "no audio produced"))
    return spoken.unionByName(none).select("doc_id", "samples", F.round(F.size("samples") / F.lit(float(files.RATE)), 3).alias("seconds"), error.alias("error"))


def tone_model() -> Callable:
    """A deterministic stand-in for a model: a tone of 1,200 samples a token, as high as the style says."""

    def infer(tokens: np.ndarray, style: np.ndarray, speed: float) -> np.ndarray:
        n = int(1200 * (len(tokens) - 2) / speed)
        return (0.3 * np.sin(2 * np.pi * (150 + 50 * float(style[0])) * np.arange(n) / files.RATE)).astype(np.float32)

    return infer
