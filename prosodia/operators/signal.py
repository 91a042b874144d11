"""Signal analytics: numpy kernels for whole clips in Arrow batches, and relational forms over long tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosodia.functions.arrow import arrow

RATE = 24_000


def _array(samples) -> np.ndarray:
    return np.asarray(samples if samples is not None else [], np.float32).astype(np.float64)


def _frames(x: np.ndarray, size: int, hop: int, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n] if n > 0 else np.zeros((0, size))


def frame_rms(x: np.ndarray, size: int, hop: int, n: int) -> np.ndarray:
    return np.sqrt((_frames(x, size, hop, n) ** 2).mean(axis=1)) if n > 0 else np.zeros(0)


def _decibel(rms: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return 20 * np.log10(rms / rms.max())


def pauses(samples, rate: int = RATE, threshold: float = -40.0, least: float = 0.1, size: int = 2048, hop: int = 512) -> list[tuple[float, float]]:
    """(start, end) in seconds of silences; the last ends with the clip."""
    x = _array(samples)
    total = len(x) / rate
    if len(x) < size:
        return []
    rms = frame_rms(x, size, hop, 1 + (len(x) - size) // hop)
    if rms.max() == 0:
        return [(0.0, total)]
    silent = np.concatenate(([0], (_decibel(rms) <= threshold).astype(int), [0]))
    opens, closes = np.nonzero(np.diff(silent) == 1)[0], np.nonzero(np.diff(silent) == -1)[0]
    found = [(a * hop / rate, total if z == len(rms) else z * hop / rate) for a, z in zip(opens, closes, strict=True)]
    return [(a, z) for a, z in found if z - a >= least]


def trim_bounds(samples, floor: float = 60.0, size: int = 2048, hop: int = 512) -> tuple[int, int]:
    """Sample bounds of what is louder than ``floor`` below the peak frame."""
    x = _array(samples)
    if len(x) < size:
        return 0, len(x)
    rms = frame_rms(x, size, hop, 1 + (len(x) - size) // hop)
    if rms.max() == 0:
        return 0, 0
    loud = np.nonzero(_decibel(rms) > -floor)[0]
    return (int(loud[0]) * hop, min(int(loud[-1] + 1) * hop, len(x))) if len(loud) else (0, 0)


#: Levels below which a frame is quiet, and below which there is no ratio to the next.
QUIET, NOTHING = 0.001, 1e-6


def level_glitches(rms: np.ndarray, hop: int) -> list[tuple[str, int, float]]:
    """Spikes and dropouts of frame levels. A frame of over four times the level before is a spike, unless it opens speech:
    four of the six frames before are quiet, or the one before is nearly so. A fall by over 20 dB is a dropout if the next
    frame is twice as loud again."""
    if len(rms) < 2:
        return []
    before, now = rms[:-1], rms[1:]
    held = before > NOTHING
    ratio = np.divide(now, before, out=np.ones_like(now), where=held)
    quiet = np.concatenate(([0], np.cumsum(rms < QUIET)))
    at = np.arange(1, len(rms))
    loud = held & (ratio > 4.0)
    onset = loud & ((quiet[at] - quiet[np.maximum(at - 6, 0)] >= 4) | (before < 0.005))
    fall = 20 * np.log10(np.maximum(ratio, 1e-300))
    after = np.append(rms[2:], 0.0)
    drop = held & ~onset & (now > NOTHING) & (fall < -20) & (after > 2 * now)
    found = [("spike", int(i) * hop, float(ratio[i - 1])) for i in at[loud & ~onset]]
    return sorted(found + [("dropout", int(i) * hop, float(-fall[i - 1])) for i in at[drop]], key=lambda g: g[1])


def mean_jumps(x: np.ndarray, window: int = 512, least: float = 0.08) -> list[tuple[str, int, float]]:
    """Places where the mean of the next window is far from that of the one before."""
    at = np.arange(window, len(x) - window, window // 2)
    sums = np.concatenate(([0.0], np.cumsum(x)))
    jump = np.abs(sums[at + window] - 2 * sums[at] + sums[at - window]) / window
    return [("dc_jump", int(i), float(j) / least) for i, j in zip(at[jump > least], jump[jump > least], strict=True)]


def glitches(samples, rate: int = RATE, size: int = 128, hop: int = 64) -> list[tuple[str, int, float]]:
    """(type, sample, severity): spikes and dropouts by place, then jumps of the mean."""
    x = _array(samples)
    if len(x) < 2 * size:
        return []
    return level_glitches(frame_rms(x, size, hop, (len(x) - size) // hop), hop) + mean_jumps(x)


def _parabola(d: np.ndarray, tau: int, last: int) -> float:
    if tau < 1 or tau >= last:
        return float(tau)
    a, b, c = d[tau - 1 : tau + 2]
    bend = 2 * (a - 2 * b + c)
    return float(tau) if abs(bend) < 1e-10 else tau + (a - c) / bend


def yin(frame: np.ndarray, rate: int, low: int, high: int, threshold: float = 0.15) -> float:
    """The fundamental frequency of one frame by cumulative mean normalised differences; 0 if it is unvoiced."""
    n = len(frame) // 2
    high = min(high, n - 1)
    if low >= high:
        return 0.0
    lagged = np.lib.stride_tricks.sliding_window_view(frame, n)[1 : high + 1]
    d = np.concatenate(([0.0], ((frame[:n] - lagged) ** 2).sum(axis=1)))
    running = np.cumsum(d)
    flat = np.where(running < 1e-10, 1.0, d * np.arange(high + 1) / np.where(running < 1e-10, 1.0, running))
    flat[0] = 1.0
    for tau in np.nonzero(flat[low:high] < threshold)[0] + low:
        if flat[tau] <= flat[tau + 1]:
            fine = _parabola(flat, int(tau), high)
            return rate / fine if fine > 0 else rate / float(tau)
    return 0.0


def pitch(samples, rate: int = RATE) -> list[tuple[float, float]]:
    """(time, f0) each 10 ms, from windows of 50 ms between 60 and 500 Hz; f0 is 0 where unvoiced."""
    x = np.asarray(samples if samples is not None else [], np.float32)
    hop, size = rate * 10 // 1000, rate * 50 // 1000
    if len(x) <= size:
        return []
    high = rate // 60
    high = size // 2 - 1 if high >= size // 2 else high
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    return [(i * hop / rate, yin(f.astype(np.float64), rate, rate // 500, high)) for i, f in enumerate(frames)]


def envelope(samples, window: int) -> np.ndarray:
    """RMS in a centred window, shortened at the edges, from prefix sums."""
    x = _array(samples)
    half, n = window // 2, len(x)
    sums = np.concatenate(([0.0], np.cumsum(x * x)))
    low, high = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return np.sqrt(np.maximum(sums[high] - sums[low], 0) / np.maximum(high - low, 1))


def smooth(gain: np.ndarray, window: int) -> np.ndarray:
    if window <= 1 or len(gain) <= window:
        return gain
    half, n = window // 2, len(gain)
    sums = np.concatenate(([0.0], np.cumsum(gain)))
    low, high = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    return (sums[high] - sums[low]) / (high - low)


def expand_dynamics(samples, rate: int = RATE) -> np.ndarray:
    """Louder parts louder and softer ones softer, the peak as before: gain is the square root of the local level over
    the reference level, between 0.7 and 1.6, eased in and out at the edges and smoothed over 100 ms."""
    x32 = np.asarray(samples if samples is not None else [], np.float32)
    x, n = x32.astype(np.float64), len(x32)
    heard = np.abs(x) > 1e-8
    if not n or not heard.any():
        return x32
    window = min(rate * 300 // 1000, n)
    level = envelope(x, window)
    reference = np.sqrt((x[heard] ** 2).mean())
    if reference < 1e-10:
        return x32
    with np.errstate(divide="ignore"):
        soft = (level < 1e-10) | (20 * np.log10(np.maximum(level, 1e-300)) < 20 * np.log10(reference) - 50.0)
    gain = np.where(soft, 1.0, np.clip(np.sqrt(level / reference), 0.7, 1.6))
    half = window // 2
    ramp = np.arange(half) / max(half, 1)
    gain[:half] = 1 + (gain[:half] - 1) * ramp
    gain[n - half :] = 1 + (gain[n - half :] - 1) * ramp[::-1]
    loud = x * smooth(gain, rate * 100 // 1000)
    peak, before = np.abs(loud).max(), np.abs(x).max()
    out = loud.astype(np.float32)
    return out * np.float32(before / peak) if peak > 0 and before > 0 else out


def spectrogram(samples, size: int = 2048, hop: int = 512, rate: int = RATE, top: int = 8000) -> np.ndarray:
    """Decibels below the loudest bin, -80 at least: frames by bins up to ``top`` Hz, symmetric Hann window."""
    x = _array(samples)
    n = 1 + (len(x) - size) // hop if len(x) >= size else 0
    bins = min(top * size // rate, size // 2)
    if n <= 0:
        return np.zeros((0, bins))
    power = np.abs(np.fft.rfft(_frames(x, size, hop, n) * np.hanning(size), axis=1))[:, :bins]
    level = 20 * np.log10(power + 1e-10)
    return np.maximum(level - level.max(), -80.0)


def hot_colour(t: float) -> tuple[int, int, int]:
    """A ramp from black through blue, magenta and orange to pale yellow."""
    t = min(max(t, 0.0), 1.0)
    stops = ((0, 0, 0), (40, 0, 120), (180, 20, 110), (240, 110, 20), (250, 210, 60), (255, 255, 220))
    k = min(int(t * 5), 4)
    return tuple(round(a + (b - a) * (t * 5 - k)) for a, b in zip(stops[k], stops[k + 1], strict=True))


# --- synthesis timeline ---------------------------------------------------------------------------------------------


def crossfade(a: np.ndarray, b: np.ndarray, n: int = 480) -> np.ndarray:
    """Overlap-add with a raised cosine; put together plainly where either is too short."""
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32)
    if n <= 0 or len(a) < n or len(b) < n:
        return np.concatenate([a, b])
    fade = 0.5 * (1 + np.cos(np.pi * np.arange(n) / n)) if n > 1 else np.ones(1)
    mixed = (a[len(a) - n :] * fade + b[:n] * (1 - fade)).astype(np.float32)
    return np.concatenate([a[: len(a) - n], mixed, b[n:]])


def fade_in(x: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(x))
    return np.concatenate([x[:n] * np.arange(n, dtype=np.float32) / max(n, 1), x[n:]])


def fade_out(x: np.ndarray, n: int) -> np.ndarray:
    return fade_in(x[::-1], n)[::-1]


def quietest(x: np.ndarray, at: int, radius: int = 1200, size: int = 240, step: int = 120) -> int:
    """The middle of the softest frame around a place."""
    best, place = None, at
    for start in range(max(0, at - radius), min(len(x) - size, at + radius) + 1, step):
        level = float((x[start : start + size].astype(np.float64) ** 2).mean())
        if best is None or level < best:
            best, place = level, start + size // 2
    return place


def insert_silence(x: np.ndarray, at: int, n: int, fade: int = 360) -> np.ndarray:
    at = min(max(at, 0), len(x))
    return np.concatenate([fade_out(x[:at], fade), np.zeros(n, np.float32), fade_in(x[at:], fade)])


def insert_clause_pauses(x: np.ndarray, n_tokens: int, places: list[int], n: int = 1200) -> np.ndarray:
    """From right to left, so that earlier places stay valid; each goes to the softest spot near its share of the clip."""
    for place in sorted(places, reverse=True):
        x = insert_silence(x, quietest(x, int(len(x) * place / max(n_tokens, 1))), n)
    return x


# --- columns and tables ---------------------------------------------------------------------------------------------


def kernel(function: Callable, returns: str) -> Callable[[Column], Column]:
    """A kernel over one array of samples as an Arrow-batched column; for a struct it gives a dictionary."""
    if returns.startswith("struct"):

        @arrow(returns)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame(batch.map(function).tolist())

    else:

        @arrow(returns)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(function)

    return run


pitch_frames = kernel(lambda s: [{"t": t, "f0": f} for t, f in pitch(s)], "array<struct<t:double,f0:double>>")
pause_spans = kernel(lambda s: [{"start": a, "end": z} for a, z in pauses(s)], "array<struct<start:double,end:double>>")
glitch_list = kernel(lambda s: [{"type": k, "sample": i, "severity": float(v)} for k, i, v in glitches(s)], "array<struct<type:string,sample:int,severity:double>>")
trimmed = kernel(lambda s: None if s is None else s[slice(*trim_bounds(s))], "array<float>")
expanded = kernel(lambda s: None if s is None else expand_dynamics(s), "array<float>")
spectra = kernel(lambda s: spectrogram(s).tolist(), "array<array<double>>")


def pitch_stats(frames: DataFrame) -> DataFrame:
    """Statistics of voiced frames (clip_id, t, f0) of each clip; population deviation and exact median."""
    voiced = F.when(F.col("f0") > 0, F.col("f0"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return frames.groupBy("clip_id").agg(
        (100 * F.count(voiced) / F.count("*")).alias("voiced_pct"),
        zero(F.avg(voiced), "mean_f0"),
        zero(F.percentile(voiced, F.lit(0.5)), "median_f0"),
        zero(F.stddev_pop(voiced), "sd_f0"),
        zero(F.min(voiced), "min_f0"),
        zero(F.max(voiced), "max_f0"),
    )


def rms(samples: Column) -> Column:
    """Root mean square of an array, 0 for an empty one."""
    total = F.aggregate(samples, F.lit(0.0), lambda acc, s: acc + s.cast("double") * s.cast("double"))
    return F.coalesce(F.sqrt(F.try_divide(total, F.size(samples))), F.lit(0.0))


def frames(clips: DataFrame, size: int = 2048, hop: int = 512, plus_one: bool = True, samples: str = "samples") -> DataFrame:
    """(clip_id, frame, rms, n): frame levels of arrays, inside the plan."""
    n = F.floor((F.size(samples) - size) / hop) + (1 if plus_one else 0)
    wide = clips.where(F.size(samples) >= size).select("clip_id", samples, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("frame"))
    return wide.select("clip_id", "frame", rms(F.slice(samples, F.col("frame") * hop + 1, size)).alias("rms"), F.size(samples).alias("n"))


def pause_islands(levels: DataFrame, rate: int = RATE, threshold: float = -40.0, least: float = 0.1, hop: int = 512) -> DataFrame:
    """(clip_id, start_s, end_s) from frame levels: runs of silent frames by a running count of changes.

    Level 0 is silent without a logarithm; the last run ends with the clip.
    """
    clip = Window.partitionBy("clip_id")
    order = clip.orderBy("frame")
    peak = F.max("rms").over(clip)
    silent = (F.col("rms") == 0) | (20 * F.log10(F.try_divide(F.when(F.col("rms") > 0, F.col("rms")), peak)) <= threshold)
    rows = levels.withColumns({"silent": silent, "last": F.max("frame").over(clip)})
    rows = rows.withColumn("changed", (F.lag("silent").over(order).isNull() | (F.lag("silent").over(order) != F.col("silent"))).cast("int"))
    rows = rows.withColumn("island", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("silent")
    spans = rows.groupBy("clip_id", "island").agg(F.min("frame").alias("a"), F.max("frame").alias("z"), F.max("last").alias("last"), F.max("n").alias("n"))
    end = F.when(F.col("z") == F.col("last"), F.col("n")).otherwise((F.col("z") + 1) * hop) / F.lit(float(rate))
    spans = spans.select("clip_id", (F.col("a") * hop / F.lit(float(rate))).alias("start_s"), end.alias("end_s"))
    return spans.where(F.col("end_s") - F.col("start_s") >= least)


def stress_peak(samples: Column, parts: Column) -> Column:
    """Where the loudest of equal slices lies: (index + 0.5) / parts; the last slice takes the rest."""
    n = F.greatest(F.floor(F.size(samples) / parts), F.lit(1)).cast("int")
    level = lambda i: rms(F.slice(samples, i * n + 1, F.when(i == parts - 1, F.greatest(F.size(samples) - i * n, F.lit(0))).otherwise(n)))
    levels = F.transform(F.sequence(F.lit(0), parts - 1), level)
    return (F.array_position(levels, F.array_max(levels)) - F.lit(0.5)) / parts


def blend(a: Column, b: Column, weight: Column) -> Column:
    """Element by element, ``weight`` of the second, in single precision."""
    w = weight.cast("float")
    return F.zip_with(a, b, lambda x, y: x * (F.lit(1).cast("float") - w) + y * w)
