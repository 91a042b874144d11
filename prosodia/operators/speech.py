"""Measurements of words and sentences in clips: levels, pitch, intonation, stress, and what two renderings differ in.

Clips have (clip_id, samples, rate), alignments (clip_id, pos, word, start_ms, end_ms, confidence), sources (clip_id, text).
A clip's words are brought to its samples as one array and cut out of them in place, so samples are moved once and never
repeated for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosodia.functions.arrow import arrow
from prosodia.functions.phonology import syllables
from prosodia.operators import distance, signal

HOP_MS = 10
_WORD = ("pos", "word", "start_ms", "end_ms", "confidence")


def sample_of(ms: Column, rate: Column) -> Column:
    """The sample at a time in milliseconds, cut to a whole one."""
    return F.floor(ms * rate / F.lit(1000)).cast("int")


def timestamp(ms: Column) -> Column:
    """mm:ss.mmm; minutes go on beyond 99."""
    whole = F.floor(ms / 1000)
    return F.format_string("%02d:%02d.%03d", F.floor(whole / 60).cast("long"), (whole % 60).cast("long"), (ms % 1000).cast("long"))


def in_words(alignment: DataFrame) -> DataFrame:
    """(clip_id, words): the words of each clip in order."""
    return alignment.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct(*_WORD))).alias("words"))


def span_rms(samples: Column, first: Column, last: Column) -> Column:
    """Level of samples from ``first`` on and before ``last``; 0 for an empty span."""
    n = F.least(last, F.size(samples)) - first
    return F.when((n > 0) & (first >= 0), signal.rms(F.slice(samples, F.greatest(first, F.lit(0)) + 1, F.greatest(n, F.lit(0))))).otherwise(F.lit(0.0))


def frames_of(start_ms: Column, end_ms: Column, hop_ms: int = HOP_MS) -> tuple[Column, Column]:
    """First frame at or after a start, and first at or after an end: those between lie within."""
    return F.ceil(start_ms / hop_ms).cast("int"), F.ceil(end_ms / hop_ms).cast("int")


def word_pitch(alignment: DataFrame, frames: DataFrame, hop_ms: int = HOP_MS) -> DataFrame:
    """(clip_id, pos, f0): mean of the voiced frames (clip_id, frame, f0) within each word, 0 for none.

    Frames lie ``hop_ms`` apart, so the interval join is one of equal frame numbers: a row for each frame of a word, as
    many as the clip has where words do not overlap.
    """
    first, after = frames_of(F.col("start_ms"), F.col("end_ms"), hop_ms)
    held = alignment.select("clip_id", "pos", F.when(after > first, F.sequence(first, after - 1)).alias("held"))
    spread = held.select("clip_id", "pos", F.explode("held").alias("frame"))
    voiced = frames.where("f0 > 0").select("clip_id", "frame", "f0")
    means = spread.join(voiced, ["clip_id", "frame"]).groupBy("clip_id", "pos").agg(F.avg("f0").alias("f0"))
    return alignment.select("clip_id", "pos").join(means, ["clip_id", "pos"], "left").select("clip_id", "pos", F.coalesce("f0", F.lit(0.0)).alias("f0"))


def voiced_between(f0: Column, start_ms: Column, end_ms: Column, hop_ms: int = HOP_MS) -> Column:
    """The voiced values of an array of frames within a time range, in order."""
    first, after = frames_of(start_ms, end_ms, hop_ms)
    return F.filter(F.slice(f0, F.greatest(first, F.lit(0)) + 1, F.greatest(after - F.greatest(first, F.lit(0)), F.lit(0))), lambda x: x > 0)


def mean_of(values: Column) -> Column:
    """Mean of an array, 0 for an empty one."""
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values)), F.lit(0.0))


def prominence(clips: DataFrame, alignment: DataFrame, f0: Column | None = None) -> DataFrame:
    """(clip_id, pos, word, rms, f0, duration) of each word: what emphasis is measured by.

    ``f0`` is an array of frames of the clips 10 ms apart; without it pitch is extracted from the samples.
    """
    frames = F.transform(signal.pitch_frames(F.col("samples")), lambda x: x["f0"]) if f0 is None else f0
    rows = clips.withColumn("f0s", frames).join(in_words(alignment), "clip_id")
    size = F.size("samples")

    def measured(w: Column) -> Column:
        last = F.least(sample_of(w["end_ms"], F.col("rate")), size)
        first = F.least(sample_of(w["start_ms"], F.col("rate")), last)
        return F.struct(
            w["pos"].alias("pos"), w["word"].alias("word"),
            span_rms(F.col("samples"), first, last).alias("rms"),
            mean_of(voiced_between(F.col("f0s"), w["start_ms"], w["end_ms"])).alias("f0"),
            ((w["end_ms"] - w["start_ms"]) / F.lit(1000.0)).alias("duration"),
        )

    return rows.select("clip_id", F.explode(F.transform("words", measured)).alias("m")).select("clip_id", "m.*")


# --- intonation -----------------------------------------------------------------------------------------------------


def plain_sentences(text: Column) -> Column:
    """array<struct<text, question, words>>: a text cut at every . ! and ?; sentences without a plain word are left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?]*[.!?]|[^.!?]+$"), F.lit(0))
    trimmed = F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    made = F.transform(trimmed, lambda s: F.struct(s.alias("text"), s.endswith("?").alias("question"), distance.plain(s).alias("words")))
    return F.filter(made, lambda s: F.size(s["words"]) > 0)


_TIMED = "array<struct<sent:int,start_ms:long,end_ms:long>>"


def sentence_times(sentences: list[list[str]], heard: list[tuple[str, int, int]]) -> list[dict]:
    """Times of sentences by matching their words on those that were heard, forward only: a sentence starts at the next
    occurrence of its first word and ends at the last of its words that is found in order; one whose first word does not
    come is left out."""
    plain = ["".join(distance.plain_words(w)) for w, _, _ in heard]
    out, at = [], 0
    for k, words in enumerate(sentences):
        if at >= len(plain):
            break
        try:
            first = plain.index(words[0], at)
        except ValueError:
            continue
        last, wanted = first, 0
        for i in range(first, len(plain)):
            if wanted == len(words):
                break
            if plain[i] == words[wanted]:
                last, wanted = i, wanted + 1
        out.append({"sent": k, "start_ms": heard[first][1], "end_ms": heard[last][2]})
        at = last + 1
    return out


@arrow(_TIMED)
def _times(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for sentences, words in batches:
        rows = []
        for ss, ws in zip(sentences, words, strict=True):
            heard = [(w["word"], int(w["start_ms"]), int(w["end_ms"])) for w in ws]
            rows.append(sentence_times([list(s["words"]) for s in ss], heard))
        yield pd.Series(rows)


def timed_sentences(alignment: DataFrame, sources: DataFrame) -> DataFrame:
    """(clip_id, sent, text, question, n_words, start_ms, end_ms) of the sentences that were heard."""
    rows = in_words(alignment).join(sources.select("clip_id", plain_sentences(F.col("text")).alias("sentences")), "clip_id")
    timed = rows.select("clip_id", "sentences", F.explode(_times(F.col("sentences"), F.col("words"))).alias("t"))
    one = F.element_at("sentences", F.col("t.sent") + 1)
    return timed.select("clip_id", "t.sent", one["text"].alias("text"), one["question"].alias("question"), F.size(one["words"]).alias("n_words"), "t.start_ms", "t.end_ms")


def intonation(clips: DataFrame, alignment: DataFrame, sources: DataFrame, f0: Column | None = None) -> DataFrame:
    """Monotone sentences, questions that fall and statements that rise: (clip_id, sent, start_ms, end_ms, type, severity,
    f0_range, f0_start, f0_end, avg_range, context)."""
    frames = F.transform(signal.pitch_frames(F.col("samples")), lambda x: x["f0"]) if f0 is None else f0
    timed = timed_sentences(alignment, sources)
    each = timed.groupBy("clip_id").agg(F.collect_list(F.struct("sent", "text", "question", "n_words", "start_ms", "end_ms")).alias("ss"))
    rows = clips.select("clip_id", frames.alias("f0s")).join(each, "clip_id")
    cut = F.transform("ss", lambda s: F.struct(s.alias("s"), voiced_between(F.col("f0s"), s["start_ms"], s["end_ms"]).alias("f0")))
    voiced = F.filter(cut, lambda x: F.size(x["f0"]) >= 2)
    ranges = F.transform(voiced, lambda x: F.array_max(x["f0"]) - F.array_min(x["f0"]))
    heard = rows.select("clip_id", mean_of(ranges).alias("avg_range"), F.explode(voiced).alias("x")).select("clip_id", "avg_range", "x.s.*", "x.f0")
    return distance.intonation(heard, "avg_range", F.col("text").alias("context"))


# --- stress ---------------------------------------------------------------------------------------------------------


@arrow("array<struct<source:int,one:int,two:int>>")
def _matches(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, ones, twos in batches:
        rows = []
        for text, one, two in zip(texts, ones, twos, strict=True):
            source = distance.plain_words(text)
            a, b = (dict(distance.matched([trimmed_word(w["word"]) for w in ws], source)) for ws in (one, two))
            rows.append([{"source": i, "one": a[i], "two": b[i]} for i in range(len(source)) if i in a and i in b])
        yield pd.Series(rows)


def trimmed_word(word: str) -> str:
    """Lower case, without what is no letter or digit at either end."""
    first, last = 0, len(word)
    while first < last and not (word[first].isalpha() or word[first].isdecimal()):
        first += 1
    while last > first and not (word[last - 1].isalpha() or word[last - 1].isdecimal()):
        last -= 1
    return word[first:last].lower()


def _peak(samples: Column, rate: Column, word: Column, parts: Column) -> Column:
    last = F.least(sample_of(word["end_ms"], rate), F.size(samples))
    first = sample_of(word["start_ms"], rate)
    cut = F.slice(samples, F.greatest(first, F.lit(0)) + 1, F.greatest(last - first, F.lit(0)))
    return F.when(last > first, signal.stress_peak(cut, parts)).otherwise(F.lit(0.0))


def compared_words(one: DataFrame, two: DataFrame, one_words: DataFrame, two_words: DataFrame, sources: DataFrame) -> DataFrame:
    """(clip_id, source, word, parts, start_ms, one_peak, two_peak, context): words of two syllables or more that both
    renderings of a text have, and where each has its loudest syllable."""
    rows = (
        sources.join(in_words(one_words).withColumnRenamed("words", "w1"), "clip_id")
        .join(in_words(two_words).withColumnRenamed("words", "w2"), "clip_id")
        .withColumn("pairs", _matches(F.col("text"), F.col("w1"), F.col("w2")))
        .join(one.select("clip_id", F.col("samples").alias("s1"), F.col("rate").alias("r1")), "clip_id")
        .join(two.select("clip_id", F.col("samples").alias("s2"), F.col("rate").alias("r2")), "clip_id")
        .withColumn("plain", distance.plain(F.col("text")))
        .withColumn("ws", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    )

    def made(p: Column) -> Column:
        word = F.element_at("plain", p["source"] + 1)
        a, b = F.element_at("w1", p["one"] + 1), F.element_at("w2", p["two"] + 1)
        parts = syllables(word)
        return F.struct(
            p["source"].alias("source"), word.alias("word"), parts.alias("parts"), a["start_ms"].alias("start_ms"),
            F.when(parts >= 2, _peak(F.col("s1"), F.col("r1"), a, parts)).alias("one_peak"),
            F.when(parts >= 2, _peak(F.col("s2"), F.col("r2"), b, parts)).alias("two_peak"),
            around(F.col("ws"), p["source"]).alias("context"),
        )

    return rows.select("clip_id", F.explode(F.transform("pairs", made)).alias("m")).select("clip_id", "m.*").where("parts >= 2")


def around(words: Column, at: Column, half: int = 4) -> Column:
    """The words around a place, itself in capitals, with dots where more precede or follow."""
    first = F.greatest(at - half, F.lit(0))
    near = F.slice(words, first + 1, F.lit(2 * half + 1) - (first - (at - half)))
    said = F.transform(near, lambda w, i: F.when(i + first == at, F.upper(w)).otherwise(w))
    return F.concat(F.when(first > 0, "...").otherwise(""), F.array_join(said, " "), F.when(at + half + 1 < F.size(words), "...").otherwise(""))


def stress(compared: DataFrame) -> DataFrame:
    """The words of compared_words() whose loudest syllables lie too far apart, with a severity."""
    severity = distance.stress_severity(F.abs(F.col("one_peak") - F.col("two_peak")), F.col("parts"))
    return compared.withColumn("severity", severity).where("severity is not null")


# --- reports --------------------------------------------------------------------------------------------------------

PAUSE_METRICS = ("total_s", "speech_s", "silence_s", "silence_ratio", "pauses", "avg_pause", "max_pause")
PITCH_METRICS = ("mean_f0", "median_f0", "sd_f0", "min_f0", "max_f0", "voiced_pct", "range_f0")
SEVERE = 35.0


def pause_summary(pauses: DataFrame, clips: DataFrame) -> DataFrame:
    """One row for each of ``clips`` (clip_id, total_s) from its pauses (clip_id, start_s, end_s)."""
    d = F.col("end_s") - F.col("start_s")
    per = pauses.groupBy("clip_id").agg(F.sum(d).alias("silence_s"), F.count("*").alias("pauses"), F.avg(d).alias("avg_pause"), F.max(d).alias("max_pause"))
    rows = clips.join(per, "clip_id", "left").fillna(0, ["silence_s", "pauses", "avg_pause", "max_pause"])
    ratio = F.coalesce(F.try_divide(F.col("silence_s"), F.col("total_s")), F.lit(0.0))
    return rows.select("clip_id", "total_s", (F.col("total_s") - F.col("silence_s")).alias("speech_s"), "silence_s", ratio.alias("silence_ratio"), "pauses", "avg_pause", "max_pause")


def versus(reference: DataFrame, test: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(clip_id, metric, ref, test, diff): the same measurements of two renderings, one row each; a clip that one side
    lacks has nulls there."""
    long = lambda frame, name: frame.select("clip_id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("x")).select("clip_id", "x.*")
    both = long(reference, "ref").join(long(test, "test"), ["clip_id", "metric"], "full_outer")
    return both.withColumn("diff", F.col("test") - F.col("ref"))


def report_row(label: Column, ref: Column, test: Column) -> Column:
    """A line of a report: label, both values and the signed difference, to three decimals."""
    diff = test - ref
    return F.format_string("%-24s %10.3f %10.3f %9s%.3f", label, ref, test, F.when(diff < 0, "").otherwise("+"), diff)


def glitch_summary(found: DataFrame, severe: float = SEVERE) -> DataFrame:
    """(clip_id, glitches, severe, worst) from glitches (clip_id, type, sample, severity); ``worst`` lists the severe ones
    in order: natural speech has many small ones."""
    worst = F.array_sort(F.collect_list(F.when(F.col("severity") >= severe, F.struct("sample", "type", "severity"))))
    return found.groupBy("clip_id").agg(F.count("*").alias("glitches"), F.count_if(F.col("severity") >= severe).alias("severe"), worst.alias("worst"))


def unified_issues(emphasis: DataFrame, pacing: DataFrame, pronunciation: DataFrame, intonations: DataFrame, stresses: DataFrame, alignment: DataFrame) -> DataFrame:
    """(clip_id, category, type, start_ms, end_ms, severity, context): the issues of all five detectors."""
    times = alignment.select("clip_id", "pos", "start_ms", "end_ms")
    columns = ("clip_id", "category", "type", "start_ms", "end_ms", "severity", "context")
    placed = emphasis.join(times, ["clip_id", "pos"]).withColumn("context", F.upper("word"))
    stressed = stresses.withColumns({"type": F.lit("stress_mismatch"), "end_ms": F.col("start_ms")})
    each = (("emphasis", placed), ("pacing", pacing), ("pronunciation", pronunciation), ("intonation", intonations), ("stress", stressed))
    out = None
    for name, frame in each:
        rows = frame.withColumn("category", F.lit(name)).select(*(F.col(c).cast("long") if c in ("start_ms", "end_ms") else F.col(c) for c in columns))
        out = rows if out is None else out.unionByName(rows)
    return out


def diagnosis_report(diagnosis: DataFrame, data_dir: str = "", fingerprint: str = "", sources: str = "") -> DataFrame:
    """(report): one row of JSON with total_words, counts by source, the data's name and fingerprint, and inventories of
    first occurrences: letter-to-sound, skipped and silver words, and those of further ``sources`` asked for."""
    asked = sorted({s.strip() for s in sources.split(",")} - {"", "lts", "skip", "silver"})
    shown = ["lts", "skip", "silver", *asked]
    low = diagnosis.withColumn("key", F.lower("word"))
    place = F.struct("doc_id", "para", "sent", "pos")
    first = low.groupBy("source", "key").agg(F.count("*").alias("n"), F.min(F.struct(place.alias("at"), F.col("word"), F.col("phonemes"), F.col("rule"))).alias("f"))
    entry = F.struct(F.col("f.word").alias("word"), F.col("f.phonemes").alias("phonemes"), F.col("f.rule").alias("rule"))
    listed = F.when(F.col("source").isin(*shown), F.struct(F.col("key"), entry.alias("entry")))
    by = first.groupBy("source").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(listed)).alias("all"))
    rows = by.agg(
        F.sum("n").alias("total_words"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("counts"),
        F.map_from_entries(F.collect_list(F.struct("source", F.transform("all", lambda x: x["entry"]).alias("all")))).alias("found"),
    )
    none = F.array().cast("array<struct<word:string,phonemes:string,rule:string>>")
    named = [F.coalesce(F.try_element_at("found", F.lit(s)), none).alias(f"{s}_inventory") for s in shown]
    return rows.select(F.to_json(F.struct(F.coalesce("total_words", F.lit(0)).alias("total_words"), "counts", F.lit(data_dir).alias("data_dir"), F.lit(fingerprint).alias("data_fingerprint"), *named)).alias("report"))


def generation_summary(sections: DataFrame) -> DataFrame:
    """(story_id, sections, audio_s, generation_s, real_time_factor) from rows (story_id, position, audio_s, generation_s)."""
    total = sections.groupBy("story_id").agg(F.count("*").alias("sections"), F.sum("audio_s").alias("audio_s"), F.sum("generation_s").alias("generation_s"))
    return total.withColumn("real_time_factor", F.try_divide(F.col("audio_s"), F.col("generation_s")))
