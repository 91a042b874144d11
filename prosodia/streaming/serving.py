"""Requests and service metrics: the same columns for batches and for streams."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOICE, SPEED, FORMAT, FORMATS, RATE = "af_sarah", 1.0, "wav", ("wav", "mp3"), 24_000
GENERATION_BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0)
AUDIO_BOUNDS = (0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 30.0, 60.0)
REQUEST = "text string, voice string, speed double, format string, emphasis boolean"


def parsed(requests: DataFrame, body: str = "body") -> DataFrame:
    """Request bodies in JSON, with an ``input`` object, as columns."""
    made = F.from_json(body, f"input struct<{', '.join(c.replace(' ', ':', 1) for c in REQUEST.split(', '))}>")
    return requests.withColumn("r", made).select(*requests.columns, "r.input.*")


def validated(requests: DataFrame) -> DataFrame:
    """Defaults filled in, and ``error`` where a request can't be served: no text, or a format that is not written."""
    voice = F.coalesce(F.nullif("voice", F.lit("")), F.lit(VOICE))
    speed = F.when(F.col("speed") > 0, F.col("speed")).otherwise(SPEED)
    form = F.coalesce(F.nullif("format", F.lit("")), F.lit(FORMAT))
    filled = requests.withColumns({"voice": voice, "speed": speed, "format": form})
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    unsupported = F.concat(F.lit('unsupported format: "'), F.col("format"), F.lit('" (must be "wav" or "mp3")'))
    return filled.withColumn("error", F.when(empty, "text is required").when(~F.col("format").isin(*FORMATS), unsupported))


SPEECH = "model string, input string, voice string, response_format string, speed double, emphasis boolean"


def speech_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Request bodies of the other shape, flat and with ``input`` and ``response_format``, as those of validated(); what is
    answered is the bare audio, so its ``content_type`` is known beforehand."""
    made = F.from_json(body, SPEECH)
    rows = requests.withColumn("r", made).select(*requests.columns, F.col("r.input").alias("text"), "r.voice", "r.speed", F.col("r.response_format").alias("format"), "r.emphasis")
    checked = validated(rows)
    error = F.regexp_replace(F.regexp_replace("error", "^text is required$", "input is required"), "^unsupported format:", "unsupported response_format:")
    kind = F.when(F.col("error").isNull(), F.when(F.col("format") == "mp3", "audio/mpeg").otherwise("audio/wav"))
    return checked.withColumn("content_type", kind).withColumn("error", F.when(made.isNull(), "invalid JSON").otherwise(error))


def voice_list(voices: DataFrame) -> DataFrame:
    """(n, names, body): how many voices (name) there are, their names in order, and the same as JSON."""
    names = F.array_sort(F.collect_set("name"))
    return voices.agg(names.alias("all")).select(
        F.size("all").cast("long").alias("n"), F.array_join("all", ", ").alias("names"), F.to_json(F.struct(F.transform("all", lambda v: F.struct(v.alias("name"))).alias("voices"))).alias("body")
    )


def with_voice(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Requests with an ``error`` that names the voices there are, where a voice is not one of them."""
    held = voices.select(F.col("name").alias("voice"), F.lit(True).alias("held")).distinct()
    listed = F.broadcast(voice_list(voices).select("names"))
    rows = requests.join(held, "voice", "left").join(listed, how="left")
    missing = F.format_string('voice "%s" not found (available: %s)', "voice", "names")
    return rows.withColumn("error", F.when(F.col("held").isNull(), missing)).drop("held", "names")


def version_row(spark, build_time: str, git_hash: str, data: dict | None = None) -> DataFrame:
    """(body): when and from what this was built, and a fingerprint of the data that is loaded; none for a stand-in."""
    import json

    body = {"build_time": build_time, "git_hash": git_hash, **({"data": data} if data is not None else {})}
    return spark.createDataFrame([(json.dumps(body),)], "body string")


def stub_seconds(text: Column, speed: Column) -> Column:
    """How long a stand-in for a synthesiser speaks: 0.08 s a word."""
    return F.size(F.filter(F.split(text, " "), lambda w: w != "")) * F.lit(0.08) / speed


#: Bytes of samples, or of what is made of them, that a task holds before it hands them on.
PART = 1 << 23


def synthesised(requests: DataFrame, synthesiser: Callable[[], Callable[[str, str, float], Sequence[float]]], encoded: bool = False) -> DataFrame:
    """Adds ``samples``, ``seconds`` and ``failed``, or where ``encoded`` the file in base64 as ``audio`` in place of samples,
    so that these never leave the task. ``synthesiser`` is called once in each task and gives a function of text, voice and
    speed, so a model is loaded once for many requests; what it raises goes to ``failed``. Requests are small and take long,
    so they are dealt evenly first; what is made of them is large, so it is handed on every ``PART`` bytes."""
    from prosodia.sources.files import encode_wav

    made = (lambda samples: base64.b64encode(encode_wav(samples)).decode()) if encoded else (lambda samples: samples)
    name, kind, width = ("audio", "string", 1) if encoded else ("samples", "array<float>", 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speak = synthesiser()
        for batch in batches:
            low, size, out, seconds, failed = 0, 0, [], [], []
            done = lambda high: batch.iloc[low:high].assign(**{name: out}, seconds=seconds, failed=failed)  # noqa: B023, E731
            for i, (text, voice, speed) in enumerate(zip(batch["text"], batch["voice"], batch["speed"], strict=True), 1):
                try:
                    samples = np.asarray(speak(text, voice, float(speed)), np.float32)
                    out.append(made(samples))
                    seconds.append(len(samples) / RATE)
                    failed.append(None)
                    size += width * len(out[-1])
                except Exception as e:  # noqa: BLE001  a request that fails must not fail the others
                    del out[i - 1 - low :], seconds[i - 1 - low :]
                    out.append(None)
                    seconds.append(None)
                    failed.append(str(e))
                if size >= PART:
                    yield done(i)
                    low, size, out, seconds, failed = i, 0, [], [], []
            if out:
                yield done(len(batch))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    dealt = requests.where("error is null").repartition(max(requests.sparkSession.sparkContext.defaultParallelism, 1))
    return dealt.mapInPandas(run, f"{kinds}, {name} {kind}, seconds double, failed string")


def tone(text: str, voice: str, speed: float) -> np.ndarray:
    """A deterministic stand-in: a tone whose pitch is the voice's and whose length is the text's."""
    n = int(len(text.split(" ")) * 0.08 / speed * RATE)
    return (0.3 * np.sin(2 * np.pi * (110 + sum(voice.encode()) % 200) * np.arange(n) / RATE)).astype(np.float32)


def responses(done: DataFrame) -> DataFrame:
    """Output or error envelopes as JSON in ``body``."""
    from prosodia.sources.files import wav_of

    audio = F.col("audio") if "audio" in done.columns else F.translate(F.base64(wav_of("samples")), "\r\n", "")
    output = F.struct(audio.alias("audio"), "format", F.lit(RATE).alias("sample_rate"), F.col("seconds").alias("duration_seconds"), "voice")
    body = F.when(F.col("failed").isNull(), F.to_json(F.struct(output.alias("output")))).otherwise(F.to_json(F.struct(F.concat(F.lit("TTS synthesis failed: "), F.col("failed")).alias("error"))))
    return done.withColumn("body", body)


def counters(observed: DataFrame) -> DataFrame:
    """(voice, status, requests, characters)."""
    return observed.groupBy("voice", "status").agg(F.count("*").alias("requests"), F.sum(F.char_length("text")).alias("characters"))


def histogram(observed: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(voice, le, n, total, sum): cumulative counts of successful requests, bounds included; one row for each bound.

    One aggregation with a sum for each bound; rows are never multiplied before it.
    """
    ok = observed.where("status = 'ok'")
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = ok.groupBy("voice").agg(*sums, F.count("*").alias("total"), F.sum(value).alias("sum"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)))
    return wide.select("voice", F.explode(rows).alias("r"), "total", "sum").select("voice", "r.le", "r.n", "total", "sum")


def general(value: Column) -> Column:
    """A number without a decimal point where it is whole, else without the zeros at its end; never with an exponent."""
    plain = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"0+$", "")
    return F.when(value == F.floor(value), F.format_string("%d", value.cast("long"))).otherwise(plain)


def exposition(counted: DataFrame, histograms: dict[str, DataFrame], loaded: bool = True, prefix: str = "tts") -> DataFrame:
    """Lines of the Prometheus text format, in order: whether a model is loaded, requests by voice and status, characters
    by voice, and a histogram for each of ``histograms`` by name."""
    kind = "part int, voice string, key string, le double, line string"
    spark = counted.sparkSession
    heads = [("model_loaded", "gauge", "Whether the model is loaded."), ("requests_total", "counter", "Requests by voice and outcome."), ("characters_total", "counter", "Characters of all requests.")]
    heads += [(name, "histogram", f"{name.replace('_', ' ').capitalize()} of successful requests.") for name in histograms]
    said = [(i, "", f" {k}", 0.0, line) for i, (n, t, h) in enumerate(heads) for k, line in enumerate((f"# HELP {prefix}_{n} {h}", f"# TYPE {prefix}_{n} {t}"))]
    out = spark.createDataFrame([*said, (0, "", "a", 0.0, f"{prefix}_model_loaded {int(loaded)}")], kind)
    put = lambda frame, part, key, le, form, *values: frame.select(
        F.lit(part).alias("part"), "voice", key.alias("key"), le.alias("le"), F.format_string(form, "voice", *values).alias("line")
    )
    zero = F.lit(0.0)
    out = out.unionByName(put(counted, 1, F.col("status"), zero, prefix + '_requests_total{voice="%s",status="%s"} %d', "status", "requests"))
    letters = counted.groupBy("voice").agg(F.sum("characters").alias("n"))
    out = out.unionByName(put(letters, 2, F.lit("a"), zero, prefix + '_characters_total{voice="%s"} %d', "n"))
    for part, (name, hist) in enumerate(histograms.items(), 3):
        name = f"{prefix}_{name}"
        out = out.unionByName(put(hist, part, F.lit("a"), F.col("le"), name + '_bucket{voice="%s",le="%s"} %d', general(F.col("le")), "n"))
        ends = hist.groupBy("voice").agg(F.first("total").alias("total"), F.first("sum").alias("sum"))
        for key, form, value in (("b", name + '_bucket{voice="%s",le="+Inf"} %d', F.col("total")), ("c", name + '_sum{voice="%s"} %s', general(F.col("sum"))), ("d", name + '_count{voice="%s"} %d', F.col("total"))):
            out = out.unionByName(put(ends, part, F.lit(key), zero, form, value))
    return out.orderBy("part", "voice", "key", "le").select("line")


def windowed(stream: DataFrame, event_time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counters by window, voice and status with a watermark: state is dropped once no late row can reach it. Times
    without a zone are in the session's."""
    return (
        stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
        .withWatermark(event_time, late)
        .groupBy(F.window(event_time, width), "voice", "status")
        .agg(F.count("*").alias("requests"), F.sum(F.char_length("text")).alias("characters"))
        .select(F.col("window.start").alias("since"), "voice", "status", "requests", "characters")
    )


def serve(jobs: DataFrame, post: Callable[[DataFrame, int], None], synthesiser, checkpoint: str, once: bool = False):
    """Runs a stream of jobs (job_id, text, voice, speed, format, emphasis): validated, synthesised and posted in batches.

    At least once: a batch is posted again if the run is lost before its offsets are written, so ``post`` should go by
    job_id. Jobs with an error are posted as such in the same batch.
    """

    def batch(frame: DataFrame, number: int) -> None:
        checked = validated(frame)
        refused = checked.where("error is not null").select("job_id", F.to_json(F.struct("error")).alias("body"))
        done = responses(synthesised(checked, synthesiser, encoded=True)).select("job_id", "body")
        post(refused.unionByName(done), number)

    writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="250 milliseconds")).start()
