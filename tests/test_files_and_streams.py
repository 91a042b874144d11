import io
import json
import zipfile

import numpy as np
import pytest

from prosodia.sources import files
from prosodia.streaming import serving


def test_wav_round_trip(spark, tmp_path):
    samples = [0.0, 0.5, -0.5, 1.0, -1.0, 2.0]
    (tmp_path / "a.wav").write_bytes(files.encode_wav(samples, title="odd"))
    (tmp_path / "b.wav").write_bytes(b"no wav at all")
    got = {r["path"][-5:]: r for r in files.read_wavs(spark, f"file://{tmp_path}").collect()}
    assert got["a.wav"]["sample_rate"] == 24_000 and got["a.wav"]["channels"] == 1
    assert np.allclose(got["a.wav"]["samples"], np.clip(samples, -1, 1), atol=1e-4)
    assert got["b.wav"]["samples"] is None and "RIFF" in got["b.wav"]["error"]


def test_voices(spark, tmp_path):
    style = np.arange(12, dtype="<f4").reshape(4, 1, 3)
    with zipfile.ZipFile(tmp_path / "v.npz", "w") as archive:
        body = io.BytesIO()
        np.save(body, style)
        archive.writestr("one.npy", body.getvalue())
    voices = files.read_voices(spark, f"file://{tmp_path}")
    assert sorted((r["name"], r["row"], list(r["style"])) for r in voices.collect())[2] == ("one", 2, [6.0, 7.0, 8.0])
    with pytest.raises(ValueError):
        files.decode_npy("x", body.getvalue()[:-4] + np.float32("nan").tobytes())
    wanted = spark.createDataFrame([("one", 0), ("one", 99)], "voice string, n_tokens int")
    assert sorted(r["row"] for r in files.style_for(wanted, voices).collect()) == [2, 3]
    assert files.parse_blend("a+b@30") == ("a", "b", 0.3) and files.parse_blend("a") is None


def test_recognised_words(spark, tmp_path):
    token = lambda t, a, z, p: {"text": t, "offsets": {"from": a, "to": z}, "p": p}
    body = {"transcription": [{"tokens": [token("[_BEG_]", 0, 0, 1.0), token(" Hel", 0, 100, 0.8), token("lo", 100, 200, 0.6), token(" low", 200, 220, 0.1), token(" world", 300, 300, 0.9)]}]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    got = sorted(tuple(r)[1:] for r in files.read_recognised(spark, f"file://{tmp_path}").collect())
    assert [(p, w, a, z) for p, w, a, z, _ in got] == [(0, "Hello", 0, 200), (1, "world", 300, 600)]
    assert abs(got[0][4] - 0.7) < 1e-9


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"cat": "kæt", "Use": {"DEFAULT": "juz", "NOUN": "jus"}, "gone": {"NOUN": "x"}}))
    got = sorted(tuple(r) for r in files.read_lexicon(spark, f"file://{tmp_path}/l.json", "gold").collect())
    assert got == [("gold", "Use", "juz"), ("gold", "cat", "kæt")]


def test_slug_and_png():
    assert files.slug("The End -- of it!") == "the-end-of-it"
    assert files.spectrogram_png(np.zeros((3, 4)))[:8] == b"\x89PNG\r\n\x1a\n"


def test_stream_of_jobs(spark, tmp_path):
    rows = [("j1", "say this now", None, None, None, None), ("j2", "", "v", 1.0, "wav", True), ("j3", "odd format", "v", 2.0, "ogg", None), ("j4", "fails", "bad", 1.0, "mp3", False)]
    schema = f"job_id string, {serving.REQUEST}"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))

    def synthesiser():
        def speak(text, voice, speed):
            if voice == "bad":
                raise ValueError("no such voice")
            return serving.tone(text, voice, speed)

        return speak

    posted = {}
    query = serving.serve(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda frame, n: posted.update({r["job_id"]: json.loads(r["body"]) for r in frame.collect()}), synthesiser, str(tmp_path / "offsets"), once=True)
    query.awaitTermination(120)
    assert abs(posted["j1"]["output"]["duration_seconds"] - 0.24) < 1e-6 and posted["j1"]["output"]["voice"] == serving.VOICE
    assert posted["j2"]["error"] == "text is required" and "unsupported format" in posted["j3"]["error"] and "no such voice" in posted["j4"]["error"]


def test_windows_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_type AS voice", "'ok' AS status", "props AS text", "ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = serving.windowed(stream, width="1 day").writeStream.format("memory").queryName("windows_seen").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows_seen").collect())) == sorted(map(tuple, serving.windowed(events, width="1 day").collect()))


def test_a_failure_among_parts_is_its_own_row(spark):
    from pyspark.sql import functions as F

    asked = spark.range(40, numPartitions=1).select("id", F.lit("a b c").alias("text"), F.when(F.col("id") == 7, "bad").otherwise("v").alias("voice"), F.lit(1.0).alias("speed"), F.lit("wav").alias("format"))

    def synthesiser():
        def speak(text, voice, speed):
            if voice == "bad":
                raise ValueError("no such voice")
            return np.zeros(100_000, np.float32)

        return speak

    for encoded in (False, True):
        done = serving.synthesised(serving.validated(asked), synthesiser, encoded=encoded).coalesce(1)
        assert sorted((r["id"], r["failed"]) for r in done.select("id", "failed").collect()) == [(i, "no such voice" if i == 7 else None) for i in range(40)]


def test_encoded_answers_are_those_of_samples(spark):
    jobs = spark.createDataFrame([(1, "say this now", "v", 1.0, "wav"), (2, "and \"this\"", "w", 0.7, "mp3")], "job_id long, text string, voice string, speed double, format string")
    bodies = [sorted((r["job_id"], r["body"]) for r in serving.responses(serving.synthesised(serving.validated(jobs), lambda: serving.tone, encoded=e)).collect()) for e in (False, True)]
    assert bodies[0] == bodies[1] and len(bodies[0]) == 2


def test_no_part_is_larger_than_its_bound():
    """The function that a task runs, on one batch of many requests."""
    import pandas as pd

    seen = {}

    class Frame:
        schema, sparkSession = [], type("S", (), {"sparkContext": type("C", (), {"defaultParallelism": 1})})

        def where(self, _):
            return self

        def repartition(self, _):
            return self

        def mapInPandas(self, run, kinds):
            seen["run"] = run

    serving.synthesised(Frame(), lambda: lambda *_: np.zeros(1 << 18, np.float32))
    batch = pd.DataFrame({"text": ["x"] * 100, "voice": ["v"] * 100, "speed": [1.0] * 100})
    parts = list(seen["run"](iter([batch])))
    assert sum(map(len, parts)) == 100 and max(sum(4 * len(x) for x in p["samples"]) for p in parts) <= serving.PART + (1 << 20)
