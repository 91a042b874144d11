"""Composed operators against results worked out by hand or by plain loops."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from prosodia.functions import sounding
from prosodia.operators import distance, frontend, homographs, lexicon, signal, speech, synthesis, text
from prosodia.sources import external, files
from prosodia.streaming import queue, serving


def front(spark):
    return frontend.load(spark, lexicon.small_lexicon(spark), homographs.SMALL, *sounding.small_trees())


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_diagnosis_is_what_synthesis_says(spark):
    table = docs(spark, "She had written. Read it to a cat!\n\nThe wind’s up, and-is — that's closing.")
    rows = frontend.diagnose_text(table, front(spark)).orderBy("doc_id", "para", "sent", "pos").collect()
    said = {r["word"]: (r["source"], r["phonemes"], r["rule"]) for r in rows}
    assert said["Read"] == ("homograph", "ɹˈid", "")  # the sentence before is no window
    assert said["a"] == ("builtin", "ə", "") and said["The"] == ("builtin", "ðə", "")
    assert said["that's"] == ("custom", "ðˈæts", "'s") and said["and-is"] == ("hyphenated", "ænd ɪz", "")
    assert said["cat"][0] == "lts" and "—" not in said
    spoken = frontend.phonemize(table, front(spark)).orderBy("para", "sent").collect()
    for r in rows:
        assert r["phonemes"] in next(s["phonemes"] for s in spoken if (s["para"], s["sent"]) == (r["para"], r["sent"]))
    assert spoken[-1]["phonemes"].count("—") == 1 and spoken[1]["phonemes"].endswith("kˈæt!")


def test_gold_owns_inflected_forms_but_no_bare_homograph(spark):
    gold = spark.createDataFrame([("gold", "closing", "klˈOzɪŋ"), ("gold", "close", "klˈOs")], "tier string, word string, ipa string")
    f = frontend.load(spark, lexicon.small_lexicon(spark).unionByName(gold), homographs.SMALL)
    rows = {r["word"]: (r["source"], r["phonemes"]) for r in frontend.diagnose_text(docs(spark, "Please close the closing."), f).collect()}
    assert rows["closing"] == ("gold", "klˈOzɪŋ") and rows["close"] == ("homograph", "klˈOz")


def test_a_front_end_that_cannot_be_spoken_is_refused(spark):
    bad = spark.createDataFrame([("gold", "x", "gX")], "tier string, word string, ipa string")
    with pytest.raises(ValueError, match="U\\+"):
        frontend.load(spark, lexicon.small_lexicon(spark).unionByName(bad))
    with pytest.raises(ValueError, match="silver"):
        frontend.load(spark, lexicon.small_lexicon(spark).where("tier != 'silver'"))
    with pytest.raises(ValueError, match="homograph"):
        frontend.load(spark, lexicon.small_lexicon(spark), {"w": homographs.Rule("ɡg")})


def test_groups_and_segments_hold_all_tokens(spark):
    phonemes = spark.createDataFrame([(1, 0, i, "a" * n) for i, n in enumerate([200, 300, 7, 1, 600, 0, 5])], "doc_id long, para int, sent int, phonemes string")
    rows = frontend.token_groups(phonemes).orderBy("grp").collect()
    assert [len(r["tokens"]) for r in rows] == [501 + 8, 1, 600, 5] or sum(len(r["tokens"]) for r in rows) == 200 + 300 + 7 + 1 + 600 + 5 + sum(r["n_sentences"] - 1 for r in rows)
    for r in rows:
        assert [t for s in r["segments"] for t in s] == list(r["tokens"]) and all(len(s) <= text.MAX_TOKENS for s in r["segments"])


def test_segments_break_at_sentences_then_clauses_then_blanks():
    plain = [50] * 600
    at = lambda **put: len(text.segments([put.get(f"t{i}", 50) for i in range(600)])[0])
    assert at() == text.MAX_TOKENS == len(text.segments(plain)[0])
    assert at(t400=4, t450=3, t500=16) == 401 and at(t450=3, t500=16) == 451 and at(t500=16) == 501
    assert at(t100=4) == text.MAX_TOKENS  # beyond the last thirty per cent


def test_hints():
    assert text.hints(["He walked in.", "Read the sign.", "Read on.", "It is here.", "Read."]) == [False, True, True, True, False]
    assert not text.narrates_past("He said: go.") and not text.narrates_past("They have walked.") and text.narrates_past("She read it.")


def test_sentence_times_go_forward_only():
    heard = [(w, 100 * i, 100 * i + 90) for i, w in enumerate("the cat sat the dog, ran".split())]
    got = speech.sentence_times([["the", "cat"], ["unheard"], ["the", "dog", "ran"], ["cat"]], heard)
    assert got == [{"sent": 0, "start_ms": 0, "end_ms": 190}, {"sent": 2, "start_ms": 300, "end_ms": 590}]


def test_prominence_from_samples(spark):
    rate = 24_000
    t = np.arange(rate) / rate
    samples = np.concatenate([0.2 * np.sin(2 * np.pi * 200 * t[: rate // 2]), 0.6 * np.sin(2 * np.pi * 300 * t[: rate // 2])]).tolist()
    clips = spark.createDataFrame([(1, samples, rate)], "clip_id long, samples array<float>, rate int")
    words = spark.createDataFrame([(1, 0, "one", 0, 500, 1.0), (1, 1, "two", 500, 950, 1.0), (1, 2, "late", 2000, 2100, 1.0)], "clip_id long, pos int, word string, start_ms int, end_ms int, confidence double")
    got = {r["word"]: r for r in speech.prominence(clips, words).collect()}
    assert abs(got["one"]["rms"] - 0.2 / 2**0.5) < 1e-3 and abs(got["two"]["rms"] - 0.6 / 2**0.5) < 1e-3 and got["late"]["rms"] == 0
    assert abs(got["one"]["f0"] - 200) < 5 and abs(got["two"]["f0"] - 300) < 5 and got["late"]["f0"] == 0


def test_edit_tables_in_little_memory():
    import tracemalloc

    draw = random.Random(2)
    a = [f"w{draw.randrange(500)}" for _ in range(6000)]
    b = [w for w in a if draw.random() > 0.02] + ["x"] * 50
    tracemalloc.start()
    found = distance.edits(a, b)
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    assert [x for k, x, _ in found if k != "insertion"] == list(range(len(a))) and sum(k != "match" for k, *_ in found) == distance.Table(a, b).last


def test_expanded_dynamics_keep_the_peak():
    x = np.concatenate([0.05 * np.sin(np.arange(24_000) / 9), 0.8 * np.sin(np.arange(24_000) / 9)])
    y = signal.expand_dynamics(x)
    assert abs(np.abs(y).max() - np.abs(x.astype(np.float32)).max()) < 1e-6
    level = lambda z: np.sqrt((np.asarray(z, float) ** 2).mean())
    assert level(y[36_000:]) / level(y[12_000:20_000]) > 1.3 * level(x[36_000:]) / level(x[12_000:20_000])
    assert not signal.expand_dynamics([0.0] * 100).any()


def test_whole_texts_are_said(spark):
    styles = spark.createDataFrame([("v", i, [float(i % 3)] * synthesis.STYLE) for i in range(4)], "name string, row int, style array<float>")
    table = docs(spark, "The cat is on it. That was it, and it is.\n\nAnd to the cat.", "", "°", None)
    got = {r["doc_id"]: r for r in synthesis.synthesize(table, front(spark), styles, synthesis.tone_model, "v").collect()}
    assert got[0]["error"] is None and got[0]["seconds"] > 2 and abs(len(got[0]["samples"]) / 24_000 - got[0]["seconds"]) < 1e-3
    assert [got[i]["error"] for i in (1, 3)] == ["text is empty"] * 2
    missing = synthesis.synthesize(table.where("doc_id = 0"), front(spark), styles, synthesis.tone_model, "nobody").first()
    assert missing["error"] == "there is no such voice" and missing["samples"] is None


def test_silences_between_groups_and_paragraphs():
    tone = (0.3 * np.sin(np.arange(24_000) / 8)).astype(np.float32)
    group = lambda p, g: {"para": p, "grp": g, "samples": tone, "sentence_samples": 6000, "paragraph_samples": 20_400}
    x = synthesis.assembled([group(0, 0), group(0, 1), group(2, 0)])
    assert abs(len(x) - (3 * 24_000 + 6000 + 20_400)) < 2048  # trims go by frames
    found = signal.pauses(x)
    assert len(found) == 2 and found[0][1] - found[0][0] < found[1][1] - found[1][0]


def test_external_programs_fail_row_by_row(spark):
    clips = spark.createDataFrame([(1, files.encode_wav([0.5] * 4800, 48_000)), (2, b"no audio")], "clip_id long, content binary")
    made = external.extracted(clips, external.at_rate(16_000)).orderBy("clip_id").collect()
    assert files.decode_wav(bytes(made[0]["wav"]))["sample_rate"] == 16_000 and len(files.decode_wav(bytes(made[0]["wav"]))["samples"]) == 1600
    assert made[1]["wav"] is None and "RIFF" in made[1]["error"]
    aligner = lambda: lambda content: [("hello", 0, 100, 0.9), ("you", 100, 200, 0.8)] if content[:4] == b"RIFF" else 1 / 0
    rows = external.aligned(clips, aligner, "content").orderBy("clip_id", "pos").collect()
    assert [(r["clip_id"], r["word"], r["start_ms"]) for r in rows] == [(1, "hello", 0), (1, "you", 100), (2, None, None)] and rows[2]["error"]
    assert external.transcribed(clips, lambda: lambda c: " said \n"[:6], "content").first()["text"] == "said"


def test_images_are_saved(spark, tmp_path):
    png = files.encode_png(np.zeros((2, 3, 3)))
    assert external.save_images(spark.createDataFrame([("a.png", png), ("b.png", png)], "name string, png binary"), f"{tmp_path}/out") == 2
    assert (tmp_path / "out/b.png").read_bytes() == png


def test_fingerprints_move_with_every_field(spark):
    rules = homographs.SMALL
    one = lexicon.data_fingerprint(lexicon.small_lexicon(spark), rules, {"a": 1, "b": 2})
    assert one["gold"]["entries"] > 5 and one["homographs"]["entries"] == len(rules)
    assert lexicon.vocabulary_fingerprint({"a": 1, "b": 3}) != one["vocab"]
    moved = {**rules, "read": homographs.Rule(**{**rules["read"].__dict__, "subject_name": "x"})}
    swapped = {**rules, "wind": homographs.Rule("wˈɪnd", {"wˈInd": homographs.Reading(("to", "will", "up"), ("down",)), "wˈɪnd": rules["wind"].readings["wˈɪnd"]})}
    assert len({lexicon.rules_fingerprint(r)["digest"] for r in (rules, moved, swapped)}) == 3
    assert lexicon.data_fingerprint(lexicon.small_lexicon(spark).where("tier = 'gold'"), {}, {})["custom"]["entries"] == 0


def test_names_of_files_count(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    one = lexicon.files_fingerprint(spark, f"file://{tmp_path}/*.json")
    (tmp_path / "a.json").rename(tmp_path / "b.json")
    assert len(one) == 12 and one != lexicon.files_fingerprint(spark, f"file://{tmp_path}/*.json")


def test_reports(spark):
    table = docs(spark, "The cat is here. Zzz and the cat.")
    report = json.loads(speech.diagnosis_report(frontend.diagnose_text(table, front(spark)), "here", "abc", "builtin, lts").first()["report"])
    assert report["total_words"] == 8 and report["counts"]["builtin"] == 2 and report["data_fingerprint"] == "abc"
    assert {e["word"] for e in report["lts_inventory"]} >= {"cat", "Zzz"} and [e["word"] for e in report["builtin_inventory"]] == ["The"]
    assert set(report) == {"total_words", "counts", "data_dir", "data_fingerprint", "lts_inventory", "skip_inventory", "silver_inventory", "builtin_inventory"}
    voices = spark.createDataFrame([("b",), ("a",), ("a",)], "name string")
    wanted = spark.createDataFrame([("a",), ("c",)], "voice string")
    assert sorted(str(r["error"]) for r in serving.with_voice(wanted, voices).collect()) == ["None", 'voice "c" not found (available: a, b)']
    assert json.loads(serving.version_row(spark, "t", "h").first()["body"]) == {"build_time": "t", "git_hash": "h"}


def test_issues_of_all_detectors_as_one_table(spark):
    s = "clip_id long, pos int, word string, type string, severity string"
    emphasis = spark.createDataFrame([(1, 0, "the", "function_word_stress", "high")], s)
    alignment = spark.createDataFrame([(1, 0, "the", 5, 9, 1.0)], "clip_id long, pos int, word string, start_ms int, end_ms int, confidence double")
    issue = lambda kind, at: spark.createDataFrame([(1, kind, at, at + 1, "low", "c")], "clip_id long, type string, start_ms long, end_ms long, severity string, context string")
    stressed = spark.createDataFrame([(1, "word", 30, "medium", "w")], "clip_id long, word string, start_ms int, severity string, context string")
    rows = speech.unified_issues(emphasis, issue("p", 1), issue("q", 2), issue("r", 3), stressed, alignment).collect()
    assert {(r["category"], r["type"], r["start_ms"]) for r in rows} == {("emphasis", "function_word_stress", 5), ("pacing", "p", 1), ("pronunciation", "q", 2), ("intonation", "r", 3), ("stress", "stress_mismatch", 30)}


class Jobs(BaseHTTPRequestHandler):
    jobs: list = []
    posted: dict = {}

    def do_GET(self):
        body = json.dumps(self.jobs.pop(0)).encode() if self.jobs and "ping" not in self.path else b""
        self.send_response(200 if body else 204)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        self.posted[self.path] = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(200)
        self.end_headers()

    def log_message(self, *_):
        pass


def test_a_queue_is_polled_served_and_answered(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Jobs)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    Jobs.jobs = [{"id": "j1", "input": {"text": "two words"}}, {"id": "j2", "input": {"text": ""}}]
    beats = queue.Heartbeat(f"{base}/ping")
    spark.streams.addListener(beats)
    spark.dataSource.register(queue.QueueSource)
    stream = spark.readStream.format("job_queue").option("url", f"{base}/job").load()
    run = serving.serve(stream, queue.poster(f"{base}/done/$ID"), lambda: serving.tone, f"{tmp_path}/checkpoint")
    try:
        for _ in range(60):
            if len(Jobs.posted) >= 2 and beats.sent:
                break
            run.awaitTermination(0.5)
    finally:
        run.stop()
        spark.streams.removeListener(beats)
        server.shutdown()
    assert Jobs.posted["/done/j1?isStream=false"]["output"]["duration_seconds"] == 0.16
    assert Jobs.posted["/done/j2?isStream=false"] == {"error": "text is required"} and beats.sent
    assert queue.ping_url("http://x?a=1", "j") == "http://x?a=1&job_id=j" and queue.result_url("http://x/$ID?k=1", "j") == "http://x/j?k=1&isStream=false"
