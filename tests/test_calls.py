"""Judge replies, signals, simulation, streaming, and a run from files to a verdict."""

import base64
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callweave import config, engine, report
from callweave.__main__ import main as main_
from callweave.operators import conversation, dynamics, ingest, judge, signal, simulate, timeline
from callweave.sources import recordings, store
from callweave.streaming import calls, recorder

# judge


def reply(**change):
    out = {d: {"reasoning": "r", "score": 4} for d in judge.DIMENSIONS} | {"overall": 4, "notable_timestamps": ["0:01"], "summary": "s", "rubric_version": "v2"}
    return json.dumps(out | change)


def parsed(spark, *texts):
    rows = judge.parse(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    return [(r.error, r.metrics) for r in rows]


def test_judge_replies(spark):
    few = json.dumps({"unscoreable": True, "unscoreable_reason": "noise"})
    said = lambda v: {"reasoning": "r", "score": v}
    bad = reply(pace=said(4.5))
    lax = reply(pace=said("4"), fluency=said(4.0), prosody=said(True))
    texts = [reply(), "Hm:\n```json\n" + reply() + "\n```\nbye {", "so " + reply() + " ok", reply(unscoreable=True), few, "no", bad, reply(overall=6), lax, None, "} {"]
    texts += [json.dumps({"unscoreable": True}), json.dumps({"unscoreable": True, "pace": said(9)}), reply(pace={"score": 4}), reply(unscoreable=True, unscoreable_reason="silence")]
    got = parsed(spark, *texts)
    lost = judge.FAILURE
    want = [None, None, None, "the judge marked the clip unscoreable", "noise", lost, lost, lost, None, lost, lost, "unscoreable", lost, lost, "silence"]
    assert [e for e, _ in got] == want
    assert [judge.acceptable(t) for t in texts] == [e != lost for e in want]
    assert len(got[0][1]) == 10 and got[0][1]["judge_overall"] == 4 and got[8][1]["judge_prosody"] == 1 and got[4][1] is None


# signals


def test_mulaw_round_trip():
    t = np.arange(8000) / 8000
    x = (0.5 * np.sin(2 * np.pi * 220 * t) * 32767).astype(np.int16)
    back = signal.mulaw_decode(signal.mulaw_encode(x))
    assert np.sqrt(np.mean(((back - x) / 32768.0) ** 2)) < 0.02
    assert signal.mulaw_decode(np.array([0xFF], np.uint8))[0] == 0
    every = np.arange(256, dtype=np.uint8)
    again = signal.mulaw_encode(signal.mulaw_decode(every))
    assert np.array_equal(signal.mulaw_decode(again), signal.mulaw_decode(every))


def test_windows(spark):
    rows = [("short", [1.0] * 3), ("even", [1.0] * 8), ("tail", [1.0] * 9), ("long", [1.0] * 11), ("none", [])]
    got = {}
    for r in signal.windows(spark.createDataFrame(rows, "clip_id string, x array<double>"), 4, 3).collect():
        got.setdefault(r.clip_id, []).append((r.window, len(r.x)))
    assert got == {"short": [(0, 3)], "even": [(0, 4), (1, 4)], "tail": [(0, 4), (1, 4)], "long": [(0, 4), (1, 4), (2, 3)]}


def test_levels_and_mixing(spark):
    df = spark.createDataFrame([([0.5, -0.25], [30000, -30000, 5], [10000, -10000])], "x array<double>, a array<int>, b array<int>")
    r = df.select(signal.peak_normalize(F.col("x"), -6.0206).alias("n"), signal.mix(F.col("a"), F.col("b")).alias("m"), signal.loop(F.col("b"), F.lit(1), 3).alias("l"), signal.silent(F.array(F.lit(0.0))).alias("s")).first()
    assert abs(r.n[0] - 0.5) < 1e-4 and r.m == [32767, -32768, 5] and r.l == [-10000, 10000, -10000] and r.s
    assert signal.bed([np.zeros(0, np.float32), None]) is None
    one = signal.bed([signal.tone(0.8, 220)], seconds=6.0, gain_db=-18.0)
    assert one.dtype == np.int16 and len(one) == 6 * 8000 and 0 < np.abs(one).max() < 0.5 * 32767
    assert len(signal.bed([np.ones(80, np.float32)], seconds=2.0)) == 5 * 8000
    hum = signal.tone(1.0, seed=3)
    assert len(hum) == 16000 and np.array_equal(hum, signal.tone(1.0, seed=3)) and not np.array_equal(hum, signal.tone(1.0, seed=4))
    assert signal.voiced(np.concatenate([np.zeros(2560), hum])).tolist()[:10] == [False] * 10 and signal.voiced(hum).mean() > 0.6
    assert len(signal.resample(np.ones(16000), 16000, 8000)) == 8000


# simulation


def test_placed_moves_and_latency(spark):
    rows = [("c", 0, "agent", "hi", 1.0, 0.5, False), ("c", 1, "caller", "yes", 2.0, 0.0, False), ("c", 2, "agent", "ok", 1.0, 1.3, False), ("d", 0, "caller", " ", 1.0, 0.0, True)]
    moves = spark.createDataFrame(rows, "call_id string, seq int, speaker string, text string, dur_s double, latency_s double, hangup boolean")
    got = [(r.start_s, r.end_s) for r in simulate.place(moves).where("call_id = 'c'").orderBy("seq").collect()]
    assert np.allclose(got, [(0.5, 1.5), (1.8, 3.8), (5.1, 6.1)])
    ev = simulate.events(moves).withColumnRenamed("call_id", "clip_id")
    assert abs(dynamics.ttft(ev).first().latency_s - 1.3) < 1e-9
    assert {tuple(r) for r in simulate.validity(moves).collect()} == {("c", True, None), ("d", False, "no agent turn")}


def test_suite_and_scenarios(spark):
    sc = simulate.scenario_table(spark, {"scenarios": [{"id": "s1", "persona": {"name": "p", "adversarial": True}, "tags": ["a"], "source_call_id": "k"}, {"id": "s2"}]})
    assert simulate.suite(sc, 3).count() == 6
    tags = [json.loads(r.tags_json) for r in simulate.tags(sc).orderBy("scenario_id").collect()]
    assert tags[0] == {"scenario_id": "s1", "source_call_id": "k", "persona": "p", "adversarial": True, "background": False, "tags": ["a"]} and tags[1]["tags"] == [] and tags[1]["source_call_id"] is None
    with pytest.raises(ValueError, match="manifest"):
        simulate.scenario_table(spark, "text")


def test_conversations_are_talked_again(spark):
    class Mute(conversation.ScriptedAgent):
        """Says nothing in every call with an even seed."""

        def __init__(self, seed):
            conversation.ScriptedAgent.__init__(self, seed=seed)
            self.mute = seed % 2 == 0

        def respond(self, heard):
            m = conversation.ScriptedAgent.respond(self, heard)
            return conversation.Move("agent", " " if self.mute else m.text, m.audio, m.latency_s)

    sc = simulate.scenario_table(spark, [{"id": f"s{i}", "max_turns": 3} for i in range(8)])
    calls_ = {r.call_id: r for r in conversation.play(sc, {"v": Mute}, k=1, regen=1).collect()}
    assert len(calls_) == 8 and {r.attempts for r in calls_.values()} == {1, 2}
    for r in calls_.values():
        assert [m.speaker for m in r.moves] == ["agent", "caller", "agent", "caller", "agent", "caller"] and r.moves[-1].hangup
        assert r.valid == (r.reason is None) and (r.valid or (r.reason == "blank turn" and r.attempts == 2))
    assert not all(r.valid for r in conversation.play(sc, {"v": Mute}, k=1, regen=0).collect())
    one = conversation.play(sc.limit(1), {"v": lambda seed: conversation.ScriptedAgent(0.7, seed=seed)}, k=1).first()
    x, rate = recordings.read_wav(one.wav)
    car = json.loads(one.sidecar)
    assert rate == 16000 and x.shape[1] == 2 and car["scenario_id"] == "s0" and not x[-rate:].any()
    ev = spark.createDataFrame([("c", i, e["kind"], e["t_s"]) for i, e in enumerate(car["events"])], "clip_id string, seq int, kind string, t_s double")
    assert abs(max(r.latency_s for r in dynamics.ttft(ev).collect()) - 0.7) < 1e-6
    rows = [("c", i, m.speaker, m.text, m.dur_s, m.latency_s, m.hangup) for i, m in enumerate(one.moves)]
    placed = simulate.events(spark.createDataFrame(rows, "call_id string, seq int, speaker string, text string, dur_s double, latency_s double, hangup boolean"))
    assert [(r.kind, round(r.t_s, 3)) for r in placed.orderBy("seq").collect()] == [(e["kind"], e["t_s"]) for e in car["events"]]


# streaming


def frames(*parts):
    return [0.3 if on else 0.0 for on, n in parts for _ in range(n)]


def log(loud, **how):
    c, p = calls.Call(), calls.Policy(**({"barge": True, "after_ms": 1000, "reply_ms": 500} | how))
    return c.take(list(range(len(loud))), loud, [False] * len(loud), p) + c.finish(p)


def kinds(out):
    return [k for k, _ in out]


def test_agent_that_yields():
    out = log(frames((1, 30), (0, 70), (1, 60), (0, 50)))
    # a greeting to 0.58 s, a reply from 1.18 to 1.68 s, an interruption a second into the next turn
    assert [e for e in out if e[0] != "tts_first_audio"] == [
        ("agent_tts_start", 0.0), ("agent_tts_end", 0.58), ("user_speech_start", 1.18), ("user_speech_end", 1.68), ("agent_tts_start", 2.0),
        ("user_speech_start", 3.0), ("barge_in_detected", 3.0), ("agent_interrupted", 3.18), ("agent_tts_end", 3.18), ("user_speech_end", 3.5), ("user_speech_start", 3.78),
    ]


def test_agent_that_talks_on():
    out = log(frames((1, 30), (0, 70), (1, 160), (0, 50)))
    assert kinds(out).count("barge_in_detected") == 1 and "agent_interrupted" not in kinds(out)


def test_turns_without_barge():
    out = log(frames((0, 10), (1, 40), (0, 100), (1, 20), (0, 60)), barge=False, transcribed=True)
    assert [(k, t) for k, t in out if k.startswith("agent")] == [("agent_tts_start", 0.2), ("agent_tts_end", 0.98), ("agent_tts_start", 3.0), ("agent_tts_end", 3.38)]
    assert [t for k, t in out if k == "stt_final"] == [0.98, 3.38] and kinds(out).count("user_speech_end") == 2
    assert "stt_final" not in kinds(log(frames((1, 9), (0, 60)), transcribed=True)) and "stt_final" not in kinds(log(frames((1, 40), (0, 60))))


def test_interruptions_count_as_turns():
    out = log(frames((1, 120), (0, 70), (1, 120), (0, 70)), max_turns=1)
    assert kinds(out).count("user_speech_start") == 1


def test_frames_of_other_tracks_take_time_alone():
    out = log([0.3, 0.3, None, None, 0.3, *[0.0] * 40], barge=False)
    assert out[-2:] == [("agent_tts_end", 0.08), ("user_speech_start", 0.68)]


def media(voiced, n, track="inbound"):
    t = np.arange(160) / 8000
    pcm = ((0.25 * np.sin(2 * np.pi * 180 * t) if voiced else 0 * t) * 32767).astype(np.int16)
    payload = base64.b64encode(signal.mulaw_encode(pcm).tobytes()).decode()
    return [{"event": "media", "media": {"track": track, "payload": payload}}] * n


def phone(*parts, **how):
    """A session that has heard some messages, and what it sent."""
    p = calls.Policy(barge=how.pop("barge", True), after_ms=1000)
    s = recorder.Session(policy=p, **how)
    return s, [m for part in parts for message in part for m in s.handle(message)]


def test_session_is_the_state_machine_with_sound():
    s, sent = phone(media(1, 30), media(0, 70), media(1, 60), media(0, 50))
    assert s.events == log(frames((1, 30), (0, 70), (1, 60), (0, 50)))[: len(s.events)] and len(sent) >= 50
    wav, car, seconds = s.recording()
    x, rate = recordings.read_wav(wav)
    assert rate == 8000 and x.shape == (int(seconds * 8000) + 8000, 2) and x[:, 0].any() and x[:, 1].any()
    assert car["channel_map"] == {"agent_channel": 0, "caller_channel": 1} and [e["t_s"] for e in car["events"]] == sorted(e["t_s"] for e in car["events"])
    assert car["transcript"].count("caller: ") == 3 and car["transport"] == "media-stream"


def test_caller_reacts_to_what_the_agent_said():
    seen = []

    def voice(turn, history):
        seen.append(history)
        return np.ones(4000, np.int16), f"turn {turn}", False

    s, _ = phone(media(1, 40), media(0, 60), voice=voice, transcribe=lambda pcm, rate: "we can send someone", barge=False)
    assert {"speaker": "agent", "text": "we can send someone"} in seen[0] and "stt_final" in kinds(s.events)
    deaf, _ = phone(media(1, 40), media(0, 60), barge=False)
    assert all(t["speaker"] == "caller" for t in deaf.transcript) and deaf.transcript and "stt_final" not in kinds(deaf.events)


def test_background_lies_under_the_caller():
    bed = signal.bed([signal.tone(1.0, 200)], seconds=5.0)
    s, sent = phone(media(1, 30), background=bed)
    assert len(sent) == 30
    for m in media(0, 60):
        s.handle(m)
    assert "user_speech_end" in kinds(s.events) and len(s.sound["caller"]) == 90


def test_replay_and_records_of_logs(spark, tmp_path):
    lines = [{"event": "connected"}, {"event": "start", "start": {"streamSid": "m1"}}, *media(1, 30), *media(0, 70), *media(1, 130), *media(0, 50), {"event": "stop"}]
    s = recorder.Session(policy=calls.Policy(barge=True, after_ms=1000, max_turns=2))
    sent = recorder.replay(iter(lines), s)
    assert s.hangup and sent and all(m["streamSid"] == "m1" for m in sent)
    rows = [json.dumps(m | {"streamSid": "m1", "sequenceNumber": str(k)}) for k, m in enumerate(lines)]
    frames_ = calls.parse(spark.createDataFrame([(r,) for r in rows], "value string"))
    r = recorder.record(frames_, lambda call: recorder.Session(policy=calls.Policy(barge=True, after_ms=1000, max_turns=2), scenario={"id": call})).first()
    car = json.loads(r.sidecar)
    wav, own, seconds = s.recording()
    assert r.call_id == "m1" and bytes(r.wav) == wav and car["events"] == own["events"] and r.duration_s == seconds
    (tmp_path / "log.jsonl").write_text("\n".join(rows))
    code = main_(["call", str(tmp_path / "log.jsonl"), "--recordings", str(tmp_path / "rec"), "--out", str(tmp_path / "out")])
    assert code == 0 and sorted(p.name for p in (tmp_path / "rec").iterdir()) == ["call__candidate__call.json", "call__candidate__call.wav"]


def test_any_order_of_frames_gives_one_log():
    rng = random.Random(2)
    loud = [0.3 if rng.random() < 0.6 else 0.0 for _ in range(400)]
    want = log(loud)
    c, got, order, p = calls.Call(), [], list(range(400)), calls.Policy(barge=True, after_ms=1000, reply_ms=500)
    for i in range(0, 400, 50):
        part = order[i : i + 50]
        rng.shuffle(part)
        for s in range(0, 50, 10):
            got += c.take(part[s : s + 10], [loud[k] for k in part[s : s + 10]], [False] * 10, p)
    assert got + c.finish(p) == want


def test_messages(spark):
    payload = base64.b64encode(bytes([0x80] * 160)).decode()
    rows = [json.dumps({"event": "media", "streamSid": "c", "sequenceNumber": "0", "media": {"payload": payload}}), json.dumps({"event": "stop", "streamSid": "c", "sequenceNumber": "1"}), "garbage", json.dumps({"event": "start", "streamSid": "c"})]
    df = calls.parse(spark.createDataFrame([(r,) for r in rows], "value string"))
    got = [(r.seq, round(r.loud, 2), r.stop) for r in calls.measured(df).orderBy("seq").collect()]
    assert got == [(0, 0.98, False), (1, 0.0, True)] and df.where("event = 'start'").count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    fr = calls.frames_of(spark.read.parquet(f"{sf}/events.parquet").where("user_id % 5 = 0")).cache()
    want = {tuple(r) for r in calls.batch(fr).collect()}
    folder = tmp_path / "in"
    pdf = fr.toPandas().sample(frac=1, random_state=1)
    folder.mkdir()
    for k, part in enumerate(np.array_split(np.arange(len(pdf)), 3)):
        pdf.iloc[part].to_parquet(folder / f"{k}.parquet", index=False)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema("call_id string, seq long, loud double, stop boolean").option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = calls.stream(src).writeStream.format("memory").queryName("calls_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {tuple(r) for r in spark.table("calls_out").collect()} == want and want


def test_sessions(spark, sf):
    out = calls.sessions(spark.read.parquet(f"{sf}/events.parquet"))
    assert out.agg(F.sum("events")).first()[0] == 1000


# files to verdict


def voice(seconds, rate=16000, seed=0):
    t = np.arange(int(seconds * rate)) / rate
    return 0.3 * np.sin(2 * np.pi * (180 + seed) * t) * (0.6 + 0.4 * np.sin(2 * np.pi * 3 * t))


SIDE = {"call_id": "k1", "agent_version": "v1", "channel_map": {"agent_channel": 0, "caller_channel": 1}, "weather": "fine", "events": [{"kind": k, "t_s": t} for k, t in [("user_speech_start", 0.0), ("user_speech_end", 2.0), ("stt_final", 2.1), ("tts_first_audio", 2.8), ("agent_tts_start", 2.8), ("agent_tts_end", 5.0)]]}


@pytest.fixture
def corpus(tmp_path):
    d = tmp_path / "corpus"
    (d / "deep").mkdir(parents=True)
    (d / "a.wav").write_bytes(recordings.write_wav([np.concatenate([np.zeros(48000), voice(2)]), voice(2, seed=9)], 16000))
    (d / "a.json").write_text(json.dumps(SIDE))
    (d / "deep" / "b.WAV").write_bytes(recordings.write_wav([voice(4)], 8000))
    (d / "deep" / "copy.wav").write_bytes((d / "deep" / "b.WAV").read_bytes())
    (d / "deep" / "b.json").write_text("{broken")
    (d / "bad.wav").write_bytes(b"RIFFnothing")
    (d / "notes.txt").write_text("no")
    return str(d)


def test_discovery_and_sidecars(spark, corpus):
    found = recordings.with_metadata(recordings.discover(spark, corpus), recordings.sidecars(spark, corpus)).cache()
    by = {r.source_path.rsplit("/", 1)[1]: r.metadata for r in found.collect()}
    assert set(by) == {"a.wav", "b.WAV", "copy.wav", "bad.wav"}
    assert by["a.wav"].extra == {"weather": "fine"} and by["a.wav"].channel_map.caller_channel == 1 and len(by["a.wav"].events) == 6
    assert by["b.WAV"].call_id is None and by["copy.wav"] is None
    clips = {r.source_path.rsplit("/", 1)[1]: r for r in recordings.decode(found).collect()}
    assert clips["bad.wav"].error and clips["b.WAV"].clip_id == clips["copy.wav"].clip_id
    a = clips["a.wav"]
    assert a.n_source_channels == 2 and len(a.agent) == len(a.mono) and abs(a.duration_s - 6.0) < 0.01 and clips["b.WAV"].agent is None
    assert ingest.first_by_path(recordings.decode(found).where("error IS NULL")).count() == 2


def test_run_to_verdict(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    cfg = config.Config(gates={"absolute": {"latency_p95_s": {"max": 0.5}, "level_db": {"min": -60.0}}, "regression": {"max_delta": {"latency_p50_s": 0.1}}})
    first = engine.evaluate(spark, corpus, out, cfg, run="r1")
    page = open(first["html"]).read()
    assert first["failures"] == 1 and not first["passed"] and first["baseline"] is None and "latency_p95_s" in page and "<svg" in page and page.count("<audio") == 2 and "The judge did not run" in page
    second = engine.evaluate(spark, corpus, out, cfg, run="r2")
    assert second["baseline"] == "r1" and second["failures"] == 1
    res = store.load(spark, out, "results", "r2")
    assert res.where("cached").count() == res.where("error IS NULL").count() > 0
    again = engine.judge_run(spark, out, None, "r2")  # by the configuration that it was made with
    assert again["failures"] == second["failures"] and "PASS" not in again["text"]
    assert engine.judge_run(spark, out, config.Config(), "r2")["passed"]
    # a changed setting is scored again, the others come from the cache
    cfg.dynamics.gap_threshold_s = 0.2
    engine.evaluate(spark, corpus, out, cfg, run="r3")
    fresh = {r.scorer for r in store.load(spark, out, "results", "r3").where("NOT cached AND error IS NULL").collect()}
    assert fresh == {"turn_taking"}
    assert store.whole(spark, out, "decoded").count() == 2  # decoded once, whatever the runs
    b = store.load(spark, out, "results", "r3").where("error IS NULL AND scorer = 'turn_taking' AND raw LIKE '%diarization%'")
    assert b.count() == 1 and store.load(spark, out, "segments", "r3").where("estimated").select("clip_id").distinct().count() == 1
    a = res.where("scorer = 'latency' AND error IS NULL").first()
    assert abs(a.metrics["latency_p50_s"] - 0.7) < 1e-9
    assert store.load(spark, out, "nowhere") is None and store.cache_get(spark, out, False) is None


def test_registry_and_config(tmp_path):
    with pytest.raises(KeyError):
        engine.build("nothing")
    with pytest.raises(ValueError, match="already"):
        engine.register(engine.Level)
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "no.json"))
    p = tmp_path / "c.json"
    p.write_text('{"judge": {"domain": "bank"}, "api_key": "x", "gates": {"absolute": {"mos": {"min": 2}}}, "more": {"token": 1, "a": 2}, "runner": null}')
    c = config.load(str(p))
    assert c.judge.domain == "bank" and c.dynamics.bargein_success_window_s == 1.5 and c.gates.absolute.mos["min"] == 2 and c.runner.cpu_workers == 0
    assert "api_key" not in c.snapshot() and '"a": 2' in c.snapshot() and "token" not in c.snapshot()
    c.scorers.judge = ["audio_judge"]
    assert c.selected()[-1] == "audio_judge" and "audio_judge" not in c.without_judge().selected() and c.selected()[-1] == "audio_judge"
    assert config.Config().gates.absolute == {} and config.load(None).judge.domain == config.Config().judge.domain
    p.write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        config.load(str(p))
    p.write_text('{"judge": 3}')
    with pytest.raises(ValueError, match="judge is a mapping"):
        config.load(str(p))


def clips_of(spark, rows):
    """Clips of (id, mono, agent, caller, events, provider)."""
    found = [(f"{c}.wav", c, 16000, len(m) / 16000, m, a, k, (c, p, [(e, t) for e, t in ev])) for c, m, a, k, ev, p in rows]
    return spark.createDataFrame(found, "source_path string, clip_id string, sample_rate int, duration_s double, mono array<float>, agent array<float>, caller array<float>, metadata struct<domain:string,tts_provider:string,events:array<struct<kind:string,t_s:double>>>").withColumn("metadata", F.struct("metadata.*", F.lit(None).cast("string").alias("payload"))).withColumn("metadata", F.col("metadata").withField("events", F.transform("metadata.events", lambda e: F.struct(e["kind"].alias("kind"), e["t_s"].alias("t_s"), F.lit(None).cast("map<string,string>").alias("payload")))))


def silence(seconds):
    return np.zeros(int(16000 * seconds), np.float32)


def hum(seconds):
    return (0.3 * np.sin(2 * np.pi * 180 * np.arange(int(16000 * seconds)) / 16000)).astype(np.float32)


def lists(*parts):
    return np.concatenate(parts).tolist()


def scored(spark, clips, cfg, client=None):
    context = engine.Context(clips, recordings.gateway_events(clips), engine.timelines(clips, cfg), client)
    return {(r.clip_id, r.scorer): r for r in engine.score(context, cfg).collect()}


def test_timelines_from_channels_and_mono(spark):
    """A caller to 2 s, the agent from 2.8 to 5 s, the caller again from 7.5 s, and over the agent at 9 s."""
    caller = lists(hum(2), silence(5.5), hum(0.5), silence(1), hum(0.6), silence(1.4))
    agent = lists(silence(2.8), hum(2.2), silence(3.3), hum(1.7), silence(1))
    mono = lists(hum(2), silence(1), hum(1))
    clips = clips_of(spark, [("two", mono, agent, caller, [], None), ("one", mono, None, None, [], None), ("mute", lists(silence(3)), None, None, [], None)])
    cfg = config.Config()
    cfg.scorers.acoustic = []
    got = scored(spark, clips, cfg)
    lat = got["two", "latency"]
    assert lat.error is None and abs(lat.metrics["latency_max_s"] - 0.8) < 0.05 and json.loads(lat.raw)["source"] == "channels" and not json.loads(lat.raw)["estimated"]
    turns = got["two", "turn_taking"]
    assert turns.metrics["awkward_gap_count"] == 1 and abs(turns.metrics["max_gap_s"] - 2.5) < 0.05 and abs(turns.metrics["overlap_ratio"] - 0.6 / 4) < 0.02
    barge = got["two", "barge_in"]
    assert barge.metrics["n_bargein_events"] == 1 and barge.metrics["bargein_success_rate"] == 1 and abs(json.loads(barge.raw)["attempts"][0]["latency_s"] - 1.0) < 0.05
    assert ("one", "barge_in") not in got and got["one", "latency"].error and json.loads(got["one", "turn_taking"].raw)["estimated"]
    assert got["mute", "turn_taking"].error == "no speech was found"
    # settings act
    cfg.dynamics.bargein_success_window_s, cfg.dynamics.gap_threshold_s = 0.5, 3.0
    again = scored(spark, clips, cfg)
    assert again["two", "barge_in"].metrics["bargein_success_rate"] == 0 and again["two", "turn_taking"].metrics["awkward_gap_count"] == 0
    cfg.dynamics.vad_backend = "ten"
    with pytest.raises(LookupError, match="ten"):
        engine.timelines(clips, cfg)


def test_diarized_calls(spark, monkeypatch):
    monkeypatch.setitem(engine.DIARIZERS, "two", lambda x, rate: [("x", 0.0, 1.0), ("y", 1.5, 4.0), ("x", 4.2, 5.0)])
    clips = clips_of(spark, [("one", lists(hum(5)), None, None, [], None)])
    segs = sorted(tuple(r) for r in engine.timelines(clips, config.Config()).select("start_s", "speaker", "estimated").collect())
    assert segs == [(0.0, "caller", True), (1.5, "agent", True), (4.2, "caller", True)]


def test_models_plug_in_over_windows(spark, monkeypatch):
    cfg = config.Config(scorers={"acoustic": ["dnsmos", "nisqa", "level"], "dynamics": []}, acoustic={"window_s": 1.0, "min_window_s": 0.5})
    clips = clips_of(spark, [("a", lists(hum(1), silence(1), 2 * hum(1), hum(0.3)), None, None, [], None), ("b", lists(silence(2)), None, None, [], None)])
    got = scored(spark, clips, cfg)
    assert "no model dnsmos" in got["a", "dnsmos"].error and "silent clip" in got["b", "level"].error and got["a", "level"].error is None
    monkeypatch.setitem(engine.MODELS, "dnsmos", lambda x, rate: {"mos": float(np.abs(x).max()), "n": float(len(x))})
    monkeypatch.setitem(engine.MODELS, "nisqa", lambda x, rate: {"whole": float(len(x))})
    got = scored(spark, clips, cfg)
    assert abs(got["a", "dnsmos"].metrics["mos"] - 0.45) < 1e-3 and got["a", "dnsmos"].metrics["n"] == 16000 and got["a", "nisqa"].metrics == {"whole": 3.3 * 16000}
    cfg.acoustic.aggregate = "mean"
    assert scored(spark, clips, cfg)["b", "dnsmos"].error.startswith("ValueError: silent")


def test_judge_scores_calls(spark, tmp_path):
    cfg = config.Config(scorers={"acoustic": [], "dynamics": [], "judge": ["audio_judge"]}, judge={"judge_model_family": "acme", "max_audio_s": 0.5, "domain": "leasing"})
    clips = clips_of(spark, [("good", lists(hum(2)), lists(hum(1)), None, [], None), ("same", lists(hum(2)), None, None, [], "Acme-TTS"), ("bad", lists(hum(2)), None, None, [], "other"), ("mute", lists(hum(2)), None, None, [], None)])

    def client(system, rubric, audio, nudge, good=reply(overall=2, rubric_version="unknown")):  # noqa: B008
        assert len(audio) == 8000 and rubric.startswith("RUBRIC_VERSION") and "about: " in system
        if "about: bad" in system:
            return "garbage"
        if "about: mute" in system:
            return json.dumps({"unscoreable": True, "unscoreable_reason": "no agent speech"})
        return good if nudge else "NOT JSON"

    got = scored(spark, clips, cfg, client)
    assert set(got) == {(c, "audio_judge") for c in ("good", "bad", "mute")}
    assert set(got["good", "audio_judge"].metrics) == {f"judge_{d}" for d in (*judge.DIMENSIONS, "overall")} and json.loads(got["good", "audio_judge"].raw)["rubric_version"] == "built-in"
    assert got["bad", "audio_judge"].error.startswith("judge_parse_failure") and got["mute", "audio_judge"].error == "no agent speech" and got["mute", "audio_judge"].metrics is None
    none = scored(spark, clips, cfg)
    assert "no judge is registered" in none["good", "audio_judge"].error
    other = config.Config(**json.loads(json.dumps(cfg)))
    other.judge.model = "newer"
    s = engine.build("audio_judge")
    assert s.settings(cfg) != s.settings(other)


def test_entry_and_oracle_keys(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[0] == "clip_id"


def test_loudness_of_empty_frames():
    assert calls.loudness(pd.Series([b"", None])).tolist() == [0.0, 0.0]


def test_asking_a_judge(spark):
    df = spark.createDataFrame([("a", "p", b"good"), ("b", "p", b"slow"), ("c", "p", b"fail"), ("d", "p", b"busy")], "clip_id string, system string, audio binary")

    def client(system, rubric, audio, nudge, good=reply(), seen=[]):  # noqa: B006, B008
        if bytes(audio) == b"fail":
            raise RuntimeError("no credit")
        if bytes(audio) == b"busy":
            seen.append(1)
            if len(seen) < 3:
                raise RuntimeError("429 too many")
        return "what?" if bytes(audio) == b"slow" and not nudge else good

    waits = lambda s: None
    got = {r.clip_id: r for r in judge.parse(judge.ask(df, client, wait=waits, at_once=1).withColumnRenamed("error", "failed")).collect()}
    assert got["a"].error is None and got["b"].error is None and got["c"].failed == "RuntimeError: no credit" and got["c"].error and got["d"].error is None
    assert spark.range(1).select(judge.cap(F.array(*[F.lit(i) for i in range(9)]), F.lit(4), 1.5).alias("x")).first().x == [0, 1, 2, 3, 4, 5]
    rows = spark.createDataFrame([([1.0], [2.0], None), ([1.0], None, [])], "mono array<double>, agent array<double>, caller array<double>")
    for kind, want in (("agent_only", [2.0, 1.0]), ("caller_only", [1.0, 1.0]), ("mono", [1.0, 1.0])):
        x, said = judge.channel(kind)
        got = rows.select(x.alias("x"), said.alias("said")).collect()
        assert [r.x[0] for r in got] == want and (got[0].said == judge.CHANNELS["agent_only"][1]) == (kind == "agent_only")


def test_simulated_regression(spark, tmp_path):
    cfg = config.Config(scorers={"acoustic": []}, simulate={"k_runs": 2})
    sc = simulate.scenario_table(spark, [{"id": "s1", "max_turns": 3}, {"id": "s2", "max_turns": 2}])
    slow, fast = (lambda seed: conversation.ScriptedAgent(2.0, seed=seed)), (lambda seed: conversation.ScriptedAgent(0.8, seed=seed))
    bad = engine.simulate(spark, sc, {"candidate": slow, "baseline": fast}, str(tmp_path / "a"), cfg)
    assert not bad["comparison"]["passed"] and bad["comparison"]["regressed"] >= 2 and bad["invalid"] == 0
    assert {r.scenario for r in bad["comparison"]["deltas"].where("verdict = 'regressed'").collect()} == {"s1", "s2"} and "regressed" in report.comparison(bad["comparison"])
    assert store.load(spark, str(tmp_path / "a"), "clips").count() == 8
    same = engine.simulate(spark, sc, {"candidate": fast, "baseline": fast}, str(tmp_path / "b"), cfg)
    assert same["comparison"]["passed"] and same["comparison"]["error"] is None


def test_external_results_join_a_run(spark, corpus, tmp_path):
    out = str(tmp_path / "out")
    cfg = config.Config(scorers={"acoustic": [], "dynamics": ["latency"]}, gates={"absolute": {"task": {"min": 0.5}}})
    rows = [("x", "semantic", "semantic", {"task": 0.0}, None, None, 0.0, False)]
    ext = spark.createDataFrame(rows, engine.RESULT)
    r = engine.evaluate(spark, corpus, out, cfg, run="r", external=ext)
    assert r["failures"] == 1 and store.load(spark, out, "results", "r").where("layer = 'semantic'").count() == 1
    with pytest.raises(Exception, match="semantic"):
        engine.evaluate(spark, corpus, out, cfg, run="q", external=ext.withColumn("layer", F.lit("judge")))


def test_command_line(spark, corpus, tmp_path, capsys):
    out = str(tmp_path / "o")
    (tmp_path / "c.json").write_text('{"gates": {"absolute": {"latency_p95_s": {"max": 0.5}}}}')
    assert main_(["ingest", corpus, "--out", out]) == 0 and "2 clips" in capsys.readouterr().out
    assert main_(["run", corpus, "--out", out, "--config", str(tmp_path / "c.json"), "--strict", "--export", str(tmp_path / "long"), "--json", str(tmp_path / "json")]) == 1
    assert {r.scorer for r in spark.read.json(str(tmp_path / "json" / "results")).collect()} >= {"latency", "level"} and spark.read.json(str(tmp_path / "json" / "clips")).count() == 2
    said = capsys.readouterr().out
    assert "FAIL: 1 fail" in said and spark.read.parquet(str(tmp_path / "long")).count() > 3
    run = store.load(spark, out, "runs").first()["run_id"]
    assert main_(["report", run, "--out", out]) == 0 and "FAIL" in capsys.readouterr().out
    assert main_(["list-scorers"]) == 0 and "audio_judge" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        main_(["run", str(tmp_path / "nowhere"), "--out", out])
    assert main_(["cache-clear", "--out", out, "--scorer", "latency"]) == 0 and capsys.readouterr().out.split()[-1] == "1"
    (tmp_path / "m.json").write_text('[{"id": "s", "max_turns": 2}]')
    assert main_(["simulate", str(tmp_path / "m.json"), "--out", str(tmp_path / "s"), "-k", "1", "--baseline-version", "base", "--candidate-latency", "3", "--recordings", str(tmp_path / "wavs")]) == 1
    assert len(list((tmp_path / "wavs").glob("*.wav"))) == 2


def test_calibration_of_a_run(spark, tmp_path):
    out, csv = str(tmp_path / "o"), tmp_path / "g.csv"
    csv.write_text("clip_id,dimension,human_score\n# note,pace,3\ncall_a.wav,pace,4\nbbb,pace,2\nnope,pace,2\n")
    store.save(spark.createDataFrame([("aaa1", "/x/call_a.wav"), ("bbb2", "/x/call_b.wav")], "clip_id string, source_path string"), out, "clips", "r")
    store.save(spark.createDataFrame([("aaa1", {"judge_pace": 4.0}, None, 1), ("bbb2", {"judge_pace": 2.0}, None, 2)], "clip_id string, metrics map<string,double>, error string, seq long"), out, "results", "r")
    r = engine.calibrate(spark, str(csv), out, "r").collect()
    assert [(x.dimension, x.n, x.kappa, x.recommend_gate) for x in r] == [("pace", 2, 1.0, True)]
