"""Timeline and dynamics on hand-made calls and against scan-style loops on random ones."""

import math
import random
from collections import defaultdict

import pytest

from callweave.operators import dynamics, timeline

FIXTURE = [(0, "user_speech_start", 0.0), (1, "user_speech_end", 3.2), (2, "stt_final", 3.4), (3, "llm_first_token", 3.9), (4, "tts_first_audio", 4.1), (5, "agent_tts_start", 4.1), (6, "user_speech_start", 6.0), (7, "barge_in_detected", 6.05), (8, "agent_interrupted", 6.25), (9, "agent_tts_end", 6.25)]
KINDS = ["agent_tts_start", "agent_tts_end", "agent_interrupted", "user_speech_start", "user_speech_end", "stt_final", "tts_first_audio", "barge_in_detected"]


def events(spark, rows):
    return spark.createDataFrame(rows, "clip_id long, seq long, kind string, t_s double")


def segments(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "clip_id long, speaker string, start_s double, end_s double")


@pytest.fixture(scope="module")
def calls():
    rng = random.Random(3)
    return {c: [(k, rng.choice(KINDS), rng.randint(0, 80) / 8) for k in range(rng.randint(3, 24))] for c in range(250)}


@pytest.fixture(scope="module")
def table(spark, calls):
    return events(spark, [(c, *r) for c, rows in calls.items() for r in rows]).cache()


def loop_segments(rows):
    out, start = [], {}
    for _, kind, t in sorted(rows, key=lambda r: (r[2], r[0])):
        who = "agent" if kind.startswith("agent") else "caller" if kind.startswith("user") else None
        if who is None:
            continue
        if who in start:
            if t > start[who]:
                out.append((who, start[who], t))
            del start[who]
        if kind in ("agent_tts_start", "user_speech_start"):
            start[who] = t
    return out


def loop_union(segs):
    out = []
    for s, e in sorted(segs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_fixture(spark):
    ev = events(spark, [(1, *r) for r in FIXTURE])
    seg = timeline.pair_events(ev)
    assert {tuple(r)[1:] for r in seg.collect()} == {("caller", 0.0, 3.2), ("agent", 4.1, 6.25)}
    lat = dynamics.latency(ev, seg).first()
    assert lat.method == "ttft_events" and lat.n_turns == 1 and all(abs(lat[f"latency_{p}_s"] - 0.7) < 1e-9 for p in ("p50", "p95", "p99", "max"))
    b = dynamics.barge_metrics(dynamics.barge(ev, seg)).first()
    assert b.bargein_latency_p50_s == 0.2 and b.bargein_success_rate == 1.0 and b.bargein_false_alarm_rate == 0.0 and b.n_bargein_events == 1
    t = dynamics.turn_taking(seg).first()
    assert t.awkward_gap_count == 0 and abs(t.max_gap_s - 0.9) < 1e-9 and t.overlap_ratio == 0 and abs(t.agent_talk_ratio - 2.15 / 5.35) < 1e-9


def test_ignored_barge(spark):
    ev = events(spark, [(1, 0, "agent_tts_start", 4.0), (1, 1, "user_speech_start", 5.0), (1, 2, "barge_in_detected", 5.05), (1, 3, "agent_tts_end", 6.25)])
    b = dynamics.barge_metrics(dynamics.barge_attempts(ev)).first()
    assert b.n_bargein_events == 1 and b.bargein_success_rate == 0 and math.isnan(b.bargein_latency_p50_s) and math.isnan(b.bargein_latency_p95_s)


def test_interval_fixtures(spark):
    got = timeline.union(segments(spark, [("agent", 0.0, 1.0), ("agent", 0.5, 2.0), ("agent", 3.0, 4.0)])).collect()
    assert {(r.start_s, r.end_s) for r in got} == {(0.0, 2.0), (3.0, 4.0)}
    cut = lambda a, c: [(r.start_s, r.end_s) for r in timeline.intersect(segments(spark, [("agent", *a), ("caller", *c)])).collect()]
    assert cut((0.0, 2.0), (1.0, 3.0)) == [(1.0, 2.0)] and cut((0.0, 1.0), (2.0, 3.0)) == []
    one = dynamics.turn_gaps(segments(spark, [("caller", 0.0, 3.0), ("agent", 3.5, 4.0), ("agent", 4.0, 4.5), ("agent", 4.5, 5.0)])).collect()
    assert [r.latency_s for r in one] == [0.5]
    assert timeline.gaps(segments(spark, [("agent", 0.0, 2.0), ("agent", 5.0, 7.0)])).count() == 0
    assert [r.gap_s for r in timeline.gaps(segments(spark, [("caller", 0.0, 2.0), ("agent", 5.0, 7.0)])).collect()] == [3.0]


def test_segments_against_a_scan(calls, table):
    got = defaultdict(set)
    for r in timeline.pair_events(table).collect():
        got[r.clip_id].add((r.speaker, r.start_s, r.end_s))
    assert all(got[c] == set(loop_segments(rows)) for c, rows in calls.items())


def test_gaps_and_overlap_against_loops(calls, table):
    merged = timeline.union(timeline.pair_events(table)).cache()
    gaps, over = defaultdict(set), defaultdict(set)
    for r in timeline.gaps(merged).collect():
        gaps[r.clip_id].add((r.start_s, r.end_s))
    for r in timeline.intersect(merged).collect():
        over[r.clip_id].add((r.start_s, r.end_s))
    for c, rows in calls.items():
        seg = loop_segments(rows)
        a, k = (loop_union([x[1:] for x in seg if x[0] == w]) for w in ("agent", "caller"))
        turns = sorted([(s, e, "agent") for s, e in a] + [(s, e, "caller") for s, e in k])
        assert gaps[c] == {(x[1], y[0]) for x, y in zip(turns, turns[1:]) if x[2] != y[2] and y[0] > x[1]}
        want = {(max(p[0], q[0]), min(p[1], q[1])) for p in a for q in k}
        assert over[c] == {(s, e) for s, e in want if e - s >= 0.1}


def test_latencies_against_loops(calls, table):
    first, gap = defaultdict(list), defaultdict(set)
    for r in dynamics.ttft(table).collect():
        first[r.clip_id].append(r.latency_s)
    for r in dynamics.turn_gaps(timeline.pair_events(table)).collect():
        gap[r.clip_id].add((r.caller_end_s, r.latency_s))
    for c, rows in calls.items():
        heard = [t for _, k, t in rows if k == "stt_final"]
        want = [t - max(h for h in heard if h <= t) for _, k, t in rows if k == "tts_first_audio" and any(h <= t for h in heard)]
        assert sorted(first[c]) == sorted(want)
        seg, used, out = loop_segments(rows), None, set()
        for s in sorted(x[1] for x in seg if x[0] == "agent"):
            ends = [x[2] for x in seg if x[0] == "caller" and x[2] <= s]
            if ends and (used is None or max(ends) > used):
                used = max(ends)
                out.add((used, s - used))
        assert gap[c] == out


def test_barges_against_loops(calls, table):
    got, line = defaultdict(set), defaultdict(set)
    for r in dynamics.barge_attempts(table).collect():
        got[r.clip_id].add((r.seq, r.latency_s, r.utterance_s, r.success))
    for r in dynamics.barge_attempts_timeline(timeline.pair_events(table)).collect():
        line[r.clip_id].add((r.barge_s, r.latency_s))
    for c, rows in calls.items():
        at = lambda kind: [t for _, k, t in rows if k == kind]  # noqa: B023, E731
        want = set()
        for n, k, t in rows:
            if k != "barge_in_detected":
                continue
            stop = min((x for x in at("agent_interrupted") if x >= t), default=None)
            onset = min((x for x in at("user_speech_start") if abs(x - t) <= 0.5), default=t)
            end = min((x for x in at("user_speech_end") if x >= onset), default=None)
            want.add((n, 15.0 if stop is None else round(stop - t, 3), None if end is None else end - onset, stop is not None and stop - t <= 1.5))
        assert got[c] == want
        seg = loop_segments(rows)
        agents = sorted(x[1:] for x in seg if x[0] == "agent")
        hit = {(s, next((e for a, e in agents if a < s < e), None)) for w, s, _ in seg if w == "caller"}
        assert line[c] == {(s, round(e - s, 3)) for s, e in hit if e is not None}


def test_vad_runs_and_smoothing(spark):
    flags = [0, 1, 1, 0, 1, 0, 0, 0, 0, 1, 1, 1]
    frames = spark.createDataFrame([(1, i, bool(v)) for i, v in enumerate(flags)], "clip_id long, frame long, speech boolean")
    runs = timeline.runs(frames, 0.1).cache()
    near = lambda df: sorted((round(r.start_s, 6), round(r.end_s, 6)) for r in df.collect())
    assert near(runs) == [(0.1, 0.3), (0.4, 0.5), (0.9, 1.2)]
    assert near(timeline.smooth(runs)) == [(0.1, 0.5), (0.9, 1.2)]
    assert near(timeline.smooth(runs, gap=0.05, least=0.15)) == [(0.1, 0.3), (0.9, 1.2)]
    assert timeline.pair_events(events(spark, [])).count() == 0 and dynamics.turn_taking(segments(spark, [])).count() == 0


def test_false_alarms_at_the_millisecond(spark):
    """An utterance of 0.09996 s counts as a tenth of a second; starts are found up to half a second away."""
    ev = [("a", 0, "barge_in_detected", 1.0), ("a", 1, "user_speech_start", 1.0), ("a", 2, "user_speech_end", 1.09996), ("a", 3, "agent_interrupted", 1.2), ("b", 0, "user_speech_start", 4.5), ("b", 1, "barge_in_detected", 5.0), ("b", 2, "user_speech_end", 5.25), ("c", 0, "user_speech_start", 4.4999), ("c", 1, "barge_in_detected", 5.0)]
    df = spark.createDataFrame(ev, "clip_id string, seq long, kind string, t_s double")
    got = {r.clip_id: r for r in dynamics.barge_attempts(df).collect()}
    assert got["a"].utterance_s == 0.1 and got["a"].onset_s == 1.0 and got["b"].onset_s == 4.5 and got["b"].utterance_s == 0.75 and got["c"].onset_s == 5.0 and got["c"].utterance_s is None
    assert {r.clip_id: r.bargein_false_alarm_rate for r in dynamics.barge_metrics(dynamics.barge_attempts(df)).collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_equal_speaking_times_of_other_sums(spark):
    """Three tenths are 0.3 of one and 0.1 + 0.2 of the other: a tie, which the lesser label wins."""
    rows = [("a", "x", 0.0, 0.3), ("a", "y", 0.0, 0.1), ("a", "y", 0.0, 0.2), ("b", "x", 0.0, 0.3), ("b", "y", 0.0, 0.300002)]
    df = spark.createDataFrame(rows, "clip_id string, label string, start_s double, end_s double")
    got = {(r.clip_id, r.end_s): r.speaker for r in timeline.label_speakers(df).collect()}
    assert got == {("a", 0.3): "agent", ("a", 0.1): "caller", ("a", 0.2): "caller", ("b", 0.3): "caller", ("b", 0.300002): "agent"}
