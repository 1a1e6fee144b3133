"""``python -m callweave``: run, ingest, report, calibrate, simulate, call, list-scorers, cache-clear."""

from __future__ import annotations

import argparse
import json
import os
import sys

from callweave import config as conf
from callweave import engine, report, session
from callweave.functions.gates import prompt_version
from callweave.operators import conversation, ingest, signal
from callweave.operators import simulate as scenarios
from callweave.sources import store
from callweave.streaming import recorder
from callweave.streaming.calls import Policy


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="callweave")
    sub = p.add_subparsers(dest="cmd", required=True)

    def command(name: str, about: str, *, scored: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("--config", help="YAML or JSON")
        c.add_argument("--out", help="folder of runs, by default outputs_dir")
        if scored:
            c.add_argument("--no-judge", action="store_true", help="leave out the judge")
            c.add_argument("--strict", action="store_true", help="exit 1 when a gate fails")
        return c

    c = command("run", "score a corpus", scored=True)
    c.add_argument("corpus", nargs="?")
    c.add_argument("--no-cache", action="store_true", help="score all again")
    c.add_argument("--baseline", help="a run, the beginning of one, or previous")
    c.add_argument("--export", help="write the long table there")
    c.add_argument("--json", help="write the run there as lines of JSON: results, clips and configuration")
    c = command("report", "gates and page of a stored run again, by its own configuration unless one is given", scored=True)
    c.add_argument("run_id")
    c = command("ingest", "decode a corpus and list its clips")
    c.add_argument("corpus", nargs="?")
    c = command("calibrate", "agreement of the judge with a CSV of labels")
    c.add_argument("golden")
    c.add_argument("--corpus", help="let the judge hear these first")
    c.add_argument("--run", help="take a stored run's scores")
    c = command("simulate", "scripted agents; exit 1 when the candidate regresses", scored=True)
    c.add_argument("manifest")
    c.add_argument("--agent-version", default="candidate")
    c.add_argument("--baseline-version")
    c.add_argument("--candidate-latency", type=float, default=0.8)
    c.add_argument("--baseline-latency", type=float, default=0.8)
    c.add_argument("-k", type=int, help="calls of each scenario")
    c.add_argument("--recordings", help="keep the recordings there")
    c = command("call", "a recording from a log of media-stream messages, scored", scored=True)
    c.add_argument("messages", help="JSON lines")
    c.add_argument("--manifest", help="scenarios, of which the first is taken")
    c.add_argument("--agent-version", default="candidate")
    c.add_argument("--prompt", help="the agent's instructions, whose digest is the prompt's version")
    c.add_argument("--recordings", required=True, help="where the recording goes")
    sub.add_parser("list-scorers", help="names and layers")
    c = command("cache-clear", "forget results")
    c.add_argument("--scorer")
    return p


def keep(calls: list, folder: str) -> None:
    os.makedirs(folder, exist_ok=True)
    for name, wav, car in calls:
        with open(os.path.join(folder, f"{name}.wav"), "wb") as f:
            f.write(wav)
        with open(os.path.join(folder, f"{name}.json"), "w") as f:
            f.write(car)


def main(args: list[str] | None = None) -> int:
    a = arguments().parse_args(args)
    if a.cmd == "list-scorers":
        print("\n".join(f"{n:<16}{engine.build(n).layer}" for n in sorted(engine.REGISTRY)))
        return 0
    cfg = conf.load(a.config)
    out = a.out or cfg.outputs_dir
    if getattr(a, "no_judge", False):
        cfg = cfg.without_judge()
    spark = session.local()
    if a.cmd in ("run", "ingest"):
        corpus = a.corpus or cfg.corpus_dir
        if not corpus:
            print("no corpus is given", file=sys.stderr)
            return 2
    if a.cmd == "ingest":
        n = 0
        for r in engine.take_in(spark, corpus, out, cfg).orderBy("source_path").select("clip_id", "duration_s", "n_source_channels", "duration_flag", "source_path").toLocalIterator():
            print(f"{r.clip_id[:12]}  {r.duration_s:8.1f}s  {r.n_source_channels} channels  {r.duration_flag}  {r.source_path}")
            n += 1
        print(f"{n} clips")
        return 0
    if a.cmd == "calibrate":
        if a.corpus:
            r = engine.calibrate_corpus(spark, a.golden, a.corpus, out, cfg)
        else:
            run = a.run or ingest.pick_baseline(store.load(spark, out, "results"), "").first()[0]
            rows = engine.calibrate(spark, a.golden, out, run, cfg.calibration.kappa_bar).cache()
            r = {"run_id": run, "rows": [x.asDict() for x in rows.collect()], "kappa_bar": cfg.calibration.kappa_bar, "text": report.agreement(rows)}
        report.save_agreement(os.path.join(out, "calibration"), r)
        print(r["text"])
        return 0
    if a.cmd == "cache-clear":
        cache = store.whole(spark, out, "cache")
        if cache is None:
            print(0)
            return 0
        left = ingest.cache_clear(cache, a.scorer)
        print(cache.count() - left.count())
        # written beside and moved, as Spark cannot overwrite what it reads
        left.write.mode("overwrite").parquet(os.path.join(out, "cache.new"))
        spark.read.parquet(os.path.join(out, "cache.new")).write.mode("overwrite").parquet(os.path.join(out, "cache"))
        return 0
    if a.cmd == "report":
        r = engine.judge_run(spark, out, cfg if a.config else None, a.run_id)
    elif a.cmd == "simulate":
        if a.k:
            cfg.simulate.k_runs = a.k
        table = scenarios.scenario_table(spark, conf.read(a.manifest))
        late = a.candidate_latency, a.baseline_latency
        agents = {a.agent_version: lambda seed: conversation.ScriptedAgent(late[0], seed=seed)}
        if a.baseline_version:
            agents[a.baseline_version] = lambda seed: conversation.ScriptedAgent(late[1], seed=seed)
        r = engine.simulate(spark, table, agents, out, cfg)
        if a.recordings:
            for x in store.load(spark, out, "calls", "simulated").toLocalIterator():
                keep([(x.call_id, bytes(x.wav), x.sidecar)], a.recordings)
    elif a.cmd == "call":
        scenario = {"id": "call"}
        if a.manifest:
            scenario = json.loads(scenarios.scenario_table(spark, conf.read(a.manifest)).first()["body"])
        barge = scenario.get("barge_in") or {}
        t = cfg.telephony
        policy = Policy(vad_rms=t.vad_rms, end_silence_ms=int(t.end_silence_ms), barge=bool(barge.get("enabled", False)), after_ms=int(1000 * barge.get("after_agent_s", 2.5)), max_barges=int(barge.get("max_barge_ins", 1)), max_turns=int(scenario.get("max_turns") or 8))
        noise = scenario.get("background") or {}
        bed = signal.bed([signal.tone(1.5, 190, 1), signal.tone(2.0, 140, 2)], gain_db=float(noise.get("gain_db", -15.0))) if noise.get("enabled") else None
        version = None
        if a.prompt:
            from pyspark.sql import functions as F

            with open(a.prompt) as f:
                version = spark.range(1).select(prompt_version(F.lit(f.read()))).first()[0]
        s = recorder.Session(voice=recorder.scripted_voice(most=policy.max_turns), policy=policy, background=bed, scenario=scenario, version=a.agent_version, prompt_version=version)
        with open(a.messages) as f:
            recorder.replay((json.loads(line) for line in f if line.strip()), s)
        wav, car, _ = s.recording()
        keep([(car["call_id"], wav, json.dumps(car, indent=2))], a.recordings)
        cfg.ingest.identity_from_call_id = True
        r = engine.evaluate(spark, a.recordings, out, cfg)
    else:
        if a.baseline:
            cfg.gates.regression.baseline = a.baseline
        r = engine.evaluate(spark, corpus, out, cfg, cached=not a.no_cache)
        if a.json:
            for name in ("results", "clips", "runs"):
                rows = store.load(spark, out, name, r["run_id"]).drop("mono", "agent", "caller")
                store.export_json(rows, os.path.join(a.json, name))
        if a.export:
            print(store.export_results(store.load(spark, out, "metrics_long", r["run_id"]), a.export))
    print(r["text"])
    print(r["html"])
    bad = a.strict and not r["passed"]
    if "comparison" in r:
        print(report.comparison(r["comparison"]))
        bad = bad or not r["comparison"]["passed"]
    return int(bad)


if __name__ == "__main__":
    sys.exit(main())
