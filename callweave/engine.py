"""Scorers, and the run from recordings to a verdict."""

from __future__ import annotations

import datetime as dt
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import report
from callweave.config import Config
from callweave.functions.gates import rubric_version, scorer_hash, self_judged
from callweave.operators import agreement, compare, conversation, dynamics, ingest, judge, metrics, signal, timeline
from callweave.operators import report as shown
from callweave.session import ship
from callweave.sources import recordings, store

RESULT = "clip_id string, scorer string, layer string, metrics map<string,double>, raw string, error string, duration_ms double, cached boolean"
NAMES = [f.split()[0] for f in RESULT.replace("<string,double>", "").split(", ")]
SEGMENTS = ["clip_id", "speaker", "start_s", "end_s", "source", "estimated"]

#: What finds speech in samples: ``(samples, rate, threshold)`` to a flag for each frame of ``signal.HOP``.
VADS: dict[str, Callable[[np.ndarray, int, float], np.ndarray]] = {"energy": signal.voiced}
#: Who speaks when in a mono track: ``(samples, rate)`` to ``(label, start, end)``; none here.
DIARIZERS: dict[str, Callable[[np.ndarray, int], list]] = {}
#: Models of speech quality: ``(samples, rate)`` to numbers; none here.
MODELS: dict[str, Callable[[np.ndarray, int], dict[str, float]]] = {}
#: Judges by backend: a configuration to what ``judge.ask`` calls; none here.
JUDGES: dict[str, Callable[[Config], Callable]] = {}


@dataclass
class Context:
    """What scorers read: clips with their samples and metadata, their events and their timelines."""

    clips: DataFrame
    events: DataFrame
    segments: DataFrame
    client: Callable | None = field(default=None)

    def only(self, clips: DataFrame) -> Context:
        ids = clips.select("clip_id").distinct()
        return replace(self, clips=clips, events=self.events.join(ids, "clip_id", "left_semi"), segments=self.segments.join(ids, "clip_id", "left_semi"))


class Scorer(Protocol):
    """Set-based: from clips to results in the shape of ``RESULT``. ``settings`` are those that change
    results, and ``applicable`` the clips that can be scored at all."""

    name: str
    layer: str
    version: str

    def settings(self, config: Config) -> dict: ...
    def applicable(self, clips: DataFrame, config: Config) -> DataFrame: ...
    def score(self, context: Context, config: Config) -> DataFrame: ...


REGISTRY: dict[str, Callable[[], Scorer]] = {}


def register(cls: type) -> type:
    if cls.name in REGISTRY:
        raise ValueError(f"scorer {cls.name} is there already")
    REGISTRY[cls.name] = cls
    return cls


def build(name: str) -> Scorer:
    if name not in REGISTRY:
        raise KeyError(f"no scorer {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]()


class Base:
    version = "1"

    def settings(self, config: Config) -> dict:
        return {}

    def applicable(self, clips: DataFrame, config: Config) -> DataFrame:
        return clips


def as_results(df: DataFrame, scorer: Scorer, names: list[str], clips: DataFrame, error: Column | str, raw: Column | None = None) -> DataFrame:
    """Columns of numbers as a metric map; a clip without a row gets an error, and one whose row has
    ``error`` that."""
    m = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))]), lambda k, v: v.isNotNull())
    failed = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    got = df.select("clip_id", F.when(failed.isNull(), m).alias("metrics"), (F.lit(None).cast("string") if raw is None else F.to_json(raw)).alias("raw"), failed.alias("failed"), F.lit(True).alias("there"))
    rows = clips.select("clip_id").distinct().join(got, "clip_id", "left")
    error = F.when(F.col("there").isNull(), F.lit(error) if isinstance(error, str) else error).otherwise(F.col("failed"))
    return rows.select("clip_id", F.lit(scorer.name).alias("scorer"), F.lit(scorer.layer).alias("layer"), "metrics", "raw", error.alias("error"), F.lit(0.0).alias("duration_ms"), F.lit(False).alias("cached"))


class RowScorer(Base):
    """A scorer of one clip's samples: ``measure(samples, rate, config)`` gives numbers. The agent's
    channel is heard where there is one, else the mix. Errors become error rows and never end a run.
    A model is loaded once in ``setup`` of each worker; where it must not run several times at once,
    as ``single_flight`` says, ``runner.cpu_workers`` bounds the tasks."""

    name, layer, single_flight = "row", "acoustic", True

    def setup(self) -> None: ...

    def measure(self, samples: np.ndarray, rate: int, config: Config) -> dict[str, float]:
        raise NotImplementedError

    def score(self, context: Context, config: Config) -> DataFrame:
        ship(context.clips.sparkSession)
        me = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            me.setup()
            for pdf in batches:
                out = []
                for clip, x, rate, track in pdf.itertuples(index=False):
                    t, m, e = time.perf_counter(), None, None
                    try:
                        if x is None or not len(x):
                            raise ValueError("no audio")
                        m = {k: float(v) for k, v in me.measure(np.asarray(x, np.float32), int(rate), config).items()}
                    except Exception as err:
                        e = f"{type(err).__name__}: {err}"
                    out.append((clip, me.name, me.layer, m, json.dumps({"input_channel": track}), e, 1000 * (time.perf_counter() - t), False))
                yield pd.DataFrame(out, columns=NAMES)

        own = F.size("agent") > 0
        rows = context.clips.select("clip_id", F.when(own, F.col("agent")).otherwise(F.col("mono")).alias("samples"), "sample_rate", F.when(own, "agent_only").otherwise("mono").alias("track"))
        if self.single_flight and config.runner.cpu_workers > 0:
            rows = rows.repartition(config.runner.cpu_workers)
        return rows.mapInPandas(run, RESULT)


def windowed(samples: np.ndarray, rate: int, config: Config, one: Callable[[np.ndarray], dict[str, float]]) -> dict[str, float]:
    """Numbers over a clip's windows, silent ones left out, each brought together by the configured
    median or mean of its real values."""
    a = config.acoustic
    size = int(a.window_s * rate)
    parts = [samples] if size <= 0 or len(samples) <= size else [samples[i : i + size] for i in range(0, len(samples), size)]
    parts = [p for k, p in enumerate(parts) if len(p) >= int(a.min_window_s * rate) or k == 0]
    loud = [p for p in parts if len(p) and np.sqrt(np.mean(np.square(p, dtype=np.float64))) >= signal.SILENT]
    if not loud:
        raise ValueError("silent clip: no window can be scored")
    found = [one(p) for p in loud]
    join = np.nanmedian if a.aggregate == "median" else np.nanmean
    return {k: float(join([f[k] for f in found])) if any(f[k] == f[k] for f in found) else float("nan") for k in found[0]}


class _Windowed(RowScorer):
    def settings(self, config: Config) -> dict:
        return dict(config.acoustic)


@register
class Level(_Windowed):
    """Loudness and peak over windows: needs no model."""

    name = "level"

    def measure(self, samples: np.ndarray, rate: int, config: Config) -> dict[str, float]:
        db = lambda p: {"level_db": 20 * float(np.log10(np.sqrt(np.mean(np.square(p, dtype=np.float64)))))}
        return windowed(samples, rate, config, db) | {"peak": float(np.abs(samples).max())}


def _model(scorer: str, whole: bool = False) -> type:
    """A scorer by a model of ``MODELS``, over windows unless the model takes whole clips."""

    class Model(_Windowed):
        name = scorer

        def measure(self, samples: np.ndarray, rate: int, config: Config) -> dict[str, float]:
            if scorer not in MODELS:
                raise LookupError(f"no model {scorer} has been registered")
            one = lambda p: MODELS[scorer](p, rate)
            return one(samples) if whole else windowed(samples, rate, config, one)

    return register(Model)


for _name, _whole in (("dnsmos", False), ("nisqa", True), ("utmos", False), ("squim", False)):
    _model(_name, _whole)


# timelines


def speech(clips: DataFrame, tracks: dict[str, str], config: Config) -> DataFrame:
    """``clip_id``, ``speaker``, ``start_s`` and ``end_s`` of the speech in columns of samples, by the
    configured finder of voice activity."""
    ship(clips.sparkSession)
    d = config.dynamics
    if d.vad_backend not in VADS:
        raise LookupError(f"no voice activity {d.vad_backend}; there are {sorted(VADS)}")
    find = VADS[d.vad_backend]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flags = [np.asarray(find(np.asarray(x, np.float32), int(r), d.vad_threshold), bool).tolist() for x, r in zip(pdf["samples"], pdf["rate"], strict=True)]
            yield pd.DataFrame({"clip_id": pdf["clip_id"], "speaker": pdf["speaker"], "rate": pdf["rate"], "flags": flags})

    each = F.explode(F.array(*[F.struct(F.lit(s).alias("speaker"), F.col(c).alias("samples")) for s, c in tracks.items()])).alias("t")
    rows = clips.select("clip_id", F.col("sample_rate").alias("rate"), each).select("clip_id", "t.speaker", "t.samples", "rate").where(F.size("samples") > 0)
    found = rows.mapInPandas(run, "clip_id string, speaker string, rate int, flags array<boolean>")
    frames = found.select(F.struct("clip_id", "speaker").alias("clip_id"), F.posexplode("flags").alias("frame", "speech"))
    regions = timeline.smooth(timeline.runs(frames, signal.HOP / config.ingest.target_sr))
    return regions.select("clip_id.clip_id", "clip_id.speaker", "start_s", "end_s")


def timelines(clips: DataFrame, config: Config) -> DataFrame:
    """``SEGMENTS`` of every clip: from its events, else from the speech in its two channels, else from
    its mono track, where a diarizer tells who speaks, or all speech is the agent's; the last is
    estimated."""
    known = timeline.source_of(clips.withColumn("has_events", F.coalesce(F.size("metadata.events") > 0, F.lit(False))))
    of = lambda s: known.where(F.col("source") == s)
    said = timeline.pair_events(recordings.gateway_events(of("events")))
    two = speech(of("channels"), {"agent": "agent", "caller": "caller"}, config)
    if DIARIZERS:
        who = next(iter(DIARIZERS.values()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [(c, str(k), float(a), float(b)) for c, x, r in pdf.itertuples(index=False) for k, a, b in who(np.asarray(x, np.float32), int(r))]
                yield pd.DataFrame(out, columns=["clip_id", "label", "start_s", "end_s"])

        mono = timeline.label_speakers(of("diarization").where(F.size("mono") > 0).select("clip_id", "mono", "sample_rate").mapInPandas(run, "clip_id string, label string, start_s double, end_s double"))
    else:
        mono = timeline.mono_speech(speech(of("diarization"), {"agent": "mono"}, config)).drop("estimated")
    parts = [(said, "events"), (two, "channels"), (mono, "diarization")]
    return reduce(DataFrame.unionByName, [p.select("clip_id", "speaker", "start_s", "end_s", F.lit(s).alias("source"), F.lit(s == "diarization").alias("estimated")) for p, s in parts])


class _Dynamics(Base):
    layer = "dynamics"

    def settings(self, config: Config) -> dict:
        return {"vad": [config.dynamics.vad_backend, config.dynamics.vad_threshold]}

    @staticmethod
    def origin(context: Context) -> DataFrame:
        """``clip_id``, ``source`` and ``estimated`` of each clip with segments."""
        return context.segments.groupBy("clip_id").agg(F.first("source").alias("source"), F.first("estimated").alias("estimated"))


@register
class Latency(_Dynamics):
    name = "latency"

    def score(self, context: Context, config: Config) -> DataFrame:
        out = dynamics.latency(context.events, context.segments).join(self.origin(context), "clip_id", "left")
        return as_results(out, self, ["latency_p50_s", "latency_p95_s", "latency_p99_s", "latency_max_s", "n_turns"], context.clips, "no response of the agent to time: that takes events or both speakers", F.struct("method", "source", "estimated"))


@register
class TurnTaking(_Dynamics):
    name = "turn_taking"

    def settings(self, config: Config) -> dict:
        return super().settings(config) | {"gap": config.dynamics.gap_threshold_s, "overlap": config.dynamics.overlap_min_s}

    def score(self, context: Context, config: Config) -> DataFrame:
        total = context.clips.select("clip_id", F.col("duration_s").alias("total_s"))
        out = dynamics.turn_taking(context.segments, total, config.dynamics.gap_threshold_s, config.dynamics.overlap_min_s).join(self.origin(context), "clip_id", "left")
        places = dynamics.awkward(timeline.gaps(timeline.union(context.segments)), config.dynamics.gap_threshold_s).select("clip_id", "places")
        return as_results(out.join(places, "clip_id", "left"), self, ["awkward_gap_count", "max_gap_s", "overlap_ratio", "agent_talk_ratio"], context.clips, "no speech was found", F.struct("places", "source", "estimated"))


@register
class BargeIn(_Dynamics):
    name = "barge_in"

    def settings(self, config: Config) -> dict:
        return super().settings(config) | {"window": config.dynamics.bargein_success_window_s, "least": config.dynamics.min_caller_utterance_ms}

    def applicable(self, clips: DataFrame, config: Config) -> DataFrame:
        return clips.where((F.size("metadata.events") > 0) | ((F.size("agent") > 0) & (F.size("caller") > 0)))

    def score(self, context: Context, config: Config) -> DataFrame:
        attempts = dynamics.barge(context.events, context.segments.where("NOT estimated"), config.dynamics.bargein_success_window_s)
        flagged = context.events.where("kind = 'barge_in_detected'").select("clip_id").distinct().withColumn("flagged", F.lit(True))
        mono = context.clips.select("clip_id").distinct().join(self.origin(context), "clip_id", "left").join(flagged, "clip_id", "left")
        measured = dynamics.barge_metrics(attempts, config.dynamics.min_caller_utterance_ms / 1000)
        listed = attempts.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("onset_s", "latency_s", "success", "utterance_s"))).alias("attempts"))
        out = mono.join(measured, "clip_id", "left").join(listed, "clip_id", "left").withColumn("n_bargein_events", F.coalesce("n_bargein_events", F.lit(0)))
        out = out.withColumn("error", F.when(F.col("flagged").isNull() & F.col("estimated"), "interruptions cannot be told from a mono track"))
        return as_results(out, self, ["bargein_latency_p50_s", "bargein_latency_p95_s", "bargein_success_rate", "bargein_false_alarm_rate", "n_bargein_events"], context.clips, "no timeline", F.struct("attempts", F.coalesce(F.when(F.col("flagged"), "events"), "source").alias("source")))


@register
class AudioJudge(Base):
    """A judge that hears the calls. Its client comes from ``JUDGES`` by the configured backend, or with
    the run; without one every clip has an error row."""

    name, layer = "audio_judge", "judge"

    @staticmethod
    def text(path: str | None, instead: str) -> str:
        if path and os.path.exists(path):
            with open(path) as f:
                return f.read()
        return instead

    def settings(self, config: Config) -> dict:
        j = config.judge
        return {k: j[k] for k in ("backend", "model", "judged_channel", "domain", "thinking_budget", "temperature", "max_audio_s")} | {"rubric": self.text(j.rubric_path, judge.RUBRIC), "system": self.text(j.system_prompt_path, judge.SYSTEM)}

    def applicable(self, clips: DataFrame, config: Config) -> DataFrame:
        if not config.judge.exclude_if_model_family_matches:
            return clips
        return clips.where(~self_judged(F.col("metadata.tts_provider"), F.lit(config.judge.judge_model_family)))

    def score(self, context: Context, config: Config) -> DataFrame:
        j = config.judge
        client = context.client or (JUDGES[j.backend](config) if j.backend in JUDGES else None)
        if client is None:
            none = context.clips.select("clip_id").where(F.lit(False))
            return as_results(none, self, [], context.clips, f"no judge is registered for the backend {j.backend!r}")
        heard, said = judge.channel(j.judged_channel)
        system = judge.prompt(said, judge.domain(F.col("metadata.domain"), j.domain), self.text(j.system_prompt_path, judge.SYSTEM))
        rubric = self.text(j.rubric_path, judge.RUBRIC)
        prompts = context.clips.select("clip_id", system.alias("system"), judge.cap(heard, F.col("sample_rate"), j.max_audio_s).alias("audio"))
        answers = judge.ask(prompts, client, rubric, j.parse_retries + 1, j.max_retries, j.max_concurrency).withColumnRenamed("error", "failed")
        read = judge.parse(answers)
        own = context.clips.sparkSession.range(1).select(rubric_version(F.lit(rubric))).first()[0]
        raw = F.to_json(F.struct(F.col("object").alias("reply"), F.coalesce(F.nullif(F.col("rubric_version"), F.lit("unknown")), F.lit(own)).alias("rubric_version")))
        return read.select("clip_id", F.lit(self.name).alias("scorer"), F.lit(self.layer).alias("layer"), F.when(F.col("failed").isNull(), F.col("metrics")).alias("metrics"), raw.alias("raw"), F.coalesce("failed", "error").alias("error"), "duration_ms", F.lit(False).alias("cached"))


# runs


def score(context: Context, config: Config, cache: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Results of all selected scorers over the clips that they apply to, those in the cache taken
    from it. The key has the clip, the scorer, its settings, and what it reads beside the audio."""
    out = []
    for name in config.selected() if names is None else names:
        s = build(name)
        h = scorer_hash(name, s.version, s.settings(config))
        inputs = F.sha2(F.to_json(F.struct("clip_id", "metadata")), 256)
        key = ingest.cache_key(F.col("clip_id"), F.lit(name), F.concat(F.lit(h), inputs))
        keyed = s.applicable(context.clips, config).withColumn("cache_key", key)
        if cache is None:
            fresh, hits = keyed, None
        else:
            fresh = ingest.cache_misses(keyed, cache)
            hits = keyed.select("cache_key", "clip_id").join(cache.drop("clip_id", "cached"), "cache_key").withColumn("cached", F.lit(True))
        done = s.score(context.only(fresh.drop("cache_key")), config).join(fresh.select("clip_id", "cache_key").distinct(), "clip_id")
        done = done.withColumn("scorer_config_hash", F.lit(h))
        out.append(done if hits is None else done.unionByName(hits.withColumn("scorer_config_hash", F.lit(h)).select(*done.columns)))
    return reduce(DataFrame.unionByName, out)


def take_in(spark: SparkSession, corpus: str | DataFrame, out: str, config: Config) -> DataFrame:
    """The clips of a corpus, which is a folder or a table of recordings with their metadata, one for
    each id and the first by path: what has been decoded with these settings before is taken from
    the table ``decoded``, and the rest is decoded and added to it."""
    i = config.ingest
    found = corpus
    if isinstance(corpus, str):
        if "://" not in corpus and not os.path.isdir(corpus):
            raise FileNotFoundError(corpus)
        found = recordings.with_metadata(recordings.discover(spark, corpus, tuple(i.accept_extensions)), recordings.sidecars(spark, corpus))
    keyed = recordings.source_key(found, i.target_sr, i.identity_from_call_id, i.normalize_dbfs)
    have = store.whole(spark, out, "decoded")
    fresh = keyed if have is None else keyed.join(have.select("source_key").distinct(), "source_key", "left_anti")
    # of files that are decoded alike, one is
    one = fresh.dropDuplicates(["source_key"])
    new = recordings.decode(one, i.target_sr, i.identity_from_call_id, i.normalize_dbfs).where("error IS NULL").join(one.select("source_path", "source_key"), "source_path").drop("source_path", "error")
    store.append(new, out, "decoded")
    have = store.whole(spark, out, "decoded").dropDuplicates(["source_key"])
    clips = ingest.first_by_path(keyed.select("source_path", "metadata", "source_key").join(have, "source_key"))
    return ingest.flag_duration(clips, i.min_duration_s, i.max_duration_s)


def evaluate(spark: SparkSession, corpus: str | DataFrame, out: str, config: Config, run: str | None = None, cached: bool = True, client: Callable | None = None, external: DataFrame | None = None) -> dict:
    """Decode, score, gate, compare with the baseline, store, render. Returns the verdict's row and the
    run's id. ``external`` holds results of elsewhere in the shape of ``RESULT``, of the semantic
    layer."""
    run = run or store.run_id()
    began = dt.datetime.now(dt.UTC).isoformat()
    store.save(take_in(spark, corpus, out, config), out, "clips", run)
    clips = store.load(spark, out, "clips", run)
    # built once for all scorers
    store.save(timelines(clips, config), out, "segments", run)
    context = Context(clips, recordings.gateway_events(clips), store.load(spark, out, "segments", run), client)
    results = score(context, config, store.cache_get(spark, out, cached))
    if external is not None:
        own = external.select(*NAMES).withColumns({"cache_key": F.lit(None).cast("string"), "scorer_config_hash": F.lit("external")})
        results = metrics.union_external(results, own)
    wide = metrics.enrich(results, clips.select("clip_id", "source_path", *[F.col(f"metadata.{v}").alias(v) for v in metrics.VERSIONS], F.col("metadata.extra")["scenario_id"].alias("scenario")))
    store.save(wide.withColumn("seq", F.xxhash64("scorer", "clip_id")), out, "results", run)
    stored = store.load(spark, out, "results", run)
    if cached:
        store.cache_put(stored.where("NOT cached AND cache_key IS NOT NULL").select("cache_key", "clip_id", "scorer", "layer", "metrics", "raw", "error", "duration_ms"), out)
    row = [(corpus if isinstance(corpus, str) else "", config.snapshot(), began, dt.datetime.now(dt.UTC).isoformat())]
    store.save(spark.createDataFrame(row, "corpus string, config string, started_at string, finished_at string"), out, "runs", run)
    return judge_run(spark, out, config, run)


def judge_marks(results: DataFrame) -> DataFrame:
    """``clip_id``, ``dimension``, ``score`` and ``reasoning`` of judge results without an error; of
    several of one clip the last counts."""
    one = results.where("layer = 'judge' AND error IS NULL").groupBy("clip_id").agg(F.max_by(F.struct("raw", "metrics"), "seq").alias("o"))
    said = F.get_json_object("o.raw", "$.reply")
    rows = one.select("clip_id", said.alias("said"), F.explode("o.metrics").alias("metric", "value")).where("metric LIKE 'judge_%'")
    dim = F.expr("substr(metric, 7)")
    why = F.from_json("said", "map<string,string>")
    return rows.select("clip_id", dim.alias("dimension"), F.bround("value").cast("int").alias("score"), F.when(dim == "overall", why["summary"]).otherwise(F.get_json_object(F.element_at(why, dim), "$.reasoning")).alias("reasoning"))


def judge_run(spark: SparkSession, out: str, config: Config | None, run: str) -> dict:
    """Gates, regression and report of a stored run, as when it was made or again later; without a
    configuration by the one that it was made with."""
    about = store.load(spark, out, "runs", run)
    about = about.first() if about is not None else None
    if config is None:
        config = Config(**json.loads(about["config"])) if about else Config()
    results = store.load(spark, out, "results", run)
    long = metrics.flatten(results)
    gates = metrics.gate_table(spark, config.gates.absolute)
    gated = metrics.gated(long, gates)
    outcomes = gated.where("status IS NOT NULL").select("clip_id", "metric", "value", "status", "threshold")
    r = config.gates.regression
    regressions = spark.createDataFrame([], "clip_id string, metric string, current double, baseline double, drop double, status string")
    every = store.load(spark, out, "results")
    base = ingest.pick_baseline(every, run, r.baseline).first()[0]
    if r.enabled and base and r.max_delta:
        old = metrics.flatten(store.load(spark, out, "results", base))
        regressions = metrics.regression(long, old, gates, metrics.delta_table(spark, r.max_delta), list(r.group_by))
    both = outcomes.unionByName(regressions.select("clip_id", "metric", F.col("current").alias("value"), "status", F.col("baseline").alias("threshold")))
    word = metrics.verdict(outcomes, regressions).first()
    summary = metrics.summary(long, gates)
    store.save(gated, out, "metrics_long", run)
    marks = judge_marks(results)
    clips = store.load(spark, out, "clips", run)
    facts = None if clips is None else clips.groupBy("clip_id").agg(F.min("source_path").alias("source_path"), F.first("duration_s").alias("duration_s"), F.first("metadata.agent_version").alias("agent_version"))
    errors = results.where("error IS NOT NULL").groupBy("clip_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "scorer", "error"))).alias("messages"))
    detail = shown.clip_detail(gated).join(errors, "clip_id", "left")
    detail = detail if facts is None else detail.join(facts, "clip_id", "left")
    path = os.path.join(out, f"{run}.html")
    report.write(
        path, run, config, about, word, summary=summary, histogram=shown.histogram(long), layers=long.where("metric IS NOT NULL").groupBy("metric").agg(F.min("layer").alias("layer")), status=shown.worst_status(outcomes), findings=shown.findings(both, marks),
        judged=marks, offenders=shown.offenders(both, marks), broken=outcomes.where("status <> 'pass'"), regressions=regressions, clips=detail.orderBy(F.desc("fails"), F.desc("warns"), "clip_id"), counts=metrics.scorer_counts(results),
    )
    return {"run_id": run, "baseline": base, "failures": word["failures"], "warnings": word["warnings"], "passed": word["passed"], "html": path, "text": report.console(summary, word, results.where("error IS NOT NULL").count())}


def calibrate(spark: SparkSession, golden_csv: str, out: str, run: str, bar: float = agreement.BAR) -> DataFrame:
    """Agreement of a stored run's judge scores with the labels of a CSV (``clip_id, dimension,
    human_score``): a row for each dimension that has pairs."""
    if not os.path.exists(golden_csv):
        raise FileNotFoundError(golden_csv)
    raw = spark.read.option("header", True).csv(golden_csv).withColumn("row_no", F.monotonically_increasing_id())
    human = agreement.golden(raw, list(judge.DIMENSIONS))
    clips = store.load(spark, out, "clips", run).withColumn("seq", F.xxhash64("source_path"))
    where = agreement.resolve(human.select(F.col("clip_id").alias("key")).distinct(), clips)
    mine = metrics.flatten(store.load(spark, out, "results", run)).where("metric LIKE 'judge_%'")
    # of several results of one clip the first by seq, then the least, as in metric_of
    scores = mine.groupBy("clip_id", F.expr("substr(metric, 7)").alias("dimension")).agg(F.bround(F.min(F.struct("seq", "value"))["value"]).cast("int").alias("judge"))
    pairs = human.withColumnRenamed("clip_id", "key").join(where.select("key", "clip_id"), "key").join(scores, ["clip_id", "dimension"])
    return agreement.calibration(pairs.select("dimension", "human", "judge"), bar)


def calibrate_corpus(spark: SparkSession, golden_csv: str, corpus: str | DataFrame, out: str, config: Config, client: Callable | None = None) -> dict:
    """As ``calibrate``, after the judge has heard the corpus: ``rows``, ``macro_kappa``, the bar, the
    clips without a score, and the text of the report."""
    only = Config(**json.loads(json.dumps(config)))
    only.scorers.acoustic, only.scorers.dynamics, only.scorers.judge = [], [], ["audio_judge"]
    run = evaluate(spark, corpus, out, only, client=client)["run_id"]
    table = calibrate(spark, golden_csv, out, run, config.calibration.kappa_bar).cache()
    failed = store.load(spark, out, "results", run).where("error IS NOT NULL").select("clip_id", "error")
    macro = agreement.macro_kappa(table).first()["macro_kappa"]
    return {"rows": [r.asDict() for r in table.orderBy("dimension").collect()], "macro_kappa": macro, "kappa_bar": config.calibration.kappa_bar, "model": config.judge.model, "errors": failed.count(), "text": report.agreement(table)}


def simulate(spark: SparkSession, scenarios: DataFrame, versions: dict[str, Callable], out: str, config: Config, caller: Callable = conversation.ScriptedCaller, client: Callable | None = None) -> dict:
    """Calls of every version's agent, scored like recordings, and, of two versions, the first compared
    with the second by scenario. ``versions`` maps a name to what makes its agent."""
    only = Config(**json.loads(json.dumps(config)))
    only.ingest.identity_from_call_id = True  # calls that sound alike are calls of their own
    calls = conversation.play(scenarios, versions, caller, config.simulate.k_runs, config.simulate.max_regen)
    store.save(calls, out, "calls", "simulated")
    calls = store.load(spark, out, "calls", "simulated")
    result = evaluate(spark, conversation.as_recordings(calls), out, only, client=client)
    result["invalid"] = calls.where("NOT valid").count()
    if len(versions) == 2:
        candidate, baseline = versions
        long = metrics.flatten(store.load(spark, out, "results", result["run_id"])).withColumnRenamed("agent_version", "version")
        mid = compare.medians(long.where("metric IS NOT NULL"))
        delta = compare.deltas(mid, candidate, baseline, metrics.gate_table(spark, config.gates.absolute), metrics.delta_table(spark, config.gates.regression.max_delta))
        word = compare.passes(mid, delta, candidate, baseline).first()
        result["comparison"] = {"passed": word["passed"], "error": word["error"], "regressed": word["regressed"], "deltas": compare.ordered(delta), "warnings": compare.one_sided(mid, candidate, baseline)}
    return result
