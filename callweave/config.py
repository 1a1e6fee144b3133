"""The run configuration: nested sections over defaults, read from YAML or JSON, without secrets in its snapshot."""

from __future__ import annotations

import copy
import json
import os

SECRET = ("key", "token", "secret", "password", "sid")

#: Every setting with its default, by section.
DEFAULTS: dict = {
    "ingest": {"accept_extensions": [".wav", ".mp3", ".flac", ".ogg", ".m4a"], "target_sr": 16000, "identity_from_call_id": False, "normalize_dbfs": None, "max_duration_s": 1800.0, "min_duration_s": 0.5},
    "scorers": {"judge": [], "dynamics": ["latency", "turn_taking", "barge_in"], "acoustic": ["level"]},
    "acoustic": {"aggregate": "median", "min_window_s": 3.0, "window_s": 20.0},
    "dynamics": {"vad_threshold": 0.5, "vad_backend": "energy", "overlap_min_s": 0.1, "min_caller_utterance_ms": 100.0, "gap_threshold_s": 1.5, "bargein_success_window_s": 1.5, "bargein_stop_target_s": 0.2},
    "judge": {
        "model": "", "backend": "", "judge_model_family": "", "exclude_if_model_family_matches": True, "judged_channel": "agent_only", "domain": "a phone call", "rubric_path": None, "system_prompt_path": None,
        "thinking_budget": 1024, "temperature": 0.0, "max_audio_s": 0.0, "parse_retries": 1, "max_retries": 5, "max_concurrency": 4, "upload_threshold_bytes": 18_000_000, "local_model": "",
    },
    "gates": {"absolute": {}, "regression": {"max_delta": {}, "group_by": ["agent_version"], "baseline": "previous", "enabled": True}},
    "runner": {"progress": True, "cpu_workers": 0},
    "calibration": {"golden_path": None, "kappa_bar": 0.6},
    "simulate": {"max_regen": 2, "max_turns": 8, "k_runs": 3, "turn_timeout_s": 60.0},
    "telephony": {"end_silence_ms": 600, "vad_rms": 0.02, "max_call_s": 180.0},
    "corpus_dir": None, "outputs_dir": "outputs",
}
#: Sections whose keys are names that the user gives.
OPEN = ("absolute", "max_delta")


class Section(dict):
    """A mapping whose keys are attributes too."""

    def __getattr__(self, name: str) -> object:
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e

    def __setattr__(self, name: str, value: object) -> None:
        self[name] = value


def section(value: object) -> object:
    if isinstance(value, dict):
        return Section({k: section(v) for k, v in value.items()})
    return copy.copy(value)


def merge(base: Section, given: dict, path: str = "") -> None:
    """Put given values over defaults; a mapping where none is expected, or none where one is, is an error."""
    for k, v in given.items():
        if isinstance(base.get(k), Section) and k not in OPEN:
            if v is not None and not isinstance(v, dict):
                raise ValueError(f"{path}{k} is a mapping")
            merge(base[k], v or {}, f"{path}{k}.")
        else:
            base[k] = section(v)


class Config(Section):
    """The sections of ``DEFAULTS`` with what is given over them. Unknown keys are kept."""

    def __init__(self, **given: object) -> None:
        super().__init__(section(DEFAULTS))
        merge(self, given)

    def selected(self) -> list[str]:
        return [*self.scorers.acoustic, *self.scorers.dynamics, *self.scorers.judge]

    def without_judge(self) -> Config:
        out = Config(**json.loads(json.dumps(self)))
        out.scorers.judge = []
        return out

    def snapshot(self) -> str:
        """JSON of the configuration without secrets."""

        def clean(v: object) -> object:
            if isinstance(v, dict):
                return {k: clean(x) for k, x in v.items() if not any(s in str(k).lower().split("_") for s in SECRET)}
            return [clean(x) for x in v] if isinstance(v, list) else v

        return json.dumps(clean(self), sort_keys=True)


def load(path: str | None) -> Config:
    """All defaults without a path. A missing file is a FileNotFoundError, a root that is no mapping a
    ValueError."""
    if path is None:
        return Config()
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    data = read(path)
    if not isinstance(data, dict):
        raise ValueError("the root of a configuration is a mapping")
    return Config(**data)


def read(path: str) -> object:
    """A JSON or YAML document; an empty one is an empty mapping."""
    with open(path) as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    data = yaml.safe_load(text)
    return {} if data is None else data
