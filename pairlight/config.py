"""Run configuration: small frozen settings, overrides by dotted path, run folders."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import platform
import random
import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_type_hints

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pairlight.functions.regression import Thresholds
from pairlight.schema import SEVERITIES


@dataclass(frozen=True)
class RunSettings:
    name: str = "exp"
    seed: int = 42
    folder: str = "runs"


@dataclass(frozen=True)
class AuditSettings:
    views: tuple[str, ...] = ("analysis_only", "full_output")
    metrics: tuple[str, ...] = ("hf_hate", "hf_toxicity")
    thresholds: Thresholds = field(default_factory=Thresholds)
    judge_mode: str = "classifier"
    least_severity: str = "mild"
    top_k: int = 50
    min_slice_n: int = 30


@dataclass(frozen=True)
class EvaluationSettings:
    n_boot: int = 2000
    alpha: float = 0.05
    min_slice_n: int = 30


@dataclass(frozen=True)
class TrainingSettings:
    repeats: str = "mild=1,moderate=2,severe=3,extreme=4"
    val_ratio: float = 0.05
    recipe: str = "mix"
    compat: bool = False


@dataclass(frozen=True)
class Settings:
    run: RunSettings = field(default_factory=RunSettings)
    audit: AuditSettings = field(default_factory=AuditSettings)
    evaluation: EvaluationSettings = field(default_factory=EvaluationSettings)
    training: TrainingSettings = field(default_factory=TrainingSettings)

    def validate(self) -> Settings:
        if self.audit.judge_mode not in ("classifier", "primary", "validate", "supplement"):
            raise ValueError(f"unknown judge mode {self.audit.judge_mode}")
        if self.audit.least_severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.audit.least_severity}")
        if not 0 < self.evaluation.alpha < 1:
            raise ValueError("alpha must lie between 0 and 1")
        return self

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(to_dict(self), sort_keys=True).encode()).hexdigest()[:10]


def to_dict(settings: Any) -> dict[str, Any]:
    return dataclasses.asdict(settings)


def from_dict(cls: type, values: dict[str, Any]) -> Any:
    """Nested settings out of plain values; unknown names raise KeyError."""
    types = get_type_hints(cls)
    known = {f.name for f in dataclasses.fields(cls)}
    if extra := set(values) - known:
        raise KeyError(f"unknown settings of {cls.__name__}: {sorted(extra)}")
    out = {}
    for name, value in values.items():
        if dataclasses.is_dataclass(types[name]) and isinstance(value, dict):
            value = from_dict(types[name], value)
        elif isinstance(value, list):
            value = tuple(value)
        out[name] = value
    return cls(**out)


def parse_scalar(text: str) -> Any:
    """true, false, null, JSON, a number, else the text itself."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none", ""):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def with_overrides(settings: Settings, overrides: list[str]) -> Settings:
    """Settings with each 'a.b=value' put in."""
    values = to_dict(settings)
    for item in overrides:
        path, eq, raw = item.partition("=")
        if not eq:
            raise ValueError(f"an override needs a value: {item}")
        at = values
        *parents, last = path.strip().split(".")
        for p in parents:
            at = at[p]
        if last not in at:
            raise KeyError(path)
        at[last] = parse_scalar(raw)
    return from_dict(Settings, values).validate()


def load(path: str) -> Settings:
    """Settings of a JSON file, or of a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix.lower() in (".yaml", ".yml"):
        import yaml

        return from_dict(Settings, yaml.safe_load(text) or {}).validate()
    return from_dict(Settings, json.loads(text)).validate()


def save(settings: Settings, path: str) -> None:
    from pairlight.sources.files import write_text

    write_text(json.dumps(to_dict(settings), indent=2, sort_keys=True) + "\n", path)


def snapshot(folder: Path | str, settings: Settings, inputs: Mapping[str, DataFrame]) -> None:
    """Writes what a run was made from: settings, versions, Spark's own settings and the files that each input reads."""
    from pairlight.sources.files import write_json

    spark = SparkSession.active()
    conf = {k: v for k, v in sorted(spark.sparkContext.getConf().getAll()) if not any(x in k.lower() for x in ("secret", "password", "token", "key"))}
    write_json({
        "settings": to_dict(settings), "fingerprint": settings.fingerprint(), "python": platform.python_version(), "spark": spark.version, "platform": platform.platform(),
        "spark_conf": conf, "inputs": {name: sorted(df.inputFiles()) for name, df in inputs.items()},
    }, f"{folder}/provenance.json")


def seed_everything(seed: int) -> None:
    """Seeds the generators of this process; draws in Spark take their seed as a parameter."""
    random.seed(seed)
    np.random.seed(seed % 2**32)


def run_folder(settings: Settings, stage: str, stamp: str | None = None) -> Path:
    """A new folder <runs>/<name>/<stage>/<time>_<fingerprint> with the settings in it."""
    folder = Path(settings.run.folder, settings.run.name, stage, f"{stamp or time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}_{settings.fingerprint()}")
    folder.mkdir(parents=True, exist_ok=True)
    save(settings, str(folder / "settings.json"))
    return folder
