"""Run settings: layer locations, step range, splits, rank and scaling options."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


# The steps of one full run, in order.
PIPELINE = ["silver", "graph-tables", "tabular", "graph-features", "training-set", "train"]


@dataclass(frozen=True)
class Split:
    """Inclusive last step of the training and validation ranges."""

    train_max: int = 480
    val_max: int = 600


@dataclass(frozen=True)
class RankSettings:
    damping: float = 0.85
    rounds: int = 10


@dataclass(frozen=True)
class Scaling:
    step_max: tuple[int, ...] = (24,)
    shuffle_partitions: tuple[int, ...] = (2, 4)


@dataclass(frozen=True)
class RunConfig:
    """Everything a batch run needs; ``root`` may be any Hadoop-readable URI."""

    root: str
    raw_csv: str
    min_step: int = 1
    max_step: int = 744
    split: Split = field(default_factory=Split)
    rank: RankSettings = field(default_factory=RankSettings)
    scaling: Scaling = field(default_factory=Scaling)
    # Where the ingested transactions are, if not under ``root``.
    bronze: str | None = None

    def layer(self, name: str) -> str:
        if name == "bronze" and self.bronze:
            return self.bronze
        return f"{self.root.rstrip('/')}/{name}"

    def to_json(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


# The two shipped presets (step range and split bounds).
PRESETS = {
    "dev": {"min_step": 1, "max_step": 24, "split": Split(16, 20)},
    "prod": {"min_step": 1, "max_step": 744, "split": Split(480, 600)},
}


def preset(name: str, root: str, raw_csv: str) -> RunConfig:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; choose from {sorted(PRESETS)}")
    return RunConfig(root=root, raw_csv=raw_csv, **PRESETS[name])


def load_config(path: str) -> RunConfig:
    """Read a JSON settings file; unknown keys are errors."""
    source = Path(path)
    if not source.exists():
        raise FileNotFoundError(f"settings file not found: {path}")
    raw = json.loads(source.read_text())
    known = {f.name for f in fields(RunConfig)}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if "split" in raw:
        raw["split"] = Split(**raw["split"])
    if "rank" in raw:
        raw["rank"] = RankSettings(**raw["rank"])
    if "scaling" in raw:
        raw["scaling"] = Scaling(**{k: tuple(v) for k, v in raw["scaling"].items()})
    return RunConfig(**raw)
