"""Engine settings, read from TOML on the driver."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

METRICS = ("L2sq", "IP", "Cos")
SCALARS = ("F64", "F32", "F16", "BF16", "I8", "B1")


@dataclass(frozen=True)
class IndexConfig:
    dimensions: int
    metric_kind: str = "L2sq"
    scalar_kind: str = "F32"
    connectivity: int = 0
    expansion_add: int = 0
    expansion_search: int = 0
    index_dir: str = "index_dir"

    def __post_init__(self) -> None:
        if self.dimensions < 1:
            raise ValueError("[index] dimensions must be greater than 0")
        if self.metric_kind not in METRICS:
            raise ValueError(f"[index] metric_kind must be one of {METRICS}, not {self.metric_kind}")
        if self.scalar_kind not in SCALARS:
            raise ValueError(f"[index] scalar_kind must be one of {SCALARS}, not {self.scalar_kind}")


@dataclass(frozen=True)
class SplitterConfig:
    max_tokens: int = 400
    merge_level: int | None = None
    hf_model_id: str | None = None
    patterns: list[list[str]] | None = None


#: Least and greatest value of the numbers of StorageConfig.
STORAGE_RANGES = {
    "compact_ratio": (math.ulp(0.0), 1.0),
    "fsync_interval_ms": (0, math.inf),
    "memory_budget_mb": (1, math.inf),
    "segment_max_mb": (1, math.inf),
    "snapshot_interval_s": (1, math.inf),
}


@dataclass(frozen=True)
class StorageConfig:
    dir: str = "storage"
    memory_budget_mb: int = 4096
    fsync_interval_ms: int = 1000
    snapshot_interval_s: int = 300
    segment_max_mb: int = 256
    compact_ratio: float = 0.3

    def __post_init__(self) -> None:
        wrong = {name: value for name, (low, high) in STORAGE_RANGES.items() if not low <= (value := getattr(self, name)) <= high}
        if wrong:
            raise ValueError(f"storage settings out of range: {wrong}; ranges are { {name: STORAGE_RANGES[name] for name in wrong} }")
        if not self.dir.strip():
            raise ValueError("storage needs a folder")

    @property
    def memory_budget_bytes(self) -> int:
        return self.memory_budget_mb << 20

    @property
    def segment_max_bytes(self) -> int:
        return self.segment_max_mb << 20

    @property
    def sync_every_write(self) -> bool:
        return self.fsync_interval_ms == 0


@dataclass(frozen=True)
class ModelConfig:
    path: str = "hashing"
    n_embd: int = 64


@dataclass(frozen=True)
class EngineConfig:
    """All settings of an engine; sections as in the TOML file."""

    index: IndexConfig
    splitter: SplitterConfig = field(default_factory=SplitterConfig)
    embedding_model: ModelConfig = field(default_factory=ModelConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)
    min_sentence_tokens: int = 4
    summaries_per_split: int = 2
    top_k: int = 5
    brute_force_max: int = 4096


#: Sections whose unknown keys are errors; in the others they are ignored.
STRICT = ("splitter", "storage")


def _section(kind: type, name: str, values: dict):
    known = {f.name for f in fields(kind)}
    if name in STRICT and (unknown := set(values) - known):
        raise ValueError(f"[{name}] has unknown keys: {sorted(unknown)}")
    return kind(**{k: v for k, v in values.items() if k in known})


def load_config(path: str | Path) -> EngineConfig:
    """Settings from a TOML file. The path must be a regular file, with the extension ``.toml`` if it has one."""
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"{path} isn't a regular file")
    if path.suffix and path.suffix != ".toml":
        raise ValueError(f"{path} must have the extension .toml")
    data = tomllib.loads(path.read_text())
    if "index" not in data:
        raise ValueError("[index] is missing")
    parts = {"index": IndexConfig, "splitter": SplitterConfig, "embedding_model": ModelConfig, "storage": StorageConfig}
    return EngineConfig(**{name: _section(kind, name, data[name]) for name, kind in parts.items() if name in data})
