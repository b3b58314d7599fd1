"""Settings: fixed defaults, a YAML file, and overrides; unknown keys are errors."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any

from ..operators.dedup import MIN_SHAPE_TOKENS, THRESHOLD, THRESHOLDS
from ..operators.density import FREQUENCY_BOOST, WEIGHTS
from ..operators.evaluate import DEFAULT_MODEL, PRICES, WINDOW
from ..operators.prose import Chunking
from ..operators.rewrite import OVERLAP, STAGE_SECONDS


@dataclass(frozen=True)
class Dedup:
    exact: bool = True
    structural: bool = True
    min_shape_tokens: int = MIN_SHAPE_TOKENS
    similarity: float = THRESHOLD
    thresholds: dict[str, float] = field(default_factory=lambda: dict(THRESHOLDS))


@dataclass(frozen=True)
class Density:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    frequency_boost: float = FREQUENCY_BOOST


@dataclass(frozen=True)
class Selection:
    ratio: float = 0.30
    reserve: float = 0.03
    min_kept: int = 1
    repair: bool = True
    strategy: str = "density"


@dataclass(frozen=True)
class Reconstruction:
    drop_markers: bool = True
    cluster_markers: bool = True


@dataclass(frozen=True)
class Rewrite:
    enabled: bool = True
    min_tokens: int = 150
    max_chunks: int = 12
    overlap: float = OVERLAP
    numbers: bool = True
    stage_seconds: float = STAGE_SECONDS


@dataclass(frozen=True)
class Evaluation:
    model: str = DEFAULT_MODEL
    num_ctx: int = WINDOW
    prices: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(PRICES))


@dataclass(frozen=True)
class Config:
    chunking: Chunking = Chunking()
    dedup: Dedup = Dedup()
    density: Density = Density()
    selection: Selection = Selection()
    reconstruction: Reconstruction = Reconstruction()
    rewrite: Rewrite = Rewrite()
    evaluation: Evaluation = Evaluation()

    def with_overrides(self, changes: dict[str, Any] | None) -> Config:
        """Deep merge; a None leaves what is there."""
        return _build(Config, _merge(asdict(self), changes or {}), "")


def _merge(base: dict, changes: dict) -> dict:
    out = dict(base)
    for k, v in changes.items():
        if v is None:
            continue
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _build(cls, values: dict, at: str):
    known = {f.name: f for f in fields(cls)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(at + k for k in extra))}")
    defaults = cls()
    made = {}
    for k, v in values.items():
        now = getattr(defaults, k)
        made[k] = _build(type(now), v or {}, f"{at}{k}.") if is_dataclass(now) else v
    return cls(**made)


def load(path: str | None = None, overrides: dict[str, Any] | None = None) -> Config:
    """From ``$TERSELAKE_CONFIG``, else ``path``, else the defaults; then the overrides."""
    path = os.environ.get("TERSELAKE_CONFIG") or path
    values: dict = {}
    if path:
        import yaml

        with open(path) as f:
            values = yaml.safe_load(f) or {}
    return _build(Config, values, "").with_overrides(overrides)
