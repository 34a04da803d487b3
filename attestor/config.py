"""Settings from the environment, checked when they are read."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from attestor.operators.chunking import Chunking
from attestor.operators.retrieval import MODES, RetrievalConfig

#: Settings that are shares, and so lie between 0 and 1.
_RATIOS = ("min_evidence", "min_similarity")


@dataclass(frozen=True)
class Config:
    chunking: Chunking = Chunking()
    retrieval: RetrievalConfig = RetrievalConfig()
    default_mode: str = "hybrid"


def from_env(env: Mapping[str, str] | None = None, prefix: str = "ATTESTOR_") -> Config:
    """Each field of RetrievalConfig, target, overlap, strategy and default_mode by its name in capitals behind the prefix."""
    env = os.environ if env is None else env
    get = lambda name: env.get(prefix + name.upper())
    values = {}
    for f in fields(RetrievalConfig):
        if (raw := get(f.name)) is None:
            continue
        value = int(raw) if isinstance(f.default, int) else float(raw)
        if value < 0 or (f.name in _RATIOS and value > 1) or (isinstance(f.default, int) and value == 0):
            raise ValueError(f"{prefix}{f.name.upper()}={raw}")
        values[f.name] = value
    base = Chunking()
    chunking = Chunking(int(get("target") or base.target), int(get("overlap") or base.overlap), get("strategy") or base.strategy)
    mode = get("default_mode") or "hybrid"
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return Config(chunking, replace(RetrievalConfig(), **values), mode)
