"""Configuration: YAML or JSON files as one frozen object, and parsers of command-line values (SRC-01, FN-36)."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    top_k: int = 100
    rounds: int = 3
    damping: float = 0.85
    seed: int = 42


def load(path: str) -> Config:
    """Known keys of a file; a key that is 0 counts as given."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(raw)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML files need PyYAML; use JSON instead") from e
        data = yaml.safe_load(raw) or {}
    known = {f.name for f in fields(Config)}
    return Config(**{k: v for k, v in data.items() if k in known and v is not None})


def source(raw: str) -> tuple[str, float, str]:
    """label=weight=path or label=path."""
    parts = raw.split("=")
    if len(parts) == 2:
        return parts[0], 1.0, parts[1]
    if len(parts) != 3:
        raise ValueError(f"label=weight=path, not {raw!r}")
    return parts[0], float(parts[1]), parts[2]


def grid(raw: str, kind: type = float) -> list:
    """Comma-separated numbers."""
    return [kind(x) for x in raw.split(",") if x.strip()]
