"""Settings of a project, kept as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Config:
    """What a project's index is built with; unknown keys are refused, missing ones have these defaults."""

    name: str = ""
    exclude: list[str] = field(default_factory=lambda: ["node_modules", "target", "dist", ".git", "*.min.js"])
    chunk_lines: int = 60
    overlap_lines: int = 10
    embedding_batch: int = 32
    max_global_notes: int = 10


def load(path: str) -> Config:
    """The settings in a file; defaults where there is none. Malformed files raise."""
    p = Path(path)
    return Config(**json.loads(p.read_text())) if p.exists() else Config()


def save(config: Config, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(config), indent=2, sort_keys=True))
