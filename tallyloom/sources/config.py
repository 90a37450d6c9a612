"""Per-repository settings from a JSON or (where a YAML library is installed) YAML file, with defaults on any failure."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class RepositoryConfig:
    """What a repository may set; unknown fields are ignored, wrong types fall back."""

    skip_globs: list[str] = field(default_factory=list)
    min_confidence: float = 0.6
    max_file_bytes: int = 500 * 1024
    languages: list[str] = field(default_factory=list)
    chunk_lines: int = 80
    final_k: int = 5


def load_config(path: str | Path) -> RepositoryConfig:
    """The settings in a file, or the defaults if it is missing, broken or no mapping."""
    try:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith((".yml", ".yaml")):
            import yaml

            raw = yaml.safe_load(text)
        else:
            raw = json.loads(text)
    except (OSError, ValueError, ImportError):
        return RepositoryConfig()
    except Exception:  # noqa: BLE001  a YAML library's own errors
        return RepositoryConfig()
    if not isinstance(raw, dict):
        return RepositoryConfig()
    base = RepositoryConfig()
    good = {}
    for f in fields(RepositoryConfig):
        v, d = raw.get(f.name), getattr(base, f.name)
        if isinstance(d, float) and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        if v is not None and type(v) is type(d):
            good[f.name] = v
    return RepositoryConfig(**good)
