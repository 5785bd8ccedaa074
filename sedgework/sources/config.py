"""Configuration of an index and the place where it is kept."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass
class Config:
    tracked_paths: list[str] = field(default_factory=list)
    exclude_patterns: list[str] = field(default_factory=list)
    extra_extensions: list[str] = field(default_factory=list)
    exclude_extensions: list[str] = field(default_factory=list)
    enabled: bool = True
    top_k: int = 5
    score_threshold: float = 0.1
    alpha: float = 0.4

    @classmethod
    def load(cls, path: Path) -> Config:
        """Defaults with what the file sets; a missing or malformed file gives the defaults, unknown keys are ignored."""
        try:
            data = json.loads(path.read_text(encoding="utf-8"))
            return cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})
        except (OSError, ValueError, TypeError, AttributeError):
            return cls()

    def save(self, path: Path) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(asdict(self), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def index_directory(given: str | None = None, start: Path | None = None, name: str = ".sedgework") -> Path:
    """The folder given, else ``$SEDGEWORK_DIR``, else the nearest ``.sedgework`` upwards but not above home, else one in home."""
    if given:
        return Path(given)
    if env := os.environ.get("SEDGEWORK_DIR"):
        return Path(env)
    home, at = Path.home(), (start or Path.cwd()).resolve()
    for folder in (at, *at.parents):
        if (folder / name).is_dir():
            return folder / name
        if folder == home:
            break
    return home / name
