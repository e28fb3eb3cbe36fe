"""Settings of a scan, from a dict, a YAML-like file or keywords."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from .model import RANKS
from .sources.corpus import EXCLUDED_FILES, EXCLUDED_PATHS

CONFIG_NAME = ".sparkwarden.json"
#: Folders that stay left out whatever the settings say.
ALWAYS_EXCLUDED = ("node_modules/", ".git/", "site-packages/")


@dataclass
class ScanConfig:
    """What to scan and when to fail; every field takes effect."""

    mode: str = "route"
    enabled: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    overrides: dict[str, str] = field(default_factory=dict)
    available: list[str] | None = None
    fail_on: str = "HIGH"
    exclude_paths: list[str] = field(default_factory=lambda: list(EXCLUDED_PATHS))
    exclude_files: list[str] = field(default_factory=lambda: list(EXCLUDED_FILES))
    legacy_exclude: bool = False
    carry_forward: bool = False

    def __post_init__(self) -> None:
        if self.mode not in ("route", "all"):
            raise ValueError(f"mode: {self.mode!r}")
        if self.fail_on not in RANKS:
            raise ValueError(f"fail_on: {self.fail_on!r}")
        self.exclude_paths += [p for p in ALWAYS_EXCLUDED if p not in self.exclude_paths]

    @classmethod
    def from_dict(cls, data: dict) -> ScanConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in known})

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2) + "\n")


def find_config(start: str) -> str | None:
    """The nearest settings file in a folder or above it."""
    at = Path(start).resolve()
    for folder in [at, *at.parents]:
        if (folder / CONFIG_NAME).is_file():
            return str(folder / CONFIG_NAME)
    return None


def load_config(start: str) -> ScanConfig:
    """The settings that hold for a folder; defaults where there are none or they can't be read."""
    found = find_config(start)
    if found is None:
        return ScanConfig()
    try:
        return ScanConfig.from_dict(json.loads(Path(found).read_text()))
    except (ValueError, TypeError, OSError):
        return ScanConfig()
