"""Settings from a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from tidesift.operators.verdict import FAIL_ON
from tidesift.schema import LAYERS


@dataclass(frozen=True)
class Config:
    """default_layers and fail_on steer scans; the other groups are kept as they are read. telemetry is always off."""

    default_layers: str = ",".join(LAYERS)
    fail_on: str = "suspicious"
    groups: dict[str, Any] = field(default_factory=dict)

    @property
    def telemetry(self) -> bool:
        return False


def config_path() -> Path:
    base = os.environ.get("APPDATA" if os.name == "nt" else "XDG_CONFIG_HOME")
    return (Path(base) if base else Path.home() / ".config") / "tidesift" / "config.toml"


def load_config(path: str | Path | None = None) -> Config:
    """The settings of a file; defaults where the usual file doesn't exist. A file that is named must exist, and what it
    sets must be of the right kind."""
    if path is None and not (path := config_path()).exists():
        return Config()
    data = tomllib.loads(Path(path).read_text("utf-8"))
    scanner = data.pop("scanner", {})
    known = {f.name for f in fields(Config)} - {"groups"}
    settings = {k: v for k, v in scanner.items() if k in known}
    if any(not isinstance(v, str) for v in settings.values()) or settings.get("fail_on", "none") not in FAIL_ON:
        raise ValueError(f"invalid settings: {settings}")
    if "telemetry" in data:
        data["telemetry"]["enabled"] = False
    if layers := settings.get("default_layers"):
        settings["default_layers"] = ",".join(x if x.startswith("L") else f"L{x}" for x in (p.strip() for p in layers.split(",")))
    return Config(**settings, groups=data)
