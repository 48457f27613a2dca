"""Settings from a TOML file or the environment; everything has a default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields

from walflow.errors import ConfigError


@dataclass
class Config:
    source_path: str = ""
    source_url: str = ""
    publication: str = "walflow"
    tables: str = ""
    sink_path: str = ""
    sink_url: str = ""
    checkpoint_path: str = ""
    dead_letter_path: str = ""
    slot: str = "walflow"
    slots: int = 1
    batch_size: int = 10_000
    batch_timeout_ms: int = 100
    status_interval_ms: int = 10_000
    metrics_port: int = 9090
    log_level: str = "info"

    @classmethod
    def load(cls, file: str | None = None, env=os.environ, **flags) -> "Config":
        """File, then WALFLOW_* variables, then flags; later ones win."""
        values: dict = {}
        if file:
            with open(file, "rb") as f:
                values |= tomllib.load(f)
        known = {f.name: f.type for f in fields(cls)}
        for name in known:
            if (v := env.get(f"WALFLOW_{name.upper()}")) is not None:
                values[name] = v
        values |= {k: v for k, v in flags.items() if v is not None}
        if unknown := values.keys() - known.keys():
            raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
        try:
            return cls(**{k: int(v) if known[k] == "int" else str(v) for k, v in values.items()})
        except ValueError as e:
            raise ConfigError(str(e)) from e
