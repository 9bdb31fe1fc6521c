"""Settings of an engine, from code, a JSON file or the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "WEFTLINE_"


@dataclass(frozen=True)
class Config:
    mode: str = "typed"
    strict: bool = False
    #: Folder where jobs are logged; none are if it is empty.
    job_log: str = ""
    #: Sets spark.sql.shuffle.partitions; 0 leaves it alone.
    shuffle_partitions: int = 0
    log_level: str = "WARNING"

    def __post_init__(self) -> None:
        if self.mode not in ("typed", "dynamic"):
            raise ValueError(f"unknown mode '{self.mode}'")

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Config:
        """A file's settings, over which those of the environment (WEFTLINE_MODE and so on) win."""
        given = json.loads(Path(path).read_text()) if path else {}
        env = dict(os.environ) if env is None else env
        for f in fields(cls):
            if (text := env.get(PREFIX + f.name.upper())) is not None:
                given[f.name] = text.lower() in ("1", "true", "yes") if f.type == "bool" else int(text) if f.type == "int" else text
        if unknown := sorted(set(given) - {f.name for f in fields(cls)}):
            raise ValueError(f"unknown settings {unknown}")
        return cls(**given)
