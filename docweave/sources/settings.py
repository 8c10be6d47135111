"""Settings from the environment and a dotenv file, read once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path

PREFIX = "DOCWEAVE_"


@dataclass(frozen=True)
class Settings:
    """Where tables are, where results go, how many partitions a shuffle has, and how much is logged."""

    data_dir: str = "data"
    output_dir: str = "out"
    shuffle_partitions: int = 0  # 0 leaves the session's setting
    log_level: str = "WARN"


def _dotenv(path: Path) -> dict[str, str]:
    out = {}
    for line in path.read_text(encoding="utf-8").splitlines() if path.is_file() else []:
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("'\"")
    return out


def load(environment: Mapping[str, str], dotenv: str | Path = ".env") -> Settings:
    """Settings by name with the prefix, in any letter case; the environment goes before the file, unknown names are passed over.

    ValueError for a number that is none.
    """
    given = {k.upper(): v for source in (_dotenv(Path(dotenv)), environment) for k, v in source.items()}
    found = {f.name: given[PREFIX + f.name.upper()] for f in fields(Settings) if PREFIX + f.name.upper() in given}
    return Settings(**{f.name: int(found[f.name]) if f.type == "int" else found[f.name] for f in fields(Settings) if f.name in found})


@lru_cache(maxsize=1)
def get_settings() -> Settings:
    """The process's settings."""
    return load(os.environ)
