"""Settings of an application, from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """PAPERLODE_TABLES: the folder of the corpus; PAPERLODE_EMBEDDINGS: which of MODELS; the services' keys."""

    tables: str = "tables"
    model: str = "bit2048"
    keys: tuple[tuple[str, str], ...] = ()

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ) -> Settings:
        keys = tuple(sorted((k.removeprefix("PAPERLODE_KEY_").lower(), v) for k, v in env.items() if k.startswith("PAPERLODE_KEY_")))
        return cls(env.get("PAPERLODE_TABLES", cls.tables), env.get("PAPERLODE_EMBEDDINGS", cls.model), keys)
