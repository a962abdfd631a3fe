"""Settings of a run, from the environment or from defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 512
    chunk_overlap: int = 64
    search_results: int = 50
    context_lines: int = 2
    top_k: int = 10
    graph_depth: int = 2
    top_n: tuple[int, ...] = (1, 3, 5)

    @classmethod
    def from_env(cls, prefix: str = "CODELODE_") -> "Settings":
        """Integers and comma-separated integers of variables that are set."""
        found = {}
        for f in fields(cls):
            v = os.environ.get(prefix + f.name.upper())
            if v:
                found[f.name] = tuple(int(x) for x in v.split(",")) if f.name == "top_n" else int(v)
        return cls(**found)
