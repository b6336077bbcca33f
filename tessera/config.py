"""Settings of builds and queries. Every field has a reader."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    window: int = 900
    overlap_share: float = 0.12
    min_chars: int = 80
    min_alpha: float = 0.45
    max_symbols: float = 0.55
    shards: int = 64
    index_path: str = ""
    embed_batch: int = 64
    rows_per_file: int = 5000
    top_k: int = 5
    snippet_chars: int = 600
    max_question: int = 300
    max_context: int = 2048
    embed_model: str = "hashing"
    chat_model: str = "stub"
    num_predict: int = 64
    temperature: float = 0.2
    num_ctx: int = 1024

    @property
    def overlap(self) -> int:
        return round(self.window * self.overlap_share)

    @classmethod
    def load(cls, path: str | None = None, **over) -> Config:
        """Defaults, then a JSON file's values, then keyword arguments that aren't None."""
        found = json.loads(Path(path).read_text()) if path else {}
        found |= {k: v for k, v in over.items() if v is not None}
        unknown = set(found) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**found)

    def export(self, spark) -> None:
        """Every field as the session's setting tessera.<field>, where sources and tasks of its jobs find them too."""
        for f in fields(self):
            spark.conf.set(f"tessera.{f.name}", str(getattr(self, f.name)))


def model_host() -> str:
    """The model server's address: OLLAMA_BASE_URL, else OLLAMA_HOST, else this machine."""
    host = os.environ.get("OLLAMA_BASE_URL") or os.environ.get("OLLAMA_HOST") or "http://localhost:11434"
    return host.rstrip("/") if "://" in host else f"http://{host.rstrip('/')}"
