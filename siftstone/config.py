"""Options of an engine session, from arguments or SIFTSTONE_* environment variables."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

DEFAULT_STORE = "~/.local/share/siftstone/index"
DEFAULT_LOW_CONFIDENCE = 0.6


def _env(name: str, default: str = "") -> str:
    return os.environ.get(f"SIFTSTONE_{name}", default)


def embeddings_disabled() -> bool:
    return _env("DISABLE_EMBEDDINGS").lower() in ("1", "true", "yes", "on")


def low_confidence() -> float:
    """The similarity below which a vector-only hit is doubtful; the default if unset or not a number."""
    try:
        return float(_env("LOW_CONFIDENCE_SIMILARITY").strip() or DEFAULT_LOW_CONFIDENCE)
    except ValueError:
        return DEFAULT_LOW_CONFIDENCE


def store_path() -> str:
    return str(Path(_env("DB_PATH", DEFAULT_STORE)).expanduser())


@dataclass(frozen=True)
class Options:
    """max_lines, overlap: line windows. max_file_bytes: larger files are skipped. embed_tasks: 1 embeds in path order with
    one breaker for the whole run; more embed in parallel with a breaker each. vector_backend: knn_l2 (global top-k by L2, then
    filters) or cosine_scan (all positive cosines in scope). posting_buckets: folders that postings are dealt to by term."""

    max_lines: int = 80
    overlap: int = 10
    max_file_bytes: int = 1_000_000
    embed_batch: int = 64
    breaker: int = 5
    embed_tasks: int = 1
    vector_backend: str = "knn_l2"
    posting_buckets: int = 16
    lexical_candidates: int = 100
    low_confidence: float | None = field(default=None)

    @property
    def doubtful(self) -> float:
        return low_confidence() if self.low_confidence is None else self.low_confidence


def embedder_settings() -> dict[str, str]:
    return {"base_url": _env("EMBED_URL", "http://127.0.0.1:11434"), "model": _env("EMBED_MODEL", "nomic-embed-text"), "api": _env("EMBED_API", "ollama")}
