"""Settings of a service from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

# The variables that configure a service, by field.
VARIABLES = {
    "api_key": "DEEPSEEK_API_KEY",
    "model": "DEEPSEEK_MODEL",
    "base_url": "DEEPSEEK_BASE_URL",
    "embedding_model": "EMBEDDING_MODEL",
    "similarity_threshold": "SIMILARITY_THRESHOLD",
    "chunking_method": "CHUNKING_METHOD",
    "chunk_size": "RECURSIVE_CHUNK_SIZE",
    "chunk_overlap": "RECURSIVE_CHUNK_OVERLAP",
    "window_pages": "LLM_CHUNKER_WINDOW_PAGES",
}


@dataclass(frozen=True)
class Settings:
    api_key: str = field(default="", repr=False)
    model: str = "deepseek-chat"
    base_url: str = "https://api.deepseek.com"
    embedding_model: str = "BAAI/bge-small-en-v1.5"
    similarity_threshold: float = 0.35
    chunking_method: str = "legal"
    chunk_size: int = 1200
    chunk_overlap: int = 150
    window_pages: int = 3

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Defaults, and what the environment sets; a number that is none raises ValueError naming its variable."""
        found, env = {}, os.environ if env is None else env
        for f in fields(cls):
            raw = env.get(VARIABLES[f.name])
            if raw is not None:
                try:
                    found[f.name] = type(f.default)(raw.strip())
                except ValueError:
                    raise ValueError(f"{VARIABLES[f.name]} must be of type {type(f.default).__name__}, not {raw!r}") from None
        return cls(**found)
