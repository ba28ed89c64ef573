"""Settings from the environment, with defaults."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field


def _number(name: str, default, kind):
    raw = os.environ.get(name, "")
    if not raw:
        return default
    m = re.match(r"\s*[+-]?\d+" if kind is int else r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+)", raw)
    return kind(m[0]) if m else kind(0)  # text that isn't a number counts as 0


def _text(name: str, default: str) -> str:
    return os.environ.get(name) or default


def _flag(name: str, default: bool) -> bool:
    raw = os.environ.get(name, "")
    return raw == "true" if raw else default


def load_env(path: str = ".env") -> None:
    """Settings of a file of NAME=value lines; what the environment has already stays. No file is no error."""
    if not os.path.exists(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not name.startswith("#"):
                value = value.strip()
                if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
                    value = value[1:-1]
                else:
                    value = value.split(" #", 1)[0].rstrip()
                os.environ.setdefault(name.strip(), value)


@dataclass
class Config:
    embedder_url: str = field(default_factory=lambda: _text("OLLAMA_URL", "http://localhost:11434"))
    embedding_model: str = field(default_factory=lambda: _text("EMBEDDING_MODEL", "all-minilm"))
    llm_model: str = field(default_factory=lambda: _text("LLM_MODEL", "llama3.2:1b"))
    store_path: str = field(default_factory=lambda: _text("STORE_PATH", ""))
    collection: str = field(default_factory=lambda: _text("COLLECTION_NAME", "code_chunks"))
    target: str = field(default_factory=lambda: _text("TARGET_CODEBASE", ""))
    max_chunk_size: int = 512
    chunk_overlap: int = 50
    hybrid: bool = field(default_factory=lambda: _flag("HYBRID_ENABLED", True))
    vector_weight: float = field(default_factory=lambda: _number("HYBRID_VECTOR_WEIGHT", 0.7, float))
    fusion: str = field(default_factory=lambda: _text("FUSION_STRATEGY", "rrf"))
    bm25_k1: float = field(default_factory=lambda: _number("BM25_K1", 1.2, float))
    bm25_b: float = field(default_factory=lambda: _number("BM25_B", 0.75, float))
    embedding_workers: int = field(default_factory=lambda: _number("EMBEDDING_WORKERS", 8, int))
    max_embeddings: int = field(default_factory=lambda: _number("MAX_CONCURRENT_EMBEDDINGS", 16, int))
    prompt_template: str = field(default_factory=lambda: _text("PROMPT_TEMPLATE", "professional"))
    use_mmr: bool = field(default_factory=lambda: _flag("USE_MMR", True))
    mmr_lambda: float = field(default_factory=lambda: _number("MMR_LAMBDA", 0.7, float))
    port: int = field(default_factory=lambda: _number("SERVER_PORT", 8080, int))
    log_level: str = field(default_factory=lambda: _text("LOG_LEVEL", "info"))
    log_format: str = field(default_factory=lambda: _text("LOG_FORMAT", "text"))
    workers: int = field(default_factory=lambda: _number("NUM_WORKERS", 0, int))  # tasks that read files; 0: four a core
    max_tokens: int = 4096
    max_per_file: int = 3
