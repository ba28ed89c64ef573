"""Model connectors: embedders and text generators. Anything with the same methods can be put in their place.

The offline defaults are deterministic; the HTTP ones speak a simple JSON protocol with retries.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EXTERNAL, AppError
from ..functions import text

ATTEMPTS = 3


def with_retry(call: Callable, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """Call up to ``attempts`` times, waiting attempt squared times 100 ms in between."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            sleep(n * n * 0.1)


class HashingEmbedder:
    """Signed feature hashing of tokens, normalised; equal texts have equal vectors."""

    def __init__(self, size: int = 384):
        self.size = size

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in t.lower().split():
                h = hashlib.md5(w.encode()).digest()
                v[int.from_bytes(h[:4], "little") % self.size] += 1.0 if h[4] & 1 else -1.0
            n = float(np.sqrt((v * v).sum()))
            out.append(((v / n) if n else v).astype(np.float32).tolist())
        return out

    def embed(self, one: str) -> list[float]:
        return self.embed_batch([one])[0]


def _post(url: str, body: dict, timeout: float):
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.loads(r.read())
    except Exception as e:
        raise AppError(EXTERNAL, f"request to {url} failed", e) from e


_slots: dict[tuple[str, int], threading.BoundedSemaphore] = {}
_lock = threading.Lock()


def _slot(url: str, most: int) -> threading.BoundedSemaphore:
    """The requests to a server that this process may have open at once."""
    with _lock:
        return _slots.setdefault((url, most), threading.BoundedSemaphore(most))


class HttpEmbedder:
    """POST {model, prompt} to /api/embeddings and read {embedding}; ``workers`` requests of a batch at once, ``most`` in a process."""

    def __init__(self, url: str, model: str, timeout: float = 30.0, workers: int = 8, most: int = 16):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout
        self.workers, self.most = max(1, workers), max(1, most)

    def embed(self, one: str) -> list[float]:
        with _slot(self.url, self.most):
            return self._ask(one)

    def _ask(self, one: str) -> list[float]:
        got = _post(f"{self.url}/api/embeddings", {"model": self.model, "prompt": one[: text.EMBED_CHARS]}, self.timeout)
        if "embedding" not in got:
            raise AppError(EXTERNAL, "the reply has no embedding")
        return [float(x) for x in got["embedding"]]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        """In order; the first failure fails the batch."""
        if len(texts) < 2 or self.workers == 1:
            return [self.embed(t) for t in texts]
        with ThreadPoolExecutor(min(self.workers, len(texts))) as pool:
            asked = [pool.submit(self.embed, t) for t in texts]
            try:
                return [a.result() for a in asked]
            except Exception:
                for a in asked:
                    a.cancel()
                raise


def with_embeddings(chunks: DataFrame, embedder, batch: int = 20) -> DataFrame:
    """Chunks with ``embedding`` from their first 384 characters, in batches per executor."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = []
            for at in range(0, len(s), batch):
                part = list(s.iloc[at : at + batch])
                out += with_retry(lambda part=part: embedder.embed_batch(part))
            yield pd.Series(out)

    return chunks.withColumn("embedding", run(text.embedding_text(F.col("content"))))


class EchoGenerator:
    """Repeats the last user message; for tests and offline use."""

    def generate(self, messages: list[dict]) -> str:
        users = [m["content"] for m in messages if m.get("role") == "user"]
        return users[-1] if users else ""

    def stream(self, messages: list[dict]) -> Iterator[str]:
        for w in self.generate(messages).split(" "):
            yield w + " "


class HttpGenerator:
    """POST {model, messages, stream} to /api/chat; streamed replies are JSON lines until ``done``."""

    def __init__(self, url: str, model: str, timeout: float = 120.0):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def generate(self, messages: list[dict]) -> str:
        got = _post(f"{self.url}/api/chat", {"model": self.model, "messages": messages, "stream": False}, self.timeout)
        return got.get("message", {}).get("content", "")

    def stream(self, messages: list[dict]) -> Iterator[str]:
        body = json.dumps({"model": self.model, "messages": messages, "stream": True}).encode()
        request = urllib.request.Request(f"{self.url}/api/chat", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                for line in r:
                    part = json.loads(line)
                    if part.get("message", {}).get("content"):
                        yield part["message"]["content"]
                    if part.get("done"):
                        return
        except (OSError, ValueError) as e:
            raise AppError(EXTERNAL, "streaming failed", e) from e
