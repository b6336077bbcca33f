"""Embedders and chat models behind two small protocols; deterministic ones for tests, HTTP ones for servers."""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Config, model_host


class Embedder(Protocol):
    name: str
    version: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...


class HashingEmbedder:
    """Signed feature hashing of lower-case words, L2-normalised; needs no model and is the same everywhere."""

    def __init__(self, dim: int = 64, version: str = "1"):
        self.name, self.version, self.dim = f"hashing-{dim}", version, dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        known: dict[str, tuple[int, float]] = {}
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                if w not in known:
                    h = hashlib.sha256(w.encode()).digest()
                    known[w] = int.from_bytes(h[:4], "big") % self.dim, 1.0 if h[4] & 1 else -1.0
                at, sign = known[w]
                out[i, at] += sign
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()


class ModelError(RuntimeError):
    pass


def _post(url: str, body: dict, attempts: int = 3, wait: float = 5.0, timeout: float = 120.0) -> dict:
    """POST JSON; after a failure wait (longer each time, jittered) and try again, `attempts` times in all."""
    for n in range(1, attempts + 1):
        try:
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)
        except (OSError, ValueError) as e:
            if n == attempts:
                raise ModelError(f"{url}: {e}") from e
            time.sleep(wait * n * random.uniform(0.8, 1.2))
    raise AssertionError


class HttpEmbedder:
    """An embedding server with /api/embed. Fewer vectors than texts is an error."""

    def __init__(self, model: str, dim: int, version: str = "1", host: str | None = None, keep_alive: str = "5m", wait: float = 5.0):
        self.name, self.version, self.dim = f"http:{model}", version, dim
        self.model, self.host, self.keep_alive, self.wait = model, host or model_host(), keep_alive, wait

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        got = _post(f"{self.host}/api/embed", {"model": self.model, "input": texts, "keep_alive": self.keep_alive}, wait=self.wait)
        vectors = got.get("embeddings") or ([got["embedding"]] if "embedding" in got else [])
        if len(vectors) != len(texts):
            raise ModelError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors


class HttpChat:
    def __init__(self, model: str, config: Config | None = None, host: str | None = None, wait: float = 5.0):
        self.model, self.config, self.host, self.wait = model, config or Config(), host or model_host(), wait

    def chat(self, messages: list[dict[str, str]]) -> str:
        c = self.config
        body = {"model": self.model, "messages": messages, "stream": False, "options": {"num_predict": c.num_predict, "temperature": c.temperature, "num_ctx": c.num_ctx}}
        return _post(f"{self.host}/api/chat", body, wait=self.wait)["message"]["content"]

    def await_ready(self, timeout: float = 60.0, every: float = 2.0) -> None:
        """Wait until the server answers."""
        until = time.monotonic() + timeout
        while True:
            try:
                with urllib.request.urlopen(f"{self.host}/api/tags", timeout=every):
                    return
            except OSError as e:
                if time.monotonic() >= until:
                    raise ModelError(f"{self.host} isn't ready") from e
                time.sleep(every)


class StubChat:
    """Says what it was given; for tests and for runs without a model."""

    def chat(self, messages: list[dict[str, str]]) -> str:
        return f"[{len(messages)} messages, {sum(len(m['content']) for m in messages)} characters]"


def embed_column(df: DataFrame, text: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """df with `embedding` (array<float>, L2-normalised) of its text column; Arrow batches, calls of `batch` texts."""
    place = df.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", embedding array<float>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, batch):  # what a call returns goes on before the next one
                b = whole.slice(i, batch)
                texts = [t or "" for t in b.column(place).to_pylist()]
                out = embedder.embed(texts)
                if len(out) != len(texts):
                    raise ModelError("an embedder returned fewer vectors than texts")
                x = np.array(out, np.float64).reshape(len(out), -1)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = (x / np.where(n == 0, 1, n)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(x), pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return df.mapInArrow(run, schema)


def cached_embed(df: DataFrame, text: str, embedder: Embedder, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(df with embedding, new cache rows): texts that the cache (text_sha, embedder, version, embedding) has are not embedded again."""
    keyed = df.withColumn("text_sha", F.sha2(F.col(text), 256))
    mine = cache.where((F.col("embedder") == embedder.name) & (F.col("version") == embedder.version)).select("text_sha", "embedding").dropDuplicates(["text_sha"])
    new = embed_column(keyed.join(mine, "text_sha", "left_anti").select("text_sha", text).dropDuplicates(["text_sha"]), text, embedder)
    rows = new.select("text_sha", F.lit(embedder.name).alias("embedder"), F.lit(embedder.version).alias("version"), "embedding")
    both = mine.unionByName(rows.select("text_sha", "embedding"))
    return keyed.join(both, "text_sha").select(*df.columns, "embedding"), rows
