"""The seam for models: a backend turns texts into vectors; the default hashes words, so that everything runs without a model."""

from __future__ import annotations

import importlib
import math
import time
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftnet.config import Config
from driftnet.functions.columns import EMBED_CLIP


class Backend(ABC):
    model_id: str
    dim: int

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def describe_image(self, path: str) -> tuple[str, str]:
        return "", "caption failed: no vision model"

    def transcribe(self, path: str) -> tuple[str, str]:
        return "", "transcribe failed: no speech model"

    def release(self) -> None:
        """Give back what the model holds."""


class HashingBackend(Backend):
    """Words hashed into signed coordinates, length 1: lexical, deterministic, without files."""

    def __init__(self, dim: int = 128):
        self.dim, self.model_id = dim, f"hashing-{dim}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in text[:EMBED_CLIP].lower().split():
                h = zlib.crc32(word.encode())
                v[h % self.dim] += 1.0 if h >> 31 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


BACKENDS = {"hashing": lambda cfg: HashingBackend(cfg.embed_dim)}


def backend(cfg: Config) -> Backend:
    """The backend a name stands for; "module:callable" names one that executors can import, called with the settings."""
    if ":" in cfg.backend:
        module, _, maker = cfg.backend.partition(":")
        return getattr(importlib.import_module(module), maker)(cfg)
    if cfg.backend not in BACKENDS:
        raise ValueError(f"unknown backend {cfg.backend!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[cfg.backend](cfg)


def check_dim(vectors: list[list[float]], dim: int, model: str) -> None:
    for v in vectors:
        if len(v) != dim:
            raise ValueError(f"{model} gave {len(v)} values, {dim} were expected")


def embed_column(cfg: Config):
    """A function from a text column to struct<embedding, error, seconds>. The model is made once in a task, fed whole batches and
    released at the end; a batch that fails is tried text by text, so that one bad text costs one row. Seconds: a text's
    part of its batch's time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = backend(cfg)

        def safe(texts: list[str]) -> list[tuple]:
            try:
                vectors = model.embed(texts)
                check_dim(vectors, cfg.embed_dim, model.model_id)
                return [(v, None) for v in vectors]
            except Exception as problem:
                return [(None, f"embed failed: {problem}")] if len(texts) == 1 else [safe([t])[0] for t in texts]

        try:
            for s in batches:
                began = time.perf_counter()
                has = [i for i, t in enumerate(s) if t is not None]
                got = dict(zip(has, safe([s.iloc[i][:EMBED_CLIP] for i in has]) if has else [], strict=True))
                rows = [got.get(i, (None, "embed failed: no text")) for i in range(len(s))]
                each = (time.perf_counter() - began) / max(1, len(rows))
                yield pd.DataFrame({"embedding": [r[0] for r in rows], "error": pd.Series([r[1] for r in rows], dtype=object), "seconds": each})
        finally:
            model.release()

    kind = T.StructType([T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType()), T.StructField("seconds", T.DoubleType())])
    return F.pandas_udf(run, kind)
