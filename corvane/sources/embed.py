"""Vectors for texts: an embedder is called with bounded batches inside the tasks."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Hashed trigrams, of length one: needs no model and gives the same vector everywhere."""

    dim: int = 64

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            padded = f"  {' '.join(text.lower().split())} "
            for j in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[j : j + 3].encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()


@dataclass(frozen=True)
class HttpEmbedder:
    """A service that takes {"inputs": [...]}; three shapes of answer are understood. `post` may be replaced in tests."""

    url: str
    dim: int = 1024
    timeout: float = 60.0
    post: Callable[[str, bytes, float], bytes] | None = None

    def encode(self, texts: list[str]) -> list[list[float]]:
        if not self.url:
            raise ValueError("the embedder has no URL")
        body = json.dumps({"inputs": texts}).encode()
        return vectors_of(json.loads((self.post or _post)(self.url, body, self.timeout)))


def _post(url: str, body: bytes, timeout: float) -> bytes:
    request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read()


def vectors_of(answer) -> list[list[float]]:
    """Vectors of a bare list, of {"embeddings": ...} or of {"data": [{"embedding": ...}]}."""
    if isinstance(answer, dict):
        answer = answer["embeddings"] if "embeddings" in answer else [d["embedding"] for d in answer["data"]]
    return answer


def encode_batches(embedder: Embedder, texts: list[str], batch: int = 32) -> list[list[float]]:
    """Vectors of all texts in order, asked for `batch` at a time; a wrong number or dimension is an error."""
    out: list[list[float]] = []
    for i in range(0, len(texts), batch):
        part = texts[i : i + batch]
        got = embedder.encode(part)
        if len(got) != len(part):
            raise ValueError(f"{len(part)} texts, but {len(got)} vectors")
        if any(len(v) != embedder.dim for v in got):
            raise ValueError(f"a vector is not of dimension {embedder.dim}")
        out += got
    return out


def with_embeddings(df: DataFrame, text_col: str, embedder: Embedder, out: str = "embedding", batch: int = 32) -> DataFrame:
    """`df` with a vector per row; a null text has none. Partitions are the workers, so encoding and writing overlap."""
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            ok = s.notna().to_numpy()
            got = iter(encode_batches(embedder, s[ok].tolist(), batch))
            yield pd.Series([next(got) if k else None for k in ok], dtype=object)

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(encode, "array<float>")(F.col(text_col)))
