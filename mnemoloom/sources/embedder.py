"""A deterministic embedder for use without a model: hashed character n-grams, unit length.

A deployment plugs in its own function from texts to vectors; operators only read the vectors.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def embed_text(text: str | None, dim: int = 64, n: int = 3) -> list[float]:
    out = np.zeros(dim)
    padded = f" {(text or '').lower()} "
    for i in range(len(padded) - n + 1):
        h = zlib.crc32(padded[i : i + n].encode())
        out[h % dim] += 1.0 if h & 0x10000 else -1.0
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).astype(np.float32).tolist()


def embedder(dim: int = 64, encode=None):
    """A column function text -> array<float>; ``encode`` replaces the built-in one, batch by batch."""

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.tolist()) if encode else [embed_text(t, dim) for t in texts])

    def of(text: Column) -> Column:
        return run(text)

    return of
