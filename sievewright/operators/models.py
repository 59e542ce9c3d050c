"""Model interfaces with deterministic offline stand-ins, and the guards around generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sievewright.functions import text as T

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed hashing of character 3-grams, L2-normalised; needs no model file."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for i in range(max(0, len(t) - 2)):
                h = zlib.crc32(t[i : i + 3].encode())
                out[k, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embed(df: DataFrame, text: str, make: Callable[[], Embedder], batch: int = 32, out: str = "embedding") -> DataFrame:
    """Adds vectors; each task makes its embedder once and feeds it fixed batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            texts = s.fillna("").tolist()
            rows = [v for k in range(0, len(texts), batch) for v in model(texts[k : k + batch])]
            yield pd.Series([v.tolist() for v in rows])

    return df.withColumn(out, run(F.col(text)))


def guarded(generated: Column, fallback: Column, most: int = 400) -> Column:
    """Generated text with each sentence once; empty or overlong text gives way to the fallback."""
    fine = (T.strip(generated) != "") & (F.char_length(generated) <= most)
    return F.when(F.coalesce(fine, F.lit(False)), T.dedup_sentences(generated)).otherwise(fallback)


def rerank(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Interface only: no cross-encoder is available offline."""
    raise NotImplementedError("no reranking model is configured")
