"""Embedding of chunks, and the chunk index table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed hashed word counts of length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dimension] += 1 if h >> 63 else -1
            size = float(np.linalg.norm(row))
            if size:
                row /= size
        return out

    return embed


def embed_chunks(chunks: DataFrame, embedder: Embedder, dimension: int, column: str = "text", batch: int = 100, tries: int = 3) -> DataFrame:
    """Add ``vector``, computed beside the text, so that no vector has to be joined by position.

    Texts go to the embedder in lists of ``batch``; a passing failure is tried again. A wrong count or dimension fails.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            found: list[np.ndarray] = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].tolist()
                for left in range(tries - 1, -1, -1):
                    try:
                        got = np.asarray(embedder(part), dtype=np.float32)
                        break
                    except (ConnectionError, TimeoutError):
                        if not left:
                            raise
                if got.shape != (len(part), dimension):
                    raise ValueError(f"{got.shape} vectors for {len(part)} texts of dimension {dimension}")
                found += list(got)
            yield pd.Series(found, index=texts.index)

    return chunks.withColumn("vector", vectors(F.coalesce(F.col(column), F.lit(""))))


def write_index(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """The chunk index as parquet folders by document bucket, with the id file:version:ordinal."""
    keyed = chunks.withColumn("chunk_key", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("version"), F.col("ordinal").cast("string")))
    keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def invalid_vectors(index: DataFrame, dimension: int) -> DataFrame:
    return index.where(F.col("vector").isNull() | (F.size("vector") != dimension))
