"""The contract of embeddings: a function from a list of texts to a list of vectors, called for each Arrow batch; and one that needs no model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.parsing import char_chunks_of

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed counts of hashed words, of unit length (a text without words: zeros); the same everywhere and always."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0).tolist()

    return embed


def embedded(rows: DataFrame, text_col: str, embed: Embedder | None = None, out: str = "vector", batch: int = 50) -> DataFrame:
    """Adds a vector for each text; the embedder gets ``batch`` texts at a time."""
    own = embed or hashing_embedder()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found: list[list[float]] = []
            for i in range(0, len(texts), batch):
                found += own(texts.iloc[i : i + batch].fillna("").tolist())
            yield pd.Series(found)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(run, "array<double>")(F.col(text_col)))


def embedded_with_cache(rows: DataFrame, cache: DataFrame, text_col: str, embed: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with vectors, and the cache (``text``, ``vector``) with those it lacked; each distinct text is embedded once."""
    misses = rows.select(F.col(text_col).alias("text")).distinct().join(cache, "text", "left_anti")
    full = cache.select("text", "vector").unionByName(embedded(misses, "text", embed))
    return rows.join(full.withColumnRenamed("text", text_col), text_col, "left"), full


def indexed(docs: DataFrame, embed: Embedder | None = None, chars: int = 500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as chunks with vectors: ``id``, ``piece_num`` (from 1), ``text``, ``vector``, ``payload`` (JSON)."""
    chunks = docs.select(F.col(id_col).alias("id"), F.posexplode(char_chunks_of(chars)(F.coalesce(F.col(text_col), F.lit("")))).alias("n", "text")).where(F.trim("text") != "")
    chunks = chunks.select("id", (F.col("n") + 1).cast("long").alias("piece_num"), "text")
    return embedded(chunks, "text", embed).withColumn("payload", F.to_json(F.struct("id", "piece_num")))


def scored(rows: DataFrame, model: Callable[[list[str]], list[dict[str, float]]], text_col: str, out: str = "scores") -> DataFrame:
    """A map of scores for each text from a scorer, reward or judge that the caller brings."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(run, "map<string,double>")(F.col(text_col)))
