"""Embeddings as a table of their own, keyed by chunk and version: new versions stand beside old ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def pending_embeddings(chunks: DataFrame, embeddings: DataFrame, version: str) -> DataFrame:
    """Chunks without a vector of this version."""
    done = embeddings.where(F.col("embedding_version") == version).select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti")


def embed_pending(chunks: DataFrame, embeddings: DataFrame, version: str, model: str, embed: Callable[[Column], Column], now: Column) -> DataFrame:
    """Rows to append: one pass over all that is pending. ``embed``: text to vector, an Arrow UDF or a Column function."""
    rows = pending_embeddings(chunks, embeddings, version)
    return rows.select("chunk_id", embed(F.col("text")).alias("embedding"), F.lit(model).alias("embedding_model"), F.lit(version).alias("embedding_version"), now.alias("embedded_at"))


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """A deterministic embedding for tests and for lack of a model: signed counts of hashed terms."""

    def embed(text: Column) -> Column:
        hashed = F.transform(tokens(text), lambda t: F.xxhash64(t))
        places = F.sequence(F.lit(0), F.lit(dim - 1))
        return F.transform(places, lambda d: F.aggregate(F.filter(hashed, lambda h: F.pmod(h, F.lit(dim)) == d), F.lit(0.0), lambda s, h: s + F.when(h > 0, 1.0).otherwise(-1.0)).cast("float"))

    return embed
