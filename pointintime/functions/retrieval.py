"""Ranking scalars: similarity, reciprocal ranks, relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import COST_INPUT_TOKENS, COST_INPUT_USD, COST_OUTPUT_TOKENS, COST_OUTPUT_USD, RANK_LIMIT, RANK_POSITIONS, RANK_WEIGHT, RRF_K


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector or vectors of different lengths."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.lit(1.0) - dot(a, b) / norm)


def rrf(position: Column, k: int = RRF_K) -> Column:
    """The share of one ranked list in a fused score."""
    return F.lit(1.0) / (F.lit(k) + position)


def found_by(dense_rank: Column, lexical_rank: Column) -> Column:
    return F.when(dense_rank.isNotNull() & lexical_rank.isNotNull(), "both").when(dense_rank.isNotNull(), "dense").otherwise("lexical")


def is_relevant(text: Column, must_contain: Column) -> Column:
    """Every term stands in the text, whatever the case; no terms: true."""
    low = F.lower(text)
    return F.forall(must_contain, lambda t: F.contains(low, F.lower(t)))


def reciprocal_rank(first: Column) -> Column:
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def extraction_cost(n_chunks: Column) -> Column:
    """Estimated USD of extracting so many chunks."""
    return n_chunks * F.lit(COST_INPUT_TOKENS * COST_INPUT_USD + COST_OUTPUT_TOKENS * COST_OUTPUT_USD) / F.lit(1e6)


def place_weights() -> list[float]:
    """The weight of a term by its number of places, up to ``RANK_POSITIONS``: the sum of 1/k**2, in units of its limit."""
    sums, total = [0.0], 0.0
    for k in range(1, RANK_POSITIONS + 1):
        total += 1.0 / (k * k)
        sums.append(total * RANK_WEIGHT / RANK_LIMIT)
    return sums
