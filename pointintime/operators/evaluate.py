"""Retrieval quality against a gold set of content predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.retrieval import is_relevant, reciprocal_rank


def positions(hits: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per question: relevant positions in order, how many, how many returned, the first, and its reciprocal.

    ``hits``: question_id, rank, text (and the columns of ``by``); ``gold``: question_id, must_contain.
    """
    by = by or []
    rows = gold.join(hits, "question_id", "left")
    rows = rows.withColumn("hit", F.when(F.col("rank").isNotNull() & is_relevant(F.col("text"), F.col("must_contain")), F.col("rank")))
    found = rows.groupBy("question_id", *by).agg(F.array_sort(F.collect_list("hit")).alias("positions"), F.count("hit").alias("n_relevant"), F.count("rank").alias("n_returned"), F.min("hit").alias("first_position"))
    return found.withColumn("reciprocal_rank", reciprocal_rank(F.col("first_position")))


def report(found: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), by: list[str] | None = None) -> DataFrame:
    """n, hit rate at each k and over all, and mean reciprocal rank; no questions: zeros."""
    rate = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    hits = [rate(F.col("first_position") <= k).alias(f"hit_at_{k}") for k in ks]
    return found.groupBy(*(by or [])).agg(F.count("*").alias("n"), rate(F.col("first_position").isNotNull()).alias("hit_rate"), *hits, F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"))


def recall_at(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Share of each question's relevant chunks among its first k (an extra: ``relevant``: question_id, chunk_id)."""
    got = relevant.join(hits.where(F.col("rank") <= k).select("question_id", "chunk_id", F.lit(1).alias("got")), ["question_id", "chunk_id"], "left")
    return got.groupBy("question_id").agg(F.avg(F.coalesce("got", F.lit(0))).alias("recall"))


def misses(found: DataFrame) -> DataFrame:
    return found.where(F.col("first_position").isNull()).select("question_id")


def by_mode(rankings: dict[str, DataFrame], gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """The metrics of several search modes over one gold set, a row a mode; and mode, question_id of the questions that each
    missed. ``rankings``: question_id, rank, text by mode; a question without any hit counts in every mode."""
    hits = None
    for mode, ranked in rankings.items():
        one = ranked.select("question_id", "rank", "text", F.lit(mode).alias("mode"))
        hits = one if hits is None else hits.unionByName(one)
    asked = gold.withColumn("mode", F.explode(F.array(*map(F.lit, rankings))))
    asked = asked.select(F.struct("mode", "question_id").alias("question_id"), "must_contain")
    found = positions(hits.withColumn("question_id", F.struct("mode", "question_id")).drop("mode"), asked)
    found = found.select(F.col("question_id.mode").alias("mode"), F.col("question_id.question_id").alias("question_id"), *(c for c in found.columns if c != "question_id"))
    return report(found, ks, ["mode"]), found.where(F.col("first_position").isNull()).select("mode", "question_id")
