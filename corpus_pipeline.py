"""From raw documents to a training mix, in five stages.

Toxic documents go; one document of each group of near duplicates stays; passages that repeat are cut; documents
that overlap a benchmark item go; sources are mixed to their target weights. Every stage works on all that its
predecessor kept, is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointintime.llm.common import remainder, table, written
from pointintime.llm.decontaminate import decontaminated
from pointintime.llm.mixing import mix_sources
from pointintime.llm.near_dup import near_duplicates
from pointintime.llm.suffix_dedup import cut_passages
from pointintime.llm.toxicity import train_toxicity, without_toxic

#: Some stages are beyond SQL: tests compare each with its operator's brute-force version.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold, by a model of the labelled rows whose remainder isn't 2."""
    training = remainder(F.col("doc_id"), 4) != 2
    model = train_toxicity(docs.where(training), table(spark, sf_dir, "labels").where(training))
    return without_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles are alike to 0.8 or more: that with the smallest id (rows without one
    come last). Rows are told by id and text, so that null and repeated ids lose no other row."""
    found = written(near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80))
    key = F.struct("doc_id", "text_hash")
    groups = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), key.alias("key"))).alias("one"), F.count("*").alias("rows")).where("rows > 1")
    groups = written(groups.select("component", "one.key"))
    rows = written(found.join(groups, "component", "left_semi").select(key.alias("key")).distinct())
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key"))
    others = packed.join(rows, packed["key"].eqNullSafe(rows["key"]), "left_anti")
    chosen = packed.join(groups, packed["key"].eqNullSafe(groups["key"]), "left_semi").dropDuplicates(["key"])
    return others.unionByName(chosen).select("doc.*")


def uncopied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that stand elsewhere, too."""
    cut = cut_passages(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many (mix_taken). That is the decision only: each row stands
    once with its whole text, and ``mixing.repeated`` builds the repetitions and runs of words from it."""
    return mix_sources(docs).where("mix_taken > 0")


STAGES = [("toxicity", clean), ("near duplicates", one_of_each), ("repeated passages", uncopied), ("decontamination", untested), ("source mix", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
