"""Readers and writers: raw bytes, text, gold sets, tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, parser_kind


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, content_hash of raw files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "modificationTime", "content", content_hash(F.col("content")).alias("content_hash"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, must_contain from a JSON file with the key ``questions``; a missing file raises."""
    schema = "questions array<struct<id:string,question:string,must_contain:array<string>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("questions")).withColumnRenamed("id", "question_id")


def sample(rows: DataFrame, n: int, seed: int = 0, doc_type: str | None = None, contains: str | None = None) -> DataFrame:
    """``n`` random rows, of a type or with a substring if asked for."""
    rows = rows if doc_type is None else rows.where(F.col("doc_type") == doc_type)
    rows = rows if contains is None else rows.where(F.ilike("text", F.lit(f"%{contains}%")))
    return rows.orderBy(F.rand(seed)).limit(n)


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Appends rows, laid out by the columns that later reads prune by."""
    w = rows.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def reparsed(documents: DataFrame, raw: DataFrame, parse) -> DataFrame:
    """Derived columns made anew from raw bytes: ``parse`` maps content to text and tables; ``changed`` tells where the text's
    hash or the number of rows differs; documents without raw bytes stay and say ``missing``."""
    new = parse(raw).select("raw_ref", F.col("text").alias("__text"), F.col("tables").alias("__tables"), F.col("text_hash").alias("__hash"))
    rows = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda s, t: s + F.size(t["rows"])), F.lit(0))
    both = documents.join(new, "raw_ref", "left")
    missing = F.col("__hash").isNull()
    changed = ~missing & (~F.col("text_hash").eqNullSafe(F.col("__hash")) | (rows(F.col("tables")) != rows(F.col("__tables"))))
    out = both.withColumn("missing", missing).withColumn("changed", changed)
    for name in ("text", "tables"):
        out = out.withColumn(name, F.when(~missing, F.col(f"__{name}")).otherwise(F.col(name)))
    return out.withColumn("text_hash", F.coalesce("__hash", "text_hash")).drop("__text", "__tables", "__hash")


def parsed(raw: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``raw`` (content_type, content) through the parser of its kind, "html" or "pdf": each adds the columns text, tables and warning.
    A kind without a parser keeps its rows, without a text and with a warning."""
    kinds = raw.withColumn("kind", parser_kind(F.col("content_type"), F.col("content")))
    out = None
    for kind, parse in parsers.items():
        one = parse(kinds.where(F.col("kind") == kind))
        out = one if out is None else out.unionByName(one)
    rest = kinds.where(~F.col("kind").isin(*parsers)).withColumn("warning", F.concat(F.lit("no parser for "), "kind"))
    return rest if out is None else out.unionByName(rest, allowMissingColumns=True)
