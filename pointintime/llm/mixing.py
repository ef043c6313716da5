"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source gets a share of all words by its weight, but at most ``max_epochs`` times what it has;
what a capped source can't take is shared out again by weight among the others until nobody is above
its cap. The level is found in closed form: sources in the order of cap / weight, each with the level
that would hold if all before it were capped; the first source below its cap fixes the level.

A document is repeated target / size times: whole repetitions and one fractional repetition, whose
word count is rounded by a seeded number. So each source comes within a word a document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import share, written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3) -> DataFrame:
    """``sizes``: source, source_size (one row a source). Adds target.

    The table has a row for each source, not for each document; its windows run over that.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("k", F.row_number().over(by_ratio))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.col("before")).cast("double") / F.col("rest"))
    s = s.withColumn("first", F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.col("k"))).over(everything))
    s = s.withColumn("level", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(everything))
    filled = F.when(F.col("first").isNull() | (F.col("k") < F.col("first")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return s.select("source", "source_size", filled.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """All columns of ``docs`` and ``mix_size, mix_source_size, mix_target, mix_taken`` (columns of these names are replaced).

    A null text has size 0, a null source is a source of its own (the last). Each row has a draw of its own: by its
    doc_id, and where several rows have it (or have none) by the text and a number among the equal ones, too.
    Empty tables give empty tables.
    """
    names = [c for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_taken")]
    docs = docs.select(names)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("mix_size")
    level = targets(docs.select("source", size).groupBy("source").agg(F.sum("mix_size").alias("source_size")), weights, max_epochs)
    level = level.select(F.struct("source", "source_size", "target").alias("level"))
    several = written(docs.groupBy("doc_id").count().where("count > 1").select(F.struct("doc_id").alias("id")))

    def decided(rows: DataFrame, draw: Column) -> DataFrame:
        rows = rows.select(*names, size, draw.alias("mix_taken"))
        both, of = rows.join(level, rows["source"].eqNullSafe(level["level"]["source"])), level["level"]
        wanted = of["target"] / of["source_size"] * rows["mix_size"] + rows["mix_taken"]
        taken = F.when(rows["mix_size"] == 0, F.lit(0)).otherwise(F.least(F.floor(wanted), rows["mix_size"] * max_epochs)).cast("long")
        return both.select(*(rows[c] for c in names), rows["mix_size"], of["source_size"].alias("mix_source_size"), of["target"].alias("mix_target"), taken.alias("mix_taken"))

    own = share(F.col("doc_id"), f"mix{seed}")
    if several.isEmpty():
        return decided(docs, own)
    same = docs["doc_id"].eqNullSafe(several["id"]["doc_id"])
    text = F.md5(F.coalesce("text", F.lit("")))
    number = F.row_number().over(Window.partitionBy("doc_id", text).orderBy(F.lit(0)))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text, number)
    return decided(docs.join(several, same, "left_anti"), own).unionByName(decided(docs.join(several, same, "left_semi"), share(key, f"mix{seed}")))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each repetition, with the words that it takes from ``first_word`` on.

    Whole repetitions take the whole text; the fractional one takes a run of words that begins at a
    seeded word. ``mix_repeat`` counts from 0.
    """
    whole = F.floor(F.col("mix_taken") / F.greatest(F.col("mix_size"), F.lit(1))).cast("int")
    part = F.col("mix_taken") - whole * F.col("mix_size")
    room = F.col("mix_size") - part + 1
    begin = F.floor(share(F.col("doc_id"), "part") * room).cast("long")
    runs = F.transform(F.sequence(F.lit(0), whole + F.when(part > 0, 0).otherwise(-1)), lambda i: F.struct(i.alias("mix_repeat"), F.when(i < whole, F.lit(0)).otherwise(begin).cast("long").alias("first_word"), F.when(i < whole, F.col("mix_size")).otherwise(part).alias("n_words")))
    rows = mixed.where("mix_taken > 0").withColumn("run", F.explode(runs))
    return rows.select(*mixed.columns, "run.*")


def op4_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1
              THEN '|' || md5(coalesce(text, '')) || '|' || row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) ELSE '' END AS among
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, source_size * 3 AS cap, row_number() OVER (ORDER BY source_size * 3 / w, source NULLS LAST) AS k FROM s
), l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o
), f AS (
  SELECT min(k) AS k FROM l WHERE cap > w * level
), t AS (
  SELECT source, source_size,
         CASE WHEN (SELECT k FROM f) IS NULL OR k < (SELECT k FROM f) THEN CAST(cap AS DOUBLE)
              ELSE w * (SELECT level FROM l WHERE k = (SELECT k FROM f)) END AS target
  FROM l
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       CASE WHEN d.size = 0 THEN 0 ELSE least(CAST(floor(t.target / t.source_size * d.size
         + CAST('0x' || substr(md5('mix0|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || d.among), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) AS BIGINT), d.size * 3) END AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
