"""The static list of sources to poll, and how it is brought into a source table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocabulary import CLUBS, INDEX_CADENCE_SECONDS, UNAVAILABLE

KINDS = ("injury_index", "transactions")


def seeds(spark: SparkSession) -> DataFrame:
    """One row for each club and kind that has a page: name, kind, team, domain, cadence_seconds."""
    clubs = spark.createDataFrame(CLUBS, "abbr string, nickname string, domain string")
    missing = spark.createDataFrame([(a, k) for a, k in UNAVAILABLE], "abbr string, kind string")
    every = clubs.withColumn("kind", F.explode(F.array(*map(F.lit, KINDS)))).join(missing, ["abbr", "kind"], "left_anti")
    name = F.concat(F.lower("abbr"), F.lit("-"), F.replace("kind", F.lit("_"), F.lit("-")))
    return every.select(name.alias("name"), "kind", F.col("abbr").alias("team"), "domain", F.lit(INDEX_CADENCE_SECONDS).alias("cadence_seconds"))


def upserted(sources: DataFrame, fresh: DataFrame, legacy_path: str = "%/team/injury-report%") -> DataFrame:
    """Sources with the new names added; legacy widget pages and pages known to be missing are disabled with a reason."""
    named = [(f"{a.lower()}-{k.replace('_', '-')}", why) for (a, k), why in UNAVAILABLE.items()]
    reasons = sources.sparkSession.createDataFrame(named, "name string, __why string")
    added = fresh.join(sources.select("name"), "name", "left_anti").withColumn("enabled", F.lit(True))
    both = sources.unionByName(added, allowMissingColumns=True).join(reasons, "name", "left")
    legacy = (F.col("kind") == "injury_report") & F.coalesce(F.col("url").like(legacy_path), F.lit(False))
    why = F.coalesce(F.col("__why"), F.when(legacy, F.lit("rendered by the client, nothing to parse")))
    return both.withColumn("last_error", F.coalesce(why, "last_error")).withColumn("enabled", F.col("enabled") & why.isNull()).drop("__why")


def added(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` to append to ``sources``: those with a name that no source has, enabled, one a name."""
    return new.dropDuplicates(["name"]).join(sources.select("name"), "name", "left_anti").withColumn("enabled", F.lit(True))


def named(sources: DataFrame, name: str) -> DataFrame:
    """The one source of a name, to be ingested by itself whatever its cadence; none: an empty table."""
    return sources.where(F.col("name") == name).orderBy("source_id").limit(1)
