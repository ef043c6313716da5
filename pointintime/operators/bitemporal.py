"""Point-in-time operators over an append-only store: what was known, when, and how far to trust it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..vocabulary import STALENESS_MULTIPLE


def as_of(documents: DataFrame, when, since=None) -> DataFrame:
    """Rows known at ``when`` (inclusive) and after ``since`` (exclusive)."""
    if when is not None:
        documents = documents.where(F.col("knowledge_time") <= F.lit(when))
    return documents if since is None else documents.where(F.col("knowledge_time") > F.lit(since))


def latest(documents: DataFrame, key: str = "source_id", tie: str = "id", when=None) -> DataFrame:
    """The newest row of each key, at an instant if one is given; equal times: the larger id.

    One partial aggregate before the shuffle, so a hot key is a row a task.
    """
    rows = as_of(documents, when)
    newest = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*rows.columns), F.struct("knowledge_time", tie)).alias("r"))
    return newest.select("r.*")


#: Ranges of time that one key's observations are compared in; the driver holds their bounds.
RANGES = 64


def _range(observations: DataFrame, ranges: int) -> Column:
    """The number of each row's range of knowledge_time, by quantiles of all rows, so that ranges have about as many rows each."""
    at = F.col("knowledge_time")
    plain = at.cast("timestamp") if observations.schema["knowledge_time"].dataType.typeName().startswith("timestamp") else at
    number = F.unix_micros(plain) if plain is not at else at.cast("long")
    cuts = F.percentile_approx(number, [k / ranges for k in range(1, ranges)], 10_000)
    bounds = sorted(set(observations.agg(cuts.alias("c")).first().c or []))
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < number)) if bounds else F.lit(0)


def changes(observations: DataFrame, key: str = "source_id", fingerprint: str = "text_hash", tie: str = "id", ranges: int = RANGES) -> DataFrame:
    """The observations that an append-if-changed store keeps: the fingerprint differs from the one before.

    A run of equal fingerprints keeps its first row; a return to an old text is a change. A null fingerprint counts
    as changed. A key's rows are compared within ranges of time, and the last fingerprint of each range is carried to the next one: a hot
    key is ``ranges`` tasks, of which one row each meets the others. The ranges' bounds take a pass over the times when this is called.
    """
    b, said = "__range", F.struct(F.col(fingerprint).alias("f"))
    rows = observations.withColumn(b, F.when(F.col("knowledge_time").isNull(), -1).otherwise(_range(observations, ranges)))
    ends = rows.groupBy(key, b).agg(F.max_by(said, F.struct("knowledge_time", tie)).alias("last"))
    seams = ends.select(F.col(key).alias("__key"), F.col(b).alias("__seam"), F.lag("last").over(Window.partitionBy(key).orderBy(b)).alias("__carried"))
    own = rows.withColumn("__own", F.lag(said).over(Window.partitionBy(key, b).orderBy("knowledge_time", tie)))
    both = own.join(seams, F.col(key).eqNullSafe(F.col("__key")) & (F.col(b) == F.col("__seam")))
    before = F.coalesce("__own", "__carried")["f"]
    return both.where(before.isNull() | F.col(fingerprint).isNull() | (before != F.col(fingerprint))).select(*observations.columns)


def append_changed(store: DataFrame, batch: DataFrame, key: str = "source_id", fingerprint: str = "text_hash", tie: str = "id") -> DataFrame:
    """The rows of ``batch`` to append to ``store``."""
    last = latest(store, key, tie).select(key, "knowledge_time", tie, fingerprint).withColumn("__old", F.lit(True))
    both = batch.select(*batch.columns, F.lit(False).alias("__old")).unionByName(last, allowMissingColumns=True)
    return changes(both, key, fingerprint, tie).where(~F.col("__old")).drop("__old")


def parse_as_of(value: str | None) -> dt.datetime | None:
    """An instant as a caller writes it: Z or an offset, UTC where there is neither; None stays None, anything else raises."""
    if value is None:
        return None
    try:
        when = dt.datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"not an instant: {value!r}") from None
    return when if when.tzinfo else when.replace(tzinfo=dt.timezone.utc)


def lookup(documents: DataFrame, sources: DataFrame, name: str, when: str | dt.datetime, preview: int = 400) -> DataFrame:
    """What was known of the source of a name at an instant: name, document_id, knowledge_time, text_hash, raw_ref and the text's
    beginning; a source that said nothing yet is a row of nulls, a name that no source has is no row."""
    when = parse_as_of(when) if isinstance(when, str) else when
    named = sources.where(F.col("name") == name).select("source_id", "name")
    known = latest(documents.join(named.select("source_id"), "source_id", "left_semi"), when=when, tie="document_id")
    text = F.concat(F.substring("text", 1, preview), F.when(F.length("text") > preview, "...").otherwise(""))
    return named.join(known, "source_id", "left").select("name", "document_id", "knowledge_time", "text_hash", "raw_ref", text.alias("preview"))


def unseen(batch: DataFrame, store: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Rows of ``batch`` whose key was never stored; of equal keys in the batch the first."""
    fresh = batch.join(store.select(*keys), keys, "left_anti")
    return fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def pending(stamped: DataFrame, stamp: str, version: str) -> DataFrame:
    """Rows whose stamp is missing or of another version."""
    return stamped.where(~F.col(stamp).eqNullSafe(F.lit(version)))


def without(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have no counterpart yet."""
    return rows.join(done.select(*keys), keys, "left_anti")


def is_due(now: Column) -> Column:
    return F.col("enabled") & (F.col("last_attempt_at").isNull() | (F.unix_micros(now) - F.unix_micros("last_attempt_at") >= F.col("cadence_seconds").cast("long") * 1_000_000))


def is_stale(now: Column) -> Column:
    """Disabled: never stale; never succeeded: stale; else older than twice the cadence."""
    age = F.unix_micros(now) - F.unix_micros("last_success_at")
    return F.when(~F.col("enabled"), False).when(F.col("last_success_at").isNull(), True).otherwise(age > F.col("cadence_seconds").cast("long") * STALENESS_MULTIPLE * 1_000_000)


def poll_health(polls: DataFrame, key: str = "source_id") -> DataFrame:
    """Source health from a log of polls (key, at, ok, error): last attempt and success, failures in a row."""
    base = polls.groupBy(key).agg(F.max("at").alias("last_attempt_at"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"), F.max_by("error", "at").alias("last_error"))
    later = polls.join(base.select(key, "last_success_at"), key).where(~F.col("ok") & (F.col("last_success_at").isNull() | (F.col("at") > F.col("last_success_at"))))
    return base.join(later.groupBy(key).agg(F.count("*").alias("consecutive_failures")), key, "left").fillna(0, ["consecutive_failures"])


def knowledge_state(sources: DataFrame, teams: DataFrame, now: Column, historical: bool = False) -> DataFrame:
    """How far an empty answer can be trusted, a row for each of ``teams`` (team), from source health."""
    on = sources.where("enabled")
    stale = is_stale(now)
    health = on.groupBy("team").agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("last_success_at").isNull()).alias("never"),
        F.count_if(F.col("last_success_at").isNotNull() & stale).alias("stale"),
        F.count_if(F.col("last_success_at").isNotNull() & ~stale).alias("fresh"),
    )
    rows = teams.join(health, "team", "left").fillna(0, ["sources", "never", "stale", "fresh"])
    state = F.when(F.col("sources") == 0, "unknown").when(F.lit(historical), "as_of_historical").when(F.col("fresh") == 0, "unknown").when(F.col("stale") + F.col("never") > 0, "partial").otherwise("complete")
    return rows.withColumn("knowledge", state)


def fetch_flags(status: Column, content: Column) -> tuple[Column, Column]:
    """Is a response unchanged (304), and is it one with content (200)?"""
    return F.coalesce(status == 304, F.lit(False)).alias("not_modified"), F.coalesce((status == 200) & content.isNotNull(), F.lit(False)).alias("ok")


def fetch_outcome(status: Column, content: Column, text: Column, fingerprint: Column, last: Column) -> Column:
    """FAIL, 304, EMPTY, SAME or NEW."""
    blank = text.isNull() | (F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == "")
    return F.when(status == 304, "304").when((status != 200) | content.isNull(), "FAIL").when(blank, "EMPTY").when(fingerprint == last, "SAME").otherwise("NEW")
