"""Typed records: model responses parsed, validated against their text, stored once, and queried in time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_vocabulary, is_grounded, null_spelling, strip
from ..vocabulary import EXTRACT_CHUNKS_PER_RUN, EXTRACTOR_VERSION, GAME_STATUSES, MAX_INJURY, MAX_PLAYER_NAME, PRACTICE_STATUSES, REPORT_DAYS

FIELDS = ("team", "position", "injury", "practice_status", "game_status", "report_day", "evidence")


def _string_at(value: Column, key: str) -> Column:
    """A member of a VARIANT object where it is a string, else null: numbers aren't turned into text."""
    at = F.try_variant_get(value, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))


def parse_responses(responses: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, position, player_name and the seven fields of each record in ``response`` (raw model output).

    Takes an object with ``records`` or a bare list, fenced or not; anything malformed gives no row.
    """
    text = strip(F.regexp_replace("response", r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    parsed = responses.withColumn("v", F.try_parse_json(text))
    kind = F.schema_of_variant("v")
    rows = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.try_variant_get("v", "$.records", "array<variant>"))
    each = parsed.select(*keys, F.posexplode(rows).alias("position_in_response", "r")).where(F.schema_of_variant("r").startswith("OBJECT"))
    drafts = each.select(*keys, "position_in_response", _string_at(F.col("r"), "player_name").alias("player_name"), *(null_spelling(_string_at(F.col("r"), f)).alias(f) for f in FIELDS))
    return drafts.where(strip(F.col("player_name")) != "")


def parse_failures(responses: DataFrame) -> DataFrame:
    """Responses that aren't JSON: they stay pending, unlike those that hold no record."""
    text = strip(F.regexp_replace("response", r"(?m)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return responses.where(F.try_parse_json(text).isNull())


def validate(drafts: DataFrame, teams: tuple[str, ...], text: str = "chunk_text") -> DataFrame:
    """Drafts that name someone in their text and assert something, with fields outside their vocabulary set to null."""
    name = strip(F.col("player_name"))
    injury, position = strip(F.col("injury")), F.upper(strip(F.col("position")))
    clean = drafts.where((name != "") & (F.length(name) <= MAX_PLAYER_NAME) & is_grounded(name, F.col(text)))
    clean = clean.withColumns(
        {
            "player_name": name,
            "team": in_vocabulary(F.col("team"), teams),
            "injury": F.when(F.length(injury) <= MAX_INJURY, injury),
            "position": F.when((F.length(position) <= 8) & F.replace(position, F.lit("/"), F.lit("")).rlike(r"^\p{L}+$"), position),
            "practice_status": in_vocabulary(F.col("practice_status"), PRACTICE_STATUSES),
            "game_status": in_vocabulary(F.col("game_status"), GAME_STATUSES),
            "report_day": in_vocabulary(F.col("report_day"), REPORT_DAYS),
            "evidence": F.nullif("evidence", F.lit("")),
        }
    )
    return clean.where(F.coalesce(F.nullif("practice_status", F.lit("")), F.nullif("game_status", F.lit("")), F.nullif("injury", F.lit("")), F.nullif("position", F.lit(""))).isNotNull())


def persist(valid: DataFrame, chunks: DataFrame, documents: DataFrame, stored: DataFrame, version: str = EXTRACTOR_VERSION, per_day: bool = False) -> DataFrame:
    """Rows to append: one a chunk, player (and day, if asked for) and version; times come from the document."""
    keys = ["chunk_id", "player_name", *(["report_day"] if per_day else [])]
    first = valid.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("position_in_response"))).where("__n = 1").drop("__n", "document_id", "knowledge_time", "published_time")
    new = first.join(stored.where(F.col("extractor_version") == version).select(*keys), keys, "left_anti")
    parents = documents.select("document_id", F.col("team").alias("document_team"), "knowledge_time", "published_time")
    rows = new.join(chunks.select("chunk_id", "document_id"), "chunk_id").join(parents, "document_id")
    return rows.withColumn("team", F.coalesce("team", "document_team")).withColumn("extractor_version", F.lit(version)).drop("document_team")


def of_player(records: DataFrame, part: str) -> DataFrame:
    """Records whose player's name holds ``part``, whatever the case; % and _ in it are wildcards."""
    return records.where(F.ilike("player_name", F.lit(f"%{part.strip()}%")))


def record_query(records: DataFrame, team: str, when=None, since=None, limit: int = 100, version: str = EXTRACTOR_VERSION, player: str | None = None) -> DataFrame:
    """A team's records of the current version (of one player, if asked for), newest first."""
    if not 2 <= len(team) <= 4 or not 1 <= limit <= 500:
        raise ValueError("team of 2-4 letters, limit 1-500")
    rows = records.where((F.col("team") == team.strip().upper()) & (F.col("extractor_version") == version))
    rows = rows if player is None else of_player(rows, player)
    rows = rows if when is None else rows.where(F.col("knowledge_time") <= F.lit(when))
    rows = rows if since is None else rows.where(F.col("knowledge_time") > F.lit(since))
    return rows.orderBy(F.desc("knowledge_time"), "id").limit(limit)


def day_index(day: Column) -> Column:
    """0 for MON to 6 for SUN, 99 for anything else."""
    place = F.array_position(F.array(*map(F.lit, REPORT_DAYS)), day)
    return F.when(place > 0, place - 1).otherwise(F.lit(99)).cast("int")


def trajectories(records: DataFrame, keys: list[str], tie: str = "id") -> DataFrame:
    """One row a report (``keys`` and document_id): practice statuses by weekday, the first injury, the last game status, and
    the earliest time; with recency 1 for the newest report of ``keys``."""
    rows = F.array_sort(F.collect_list(F.struct(day_index(F.col("report_day")).alias("day"), F.col(tie).alias("at"), "practice_status", "injury", "game_status")))
    per = records.groupBy(*keys, "document_id").agg(F.min("knowledge_time").alias("knowledge_time"), rows.alias("r"))
    said = lambda f: F.filter(F.transform("r", lambda x: x[f]), lambda v: v.isNotNull())
    per = per.select(*keys, "document_id", "knowledge_time", said("practice_status").alias("practice"), F.try_element_at(said("injury"), F.lit(1)).alias("injury"), F.try_element_at(said("game_status"), F.lit(-1)).alias("game_status"))
    return per.withColumn("recency", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("knowledge_time"), F.desc("document_id"))))


def team_summary(records: DataFrame, version: str = EXTRACTOR_VERSION) -> DataFrame:
    """Per team: records and the newest time, most records first, and the grand total on every row."""
    per = records.where(F.col("extractor_version") == version).groupBy("team").agg(F.count("*").alias("records"), F.max("knowledge_time").alias("latest"))
    return per.withColumn("total", F.sum("records").over(Window.partitionBy())).orderBy(F.desc("records"), "team")


def completeness(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """field, filled, total, percent: one pass for all fields."""
    counts = records.agg(F.count("*").alias("total"), *(F.count(f).alias(f) for f in fields))
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    long = counts.select("total", F.expr(f"stack({len(fields)}, {pairs}) as (field, filled)"))
    return long.select("field", "filled", "total", (100.0 * F.col("filled") / F.greatest("total", F.lit(1))).alias("percent"))


def prompt(chunk: Column, team: Column, published: Column) -> Column:
    """The user's part of an extraction prompt."""
    hint = F.when(team.isNotNull(), F.concat(F.lit("Team: "), team, F.lit("\n"))).otherwise("")
    date = F.when(published.isNotNull(), F.concat(F.lit("Published: "), F.date_format(published, "EEEE dd MMMM yyyy"), F.lit("\n"))).otherwise("")
    return F.concat(hint, date, F.lit("\n"), chunk)


def extracted(chunks: DataFrame, extract: Callable[[str], str] | None) -> DataFrame:
    """chunk_id, response, error of each row of ``chunks`` (chunk_id, text, and team and published for the prompt, if there are any).

    ``extract`` takes a prompt and returns a raw response; what it raises is the error of that chunk, which stays pending,
    and costs no other. Without an extractor nothing is extracted.
    """
    none = F.lit(None).cast("string")
    optional = lambda c, kind: F.col(c) if c in chunks.columns else F.lit(None).cast(kind)
    asked = chunks.select("chunk_id", prompt(F.col("text"), optional("team", "string"), optional("published", "timestamp")).alias("prompt"))
    if extract is None:
        return asked.select("chunk_id", none.alias("response"), none.alias("error")).where("false")

    def call(batches):
        for batch in batches:
            out = []
            for text in batch["prompt"]:
                try:
                    out.append((extract(text), None))
                except Exception as problem:  # noqa: BLE001 - whatever goes wrong is this chunk's result
                    out.append((None, repr(problem)))
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "response": [r for r, _ in out], "error": [e for _, e in out]})

    return asked.mapInPandas(call, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, response string, error string")


def extraction_pass(responses: DataFrame, chunks: DataFrame, teams: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``extracted``: the valid records; the chunks to stamp as done (also those without a record); those that failed, by
    the extractor's error or by a response that isn't JSON, with the reason: they stay pending."""
    bad = parse_failures(responses.where("error is null").fillna("", ["response"])).select("chunk_id", F.lit("not JSON").alias("error"))
    failed = responses.where("error is not null").select("chunk_id", "error").unionByName(bad)
    done = responses.select("chunk_id").join(failed.select("chunk_id"), "chunk_id", "left_anti")
    drafts = parse_responses(responses.join(done, "chunk_id", "left_semi"), ["chunk_id"]).join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id")
    return validate(drafts, teams), done, failed


def extraction_batch(chunks: DataFrame, documents: DataFrame, version: str = EXTRACTOR_VERSION, limit: int = EXTRACT_CHUNKS_PER_RUN) -> DataFrame:
    """The next chunks to extract: injury reports first, then by id."""
    todo = chunks.where(~F.col("extracted_version").eqNullSafe(F.lit(version))).join(documents.select("document_id", "doc_type"), "document_id")
    return todo.orderBy(F.when(F.col("doc_type") == "injury_report", 0).otherwise(1), "chunk_id").limit(limit)
