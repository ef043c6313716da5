"""Counts, audits and run accounting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.retrieval import extraction_cost
from ..vocabulary import ARTICLES_PER_PASS, RATE_LIMIT, RATE_WINDOW_SECONDS


def corpus_status(chunks: DataFrame, version: str) -> DataFrame:
    """Chunks, documents that have any, embedded, pending, in one pass."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.count("embedding").alias("embedded"), F.count_if(~F.col("embedding_version").eqNullSafe(F.lit(version))).alias("pending"))


def chunk_audit(chunks: DataFrame) -> DataFrame:
    """Structured and prose chunks, and what structured ones lack, as counts and shares of max(structured, 1)."""
    rows = F.coalesce(F.col("section_path").contains("table"), F.lit(False))
    text = F.col("text")
    lacks = {"missing_team": ~text.startswith("Team: "), "missing_day": ~text.contains("| Day: "), "no_status": ~text.contains("| Practice: ") & ~text.contains("| Status: ")}
    counts = chunks.agg(F.count("*").alias("chunks"), F.count_if(rows).alias("structured"), F.count_if(~rows).alias("prose"), *(F.count_if(rows & c).alias(n) for n, c in lacks.items()))
    return counts.select("*", *((F.col(n) / F.greatest("structured", F.lit(1))).alias(f"{n}_share") for n in lacks))


def leading_teams(chunks: DataFrame, limit: int) -> DataFrame:
    """The most frequent leading ``Team: x`` parts."""
    rows = chunks.where(F.coalesce(F.col("section_path").contains("table"), F.lit(False)) & F.col("text").startswith("Team: "))
    team = F.trim(F.expr("substring(split_part(text, '|', 1), 7)"))
    return rows.groupBy(team.alias("team")).count().orderBy(F.desc("count"), "team").limit(limit)


def sweep_totals(outcomes: DataFrame) -> DataFrame:
    """attempted, failed, created of each job run, from a row per source (job_name, failed, created)."""
    return outcomes.groupBy("job_name").agg(F.count("*").alias("attempted"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("created"), F.lit(0)).alias("created"))


def status_lines(outcomes: DataFrame) -> DataFrame:
    """line, n: what a console says of each polled source in the order of names, and the totals; nothing polled: one line.

    ``outcomes``: name, outcome (FAIL, 304, EMPTY, SAME, NEW), detail, created.
    """
    said = {"304": "unchanged", "SAME": "identical content, no new row"}
    detail = F.coalesce(*(F.when(F.col("outcome") == k, F.lit(v)) for k, v in said.items()), F.col("detail"), F.lit(""))
    each = outcomes.select(F.lit(0).alias("part"), "name", F.concat(F.rpad("outcome", 7, " "), "name", F.lit(": "), detail).alias("line"))
    failed = F.count_if(F.col("outcome").isin("FAIL", "EMPTY"))
    total = F.format_string("-- attempted %d, failed %d, created %d", F.count("*"), failed, F.coalesce(F.sum("created"), F.lit(0)).cast("long"))
    last = outcomes.agg(F.when(F.count("*") == 0, F.lit("nothing due")).otherwise(total).alias("line")).select(F.lit(1).alias("part"), F.lit("").alias("name"), "line")
    return each.unionByName(last).orderBy("part", "name").select("line")


def job_run(outcomes: DataFrame, job_name: str, started_at, finished_at, error: str | None = None) -> DataFrame:
    """The row that a finished run appends: job_name, started_at, finished_at, ok, error, attempted, failed, created.

    ``outcomes``: failed, created, a row for each source that was tried; append the row in the same batch as its documents.
    """
    totals = outcomes.agg(F.count("*").alias("attempted"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("created"), F.lit(0)).cast("long").alias("created"))
    run = [F.lit(job_name).alias("job_name"), F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(finished_at).cast("timestamp").alias("finished_at"), F.lit(error is None).alias("ok"), F.lit(error).cast("string").alias("error")]
    return totals.select(*run, "attempted", "failed", "created")


def health(sources: DataFrame, runs: DataFrame, now, stale) -> DataFrame:
    """ok: no enabled source is stale and the newest run succeeded (or there is none)."""
    s = sources.where("enabled").agg(F.coalesce(F.bool_and(~stale(now)), F.lit(True)).alias("fresh"))
    r = runs.agg(F.coalesce(F.max_by("ok", F.struct("started_at", "id")), F.lit(True)).alias("last_ok"))
    return s.join(r).select((F.col("fresh") & F.col("last_ok")).alias("ok"), "fresh", "last_ok")


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return runs.withColumn("duration_seconds", seconds).orderBy(F.desc("started_at"), F.desc("id")).limit(min(limit, 100))


def cost(chunks: DataFrame) -> DataFrame:
    return chunks.agg(extraction_cost(F.count("*")).alias("usd"))


def per_pass(links: DataFrame, key: str, order: list, limit: int = ARTICLES_PER_PASS) -> DataFrame:
    """The first ``limit`` rows of each key."""
    return links.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")


def discovery_counts(links: DataFrame, seen: DataFrame) -> DataFrame:
    """source_id, linked, unseen: what an index pass would do, without storing anything."""
    known = seen.select("source_id", "url", F.lit(True).alias("seen"))
    return links.join(known, ["source_id", "url"], "left").groupBy("source_id").agg(F.count("*").alias("linked"), F.count_if(F.col("seen").isNull()).alias("unseen"))


def rate_limited(hits: DataFrame, window: int = RATE_WINDOW_SECONDS, most: int = RATE_LIMIT) -> DataFrame:
    """caller, ts, n, rejected: windows open at a caller's first request and anew at the first one ``window`` seconds later.

    Each window depends on the one before, so a caller's requests are taken in order: the state is one start and one count,
    carried from batch to batch of a sorted partition, whatever the number of requests. Within a batch it goes from window to
    window by binary search.
    """
    span = int(window * 1_000_000)

    def fold(batches):
        caller = start = None
        n = 0
        for pdf in batches:
            times = pdf["ts"].astype("datetime64[us]").to_numpy().astype("int64")
            who = pdf["caller"].to_numpy()
            edges = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1).tolist(), len(who)]
            count = np.zeros(len(who), np.int64)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b and who[a] != caller:
                    caller, start, n = who[a], times[a], 0
                while a < b:
                    if times[a] - start >= span:
                        start, n = times[a], 0
                    end = a + int(np.searchsorted(times[a:b], start + span))
                    count[a:end] = n + 1 + np.arange(end - a)
                    n, a = n + end - a, end
            yield pd.DataFrame({"caller": pdf["caller"], "ts": pdf["ts"], "n": count, "rejected": count > most})

    kind = hits.schema["ts"].dataType.simpleString()
    dealt = hits.select("caller", "ts").repartition("caller").sortWithinPartitions("caller", "ts")
    return dealt.mapInPandas(fold, f"caller {hits.schema['caller'].dataType.simpleString()}, ts {kind}, n long, rejected boolean")
