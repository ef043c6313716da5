"""Queries over the driver's tables, one for each group of operators, and SQL that gives the same rows.

Events stand for polls (user_id: source, ts: knowledge time, an ``error`` event: a failed poll) and for reports of players; documents
for parsed documents and chunks; conversations for table rows; benchmark for questions; labels for stamps.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import retrieval as R
from ..functions import text as X
from ..functions.stem import stem_sql, stemmed
from ..operators import bitemporal, chunks, evaluate, ops, records, report, search, vector_index
from ..sources import files
from ..sources import pages as P
from ..sources import seeds as S
from ..vocabulary import CLUBS, REPORT_DAYS, STOP_WORDS

NOW = "2024-01-31 00:00:00"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: _long(fn(spark, sf_dir))
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _long(df: DataFrame) -> DataFrame:
    """Numbers of rows and ranks as DuckDB has them."""
    return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _polls(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


# -- point in time --------------------------------------------------------------------------------


@query("""
SELECT user_id, event_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00')
WHERE n = 1""")
def asof_latest_per_source(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.col("ts").alias("knowledge_time"))
    return bitemporal.latest(e.where("ts <= timestamp_ntz'2024-01-15 12:00:00'"), "user_id", "event_id").drop("knowledge_time")


@query("""
SELECT doc_id, source, text_hash FROM (
  SELECT doc_id, source, text_hash, lag(text_hash) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM (
    SELECT doc_id, source, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_hash FROM documents))
WHERE before IS NULL OR before <> text_hash""")
def snapshot_changes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", X.text_fingerprint(F.col("text")).alias("text_hash"), F.col("doc_id").alias("knowledge_time"))
    return bitemporal.changes(d, "source", "text_hash", "doc_id").drop("knowledge_time")


@query("""
SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE before IS NULL OR before <> event_type""")
def change_points_by_key(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("knowledge_time"))
    return bitemporal.changes(e, "user_id", "event_type", "event_id").drop("knowledge_time")


@query("""
WITH k AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) || regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS place FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY page_id) AS n FROM k
      WHERE url NOT LIKE '%?%' AND place NOT IN (SELECT place FROM k WHERE url LIKE '%?%'))
SELECT page_id, place FROM f WHERE n = 1""")
def first_seen_url(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.concat(X.url_host(F.col("url")), X.url_path(F.col("url"))).alias("place"))
    with_query = F.col("url").contains("?")
    return bitemporal.unseen(p.where(~with_query), p.where(with_query), ["place"], ["page_id"]).select("page_id", "place")


@query("""
WITH k AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM pages)
SELECT page_id, host FROM k WHERE host IN (SELECT host FROM k WHERE url LIKE '%?%')""")
def url_semi_join(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url", X.url_host(F.col("url")).alias("host"))
    return p.join(p.where(F.col("url").contains("?")).select("host"), "host", "left_semi").select("page_id", "host")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def pending_anti_join(spark, sf_dir):
    stamped = read(spark, sf_dir, "labels").withColumn("stamp", F.concat(F.lit("v"), F.col("quality").cast("string")))
    docs = read(spark, sf_dir, "documents").join(stamped.select("doc_id", "stamp"), "doc_id", "left")
    return bitemporal.pending(docs, "stamp", "v1").select("doc_id", "source")


_HEALTH = """
base AS (SELECT user_id AS source_id, max(ts) AS last_attempt_at, max(ts) FILTER (event_type <> 'error') AS last_success_at FROM events GROUP BY 1),
fails AS (SELECT e.user_id AS source_id, count(*) AS n FROM events e JOIN base b ON b.source_id = e.user_id
          WHERE e.event_type = 'error' AND (b.last_success_at IS NULL OR e.ts > b.last_success_at) GROUP BY 1),
src AS (SELECT source_id, last_attempt_at, last_success_at, 'T' || (source_id % 8) AS team, source_id % 10 <> 0 AS enabled,
               CAST(3600 * (1 + source_id % 12) AS BIGINT) AS cadence_seconds FROM base)"""


def _sources(spark, sf_dir) -> DataFrame:
    h = bitemporal.poll_health(_polls(spark, sf_dir))
    n = F.col("source_id")
    return h.withColumn("team", F.concat(F.lit("T"), (n % 8).cast("string"))).withColumn("enabled", n % 10 != 0).withColumn("cadence_seconds", 3600 * (1 + n % 12))


@query(f"""WITH {_HEALTH}
SELECT b.source_id, epoch_us(b.last_attempt_at) AS last_attempt_us, epoch_us(b.last_success_at) AS last_success_us, coalesce(f.n, 0) AS consecutive_failures
FROM base b LEFT JOIN fails f USING (source_id)""")
def source_health(spark, sf_dir):
    h = bitemporal.poll_health(_polls(spark, sf_dir))
    return h.select("source_id", F.unix_micros("last_attempt_at").alias("last_attempt_us"), F.unix_micros("last_success_at").alias("last_success_us"), "consecutive_failures")


@query(f"""WITH {_HEALTH},
s AS (SELECT *, epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_success_at) > cadence_seconds * 2000000 AS old FROM src WHERE enabled),
h AS (SELECT team, count(*) AS sources, count(*) FILTER (last_success_at IS NULL) AS never, count(*) FILTER (last_success_at IS NOT NULL AND old) AS stale,
             count(*) FILTER (last_success_at IS NOT NULL AND NOT old) AS fresh FROM s GROUP BY 1),
t AS (SELECT 'T' || i AS team FROM range(10) r(i)),
j AS (SELECT t.team, coalesce(sources, 0) AS sources, coalesce(never, 0) AS never, coalesce(stale, 0) AS stale, coalesce(fresh, 0) AS fresh FROM t LEFT JOIN h USING (team))
SELECT *, CASE WHEN sources = 0 OR fresh = 0 THEN 'unknown' WHEN stale + never > 0 THEN 'partial' ELSE 'complete' END AS knowledge FROM j""")
def knowledge_state(spark, sf_dir):
    teams = spark.range(10).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("team"))
    return bitemporal.knowledge_state(_sources(spark, sf_dir), teams, F.lit(NOW).cast("timestamp"))


@query(f"""WITH {_HEALTH}
SELECT source_id, cadence_seconds FROM src WHERE enabled AND (last_attempt_at IS NULL OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_attempt_at) >= cadence_seconds * 1000000)""")
def due_sources(spark, sf_dir):
    return _sources(spark, sf_dir).where(bitemporal.is_due(F.lit(NOW).cast("timestamp"))).select("source_id", "cadence_seconds")


@query("""
SELECT source, lang, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY source, lang""")
def dedupe_natural_key(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    first = bitemporal.unseen(d, d.where("false"), ["source", "lang"], ["doc_id"]).select("source", "lang", F.col("doc_id").alias("first_id"))
    return d.groupBy("source", "lang").agg(F.count("*").alias("n")).join(first, ["source", "lang"])


@query("""
SELECT CASE WHEN event_type = 'error' THEN 'FAIL' WHEN event_type = 'view' THEN '304' WHEN value < 5 THEN 'EMPTY' WHEN user_id % 2 = 0 THEN 'SAME' ELSE 'NEW' END AS outcome, count(*) AS n
FROM events GROUP BY 1""")
def fetch_outcomes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 304).otherwise(200)
    text = F.when(F.col("value") < 5, " \n").otherwise(F.col("props"))
    return e.groupBy(bitemporal.fetch_outcome(status, F.col("props"), text, (F.col("user_id") % 2).cast("string"), F.lit("0")).alias("outcome")).agg(F.count("*").alias("n"))


# -- chunks ----------------------------------------------------------------------------------------

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""
WITH s AS (SELECT conv_id, turn, {_STRIP.format("role")} AS role, {_STRIP.format("text")} AS text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS row_no FROM s)
SELECT conv_id AS document_id, row_no AS ordinal, concat_ws(' | ', CASE WHEN role <> '' THEN 'Role: ' || role END, 'Turn: ' || turn, CASE WHEN text <> '' THEN 'Text: ' || text END) AS text,
       'depth_chart > table 0 > row ' || row_no AS section_path FROM t""")
def row_sentences(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    row = F.struct("turn", X.strip(F.col("role")).alias("role"), X.strip(F.col("text")).alias("text"))
    nested = c.groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    cells = F.transform("r", lambda x: F.array(x["role"], x["turn"].cast("string"), x["text"]))
    header = F.array(F.array(F.lit("Role"), F.lit("Turn"), F.lit("Text")))
    tables = F.array(F.struct(F.lit(0).alias("index"), F.concat(header, cells).alias("rows")))
    return chunks.table_chunks(nested.select("document_id", F.lit("depth_chart").alias("doc_type"), tables.alias("tables")))


def _end_sql(s: str) -> str:
    tail = f"substr(text, {s} + 601, least({s} + 1200, n) - {s} - 600)"
    back = lambda sep: f"strpos(reverse({tail}), reverse({sep}))"
    after = lambda sep: f"{s} + 600 + length({tail}) - {back(sep)} + 1"
    p, q, r = "chr(10) || chr(10)", "chr(10)", "'. '"
    return f"CASE WHEN {s} + 1200 >= n THEN n WHEN {back(p)} > 0 THEN {after(p)} WHEN {back(q)} > 0 THEN {after(q)} WHEN {back(r)} > 0 THEN {after(r)} ELSE {s} + 1200 END"


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 0),
w AS (
  SELECT doc_id, text, n, CAST(0 AS BIGINT) AS s, CAST({_end_sql("0")} AS BIGINT) AS e FROM d
  UNION ALL
  SELECT doc_id, text, n, s, CAST({_end_sql("s")} AS BIGINT) AS e FROM (SELECT doc_id, text, n, greatest(e - 200, s + 1) AS s FROM w WHERE e < n)
), c AS (SELECT doc_id, s, e, {_STRIP.format("substr(text, s + 1, e - s)")} AS chunk FROM w)
SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ordinal, chunk AS text, 'article > text > chars ' || s || '-' || e AS section_path, s AS span_start, e AS span_end
FROM c WHERE chunk <> ''""")
def prose_windows(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit("article").alias("doc_type"), "text")
    return chunks.prose_chunks(d)


def _chunk_rows(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    version = F.when(F.col("toxic").isNotNull(), F.concat(F.lit("v"), F.col("toxic").cast("string")))
    return d.select(F.col("source").alias("document_id"), "text", F.col("quality").alias("embedding"), version.alias("embedding_version"))


@query("""
SELECT count(*) AS chunks, count(DISTINCT source) AS documents, count(quality) AS embedded, count(*) FILTER (toxic IS NULL OR toxic <> 1) AS pending
FROM documents LEFT JOIN labels USING (doc_id)""")
def corpus_status(spark, sf_dir):
    return ops.corpus_status(_chunk_rows(spark, sf_dir), "v1")


@query("""
WITH c AS (SELECT CASE WHEN role = 'user' THEN 'Team: ' || role || ' | Day: ' || turn ELSE role || ' | Practice: x' END AS text, CASE WHEN turn % 3 <> 0 THEN 'a > table 0' ELSE 'a > text' END AS section_path FROM conversations),
k AS (SELECT count(*) AS chunks, count(*) FILTER (section_path LIKE '%table%') AS structured, count(*) FILTER (section_path NOT LIKE '%table%') AS prose,
  count(*) FILTER (section_path LIKE '%table%' AND text NOT LIKE 'Team: %') AS missing_team, count(*) FILTER (section_path LIKE '%table%' AND text NOT LIKE '%| Day: %') AS missing_day,
  count(*) FILTER (section_path LIKE '%table%' AND text NOT LIKE '%| Practice: %' AND text NOT LIKE '%| Status: %') AS no_status FROM c)
SELECT *, missing_team / greatest(structured, 1) AS missing_team_share, missing_day / greatest(structured, 1) AS missing_day_share, no_status / greatest(structured, 1) AS no_status_share FROM k""")
def chunk_audit(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "user", F.concat(F.lit("Team: "), "role", F.lit(" | Day: "), F.col("turn").cast("string"))).otherwise(F.concat("role", F.lit(" | Practice: x")))
    return ops.chunk_audit(c.select(text.alias("text"), F.when(F.col("turn") % 3 != 0, "a > table 0").otherwise("a > text").alias("section_path")))


@query("SELECT role AS team, count(*) AS count FROM conversations GROUP BY 1")
def leading_teams(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return ops.leading_teams(c.select(F.concat(F.lit("Team: "), "role", F.lit(" | Day: 1")).alias("text"), F.lit("a > table 1").alias("section_path")), 50)


@query("""
WITH r AS (SELECT count(*) AS total, count(quality) AS quality, count(toxic) AS toxic, count(lang) AS lang FROM documents LEFT JOIN labels USING (doc_id))
SELECT field, filled, total, 100.0::DOUBLE * filled / greatest(total, 1) AS percent FROM (
  SELECT 'quality' AS field, quality AS filled, total FROM r UNION ALL SELECT 'toxic', toxic, total FROM r UNION ALL SELECT 'lang', lang, total FROM r)""")
def field_coverage(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return records.completeness(d, ("quality", "toxic", "lang"))


# -- scalars ---------------------------------------------------------------------------------------

_CELLS = ("Full", "fp", "Limited Participation", "LP.", "dnp", "Did Not Participate!", "Out", "q", "Rest", "doubtful.", "")


@query(f"""
WITH c AS (SELECT CASE event_id % 3 WHEN 0 THEN cell WHEN 1 THEN upper(cell) ELSE '  ' || cell || ' ' END AS v FROM (SELECT event_id, {list(_CELLS)}[user_id % 11 + 1] AS cell FROM events)),
n AS (SELECT v, trim(v) AS t FROM c)
SELECT v, CASE regexp_replace(upper(t), '[^A-Z ]', '', 'g') WHEN 'FULL' THEN 'FULL' WHEN 'FP' THEN 'FULL' WHEN 'FULL PARTICIPATION' THEN 'FULL' WHEN 'LIMITED' THEN 'LIMITED' WHEN 'LP' THEN 'LIMITED'
  WHEN 'LIMITED PARTICIPATION' THEN 'LIMITED' WHEN 'DNP' THEN 'DNP' WHEN 'DID NOT PARTICIPATE' THEN 'DNP' END AS participation,
  regexp_replace(upper(t), '[^A-Z]', '', 'g') IN ('OUT', 'DOUBTFUL', 'QUESTIONABLE', 'QUES', 'Q', 'D', 'O') AS game_status, count(*) AS n FROM n GROUP BY ALL""")
def participation_norm(spark, sf_dir):
    """Cells as report tables have them, one an event: each source spells in its own way."""
    cell = F.element_at(F.array(*map(F.lit, _CELLS)), (F.col("user_id") % 11 + 1).cast("int"))
    v = F.when(F.col("event_id") % 3 == 0, cell).when(F.col("event_id") % 3 == 1, F.upper(cell)).otherwise(F.concat(F.lit("  "), cell, F.lit(" ")))
    cells = read(spark, sf_dir, "events").select(v.alias("v"))
    return cells.groupBy("v", X.normalise_participation(F.col("v")).alias("participation"), X.looks_like_game_status(F.col("v")).alias("game_status")).agg(F.count("*").alias("n"))


@query("SELECT event_type, CASE WHEN upper(event_type) IN ('CLICK', 'VIEW') THEN upper(event_type) END AS member, count(*) AS n FROM events GROUP BY 1, 2")
def vocab_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", X.in_vocabulary(F.col("event_type"), ("CLICK", "VIEW")).alias("member")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS t FROM documents)""")
def tokenize_terms(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("""
SELECT event_id, coalesce(epoch_us(CASE event_id % 4 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('day', ts) END), -1) AS us FROM events""")
def display_date_parse(spark, sf_dir):
    """Each event's time as a page shows it, with and without the hour; days that don't exist and texts without a date."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    shown = F.when(k == 0, F.concat(F.lit("Posted "), F.date_format(t, "MMM d, yyyy 'at' h:mm a"), F.lit(" and Feb 2, 2026"))).when(k == 1, F.date_format(t, "MMM d, yyyy")).when(k == 2, F.concat(F.lit("Feb 31, "), F.date_format(t, "yyyy"))).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.unix_micros(X.parse_display_date(shown)), F.lit(-1)).alias("us"))


@query("""
SELECT event_id, coalesce(epoch_us(CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts) END), -1) AS us FROM events""")
def iso_parse(spark, sf_dir):
    """Each event's time as an instant with Z, with an offset, without a zone, as a day; and texts that are none."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    at = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, F.concat(at, F.lit("+02:00"))).when(k == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(k == 3, F.date_format(t, "yyyy-MM-dd")).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.coalesce(F.unix_micros(X.parse_iso(shown)), F.lit(-1)).alias("us"))


@query("""
WITH w AS (SELECT conv_id, turn, list_transform(list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''’.\\-]*'), lambda x: length(x) > 1), lambda x: lower(x)) AS ws, ws AS name FROM conversations),
p AS (SELECT a.conv_id, a.turn, coalesce(list_has_any(a.name, b.ws), false) AS grounded FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
SELECT conv_id, turn, grounded FROM p""")
def grounding_overlap(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", X.is_grounded(F.col("text"), F.col("said")).alias("grounded"))


# -- retrieval -------------------------------------------------------------------------------------


def _questions(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _index(spark, sf_dir) -> DataFrame:
    return search.counts(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), _questions(spark, sf_dir))


_LEXICAL = """
tf AS (SELECT term, doc_id AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) WHERE length(term) > 1 GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id AS question_id, lower(term) AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}''’.\\-]*')) AS term FROM benchmark) WHERE length(term) > 1),
hits AS (SELECT question_id, chunk_id, round(sum(tf / (tf + 1.0::DOUBLE)), 6) AS score, count(*) AS n FROM tf JOIN q USING (term) GROUP BY 1, 2),
lexical AS (SELECT * FROM (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM hits) WHERE rank <= 50)"""


@query(f"WITH {_LEXICAL} SELECT question_id, chunk_id, score, rank FROM lexical WHERE rank <= 10")
def lexical_or_topk(spark, sf_dir):
    return search.lexical(_index(spark, sf_dir), _questions(spark, sf_dir), 10)


@query(f"""WITH {_LEXICAL},
k AS (SELECT question_id, count(*) AS terms FROM q GROUP BY 1)
SELECT question_id, count(*) AS any_term, count(*) FILTER (n = terms) AS all_terms FROM hits JOIN k USING (question_id) GROUP BY 1""")
def lexical_or_canary(spark, sf_dir):
    return search.matched(_index(spark, sf_dir), _questions(spark, sf_dir))


_WORDS = """
w AS (SELECT doc_id AS chunk_id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents)),
kept AS (SELECT chunk_id, term, least(place, 16383) AS place FROM w WHERE term NOT IN (""" + ", ".join(f"'{x}'" for x in STOP_WORDS) + """)),
asked AS (SELECT DISTINCT item_id AS question_id, unnest(regexp_extract_all(lower(term), '[a-z0-9]+')) AS term FROM
  (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{N}\'\'’.\\-]*')) AS term FROM benchmark) WHERE length(term) > 1),
both_words AS (SELECT DISTINCT term FROM (SELECT term FROM kept UNION ALL SELECT term FROM asked)),
""" + stem_sql("both_words", "stems") + """,
q AS (SELECT DISTINCT question_id, stem FROM asked JOIN stems USING (term) WHERE term NOT IN (""" + ", ".join(f"'{x}'" for x in STOP_WORDS) + """)),
n AS (SELECT question_id, count(*) AS stems FROM q GROUP BY 1),
places AS (SELECT stem, chunk_id, list_sort(list_distinct(list(place)))[:255] AS ps FROM kept JOIN stems USING (term) WHERE stem IN (SELECT stem FROM q) GROUP BY 1, 2),
size AS (SELECT chunk_id, count(*) AS length FROM kept GROUP BY 1),
hits AS (SELECT question_id, chunk_id, sum(list_sum(list_transform(range(1, len(ps) + 1), lambda k: 1.0::DOUBLE / (k * k))) * 0.1::DOUBLE / 1.64493406685::DOUBLE) AS weight FROM places JOIN q USING (stem) GROUP BY 1, 2)"""


@query(f"WITH {_WORDS[1:]}, s AS (SELECT question_id, chunk_id, round(weight / stems, 9) AS score FROM hits JOIN n USING (question_id)) "
    "SELECT question_id, chunk_id, round(score, 7) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 10")  # fmt: skip
def lexical_english_topk(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    q = _questions(spark, sf_dir)
    return search.ranked(search.positions(chunks, q), q, 10).withColumn("score", F.floor(F.col("score") * 1e7 + 0.5) / 1e7)


@query(f"""WITH {_WORDS[1:]},
found AS (SELECT question_id, chunk_id, stem, ps, lead(ps) OVER (PARTITION BY question_id, chunk_id ORDER BY stem) AS following FROM places JOIN q USING (stem)),
close AS (SELECT question_id, chunk_id, sum(CASE WHEN following IS NOT NULL THEN 1.0::DOUBLE / greatest(list_min(list_transform(ps, lambda x: list_min(list_transform(following, lambda y: abs(x - y))))), 1) ELSE 0 END) AS near FROM found GROUP BY 1, 2),
s AS (SELECT question_id, chunk_id, round(weight / stems / (1 + ln(length::DOUBLE)) + 0.01::DOUBLE * near, 9) AS score FROM hits JOIN n USING (question_id) JOIN size USING (chunk_id) JOIN close USING (question_id, chunk_id))
SELECT question_id, chunk_id, round(score, 7) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 10""")
def lexical_closeness_topk(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    q = _questions(spark, sf_dir)
    return search.ranked(search.positions(chunks, q), q, 10, normalise="log", closeness=0.01).withColumn("score", F.floor(F.col("score") * 1e7 + 0.5) / 1e7)


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
{stem_sql("w", "stems")}
SELECT stem, count(*) AS words, min(term) AS first_word FROM stems GROUP BY 1""")
def word_stems(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("term")).distinct()
    return stemmed(words).groupBy("stem").agg(F.count("*").alias("words"), F.min("term").alias("first_word"))


_DENSE = """
qv AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {where}),
near AS (SELECT question_id, vec_id AS chunk_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], v), 9) AS distance FROM embeddings CROSS JOIN qv),
dense AS (SELECT * FROM (SELECT question_id, chunk_id, distance, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM near) WHERE rank <= 50)"""


@query(f"WITH {_DENSE.format(where='vec_id % 20 = 0')} SELECT question_id, chunk_id, round(distance, 6) AS distance, rank FROM dense WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return search.dense(e, e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("vector")), 10).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_DENSE.format(where='vec_id % 20 = 0').replace('CROSS JOIN qv', 'CROSS JOIN qv WHERE label % 2 = 0')} SELECT question_id, chunk_id, round(distance, 6) AS distance, rank FROM dense WHERE rank <= 10")
def vector_index_topk(spark, sf_dir):
    """The index of all vectors, under a cut-off that hides the odd labels; all cells are probed, so that SQL gives the same rows."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", (F.col("label") % 2).alias("knowledge_time"))
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    path = f"{named.rstrip('/')}/vector_index/{uuid.uuid4().hex}"
    vector_index.build(e, path, 16)
    q = e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("vector"))
    return vector_index.search(spark, path, q, 10, probes=16, when=0).withColumn("distance", F.round("distance", 6))


_FUSED = """
parts AS (SELECT question_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS share, rank AS lexical_rank, NULL::BIGINT AS dense_rank FROM lexical UNION ALL SELECT question_id, chunk_id, 1.0::DOUBLE / (60 + rank), NULL, rank FROM dense),
fused AS (SELECT question_id, chunk_id, round(sum(share), 9) AS score, min(dense_rank) AS dense_rank, min(lexical_rank) AS lexical_rank FROM parts GROUP BY 1, 2),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 10)"""


@query(f"""WITH {_LEXICAL}, {_DENSE.format(where="vec_id IN (SELECT item_id FROM benchmark)")}, {_FUSED}
SELECT question_id, chunk_id, round(score, 6) AS score, rank, CASE WHEN dense_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'both' WHEN dense_rank IS NOT NULL THEN 'dense' ELSE 'lexical' END AS found_by, 'hybrid' AS mode_used FROM hybrid""")
def hybrid_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    embed = lambda q: q.join(e.select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("vector")), "question_id").select("question_id", "vector")
    hits = search.hybrid(e, _index(spark, sf_dir), _questions(spark, sf_dir), embed)
    return search.serialised(hits).select("question_id", "chunk_id", "score", "rank", "found_by", "mode_used")


@query("""
WITH a AS (SELECT source AS question_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT source AS question_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
u AS (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20),
f AS (SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY 1, 2)
SELECT question_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 10""")
def rrf_fusion(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("question_id"), F.col("doc_id").alias("chunk_id"), "n_chars")
    first = lambda *order: d.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where("rank <= 20")
    fused = search.fuse({"lexical": first(F.desc("n_chars"), "chunk_id"), "dense": first("chunk_id")})
    return fused.select("question_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("""
SELECT doc_id, 'new' AS list FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'labelled' FROM labels WHERE toxic = 1""")
def union_ranked(spark, sf_dir):
    new = read(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id", F.lit("new").alias("list"))
    return new.unionByName(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("labelled").alias("list")))


_GOLD = f"""WITH {_LEXICAL},
h AS (SELECT l.question_id, l.rank, CASE WHEN contains(lower(d.text), lower(b.text)) THEN l.rank END AS hit FROM lexical l JOIN documents d ON d.doc_id = l.chunk_id JOIN benchmark b ON b.item_id = l.question_id WHERE l.rank <= 10),
p AS (SELECT b.item_id AS question_id, count(hit) AS n_relevant, count(rank) AS n_returned, min(hit) AS first_position, coalesce(1.0::DOUBLE / min(hit), 0) AS reciprocal_rank FROM benchmark b LEFT JOIN h ON h.question_id = b.item_id GROUP BY 1)"""


def _found(spark, sf_dir) -> DataFrame:
    q, texts = _questions(spark, sf_dir), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = search.with_text(search.lexical(_index(spark, sf_dir), q, 10), texts, q, 10)
    return evaluate.positions(hits, q.select("question_id", F.array("question").alias("must_contain")))


@query(_GOLD + " SELECT question_id, n_relevant, n_returned, coalesce(first_position, 0) AS first_position, reciprocal_rank FROM p")
def relevance_eval(spark, sf_dir):
    return _found(spark, sf_dir).drop("positions").fillna(0, ["first_position"])


@query(_GOLD + """
SELECT count(*) AS n, avg(CASE WHEN first_position IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, avg(CASE WHEN first_position <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_1,
  avg(CASE WHEN first_position <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_3, avg(CASE WHEN first_position <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_5, avg(CASE WHEN first_position <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_10, round(avg(reciprocal_rank), 9) AS mrr FROM p""")
def hit_rate_mrr(spark, sf_dir):
    return evaluate.report(_found(spark, sf_dir)).withColumn("mrr", F.round("mrr", 9))


@query(_GOLD + " SELECT question_id FROM p WHERE first_position IS NULL")
def missed_questions(spark, sf_dir):
    return evaluate.misses(_found(spark, sf_dir))


# -- records ---------------------------------------------------------------------------------------


def _records(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events")
    t = F.col("event_type")
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("long")
    day = F.element_at(F.array(*map(F.lit, REPORT_DAYS)), (F.weekday(F.col("ts").cast("date")) + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), "user_id", week.alias("document_id"), F.col("ts").alias("knowledge_time"), F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("team"), F.lit("v2").alias("extractor_version"),
        F.when(F.col("value") < 80, day).alias("report_day"), F.when(t == "click", "DNP").when(t == "view", "LIMITED").when(t == "purchase", "FULL").alias("practice_status"),
        F.when(t == "signup", F.col("props")).alias("injury"), F.when(t == "error", "OUT").when(F.col("value") > 60, "QUESTIONABLE").alias("game_status"),
    )


_RECORDS = """
r AS (SELECT event_id AS id, user_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS document_id, ts AS knowledge_time, 'T' || (user_id % 5) AS team,
  CASE WHEN value < 80 THEN isodow(CAST(ts AS DATE)) - 1 ELSE 99 END AS day, CASE event_type WHEN 'click' THEN 'DNP' WHEN 'view' THEN 'LIMITED' WHEN 'purchase' THEN 'FULL' END AS practice_status,
  CASE WHEN event_type = 'signup' THEN props END AS injury, CASE WHEN event_type = 'error' THEN 'OUT' WHEN value > 60 THEN 'QUESTIONABLE' END AS game_status FROM events)"""


@query(f"""WITH {_RECORDS},
g AS (SELECT user_id, document_id, min(knowledge_time) AS knowledge_time, coalesce(string_agg(practice_status, '>' ORDER BY day, id), '') AS practice, arg_min(injury, (day, id)) FILTER (injury IS NOT NULL) AS injury, arg_max(game_status, (day, id)) FILTER (game_status IS NOT NULL) AS game_status FROM r GROUP BY 1, 2)
SELECT user_id, document_id, epoch_us(knowledge_time) AS known_us, practice, injury, game_status, row_number() OVER (PARTITION BY user_id ORDER BY knowledge_time DESC, document_id DESC) AS recency FROM g""")
def trajectory_ordered(spark, sf_dir):
    t = records.trajectories(_records(spark, sf_dir), ["user_id"])
    return t.select("user_id", "document_id", F.unix_micros(F.col("knowledge_time").cast("timestamp")).alias("known_us"), F.array_join("practice", ">").alias("practice"), "injury", "game_status", "recency")


@query(f"WITH {_RECORDS} SELECT team, count(*) AS records, epoch_us(max(knowledge_time)) AS latest_us, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM r GROUP BY 1")
def team_summary(spark, sf_dir):
    return records.team_summary(_records(spark, sf_dir)).select("team", "records", F.unix_micros(F.col("latest").cast("timestamp")).alias("latest_us"), "total")


@query(f"WITH {_RECORDS} SELECT id, user_id, game_status FROM r WHERE team = 'T3' AND knowledge_time <= TIMESTAMP '2024-01-20 00:00:00' AND knowledge_time > TIMESTAMP '2024-01-10 00:00:00' ORDER BY knowledge_time DESC, id LIMIT 100")
def record_query(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("knowledge_time", F.col("knowledge_time").cast("timestamp"))
    stamp = lambda s: F.lit(s).cast("timestamp")
    return records.record_query(rows, "T3", stamp("2024-01-20 00:00:00"), stamp("2024-01-10 00:00:00"), 100).select("id", "user_id", "game_status")


@query("""
SELECT doc_id AS chunk_id, CASE WHEN source IN ('src1', 'src2') THEN 'injury_report' ELSE 'article' END AS doc_type FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE toxic IS NULL OR toxic <> 1 ORDER BY CASE WHEN source IN ('src1', 'src2') THEN 0 ELSE 1 END, doc_id LIMIT 50""")
def priority_batch(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    kind = F.when(F.col("source").isin("src1", "src2"), "injury_report").otherwise("article")
    c = d.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.concat(F.lit("v"), F.col("toxic").cast("string")).alias("extracted_version"))
    return records.extraction_batch(c, d.select(F.col("doc_id").alias("document_id"), kind.alias("doc_type")), "v1").select("chunk_id", "doc_type")


@query("""
WITH d AS (SELECT c_custkey AS k, 'Roe ' || chr(65 + CAST(c_custkey % 26 AS INTEGER)) || 'ab' AS player_name, ['PHI', 'DAL', NULL][c_custkey % 3 + 1] AS team, ['WR', 'G/T', NULL, NULL][c_custkey % 4 + 1] AS position,
  CASE WHEN c_custkey % 5 <> 0 THEN lower(c_mktsegment) END AS injury, CASE WHEN c_custkey % 6 = 0 THEN 'LIMITED' END AS practice_status, ['OUT', 'DOUBTFUL', NULL][c_custkey // 3 % 3 + 1] AS game_status,
  CASE WHEN c_custkey % 8 = 0 THEN 'WED' END AS report_day, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS evidence FROM customer WHERE c_custkey % 7 <> 0)
SELECT * FROM d WHERE coalesce(practice_status, game_status, injury, position) IS NOT NULL""")
def record_validation(spark, sf_dir):
    """A draft for each customer; one in seven names someone that its text doesn't, others hold values of no vocabulary."""
    k = F.col("c_custkey")
    of = lambda values, n=k: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (n % len(values) + 1).cast("int"))
    name = F.concat(F.lit("Roe "), F.char((65 + k % 26).cast("int")), F.lit("ab"))
    drafts = read(spark, sf_dir, "customer").select(
        k.alias("k"), F.concat(F.lit(" "), name).alias("player_name"), of(["phi", " Dal ", "XYZ"]).alias("team"), of([" wr", "g/t", "quarterback", "Q1"]).alias("position"),
        F.when(k % 5 == 0, F.repeat(F.lit("k"), F.lit(65))).otherwise(F.concat(F.lower("c_mktsegment"), F.lit(" "))).alias("injury"), F.when(k % 6 == 0, "limited").otherwise("Limited participation").alias("practice_status"),
        of(["out", "Doubtful", "maybe"], F.floor(k / 3)).alias("game_status"), F.when(k % 8 == 0, "wed").otherwise("Sunday").alias("report_day"), F.when(k % 2 == 1, F.col("c_name")).otherwise("").alias("evidence"),
        F.when(k % 7 == 0, "Another text").otherwise(F.concat(F.lit("WR "), name, F.lit(" was hurt"))).alias("chunk_text"),
    )
    return records.validate(drafts, ("PHI", "DAL")).drop("chunk_text")


@query("""
SELECT c_custkey AS id, c_name AS player_name, CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment END AS team, CAST(NULL AS VARCHAR) AS injury, CAST(NULL AS VARCHAR) AS position, CASE WHEN c_custkey % 6 = 1 THEN 'FULL' END AS practice_status
FROM customer WHERE c_custkey % 6 < 2""")
def llm_response_parse(spark, sf_dir):
    """A raw response for each customer: an object, a fenced list, prose, a truncated one, no record, a mere string."""
    k, name = F.col("c_custkey"), F.to_json(F.struct(F.col("c_name").alias("player_name")))
    open_name = F.expr("substr(to_json(named_struct('player_name', c_name)), 1, length(to_json(named_struct('player_name', c_name))) - 1)")
    response = (
        F.when(k % 6 == 0, F.concat(F.lit('{"records": ['), open_name, F.lit(', "team": "'), F.col("c_mktsegment"), F.lit('", "injury": "null", "position": 5}, {"player_name": " "}, 7]}')))
        .when(k % 6 == 1, F.concat(F.lit("```json\n["), open_name, F.lit(', "practice_status": "FULL", "evidence": " N/A "}]\n```')))
        .when(k % 6 == 2, F.col("c_name")).when(k % 6 == 3, F.concat(F.lit('{"records": ['), name)).when(k % 6 == 4, F.lit('{"records": []}')).otherwise(F.concat(F.lit('"'), F.col("c_name"), F.lit('"')))
    )
    responses = read(spark, sf_dir, "customer").select(k.alias("id"), response.alias("response"))
    return records.parse_responses(responses, ["id"]).select("id", "player_name", "team", "injury", "position", "practice_status")


@query(f"""
WITH c AS (SELECT *, {[c[1] for c in CLUBS]}[c_nationkey + 1] AS team, replace(c_name, '#', ' ') AS player FROM customer)
SELECT team, 'Tuesday' AS day, 'DT' AS position, player, lower(c_mktsegment) AS injury, CASE WHEN c_custkey % 4 = 0 THEN 'LIMITED' ELSE 'DNP' END AS participation, CAST(NULL AS VARCHAR) AS game_status FROM c WHERE c_custkey % 2 = 0
UNION ALL SELECT team, 'Wednesday', 'G/T', player, NULL, NULL, 'QUESTIONABLE' FROM c WHERE c_custkey % 2 = 1""")
def report_rows_golden(spark, sf_dir):
    """Reports written from customers, about fifty of a nation in each, and read back: days, groups and teams carried forward."""
    return report.report_rows(_reports(spark, sf_dir)).drop("document_id", "line_no")


def _reports(spark, sf_dir, nameless: int = 0) -> DataFrame:
    """document_id and text; nations whose number this divides have headings without a club."""
    k, player = F.col("c_custkey"), F.replace("c_name", F.lit("#"), F.lit(" "))
    team = F.element_at(F.array(*(F.lit(f"{c[1]} ") for c in CLUBS)), (F.col("c_nationkey") + 1).cast("int"))
    team = F.when(F.col("c_nationkey") % nameless == 0, "").otherwise(team) if nameless else team
    detail = F.concat(F.lower("c_mktsegment"), F.when(k % 4 == 0, "/Limited Participation").otherwise(""))
    line = F.when(k % 2 == 0, F.concat(F.lit("DT "), player, F.lit(" ("), detail, F.lit(")"))).otherwise(F.concat(F.lit("G/T "), player))
    lines = read(spark, sf_dir, "customer").select((F.col("c_nationkey").cast("long") * 1_000_000_000 + F.floor(k / 1250)).alias("document_id"), team.alias("team"), F.struct((k % 2).alias("odd"), k.alias("k"), line.alias("line")).alias("r"))
    each = lines.groupBy("document_id", "team").agg(F.array_sort(F.collect_list("r")).alias("r"))
    of = lambda odd: F.array_join(F.transform(F.filter("r", lambda x: x["odd"] == odd), lambda x: x["line"]), "\n")
    head = F.concat(F.lit("Report of the week\nDec 18, 2025 at 04:15 PM\nTuesday’s Injury Report\n"), "team", F.lit("Injury Report\nDid Not Participate\n"))
    text = F.concat(head, of(0), F.lit("\nWednesday Injury Report\n"), "team", F.lit("Practice Report\nQuestionable\n"), of(1), F.lit("\nNote: players listed above took part in a walk-through on the day."))
    return each.select("document_id", text.alias("text"))


_REPORTS = "r AS (SELECT c_nationkey::BIGINT * 1000000000 + c_custkey // 1250 AS document_id, c_nationkey, count(*) AS n, count(*) FILTER (c_custkey % 2 = 0) AS even FROM customer GROUP BY ALL)"


@query(f"""WITH {_REPORTS},
c AS (SELECT unnest(['DAY', 'GROUP', 'TEAM', 'PLAYER', '']) AS class, unnest([2, 2, 2, even, 3 + n - even]) AS n FROM r)
SELECT class, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def line_classes(spark, sf_dir):
    return report.report_lines(_reports(spark, sf_dir)).groupBy(X.diagnostic_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {_REPORTS} SELECT document_id, n AS n_rows, CASE WHEN c_nationkey % 5 = 0 THEN n ELSE 0 END AS teamless, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE 1 END AS teams FROM r")
def heading_audit(spark, sf_dir):
    return report.heading_audit(report.report_rows(_reports(spark, sf_dir, nameless=5)))


@query("""
WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A PRACTICE report. ' || text WHEN 1 THEN text || repeat('x', 4000) || ' Injury Report' ELSE text END AS text FROM documents)
SELECT doc_id, regexp_matches(substr(text, 1, 4000), '(?i)injury report|practice report') AS report, CASE WHEN contains(lower(left(text, 200)), 'inactives') THEN 'inactives' ELSE 'injury_report' END AS doc_type,
  CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'pdf' ELSE 'html' END AS kind FROM t""")
def document_gates(spark, sf_dir):
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents").withColumn("text", F.when(k % 4 == 0, F.concat(F.lit("A PRACTICE report. "), "text")).when(k % 4 == 1, F.concat("text", F.repeat(F.lit("x"), F.lit(4000)), F.lit(" Injury Report"))).otherwise(F.col("text")))
    header = F.when(k % 5 == 0, "Application/PDF; charset=x").when(k % 3 == 0, "text/html")
    content = F.concat(F.when(k % 7 == 0, "%PDF-1.7 ").otherwise(" "), "text").cast("binary")
    return d.select("doc_id", X.looks_like_injury_report(F.col("text")).alias("report"), X.document_type(F.substring("text", 1, 200)).alias("doc_type"), X.parser_kind(header, content).alias("kind"))


@query("""
SELECT page_id, sha256(html) AS digest, 'pages/' || strftime(ts, '%Y/%m/%d') || '/p' || page_id || '-' || substr(sha256(html), 1, 12) AS path FROM pages JOIN events ON event_id = page_id""")
def raw_paths(spark, sf_dir):
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").cast("timestamp").alias("at"))
    p = read(spark, sf_dir, "pages").join(times, "page_id").withColumn("digest", X.content_hash(F.col("html")))
    return p.select("page_id", "digest", X.raw_path(F.lit("pages"), F.col("at"), F.concat(F.lit("p"), F.col("page_id").cast("string")), F.col("digest")).alias("path"))


@query("SELECT page_id, page_id % 4 = 0 AS missing, page_id % 4 <> 0 AND (page_id % 3 = 0 OR page_id % 5 = 0) AS changed, sha256(html) AS text_hash FROM pages WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, true, false, CASE WHEN page_id % 3 = 0 THEN 'old' ELSE sha256(html) END FROM pages WHERE page_id % 4 = 0")
def reparse_changes(spark, sf_dir):
    """Pages parsed anew from raw bytes, of which a fourth is lost; a third had another text, a fifth no table."""
    k, digest = F.col("page_id"), X.content_hash(F.col("html"))
    p = read(spark, sf_dir, "pages").withColumn("raw_ref", F.concat(F.lit("r"), k.cast("string")))
    table = F.array(F.struct(F.lit(0).alias("index"), F.array(F.array(F.lit("a"))).alias("rows")))
    stored = p.select("page_id", "raw_ref", F.col("html").alias("text"), F.when(k % 3 == 0, "old").otherwise(digest).alias("text_hash"), F.when(k % 5 == 0, F.slice(table, 1, 0)).otherwise(table).alias("tables"))
    parse = lambda raw: raw.select("raw_ref", F.col("html").alias("text"), table.alias("tables"), digest.alias("text_hash"))
    return files.reparsed(stored, p.where(k % 4 != 0).select("raw_ref", "html"), parse).select("page_id", "missing", "changed", "text_hash")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 500")
def chunk_batch(spark, sf_dir):
    d, done = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id")), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return chunks.chunk_batch(d, done).select(F.col("document_id").alias("doc_id"))


# -- operations ------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE e AS (SELECT user_id, ts, event_id FROM events),
w AS (
  SELECT user_id, min(ts) AS start FROM e GROUP BY 1
  UNION ALL
  SELECT w.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 1 DAY) FROM w
  WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 1 DAY)
), k AS (SELECT e.user_id, e.ts, (SELECT max(start) FROM w WHERE w.user_id = e.user_id AND w.start <= e.ts) AS start FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, start ORDER BY ts) AS n FROM k)
SELECT user_id AS caller, epoch_us(ts) AS us, n, n > 2 AS rejected FROM n""")
def rate_limited(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("caller"), F.col("ts").cast("timestamp").alias("ts"))
    return ops.rate_limited(e, 86400, 2).select("caller", F.unix_micros("ts").alias("us"), "n", "rejected")


@query("SELECT count(*) * (600 * 1.0::DOUBLE + 200 * 5.0::DOUBLE) / 1e6::DOUBLE AS usd FROM documents")
def cost_estimate(spark, sf_dir):
    return ops.cost(read(spark, sf_dir, "documents"))


@query("SELECT source AS job_name, count(*) AS attempted, count(*) FILTER (lang = 'de') AS failed, CAST(sum(n_chars) AS BIGINT) AS created FROM documents GROUP BY 1")
def sweep_totals(spark, sf_dir):
    return ops.sweep_totals(read(spark, sf_dir, "documents").select(F.col("source").alias("job_name"), (F.col("lang") == "de").alias("failed"), F.col("n_chars").alias("created")))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view') WHERE n <= 5")
def articles_per_pass(spark, sf_dir):
    return ops.per_pass(read(spark, sf_dir, "events").where("event_type = 'view'"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


@query("""
WITH l AS (SELECT DISTINCT d.source AS source_id, d.lang AS url FROM documents d), s AS (SELECT DISTINCT source AS source_id, lang AS url FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT source_id, count(*) AS linked, count(*) FILTER (s.url IS NULL) AS unseen FROM l LEFT JOIN s USING (source_id, url) GROUP BY 1""")
def discovery_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    key = [F.col("source").alias("source_id"), F.col("lang").alias("url")]
    seen = d.join(read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select(*key).distinct()
    return ops.discovery_counts(d.select(*key).distinct(), seen)


@query("""
WITH s AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'injury_report' ELSE 'injury_index' END AS kind, s_suppkey % 3 <> 0 OR s_suppkey % 2 <> 0 AS enabled FROM supplier
  UNION ALL SELECT kind, true FROM (SELECT unnest(['injury_index', 'transactions']) AS kind, i FROM range(32) r(i)) WHERE NOT (i = 0))
SELECT kind, enabled, count(*) AS n, count(*) FILTER (NOT enabled) AS with_reason FROM s GROUP BY 1, 2""")
def seed_sources(spark, sf_dir):
    """The static list brought into a table of sources, of which the legacy widget pages are disabled."""
    k = F.col("s_suppkey")
    sources = read(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.when(k % 3 == 0, "injury_report").otherwise("injury_index").alias("kind"), F.lit(True).alias("enabled"), F.lit(None).cast("string").alias("last_error"),
        F.when(k % 2 == 0, F.concat(F.lit("https://www.example.com/team/injury-report/"), k.cast("string"))).alias("url"),
    )
    return S.upserted(sources, S.seeds(spark)).groupBy("kind", "enabled").agg(F.count("*").alias("n"), F.count_if(~F.col("enabled") & F.col("last_error").isNotNull()).alias("with_reason"))


@query(r"""
WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title,
  unnest(range(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')))) AS pos FROM pages),
l AS (SELECT page_id, pos, base || regexp_extract(href, '^([^#]*)', 1) AS link, title FROM a WHERE regexp_matches(title, '[A-Za-z0-9_]{3}') AND NOT regexp_matches(regexp_extract(href, '^([^?#]*)', 1), '(?i)/(video|photos|audio|podcast|team)/')),
f AS (SELECT page_id, min(pos) AS pos, link, arg_min(title, pos) AS title FROM l GROUP BY page_id, link)
SELECT page_id, pos, link, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM f) WHERE n <= 200""")
def link_discovery(spark, sf_dir):
    return P.discovered_links(read(spark, sf_dir, "pages"), r"(?i)\w{3}")


@query("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN -1 ELSE epoch_us(date_trunc('second', ts) - CASE page_id % 5 WHEN 2 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END) END AS us FROM pages JOIN events ON event_id = page_id""")
def page_published(spark, sf_dir):
    """The pages with times of events in their heads, in the ways that pages say so."""
    at = lambda before, zone, after: F.concat(F.lit(before), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone + after))
    head = [
        F.lit('<meta property="og:published_time" content="soon">'),
        at('<meta property="article:published_time" content="', "Z", '"><time datetime="2020-01-01T00:00:00Z">'),
        at('<script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "', "+02:00", '"}</script>'),
        at('<time datetime="', "", '">'),
        at('<meta name="pubdate" content="never"><script type="application/ld+json">{"dateCreated": "', "Z", '"}</script>'),
    ]
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), F.col("ts").cast("timestamp").alias("at"))
    pages = read(spark, sf_dir, "pages").join(times, "page_id").withColumn("html", F.concat(F.element_at(F.array(*head), ((F.col("page_id") % 5) + 1).cast("int")), "html"))
    return pages.select("page_id", F.coalesce(F.unix_micros(P.published_time(F.col("html"))), F.lit(-1)).alias("us"))


@query(f"WITH {_RECORDS} SELECT id, user_id, game_status FROM r WHERE team = 'T3' AND 'Player ' || user_id || ' Jr.' ILIKE '%LAYER _3%' ORDER BY knowledge_time DESC, id LIMIT 500")
def player_records(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("player_name", F.concat(F.lit("Player "), F.col("user_id").cast("string"), F.lit(" Jr.")))
    return records.record_query(rows, "t3", limit=500, player=" LAYER _3 ").select("id", "user_id", "game_status")


@query("""
SELECT '7' AS name, event_id AS document_id, epoch_us(ts) AS known_us, event_type AS text_hash, repeat(props, 40)[:400] || CASE WHEN length(repeat(props, 40)) > 400 THEN '...' ELSE '' END AS preview
FROM events WHERE user_id = 7 AND ts <= TIMESTAMP '2024-01-15 10:00:00' ORDER BY ts DESC, event_id DESC LIMIT 1""")
def asof_lookup(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.repeat("props", F.lit(40))
    docs = e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("document_id"), F.col("ts").cast("timestamp").alias("knowledge_time"), F.col("event_type").alias("text_hash"), text.alias("text"), F.lit(None).cast("string").alias("raw_ref"))
    sources = e.select(F.col("user_id").alias("source_id"), F.col("user_id").cast("string").alias("name")).distinct()
    found = bitemporal.lookup(docs, sources, "7", "2024-01-15T12:00:00+02:00")
    return found.select("name", "document_id", F.unix_micros("knowledge_time").alias("known_us"), "text_hash", "preview")


@query("""
SELECT 'nightly' AS job_name, epoch_us(TIMESTAMP '2024-01-31 00:00:00') AS started_us, true AS ok, count(*) AS attempted, count(*) FILTER (lang = 'de') AS failed, CAST(sum(n_chars) AS BIGINT) AS created FROM documents""")
def job_run(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select((F.col("lang") == "de").alias("failed"), F.col("n_chars").alias("created"))
    return ops.job_run(d, "nightly", NOW, "2024-01-31 00:10:00").select("job_name", F.unix_micros("started_at").alias("started_us"), "ok", "attempted", "failed", "created")


@query("""
WITH o AS (SELECT CAST(doc_id AS VARCHAR) AS name, ['FAIL', '304', 'EMPTY', 'SAME', 'NEW'][doc_id % 5 + 1] AS outcome, lang AS detail, CASE WHEN doc_id % 5 = 4 THEN 1 ELSE 0 END AS created FROM documents)
SELECT rpad(outcome, 7, ' ') || name || ': ' || CASE outcome WHEN '304' THEN 'unchanged' WHEN 'SAME' THEN 'identical content, no new row' ELSE coalesce(detail, '') END AS line FROM o
UNION ALL SELECT '-- attempted ' || count(*) || ', failed ' || count(*) FILTER (outcome IN ('FAIL', 'EMPTY')) || ', created ' || CAST(sum(created) AS BIGINT) FROM o""")
def status_lines(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("FAIL", "304", "EMPTY", "SAME", "NEW")))
    d = read(spark, sf_dir, "documents")
    return ops.status_lines(d.select(F.col("doc_id").cast("string").alias("name"), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("outcome"), F.col("lang").alias("detail"), F.when(F.col("doc_id") % 5 == 4, 1).otherwise(0).alias("created")))


@query(f"""WITH {_LEXICAL}, {_DENSE.format(where="vec_id IN (SELECT item_id FROM benchmark)")}, {_FUSED},
h AS (SELECT 'lexical' AS mode, question_id, chunk_id, rank FROM lexical WHERE rank <= 10 UNION ALL SELECT 'dense', question_id, chunk_id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT 'hybrid', question_id, chunk_id, rank FROM hybrid),
r AS (SELECT m.mode, b.item_id AS question_id, min(CASE WHEN contains(lower(d.text), lower(b.text)) THEN h.rank END) AS first FROM benchmark b CROSS JOIN (VALUES ('lexical'), ('dense'), ('hybrid')) m(mode)
  LEFT JOIN h ON h.mode = m.mode AND h.question_id = b.item_id LEFT JOIN documents d ON d.doc_id = h.chunk_id GROUP BY 1, 2)
SELECT mode, count(*) AS n, avg(CASE WHEN first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) AS hit_rate, avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_1, avg(CASE WHEN first <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_3,
  avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_5, avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr FROM r GROUP BY 1""")
def mode_comparison(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    embed = lambda q: q.join(e.select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("vector")), "question_id").select("question_id", "vector")
    q, texts = _questions(spark, sf_dir), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    lists = {"lexical": search.lexical(_index(spark, sf_dir), q), "dense": search.dense(e, embed(q))}
    ranked = {mode: found.where("rank <= 10") for mode, found in lists.items()} | {"hybrid": search.fuse(lists)}
    metrics, _ = evaluate.by_mode({m: search.with_text(r, texts, q, 10) for m, r in ranked.items()}, q.select("question_id", F.array("question").alias("must_contain")))
    return metrics.withColumn("mrr", F.round("mrr", 9))


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract(text, '^([A-Z][a-z]+) ', 1) AS name FROM documents)
SELECT doc_id AS chunk_id, CASE WHEN name = '' THEN 'failed' WHEN length(name) % 5 = 0 THEN 'not JSON' ELSE 'done' END AS state, CAST(CASE WHEN name <> '' AND length(name) % 5 <> 0 AND length(name) > 3 THEN 1 ELSE 0 END AS BIGINT) AS records FROM w""")
def extraction_states(spark, sf_dir):
    """An extractor by rules over whole texts: one that finds no name fails, and one that answers in prose costs its chunk only."""
    c = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")

    def extract(prompt):
        found = re.match(r"\n([A-Z][a-z]+) ", prompt)
        if not found:
            raise ValueError("no name")
        name = found[1]
        if len(name) % 5 == 0:
            return f"I found {name}."
        return json.dumps({"records": [{"player_name": name, "injury": "knee"}] if len(name) > 3 else []})

    valid, done, failed = records.extraction_pass(records.extracted(c, extract), c, ("SEA",))
    n = valid.groupBy("chunk_id").agg(F.count("*").alias("records"))
    states = done.select("chunk_id", F.lit("done").alias("state")).unionByName(failed.select("chunk_id", F.when(F.col("error") == "not JSON", "not JSON").otherwise("failed").alias("state")))
    return states.join(n, "chunk_id", "left").fillna(0, ["records"])
