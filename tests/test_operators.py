import datetime as dt

import pytest
from pyspark.sql import functions as F

from pointintime.operators import bitemporal, evaluate, ops, records, search
from pointintime.sources import pages, seeds
from pointintime.streaming import incremental

T0 = dt.datetime(2024, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_append_if_changed(spark):
    schema = "source_id int, id long, knowledge_time timestamp, text_hash string"
    seen = spark.createDataFrame([(1, i, at(i), h) for i, h in enumerate("AABBAA")] + [(2, 9, at(1), "A")], schema)
    assert sorted(r.id for r in bitemporal.changes(seen).collect()) == [0, 2, 4, 9]
    batch = spark.createDataFrame([(1, 10, at(10), "A"), (1, 11, at(11), "C"), (3, 12, at(1), "Z")], schema)
    assert sorted(r.id for r in bitemporal.append_changed(seen, batch).collect()) == [11, 12]


def test_as_of_is_inclusive_and_ties_go_to_the_larger_id(spark):
    rows = spark.createDataFrame([(1, 1, at(1)), (1, 2, at(1)), (1, 3, at(2))], "source_id int, id long, knowledge_time timestamp")
    assert bitemporal.latest(rows, when=at(1)).collect()[0].id == 2
    assert [r.id for r in bitemporal.as_of(rows, at(2), since=at(1)).collect()] == [3]


@pytest.mark.parametrize(("age", "state"), [([0.5], "complete"), ([1.5], "complete"), ([2.5], "unknown"), ([0.5, 2.5], "partial"), ([None, 0.1], "partial"), ([], "unknown")])
def test_knowledge_state(spark, age, state):
    rows = [("PHI", True, 3600, None if a is None else at(-a)) for a in age]
    sources = spark.createDataFrame(rows, "team string, enabled boolean, cadence_seconds int, last_success_at timestamp")
    teams = spark.createDataFrame([("PHI",)], "team string")
    got = bitemporal.knowledge_state(sources, teams, F.lit(T0)).collect()[0]
    assert got.knowledge == state and got.sources == len(age)
    if age:
        assert bitemporal.knowledge_state(sources, teams, F.lit(T0), historical=True).collect()[0].knowledge == "as_of_historical"


def test_fusion_prefers_agreement_and_limits_after(spark):
    one = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "question_id int, chunk_id int, rank int")
    two = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "question_id int, chunk_id int, rank int")
    got = search.fuse({"lexical": one, "dense": two}, limit=2).orderBy("rank").collect()
    assert [(r.chunk_id, r.found_by) for r in got] == [(8, "both"), (7, "lexical")]
    assert abs(got[0].score - (1 / 61 + 1 / 62)) < 1e-8 and set(got[0].contributions) == {"lexical", "dense"}


def test_any_term_matches_and_as_of_hides(spark):
    docs = spark.createDataFrame([(1, at(1)), (2, at(5))], "document_id int, knowledge_time timestamp")
    chunks = spark.createDataFrame([(1, 1, "alpha beta"), (2, 1, "beta"), (3, 2, "alpha beta gamma")], "chunk_id int, document_id int, text string")
    ask = spark.createDataFrame([(1, "alpha beta gamma zeta"), (2, "? !")], "question_id int, question string")
    full = search.lexical(search.postings(search.corpus(chunks, docs)), ask)
    assert [r.chunk_id for r in full.orderBy("rank").collect()] == [3, 1, 2]
    early = search.lexical(search.postings(search.corpus(chunks, docs, at(2))), ask)
    assert [r.chunk_id for r in early.orderBy("rank").collect()] == [1, 2]
    hits = full.join(chunks, "chunk_id")
    gold = spark.createDataFrame([(1, ["GAMMA"]), (2, ["x"]), (3, [])], "question_id int, must_contain array<string>")
    found = evaluate.positions(hits, gold)
    assert {r.question_id: r.first_position for r in found.collect()} == {1: 1, 2: None, 3: None}
    assert abs(evaluate.report(found).collect()[0].mrr - 1 / 3) < 1e-9


def test_without_an_embedder_search_is_lexical(spark):
    chunks = spark.createDataFrame([(1, "alpha")], "chunk_id int, text string")
    ask = spark.createDataFrame([(1, "alpha")], "question_id int, question string")
    assert search.hybrid(chunks, search.postings(chunks), ask, None).collect()[0].mode_used == "lexical"
    with pytest.raises(ValueError):
        search.hybrid(chunks, search.postings(chunks), ask, None, limit=99)


def test_records_are_stored_once_and_inherit_times(spark):
    draft = "chunk_id int, position_in_response int, player_name string, team string, position string, injury string, practice_status string, game_status string, report_day string, evidence string"
    valid = spark.createDataFrame([(1, 0, "A", None, "WR", None, None, None, "WED", None), (1, 1, "A", None, "TE", None, None, None, "THU", None), (1, 2, "B", "DAL", "QB", None, None, None, None, None)], draft)
    chunks = spark.createDataFrame([(1, 5)], "chunk_id int, document_id int")
    docs = spark.createDataFrame([(5, "PHI", at(3), None)], "document_id int, team string, knowledge_time timestamp, published_time timestamp")
    none = spark.createDataFrame([], "chunk_id int, player_name string, extractor_version string, report_day string")
    rows = {r.player_name: r for r in records.persist(valid, chunks, docs, none).collect()}
    assert rows["A"].position == "WR" and rows["A"].team == "PHI" and rows["B"].team == "DAL" and rows["A"].knowledge_time == at(3)
    assert records.persist(valid, chunks, docs, none, per_day=True).count() == 3
    done = spark.createDataFrame([(1, "A", "v2", "WED")], none.schema)
    assert [r.player_name for r in records.persist(valid, chunks, docs, done).collect()] == ["B"]


def test_broken_responses_stay_pending(spark):
    raw = spark.createDataFrame([(1, "not json"), (2, '{"records": []}')], "id int, response string")
    assert [r.id for r in records.parse_failures(raw).collect()] == [1]


def test_limiter_opens_windows_at_the_first_request(spark):
    hits = [("a", T0 + dt.timedelta(seconds=s)) for s in [*range(31), 61, 62]] + [("b", T0)]
    got = ops.rate_limited(spark.createDataFrame(hits, "caller string, ts timestamp")).collect()
    assert [r.ts.second for r in got if r.rejected] == [30] and {r.n for r in got if r.caller == "a" and r.ts >= T0 + dt.timedelta(seconds=61)} == {1, 2}


def test_links_and_dates_of_pages(spark):
    html = """<a href="/news/a-injury-report">Eagles Injury ReportDec 1</a><a href="/news/a-injury-report#top">Injury report again</a><a href="/video/x">Injury report</a>
    <a href="https://other.com/i">Injury report</a><a href="#x">Injury report</a><a href="/n/b">Roster moves</a><a href="/n/c">Feature</a>
    <meta property="article:published_time" content="2025-12-18T10:00:00Z"><table><tr><th>A</th><th>B</th></tr><tr><td> </td></tr><tr><td>1</td><td>2 &amp; 3</td></tr></table>"""
    page = spark.createDataFrame([(1, "https://club.com/index", html)], "page_id int, url string, html string")
    links = pages.discovered_links(page).orderBy("pos").collect()
    assert [r.link for r in links] == ["https://club.com/news/a-injury-report", "https://club.com/n/b"]
    row = page.select(pages.published_time(F.col("html")).alias("t"), pages.html_tables(F.col("html")).alias("tables")).collect()[0]
    assert row.t == dt.datetime(2025, 12, 18, 10) and row.tables[0].rows == [["A", "B"], ["1", "2 & 3"]]


def test_seeds(spark):
    rows = seeds.seeds(spark)
    assert rows.count() == 62
    old = spark.createDataFrame([("phi-transactions", "transactions", None, True, None), ("old", "injury_report", "https://x/team/injury-report/", True, None)], "name string, kind string, url string, enabled boolean, last_error string")
    got = {r.name: r.enabled for r in seeds.upserted(old, rows).collect()}
    assert len(got) == 63 and not got["old"] and got["phi-transactions"]


def test_a_stream_run_twice_adds_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "id int, text string")
    rows.write.parquet(src)
    for k in (1, 2):
        stream = spark.readStream.schema(rows.schema).parquet(src)
        incremental.run_available(stream, lambda b: b, out, str(tmp_path / f"check{k}"), ["id"]).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_embeddings_are_kept_by_version(spark):
    from pointintime.operators import embed

    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, "gamma")], "chunk_id int, text string")
    old = spark.createDataFrame([(1, "v1"), (2, "v0")], "chunk_id int, embedding_version string")
    rows = {r.chunk_id: r for r in embed.embed_pending(chunks, old, "v1", "hash", embed.hashing_embedder(16), F.lit(T0)).collect()}
    assert set(rows) == {2, 3} and len(rows[2].embedding) == 16 and sum(map(abs, rows[2].embedding)) == 2
    nearest = search.dense(chunks.withColumn("embedding", embed.hashing_embedder(16)(F.col("text"))), spark.createDataFrame([(9, "beta alpha")], "question_id int, text string").select("question_id", embed.hashing_embedder(16)(F.col("text")).alias("vector")))
    assert [r.chunk_id for r in nearest.orderBy("rank").collect()][:2] == [1, 2]


INDEX = """<html><body><a href="/news/a-injury-report">Hawks at Owls Injury Report</a> <a href='/news/b-inactives#top'>Owls Inactives</a> <a href="/news/a-injury-report">Again the Injury Reports</a>
<a href="/video/c">Video of the injury report</a> <a href="/photos/d">Photos: practice report</a> <a href="/news/e">6 things</a> <a href="https://other.example/f">Game Status</a> <a href="#x">Injury report</a>
<a href="/news/g" title="Roster moves"><img src=x></a></body></html>"""


def test_links_of_reports(spark):
    rows = spark.createDataFrame([(1, "https://club.example/team/injury-report/", INDEX)], "page_id long, url string, html string")
    got = [(r.link, r.title) for r in pages.discovered_links(rows).orderBy("pos").collect()]
    host = "https://club.example/news/"
    assert got == [(host + "a-injury-report", "Hawks at Owls Injury Report"), (host + "b-inactives", "Owls Inactives"), (host + "g", "Roster moves")]


def test_page_text_and_its_fallback(spark):
    html = "<head><title>t</title></head><nav>menu</nav><article><h1>A &amp; B</h1><p>first <b>line</b><br>second<script>x()</script></article><table><tr><td>c<td>d</tr></table><footer>end</footer>"
    rows = spark.createDataFrame([(1, html), (2, "<nav>only a menu</nav>"), (3, None), (4, "")], "id int, html string")
    got = {r.id: r for r in pages.parsed_pages(rows).collect()}
    assert got[1].text == "A & B\nfirst line\nsecond\ncd" and got[1].warning is None and got[1].tables[0].rows == [["c", "d"]]
    assert got[2].text == "only a menu" and got[2].warning and got[3].text == got[4].text == ""


def test_lookup_by_name(spark):
    docs = spark.createDataFrame([(1, 5, at(1), "h", "r", "x" * 500), (1, 6, at(3), "i", "s", "short")], "source_id int, document_id int, knowledge_time timestamp, text_hash string, raw_ref string, text string")
    names = spark.createDataFrame([(1, "one"), (2, "two")], "source_id int, name string")
    first = bitemporal.lookup(docs, names, "one", "2024-01-01T01:00:00Z").collect()
    assert len(first) == 1 and first[0].document_id == 5 and first[0].preview == "x" * 400 + "..."
    assert bitemporal.lookup(docs, names, "one", "2024-01-01 05:00:00").collect()[0].preview == "short"
    assert bitemporal.lookup(docs, names, "two", "2024-01-01T01:00:00Z").collect()[0].document_id is None and not bitemporal.lookup(docs, names, "none", at(9)).collect()
    assert bitemporal.parse_as_of(None) is None and bitemporal.parse_as_of("2024-01-01T02:00:00+02:00") == bitemporal.parse_as_of("2024-01-01")
    with pytest.raises(ValueError, match="instant"):
        bitemporal.parse_as_of("soon")


def test_one_bad_chunk_costs_one_chunk(spark):
    chunks = spark.createDataFrame([(1, "Roe out", "SEA"), (2, "bad", None), (3, "odd", None)], "chunk_id int, text string, team string")

    def extract(prompt):
        if "bad" in prompt:
            raise RuntimeError("boom")
        return "no" if "odd" in prompt else '[{"player_name": "Roe", "game_status": "OUT"}]' if prompt.startswith("Team: SEA") else "[]"

    valid, done, failed = records.extraction_pass(records.extracted(chunks, extract), chunks, ("SEA",))
    assert [(r.chunk_id, r.player_name) for r in valid.collect()] == [(1, "Roe")] and [r.chunk_id for r in done.collect()] == [1]
    assert {r.chunk_id: r.error for r in failed.collect()} == {2: "RuntimeError('boom')", 3: "not JSON"}
    assert records.extracted(chunks, None).count() == 0


def test_runs_sources_and_flags(spark):
    none = spark.createDataFrame([], "name string, outcome string, detail string, created int, failed boolean")
    assert [r.line for r in ops.status_lines(none).collect()] == ["nothing due"]
    run = ops.job_run(none, "job", T0, at(1), "boom").collect()[0]
    assert (run.ok, run.error, run.attempted, run.failed, run.created) == (False, "boom", 0, 0, 0)
    have = spark.createDataFrame([(1, "a")], "source_id int, name string")
    new = seeds.added(have, spark.createDataFrame([("a",), ("b",), ("b",)], "name string")).collect()
    assert [(r.name, r.enabled) for r in new] == [("b", True)] and seeds.named(have, "a").count() == 1 and seeds.named(have, "z").count() == 0
    flags = spark.createDataFrame([(304, None), (200, "x"), (200, None), (500, "x"), (None, None)], "status int, content string").select(*bitemporal.fetch_flags(F.col("status"), F.col("content"))).collect()
    assert [tuple(f) for f in flags] == [(True, False), (False, True), (False, False), (False, False), (False, False)]


def test_modes_over_one_gold_set(spark):
    gold = spark.createDataFrame([(1, ["x"]), (2, ["y"])], "question_id int, must_contain array<string>")
    a = spark.createDataFrame([(1, 1, "an x"), (2, 1, "z"), (2, 2, "y")], "question_id int, rank int, text string")
    metrics, missed = evaluate.by_mode({"lexical": a, "dense": a.where("question_id = 1")}, gold)
    got = {r["mode"]: (r.n, r.hit_at_1, r.hit_at_3, r.mrr) for r in metrics.collect()}
    assert got == {"lexical": (2, 0.5, 1.0, 0.75), "dense": (2, 0.5, 0.5, 0.5)} and [tuple(r) for r in missed.collect()] == [("dense", 2)]


def test_limited_stream(spark, tmp_path):
    for k, seconds in enumerate(([0, 10, 20, 50], [30, 70, 200], [140])):
        rows = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=x)) for x in seconds] + [("b", T0)], "caller string, ts timestamp")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        done = incremental.limited(stream, 60, 3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        done.awaitTermination(60)
    got = {((r.ts - T0).total_seconds(), r.caller): r.rejected for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[x, "a"] for x in (0, 10, 20, 50)] == [False, False, False, True] and got[70, "a"] is False and got[0, "b"] is False


def test_late_rows_and_reports_of_runs(spark):
    docs = spark.createDataFrame([(1, at(1), at(2)), (2, at(3), at(3)), (3, None, at(3))], "id int, published_time timestamp, knowledge_time timestamp")
    assert [r.id for r in incremental.late(docs).collect()] == [1]
    runs = spark.createDataFrame([(1, at(1), at(2), True), (2, at(5), at(5), False)], "id int, started_at timestamp, finished_at timestamp, ok boolean")
    assert [(r.id, r.duration_seconds) for r in ops.recent_runs(runs, 1).collect()] == [(2, 0.0)]
    sources = spark.createDataFrame([(True, 3600, at(0))], "enabled boolean, cadence_seconds int, last_success_at timestamp")
    got = [ops.health(sources, runs.where(f"id <= {k}"), F.lit(at(1)), bitemporal.is_stale).collect()[0] for k in (0, 1, 2)]
    assert [(g.ok, g.fresh, g.last_ok) for g in got] == [(True, True, True), (True, True, True), (False, True, False)]
