"""Readers, landed responses, dispatch by kind, samples, limits; the shapes of drafts, responses and reports that parsers meet."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pointintime.functions import text as X
from pointintime.operators import records, report
from pointintime.sources import files, pages
from pointintime.sources.responses import LandedResponses


def test_files_and_gold_sets(spark, tmp_path):
    (tmp_path / "raw" / "a").mkdir(parents=True)
    (tmp_path / "raw" / "a" / "x.html").write_bytes(b"<p>one\ntwo</p>")
    (tmp_path / "raw" / "y.bin").write_bytes(b"\x00\xff")
    raw = {r.path.rsplit("/", 1)[1]: r for r in files.raw_files(spark, str(tmp_path / "raw")).collect()}
    assert set(raw) == {"x.html", "y.bin"} and bytes(raw["y.bin"].content) == b"\x00\xff"
    assert raw["x.html"].content_hash == hashlib.sha256(b"<p>one\ntwo</p>").hexdigest()
    assert [r.text for r in files.whole_texts(spark, str(tmp_path / "raw" / "a")).collect()] == ["<p>one\ntwo</p>"]
    (tmp_path / "gold.json").write_text(json.dumps({"questions": [{"id": "q1", "question": "Who?", "must_contain": ["a", "b"]}, {"id": "q2", "question": "What?", "must_contain": []}]}, indent=1))
    assert [tuple(r) for r in files.gold_set(spark, str(tmp_path / "gold.json")).collect()] == [("q1", "Who?", ["a", "b"]), ("q2", "What?", [])]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.gold_set(spark, str(tmp_path / "none.json")).collect()


def test_samples(spark):
    rows = spark.range(200).selectExpr("id", "if(id % 2 = 0, 'article', 'report') as doc_type", "concat('Text ', id % 10) as text")
    got = files.sample(rows, 7, doc_type="article", contains="TEXT 4").collect()
    assert len(got) == 7 and all(r.id % 10 == 4 for r in got)
    assert files.sample(rows.where("false"), 5).count() == 0 and files.sample(rows, 500).count() == 200


def test_parsers_by_kind(spark):
    rows = spark.createDataFrame([(1, "text/html", b"<p>One</p>"), (2, None, b"%PDF-1.4"), (3, "application/PDF", b"x"), (4, None, None)], "k int, content_type string, content binary")
    html = lambda df: pages.parsed_pages(df.withColumn("html", F.col("content").cast("string"))).drop("html")
    got = {r.k: r for r in files.parsed(rows, {"html": html}).collect()}
    assert got[1].text == "One" and got[4].text == "" and got[2].text is None and got[2].warning == got[3].warning == "no parser for pdf"
    assert files.parsed(rows, {}).count() == 4


def land(folder, name, *responses):
    folder.mkdir(parents=True, exist_ok=True)
    line = lambda url, status, body: json.dumps({"url": url, "status": status, "etag": f'"{url}"', "fetched_at": "2025-01-02T03:04:05Z", "body": None if body is None else base64.b64encode(body).decode()})
    (folder / f"{name}.jsonl").write_text("\n".join(line(*r) for r in responses))


def test_landed_responses(spark, tmp_path):
    spark.dataSource.register(LandedResponses)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    land(tmp_path / "in" / "day=2025-01-01", "0001", ("a", 200, b"\x00one"), ("b", 304, None))
    land(tmp_path / "in" / "day=2025-01-02", "0001", ("c", 200, b""), ("d", 500, b"no"))
    load = spark.read.format("landed_responses").load
    rows = load(str(tmp_path / "in"))
    assert sorted((r.url, r.status, r.day, None if r.content is None else bytes(r.content)) for r in rows.collect()) == [("a", 200, "2025-01-01", b"\x00one"), ("b", 304, "2025-01-01", None), ("c", 200, "2025-01-02", b""), ("d", 500, "2025-01-02", b"no")]
    assert rows.select(F.unix_timestamp("fetched_at")).first()[0] == 1735787045
    (tmp_path / "in" / "day=2025-01-02" / "0000.jsonl").write_text("broken")
    old = load(str(tmp_path / "in")).where("day <= '2025-01-01' and status = 200")
    assert [r.url for r in old.collect()] == ["a"] and old.rdd.getNumPartitions() == 1  # the broken file's day isn't opened
    with pytest.raises(Exception, match="JSON"):
        load(str(tmp_path / "in")).collect()
    (tmp_path / "in" / "day=2025-01-02" / "0000.jsonl").unlink()
    assert load(str(tmp_path / "nowhere")).count() == 0

    def go():
        stream = spark.readStream.format("landed_responses").option("filesPerBatch", 1).load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        return sorted(r.url for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())

    first = go()
    land(tmp_path / "in" / "day=2025-01-03", "0001", ("e", 200, b"new"))
    assert set(first) <= {"a", "b", "c", "d"} and set(go() + go()) == {"a", "b", "c", "d", "e"} and len(go()) == 5


def test_published_falls_back_to_the_text(spark):
    row = spark.createDataFrame([("<p>x</p>", "Posted Nov 3, 2024"), ('<time datetime="2024-01-01">', "Nov 3, 2024"), ("", "x" * 600 + "Nov 3, 2024")], "html string, text string")
    assert [r[0] for r in row.select(F.date_format(pages.published_time(F.col("html"), F.col("text")), "yyyy-MM-dd")).collect()] == ["2024-11-03", "2024-01-01", None]


def test_drafts_and_responses(spark):
    fields = "player_name string, team string, position string, injury string, practice_status string, game_status string, report_day string, evidence string, chunk_text string"
    drafts = [
        ("Ann Lee", "phi", "wr", " Knee ", "limited", "out", "wed", "x", "WR Ann Lee (Knee)"), ("Bob Poe", "XYZ", "G/T", None, "full", None, "MON", None, "T Bob Poe practised"), ("Cal Roe", "DAL", "quarterback", None, None, None, None, "said", "Cal Roe ran"),
        ("Nobody Here", "DAL", "QB", None, "DNP", None, None, None, "another text"), ("Dee", "DAL", "Q1", "k" * 65, "Limited participation", "Doubtful", "Sunday", None, "Dee was hurt"), ("  ", "DAL", "QB", "arm", None, None, None, None, "QB arm"),
    ]
    got = records.validate(spark.createDataFrame(drafts, fields), ("PHI", "DAL")).drop("chunk_text").collect()
    assert sorted(map(tuple, got)) == [("Ann Lee", "PHI", "WR", "Knee", "LIMITED", "OUT", "WED", "x"), ("Bob Poe", None, "G/T", None, "FULL", None, "MON", None), ("Dee", "DAL", None, None, None, "DOUBTFUL", None, None)]
    said = [
        (1, '{"records": [{"player_name": "Ann Lee", "team": "PHI", "injury": "null", "position": 5}, {"player_name": " "}, 7]}'), (2, '```json\n[{"player_name": "Bob Poe", "practice_status": "FULL", "evidence": " N/A "}]\n```'),
        (3, "not json"), (4, '{"records": [{"player_name": "Cut'), (5, '{"records": []}'), (6, '"text"'),
    ]
    got = records.parse_responses(spark.createDataFrame(said, "id int, response string"), ["id"]).select("id", "player_name", "team", "injury", "position", "practice_status", "evidence")
    assert sorted(map(tuple, got.collect())) == [(1, "Ann Lee", "PHI", None, None, None, None), (2, "Bob Poe", None, None, None, "FULL", None)]


def test_report_article(spark):
    article = """Eagles at Commanders Injury Report
Dec 18, 2025 at 04:15 PM
Tuesday’s Injury Report
Eagles Injury Report
Did Not Participate
DT Ann O'Neil (Shoulder)
G/T Bob Poe III (Calf/Rest)
Questionable
TE Cal Roe
Commanders Injury Report
WR Dee Fox (Knee/Limited Participation)
TE Cal Roe
Wednesday Injury Report
Full Participation
QB Eve Gee (illness)
Note: players listed above took part in a walk-through on the day.
49ers Game Status Report
Out
CB Flo Hay (Ankle)"""
    rows = report.report_rows(spark.createDataFrame([(1, article)], "document_id int, text string")).orderBy("line_no").drop("document_id", "line_no")
    assert [tuple(r) for r in rows.collect()] == [
        ("Eagles", "Tuesday", "DT", "Ann O'Neil", "Shoulder", "DNP", None), ("Eagles", "Tuesday", "G/T", "Bob Poe III", "Calf/Rest", "DNP", None), ("Eagles", "Tuesday", "TE", "Cal Roe", None, None, "QUESTIONABLE"),
        ("Commanders", "Tuesday", "WR", "Dee Fox", "Knee", "LIMITED", None), ("Commanders", "Wednesday", "QB", "Eve Gee", "illness", "FULL", None), ("49ers", "Wednesday", "CB", "Flo Hay", "Ankle", None, "OUT"),
    ]


def test_spellings_and_dates(spark):
    cells = {"Full": "FULL", "fp": "FULL", " Limited Participation ": "LIMITED", "LP.": "LIMITED", "dnp": "DNP", "Did Not Participate!": "DNP", "Out": None, "": None}
    rows = spark.createDataFrame([(v,) for v in cells], "v string").select("v", X.normalise_participation(F.col("v")).alias("n")).collect()
    assert {r.v: r.n for r in rows} == cells
    dates = {"Dec 18, 2025 at 04:15 PM": "2025-12-18 16:15", "Posted Nov 3, 2024": "2024-11-03 00:00", "Jan 1, 2025 at 12:05 AM and Feb 2, 2026": "2025-01-01 00:05", "Feb 31, 2025": None, "no date": None, "Abc 3, 2024": None}
    rows = spark.createDataFrame([(v,) for v in dates], "v string").select("v", F.date_format(X.parse_display_date(F.col("v")), "yyyy-MM-dd HH:mm").alias("d")).collect()
    assert {r.v: r.d for r in rows} == dates
