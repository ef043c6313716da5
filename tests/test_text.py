from pyspark.sql import functions as F

from pointintime.functions import text as X
from pointintime.operators import chunks, report
from pointintime.plans.queries import grounding_overlap


def values(spark, rows, fn, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}").orderBy("i").select(fn(F.col("v"))).collect()]


def test_fingerprint_ignores_reflow(spark):
    a, b, c = values(spark, ["one  two\nthree ", "one two three", "one two four"], X.text_fingerprint)
    assert a == b != c


def test_headings(spark):
    assert values(spark, ["Thursday's Injury Report", "WEDNESDAY Practice Report", "Thursday’s Injury Report:", "Friday notes"], X.day_heading) == ["Thursday", "Wednesday", "Thursday", None]
    lines = ["Eagles Injury Report", "Week 17 Injury Report (Browns)", "49ers Practice Report", "Bears Game Status Report", "Eagles at Commanders Injury Report", "Eagles win", "Browns " * 20 + "Injury Report"]
    assert values(spark, lines, X.team_heading) == ["Eagles", "Browns", "49ers", "Bears", None, None, None]


def test_player_lines(spark):
    got = values(spark, ["DT Jo O'Dell (Shoulder/DNP)", "G/T Al Bee III (Knee)", "plain words", "dt low case (x)"], X.player_line)
    assert [g and tuple(g) for g in got] == [("DT", "Jo O'Dell", "Shoulder/DNP"), ("G/T", "Al Bee III", "Knee"), None, None]
    got = values(spark, ["Foot/Did Not Participate", "Calf/Rest", "LP", "", "A/FP/DNP"], X.split_detail)
    assert [tuple(g) for g in got] == [("Foot", "DNP"), ("Calf/Rest", None), (None, "LIMITED"), (None, None), ("A/DNP", "FULL")]


def test_dates_and_urls(spark):
    assert [str(v) for v in values(spark, ["Dec 18, 2025 at 04:15 PM", "Feb 31, 2025", "nothing"], X.parse_display_date)] == ["2025-12-18 16:15:00", "None", "None"]
    assert values(spark, ["https://a.b/c/d-e/?q=1", "https://a.b/x"], X.slug) == ["d-e", "x"]
    assert values(spark, [None, "", " 1.2.3.4, 5.6", "9.9"], lambda c: X.client_key(c, F.lit(None).cast("string"))) == ["unknown", "unknown", "1.2.3.4", "9.9"]


def test_table_rows(spark):
    rows = [["Player", "Pos", "Injury", "Wed"], ["K. Lamb", "WR", "Ankle", "LP"], [" ", "", "", ""], ["J. Ash", "TE", "", "DNP"]]
    docs = spark.createDataFrame([(1, "injury_report", [(0, rows), (1, [["A. Bo", "QB", "FULL"]])])], "document_id long, doc_type string, tables array<struct<index:int,rows:array<array<string>>>>")
    got = [(r.ordinal, r.text, r.section_path) for r in chunks.table_chunks(docs).orderBy("ordinal").collect()]
    assert got == [
        (0, "Player: K. Lamb | Pos: WR | Injury: Ankle | Wed: LP", "injury_report > table 0 > row 0"),
        (1, "Player: J. Ash | Pos: TE | Wed: DNP", "injury_report > table 0 > row 2"),
        (2, "A. Bo | QB | FULL", "injury_report > table 1 > row 0"),
    ]


def test_windows_against_a_loop(spark):
    def spans(text):
        at, out = 0, []
        while at < len(text):
            end = min(at + 1200, len(text))
            if end < len(text):
                for sep in ("\n\n", "\n", ". "):
                    if (k := text.rfind(sep, at + 600, end)) >= 0:
                        end = k + len(sep)
                        break
            out.append((at, end))
            if end >= len(text):
                break
            at = max(end - 200, at + 1)
        return out

    texts = ["", "short", "word " * 5000, "\n\n".join("ä" * 290 + ". b" for _ in range(15)), "\n".join("x" * 700 for _ in range(9)), "y" * 5000]
    got = values(spark, texts, chunks.window_spans)
    assert [[tuple(w) for w in g] for g in got] == [spans(t) for t in texts]


def test_documents_fall_back_to_windows(spark):
    docs = spark.createDataFrame([(1, "injury_report", "some prose", []), (2, "article", "more prose", [(0, [["a", "b"], ["c", "FULL"]])])], "document_id long, doc_type string, text string, tables array<struct<index:int,rows:array<array<string>>>>")
    got = {(r.document_id, r.text) for r in chunks.chunk_documents(docs).collect()}
    assert got == {(1, "some prose"), (2, "more prose")}


def test_report_state(spark):
    lines = ["Monday Injury Report", "Bears Injury Report", "Out", "TE Cal Roe", "Lions Injury Report", "TE Cal Roe", "QB Eve Gee (Knee/LP)"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "document_id int, text string")
    got = [(r.team, r.day, r.player, r.participation, r.game_status) for r in report.report_rows(docs).orderBy("line_no").collect()]
    assert got == [("Bears", "Monday", "Cal Roe", None, "OUT"), ("Lions", "Monday", "Eve Gee", "LIMITED", None)]
    tables = report.report_tables(docs).collect()[0].tables
    assert tables[0].rows[0][0] == "Team" and len(tables[0].rows) == 3


def test_grounding_looks_at_whole_turns(spark, tmp_path):
    rows = [("a", 0, "We met our goalkeeper"), ("a", 1, "It was raining again, and nobody could say who the goalkeeper was"), ("a", 2, "Hello")]
    spark.createDataFrame(rows, "conv_id string, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = grounding_overlap(spark, str(tmp_path)).collect()
    assert {(r.turn, r.grounded) for r in got} == {(1, True), (2, False)}
