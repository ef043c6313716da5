"""Postings as lists: a row for each text, whatever the number of its terms; odd texts; more words than are sent."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pointintime.operators import scored, search

ODD = [None, "", "?", "knee", "Knee KNEES", "Knee İnjury injured", "a b c", "knee" + "é" + "injury", "injury " * 700, "x " * 17_000 + "knee injury knee", "reports of 12 knees, injuries 12", "é", "knees"]
ASKED = [(1, "injury knee"), (2, "report 12"), (3, "of the"), (4, "injuries, reports and knees")]


def _frames(spark):
    rows = [*enumerate(ODD), (3, "injury"), (None, "knee injury"), (None, "report")]
    return spark.createDataFrame(rows, "chunk_id long, text string").coalesce(2), spark.createDataFrame(ASKED, "question_id int, question string")


def test_a_text_is_a_row_until_it_is_scored(spark):
    """What is dealt and sorted by chunk grows with texts: before, each term of each text was a row of its own."""
    chunks = spark.range(500).selectExpr("id AS chunk_id", "'alpha beta gamma alpha' AS text").coalesce(2)
    ask = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma")], "question_id int, question string")
    sent = spark.sparkContext.broadcast(scored.Questions(ask.selectExpr("question_id", "split(question, ' ') AS terms").collect()))
    for index in (search.counts(chunks, ask), search.counts(chunks), search.postings(chunks, ask).coalesce(1).sortWithinPartitions("chunk_id")):
        assert scored._packed(index, sent, "term", ["tf"]).count() == 500
    assert search.positions(chunks, ask).count() == 500
    assert "Exchange" not in search.positions(chunks, ask)._jdf.queryExecution().toString()


@pytest.mark.parametrize("piece", [1 << 20, 20])
def test_words_are_those_of_the_pattern(piece, monkeypatch):
    monkeypatch.setattr(search, "PIECE_BYTES", piece)
    texts = [None if t is None else t.lower() for t in ODD]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["chunk_id", "text"])
    for at in (0, 3):
        got = []
        for _, some in search._pieces([batch.slice(at)]):
            words, length, n = search._words(some)
            assert [len(w) for w in words.to_pylist()] == length.tolist()
            ends = n.cumsum()
            got += [words.to_pylist()[e - k : e] for k, e in zip(n, ends, strict=True)]
        assert got == [re.findall("[a-z0-9]+", t or "") for t in texts[at:]]


def test_counts_of_odd_texts(spark):
    chunks, ask = _frames(spark)
    lower = {r.text: r.low for r in chunks.selectExpr("text", "lower(text) AS low").collect()}
    want = Counter()
    for r in chunks.collect():
        for w in re.findall("[a-z0-9]+", lower[r.text] or ""):
            want[w, r.chunk_id] += len(w) > 1
    assert {(r.term, r.chunk_id): r.tf for r in search.postings(chunks).collect()} == +want


@pytest.mark.parametrize("sent", [20_000, 2])
def test_more_words_than_are_sent(spark, sent, monkeypatch):
    """Sent or joined, lists or rows of one posting: the same hits."""
    chunks, ask = _frames(spark)
    hits = lambda found: sorted(map(repr, found.collect()))
    plain, english = hits(search.lexical(search.postings(chunks), ask, 9)), [hits(search.ranked(search.positions(chunks), ask, 9, n, c)) for n, c in ((None, 0.0), ("log", 0.5))]
    monkeypatch.setattr(search, "SENT_TERMS", sent)
    assert plain and all(english)
    assert hits(search.lexical(search.counts(chunks, ask), ask, 9)) == hits(search.lexical(search.postings(chunks, ask), ask, 9)) == plain
    assert [hits(search.ranked(search.positions(chunks, ask), ask, 9, n, c)) for n, c in ((None, 0.0), ("log", 0.5))] == english


def test_places_count_up_to_the_last(spark):
    """255 places of a stem count, those beyond the last place that is told apart are one."""
    chunks, ask = _frames(spark)
    got = {r.chunk_id: r.score for r in search.ranked(search.positions(chunks, ask), ask.where("question_id = 1"), 20).collect()}
    weigh = lambda n: sum(1 / k**2 for k in range(1, n + 1)) * 0.1 / 1.64493406685 / 2
    assert got[8] == pytest.approx(weigh(255), abs=1e-9) and got[9] == pytest.approx(2 * weigh(1), abs=1e-9)
    assert got[3] == pytest.approx(2 * weigh(1), abs=1e-9)  # two rows of one chunk
    assert got[4] == pytest.approx(weigh(2), abs=1e-9) and got[None] == pytest.approx(2 * weigh(1), abs=1e-9)


@pytest.mark.parametrize("base", [256, 2])
def test_a_count_is_sorted_with_its_number(spark, base, monkeypatch):
    """What is sorted by chunk is one integer a posting: before, a number and a count of eight bytes. Large counts are several integers, which add up."""
    monkeypatch.setattr(scored, "ONE_COUNT", base)
    chunks = spark.createDataFrame([(1, "alpha " * 700 + "beta"), (2, "beta " * 512), (None, "alpha"), (1, "alpha gamma"), (3, "delta")], "chunk_id long, text string").coalesce(1)
    ask = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma")], "question_id int, question string")
    sent = spark.sparkContext.broadcast(scored.Questions(ask.selectExpr("question_id", "split(question, ' ') AS terms").collect()))
    want = Counter({(1, "alpha"): 701, (1, "beta"): 1, (2, "beta"): 512, (None, "alpha"): 1, (1, "gamma"): 1})
    for index in (search.counts(chunks, ask), search.counts(chunks), search.postings(chunks, ask)):
        packed = scored._packed(index, sent, "term", ["tf"], True)
        assert packed.dtypes == [("number", "array<int>"), ("chunk_id", "bigint")]
        rows = packed.collect()
        batch = pa.RecordBatch.from_arrays([pa.array([r.number for r in rows], pa.list_(pa.int32())), pa.array([r.chunk_id for r in rows])], names=["number", "chunk_id"])
        got = Counter()
        for b in scored._counted(scored._postings([batch]), sent.value.base):
            for number, chunk, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                assert 1 <= count <= base
                got[chunk, sent.value.terms[number]] += count
        assert got == want
        hits = {(r.question_id, r.chunk_id): r.score for r in search.lexical(index, ask, 9).collect()}
        assert hits == pytest.approx({(1, 1): 701 / 702 + 1, (1, 2): 512 / 513, (1, None): 0.5, (2, 1): 0.5}, abs=1e-6)
        assert {r.question_id: (r.any_term, r.all_terms) for r in search.matched(index, ask).collect()} == {1: (3, 1), 2: (1, 1)}


def test_a_number_and_a_count_stay_below_the_largest_integer():
    """Few terms or many: the largest code of the last term is still an int."""
    for terms in (1, 1 << 23, 1 << 27, (1 << 31) - 1):
        base = min(scored.ONE_COUNT, (2**31 - 1) // terms)
        code, times = scored._coded(np.array([terms - 1], np.int32), np.array([base + 1]), base)
        assert code.dtype == np.int32 and (code >= 0).all() and times.tolist() == [2]
        assert (code // base).tolist() == [terms - 1] * 2 and (code % base + 1).sum() == base + 1


@pytest.mark.parametrize("most", [100_000, 10])
def test_texts_stay_where_they_are(spark, most, monkeypatch, tmp_path):
    """Hits are sent to the texts up to a number: before, all texts were dealt and sorted to meet a few hits. The rows are the same."""
    monkeypatch.setattr(search, "SENT_HITS", most)
    chunks, ask = _frames(spark)
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    hits = search.lexical(search.counts(chunks, ask), ask, 5)
    got = search.with_text(hits, chunks, ask, 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (most > 20)
    want = sorted(repr((r.question_id, r.chunk_id, r["rank"], c.text)) for r in hits.collect() for c in chunks.collect() if c.chunk_id == r.chunk_id and c.chunk_id is not None)
    assert want and sorted(repr((r.question_id, r.chunk_id, r["rank"], r.text)) for r in got.collect()) == want
