"""Scores of all chunks for many questions, in tasks that hold and pass on a bounded part."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pointintime.operators import chunks as C
from pointintime.operators import scored, search

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def _texts(n: int) -> list[tuple[int | None, str | None]]:
    draw = np.random.default_rng(3)
    rows = [(int(k) if k < n - 6 else None, " ".join(draw.choice(WORDS, draw.integers(1, 12)))) for k in range(n)]
    return [*rows, (5, "Alpha alpha beta"), (5, "beta KAPPA"), (7, None), (n, ""), (n + 1, "nothing asked")]


@pytest.mark.parametrize(("asked", "cells"), [(65_536, 1 << 20), (3, 4)])
def test_lexical_against_plain(spark, asked, cells, monkeypatch):
    """Blocks of questions, small parts, rows that share an id, ids that are null, texts without words."""
    monkeypatch.setattr(scored, "ASKED", asked)
    monkeypatch.setattr(scored, "CELLS", cells)
    rows = _texts(60)
    questions = [(1, "alpha beta"), (2, "kappa, iota and theta"), (3, "?"), (4, "alpha beta gamma delta epsilon"), (5, "unheard")]
    have: dict = {}
    for k, t in rows:
        have.setdefault(k, Counter()).update(w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) > 1)
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    ask = spark.createDataFrame(questions, "question_id int, question string")
    want, met = [], {}
    for q, text in questions:
        terms = set(re.findall("[a-z]+", text))
        hits = sorted((-round(sum(c[t] / (c[t] + 1) for t in terms), 6), -1 if k is None else k) for k, c in have.items() if terms & c.keys())
        want += [(q, None if k < 0 else k, -s, r) for r, (s, k) in enumerate(hits[:7], 1)]
        if hits:
            met[q] = len(hits), sum(terms <= c.keys() for c in have.values())
    for index in (search.counts(chunks, ask), search.postings(chunks, ask), search.postings(chunks)):
        got = search.lexical(index, ask, 7).collect()
        assert sorted((r.question_id, r["rank"], r.chunk_id, r.score) for r in got) == [(q, r, k, pytest.approx(s, abs=1e-9)) for q, k, s, r in want]
        assert {r.question_id: (r.any_term, r.all_terms) for r in search.matched(index, ask).collect()} == met


def test_a_task_passes_on_its_best_only(spark):
    """No row for each question and chunk: as many as the limit for each question and task, though all chunks have all words."""
    chunks = spark.range(2_000).selectExpr("id AS chunk_id", "'alpha beta gamma' AS text").coalesce(2)
    ask = spark.createDataFrame([(q, "alpha beta") for q in range(20)], "question_id int, question string")
    found = scored.best(search.counts(chunks, ask), search.asked_terms(ask), "term", ["tf"], scored.by_counts, 5, scored.compact_counts)
    parts = spark.sparkContext.getConf().get("spark.sql.shuffle.partitions")
    assert 100 <= found.count() <= 100 * int(parts)
    assert "HashAggregate" not in search.counts(chunks, ask)._jdf.queryExecution().toString()
    got = search.lexical(search.counts(chunks, ask), ask, 5).where("question_id = 3").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2, 3, 4]


def test_nearest_holds_a_bounded_number(monkeypatch):
    monkeypatch.setattr(search, "HELD", 100)
    draw = np.random.default_rng(1)
    likeness = np.round(draw.uniform(-1, 1, (3, 4_000)), 2)  # many ties
    best = search._Nearest(3, 10)
    ids = draw.permutation(4_000)
    most = 0
    for at in range(0, 4_000, 50):
        best.add(np.arange(3), likeness[:, at : at + 50], pa.array(ids[at : at + 50]), np.arange(50))
        most = max(most, best.size)
    best.prune()
    assert most <= 120 + 3 * 50
    query, distance, got = best.held[0]
    for q in range(3):
        want = sorted(zip(np.floor((1 - likeness[q]) * 1e9 + 0.5) / 1e9, ids.tolist(), strict=True))[:10]
        assert list(zip(distance[query == q].tolist(), got.to_numpy()[query == q].tolist(), strict=True)) == want


def test_prose_windows_a_few_texts_at_a_time(spark, monkeypatch):
    """Windows leave the worker as rows, a few texts at a time, not as one array a text and one array of these a batch."""
    monkeypatch.setattr(C, "PIECE_BYTES", 500)
    texts = [(k, "article", t) for k, t in enumerate(["", None, "  \n", "word " * 900, "One. Two.\n\n" * 300, "x" * 5_000])]
    made = C.prose_chunks(spark.createDataFrame(texts, "document_id long, doc_type string, text string").coalesce(1))
    assert "ArrowEvalPython" not in made._jdf.queryExecution().toString()
    got = sorted((r.document_id, r.ordinal, r.text, r.span_start, r.span_end) for r in made.collect())
    assert got == [(k, i, c, s, e) for k, _, t in texts for i, (s, e, c) in enumerate(w for w in C._windows(t) if w[2])]
