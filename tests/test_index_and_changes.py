"""The vector index against exact search; changes of hot keys against a loop."""

import random
import re

from pyspark.sql import functions as F

from pointintime.operators import bitemporal, search, vector_index


def test_index_recall_and_cut_off(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding", (F.col("vec_id") % 3).alias("knowledge_time"))
    path = str(tmp_path / "index")
    vector_index.build(e, path, 32)
    queries = e.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("vector"))
    for when in (None, 1):
        known = e if when is None else e.where(F.col("knowledge_time") <= when)
        exact = {(r.question_id, r.chunk_id) for r in search.dense(known, queries, 10).collect()}
        hits = vector_index.search(spark, path, queries, 10, probes=20, when=when)
        rows = hits.collect()
        found = {(r.question_id, r.chunk_id) for r in rows}
        assert len(found) == len(rows) == len(exact) and len(found & exact) >= 0.9 * len(exact)
        every = vector_index.search(spark, path, queries, 10, probes=32, when=when)
        assert {tuple(r) for r in every.collect()} == {tuple(r) for r in search.dense(known, queries, 10).select(*every.columns).collect()}
    assert "PartitionFilters: [isnotnull(cell" in hits._jdf.queryExecution().toString()


def test_index_of_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.5, 0.5]), (8, [None, 1.0])]
    e = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    vector_index.build(e, str(tmp_path / "a"), 4)
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0])], "question_id long, vector array<double>")
    hits = vector_index.search(spark, str(tmp_path / "a"), q, 10, probes=4).orderBy("rank").collect()
    assert [(r.question_id, r.chunk_id) for r in hits] == [(1, 1), (1, 2), (1, 7)]


def test_changes_of_a_hot_key_against_a_loop(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(300), rng.choice(["x", "y", "y", None])) for k in range(1500)]
    want, before = set(), {}
    for k, key, at, text in sorted(rows, key=lambda r: (r[2], r[0])):
        if before.get(key) is None or text is None or before[key] != text:
            want.add(k)
        before[key] = text
    frame = spark.createDataFrame(rows, "id long, source_id string, at long, text_hash string").repartition(5)
    for ranges in (1, 7, 64):
        timed = frame.withColumn("knowledge_time", F.timestamp_seconds("at"))
        got = bitemporal.changes(timed, ranges=ranges)
        assert {r.id for r in got.collect()} == want and got.columns == timed.columns
    plan = bitemporal.changes(frame.withColumn("knowledge_time", F.col("at")))._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(source_id#\d+, __range#\d+", plan)  # one key goes to as many tasks as ranges
    assert bitemporal.changes(frame.withColumn("knowledge_time", F.col("at")).where("false")).count() == 0
