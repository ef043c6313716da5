"""Commits of a store, micro-batches on it, the kept view of latest rows, and state that goes."""

import random

import pytest
from pyspark.sql import functions as F

from pointintime.operators import bitemporal, chunks
from pointintime.sources.store import Conflict, Store
from pointintime.streaming import incremental


def run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_commits_are_seen_whole(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", 4)
    assert store.read("a") is None and store.number() == 0
    rows = spark.range(20).withColumnRenamed("id", "k")
    store.commit({"a": ("append", rows, ["k"], None), "b": ("append", rows.where("k < 3"), ["k"], None)})
    before = store.read("a")
    touched = store.touched(rows.where("k = 5"), ["k"])
    assert len(touched) == 1
    own = store.read("a", touched)
    assert 0 < own.count() < 20 and set(own.inputFiles()) < set(store.read("a").inputFiles())
    store.commit({"a": ("replace", own.where("k <> 5"), ["k"], touched), "b": ("replace", rows.where("false"), ["k"], None)})
    assert store.read("a").count() == 19 and store.read("b").count() == 0
    assert before.count() == 20 and store.read("b", number=1).count() == 3  # readers keep what they began with
    with pytest.raises(Conflict):
        store._publish(2, {})
    assert store.commit({"a": ("append", rows, ["k"], None)}, "run", 7) == 3
    assert store.commit({"a": ("append", rows, ["k"], None)}, "run", 7) == 3 and store.read("a").count() == 39


def test_a_failed_commit_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    store.commit({"a": ("append", spark.range(5), ["id"], None)})
    broken = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        store.commit({"a": ("append", spark.range(5, 9), ["id"], None), "b": ("append", broken, ["id"], None)})
    assert store.number() == 1 and store.read("a").count() == 5 and store.read("b") is None


def test_micro_batches_once(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "out"), 16)
    read = lambda: spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).json(str(source))
    go = lambda mark, work=lambda b: b: incremental.run_available(read(), work, str(tmp_path / "out"), str(tmp_path / mark), ["k"])
    for part in range(3):
        spark.range(part * 40, part * 40 + 60).selectExpr("id as k", "'x' as v").coalesce(1).write.mode("append").json(str(source))
    calls = []

    def fails_once(batch):
        calls.append(1)
        return batch.withColumn("v", F.raise_error(F.lit("stop"))) if len(calls) == 2 else batch

    with pytest.raises(Exception, match="stop"):
        go("one", fails_once).awaitTermination()
    done = store.read("rows").count()
    assert done == 60
    run(go("one"))
    assert store.read("rows").count() == 140 == store.read("rows").select("k").distinct().count()
    files = store.number()
    run(go("one"))
    run(go("two"))  # a new checkpoint: its keys are known
    assert store.read("rows").count() == 140 and store.number() >= files
    spark.createDataFrame([(1, "y")], "k long, v string").coalesce(1).write.mode("append").json(str(source))
    part = store.read("rows", store.touched(spark.createDataFrame([(1,)], "k long"), ["k"]))
    assert len(part.inputFiles()) < len(store.read("rows").inputFiles()) / 4  # what a batch of one key reads
    run(go("one"))
    assert store.read("rows").count() == 140


def test_latest_is_kept_in_any_order(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, rng.choice(["a", "b", "c", "d"]), rng.randrange(40), f"t{k}") for k in range(90)]
    rng.shuffle(rows)
    for at in range(0, 90, 30):
        frame = spark.createDataFrame(rows[at : at + 30], "id long, source_id string, knowledge_time long, text string")
        frame.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run(incremental.run_latest(stream, str(tmp_path / "out"), str(tmp_path / "mark")))
    everything = spark.createDataFrame(rows, frame.schema)
    got = Store(spark, str(tmp_path / "out")).read("latest").select(*everything.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bitemporal.latest(everything).select(*everything.columns).collect()))
    run(incremental.run_latest(stream, str(tmp_path / "out"), str(tmp_path / "again")))
    assert got.count() == 4 == Store(spark, str(tmp_path / "out")).read("latest").count()


def test_chunks_and_records_change_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    documents = spark.createDataFrame([(k, "article", f"Text of {k}. " * 3, None) for k in range(12)], "document_id long, doc_type string, text string, tables array<struct<index:int,rows:array<array<string>>>>")
    assert chunks.replace_chunks(store, documents) == 1
    records = store.read("chunks").selectExpr("document_id", "concat('r', document_id) as record")
    store.commit({"records": ("append", records, ["document_id"], None)})
    old = store.read("chunks"), store.read("records")
    changed = documents.where("document_id = 5").withColumn("text", F.lit("Another text."))
    chunks.replace_chunks(store, changed)
    assert [r.text for r in store.read("chunks").where("document_id = 5").collect()] == ["Another text."]
    assert store.read("records").where("document_id = 5").count() == 0 and store.read("records").count() == 11 and store.read("chunks").count() == 12
    assert old[0].where("document_id = 5").first().text.startswith("Text of 5") and old[1].where("document_id = 5").count() == 1


def test_state_of_idle_callers_goes(spark, tmp_path):
    def arrive(caller, *minutes):
        spark.createDataFrame([(caller, m) for m in minutes], "caller string, m int").selectExpr("caller", "timestamp_seconds(1700000000 + 60 * m) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    arrive("idle", 0, 0, 0)
    stream = spark.readStream.schema("caller string, ts timestamp").parquet(str(tmp_path / "in"))
    rows = []

    def go():
        query = incremental.limited(stream, 60, 2, "1 minute").writeStream.foreachBatch(lambda b, _: rows.extend(map(tuple, b.select("caller", "rejected").collect()))).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
        run(query)
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    assert go() == 1
    arrive("busy", 30)
    go()
    arrive("busy", 31)
    assert go() == 1  # the idle caller's state is gone, its answers stay
    assert sorted(rows) == [("busy", False), ("busy", False), ("idle", False), ("idle", False), ("idle", True)]
