"""An approximate vector index: inverted lists over trained centroids, kept as files by cell, searched under an as-of cut-off.

A chunk stands in the list of its nearest centroid; a query reads the lists of the few centroids nearest to it, so that the other
cells' folders are pruned. What was known at an instant is decided on a list's rows, before any of them is ranked: a cut-off never takes
hits away from a query that has enough. How many cells to probe depends on the vectors: those of the given tables have no clusters, and
20 of 32 cells find 0.93 of the ten nearest at sf0.1 (a test holds it over 0.9).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocabulary import CANDIDATES
from .bitemporal import as_of
from .search import _top, _unit

#: Sampled vectors that train one centroid (the bound of what the driver holds is this many a cell), and rounds of training.
SAMPLE, ROUNDS = 64, 12
#: Rows of a list that meet queries in one task, and queries of a cell that do at one time.
PART, BLOCK = 8_192, 1_024


def train(chunks: DataFrame, cells: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of the embeddings, from a sample of at most ``SAMPLE`` vectors a cell: the smallest hashes of chunk_id, so that
    runs agree whatever the layout. Fewer vectors than cells: as many centroids."""
    picked = chunks.where(F.col("embedding").isNotNull()).select("embedding", F.xxhash64("chunk_id", F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE * cells)
    units = _unit([r.embedding for r in picked.collect()])
    if not units:
        return np.zeros((0, 0))
    _, v = units[max(units, key=lambda n: len(units[n][0]))]
    centre = v[: min(cells, len(v))].copy()
    for _ in range(ROUNDS):
        own = np.argmax(v @ centre.T, 1)
        total = np.zeros_like(centre)
        np.add.at(total, own, v)
        norm = np.sqrt((total * total).sum(1))
        centre[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centre


def _nearest(sent, probes: int):
    """Arrow batches whose last column is a vector to rows of all columns and cell, one for each of the nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = sent.value
        for batch in batches:
            for n, (rows, v) in _unit(batch.column(batch.num_columns - 1).to_pylist()).items():
                if centre.size and n == centre.shape[1] and len(rows):
                    k = min(probes, len(centre))
                    cells = np.argsort(-(v @ centre.T), 1, kind="stable")[:, :k]
                    out = batch.take(pa.array(np.repeat(rows, k)))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cells.ravel().astype(np.int32))], names=[*batch.schema.names, "cell"])

    return run


def build(chunks: DataFrame, path: str, cells: int, seed: int = 0) -> None:
    """Writes the index of ``chunks`` (chunk_id, embedding, and knowledge_time where there is one) to ``path``: lists/cell=N, cells
    and centroids. Every chunk with a vector of the common length is in one list; null and zero vectors, and those that hold a null
    or a component that isn't finite, are in none.

    A list is kept in parts of about ``PART`` rows by a hash of chunk_id, so that a large cell is many tasks of a search.
    """
    spark = chunks.sparkSession
    centre = train(chunks, cells, seed)
    sent = spark.sparkContext.broadcast(centre)
    kept = [c for c in ("chunk_id", "knowledge_time", "embedding_version", "embedding") if c in chunks.columns]
    schema = T.StructType([*(chunks.schema[c] for c in kept), T.StructField("cell", T.IntegerType())])
    listed = chunks.where(F.col("embedding").isNotNull()).select(*kept).mapInArrow(_nearest(sent, 1), schema)
    sizes = listed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sizes.write.mode("overwrite").parquet(f"{path}/cells")
    parts = listed.join(F.broadcast(spark.read.parquet(f"{path}/cells")), "cell")  # a row a cell
    parts = parts.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    parts.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/lists")
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(centre)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # as many as the index has cells
    return np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))


def search(spark: SparkSession, path: str, queries: DataFrame, limit: int = CANDIDATES, probes: int = 8, when=None, version: str | None = None) -> DataFrame:
    """question_id, chunk_id, distance, rank: the nearest chunks of each query (question_id, vector) by cosine distance among the lists
    of its ``probes`` nearest cells; with as many probes as cells the result is that of ``search.dense``.

    Queries and lists meet by a shuffle on (cell, part): nothing of either is collected, and each group is at most ``PART`` rows or so
    by ``BLOCK`` queries. Ties go to the smaller chunk_id.
    """
    sent = spark.sparkContext.broadcast(centroids(spark, path))
    fields = T.StructType([queries.schema["question_id"], queries.schema["vector"], T.StructField("cell", T.IntegerType())])
    asked = queries.select("question_id", "vector").mapInArrow(_nearest(sent, probes), fields)
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("blocks")
    asked = asked.join(asked.groupBy("cell").agg(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("question_id"), F.col("blocks")).cast("int"))
    cells = spark.read.parquet(f"{path}/cells")
    asked_parts = asked.join(F.broadcast(cells), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lists = as_of(spark.read.parquet(f"{path}/lists"), when)
    lists = lists if version is None else lists.where(F.col("embedding_version") == version)
    # the cells that any query reads prune the folders, and each part meets each block of its cell's queries
    wanted = asked.select(F.col("cell").alias("cell"), F.col("block").alias("block")).distinct()
    lists = lists.select("chunk_id", "embedding", "cell", "part").join(F.broadcast(wanted), "cell")
    kind = lists.schema["chunk_id"].dataType
    out = T.StructType([queries.schema["question_id"], T.StructField("chunk_id", kind), T.StructField("distance", T.DoubleType())])

    def meet(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        found = []
        chunk = have["chunk_id"].to_numpy()
        order = np.argsort(np.argsort(chunk, kind="stable"), kind="stable")
        rows = _unit(list(have["embedding"]))
        for n, (who, q) in _unit(list(ask["vector"])).items():
            if n in rows and len(rows[n][0]) and len(who):
                at, v = rows[n]
                for lo in range(0, len(q), 256):
                    distance = np.floor((1 - q[lo : lo + 256] @ v.T) * 1e9 + 0.5) / 1e9
                    most = min(limit, len(at))
                    bound = np.partition(distance, most - 1, 1)[:, most - 1]
                    row, col = np.nonzero(distance <= bound[:, None])
                    sort = np.lexsort((order[at[col]], distance[row, col], row))
                    row, col = row[sort], col[sort]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < limit
                    row, col = row[keep], col[keep]
                    found.append(pd.DataFrame({"question_id": ask["question_id"].to_numpy()[who[lo + row]], "chunk_id": chunk[at[col]], "distance": distance[row, col]}))
        return pd.concat(found) if found else pd.DataFrame({"question_id": ask["question_id"][:0], "chunk_id": have["chunk_id"][:0], "distance": np.zeros(0)})

    keys = ["cell", "part", "block"]
    hits = asked_parts.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(meet, out)
    return _top(hits, [F.asc("distance"), F.asc("chunk_id")], limit)
