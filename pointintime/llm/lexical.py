"""Ranked lexical search over shards of documents, with impacts computed once as integers.

A shard is a run of documents as one row: its words in order, how many of its documents hold each (their postings stand one word
after another, as in a compressed sparse row matrix), and for each posting the document's number and its impact. A search adds up a
question's words one at a time in one array over a shard's documents and keeps the best; Spark merges what the shards keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORDED, Tables, table
from .terms import distinct, strings, word_stretches

#: A shard ends after so many bytes of words or documents; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCUMENTS = 8 << 20, 1 << 16
#: Rows (question, word) that are sent to all tasks at one time, in whole questions: about 16 MB.
BLOCK_ROWS = 1 << 18
#: Hits of each question.
BEST = 50


def _sizes(batches):
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for row, _, start, _, _ in word_stretches(batch.column(0), WORDED):
            n += np.bincount(row, minlength=len(n)) if len(row) else 0
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "words"])


def collection_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """How many documents have a word, and how many words all of them have."""
    found = docs.select(F.col(column).cast("string")).mapInArrow(_sizes, "documents long, words long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return found[0], found[1]


class _Shard:
    """Documents whose words are being counted."""

    def __init__(self):
        self.ids: list = []
        self.words: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(start):
            first, which = distinct(data, start, end)
            number = np.fromiter((self.words.setdefault(data[a:b].tobytes(), len(self.words)) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)), np.int64, len(first))
            self.parts.append(np.unique((number[which] << 32) | doc, return_counts=True))
        self.size += len(data)

    def row(self, documents: int, words: int) -> dict:
        key = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.int64)
        times = np.concatenate([n for _, n in self.parts]) if self.parts else np.zeros(0, np.int64)
        key, back = np.unique(key, return_inverse=True)  # a long text's stretches repeat words
        tf = np.zeros(len(key), np.int64)
        np.add.at(tf, back, times)
        doc, number = key & 0xFFFFFFFF, key >> 32
        length = np.bincount(doc, tf, len(self.ids)).astype(np.int64)
        norm = np.array([50 + 50 * n * documents // words for n in length.tolist()], np.int64) if words else length
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc])
        order = np.array([k for _, k in sorted((w, k) for w, k in self.words.items())], np.int64)
        df = np.bincount(number, minlength=len(self.words))
        starts = np.concatenate([[0], np.cumsum(df)])
        spread = np.arange(len(key)) + np.repeat(starts[order] - np.concatenate([[0], np.cumsum(df[order])])[:-1], df[order]) if len(key) else key
        names = list(self.words)
        return {"ids": self.ids, "terms": [names[k].decode() for k in order], "df": df[order].astype(np.int32), "docs": doc[spread].astype("<i4").tobytes(), "impacts": impact[spread].astype("<i4").tobytes(), "documents": documents}


def build_index(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Shards of all documents: ids, terms, df, docs, impacts, documents (how many of the collection have a word). ``docs`` and
    ``impacts`` are 32-bit integers as bytes, little end first, which no reader takes apart number by number.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A null or empty text has no words and is found
    by nothing; repeated rows and ids are documents each; a null id stays null. A long text is counted in stretches and can be a shard
    alone. An empty table gives no shard. ``key`` is a column of whole numbers; other columns don't matter. The collection's size is
    counted first, so one job runs when this is called.
    """
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(column).cast("string").alias("text"))
    documents, words = collection_size(docs)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            ids, begun = batch.column(0).to_pylist(), 0  # rows before ``begun`` are in shards that ended
            for row, data, start, end, whole in word_stretches(batch.column(1), WORDED):
                if not len(row):
                    continue
                shard.add(row - begun + len(shard.ids), data, start, end)
                if whole and (shard.size >= SHARD_BYTES or len(shard.ids) + int(row[-1]) + 1 - begun >= SHARD_DOCUMENTS):
                    last = int(row[-1]) + 1
                    shard.ids += ids[begun:last]
                    yield _packed(shard.row(documents, words))
                    shard, begun = _Shard(), last
            shard.ids += ids[begun:]
        if shard.parts:
            yield _packed(shard.row(documents, words))

    return docs.mapInArrow(shards, _SHARD)


_SHARD = "ids array<long>, terms array<string>, df array<int>, docs binary, impacts binary, documents long"


def _packed(row: dict) -> pa.RecordBatch:
    kinds = (pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row.values(), kinds, strict=True)], names=list(row))


def written_index(index: DataFrame) -> DataFrame:
    """The shards as a table in the shared folder. Each is a row group: a reader holds all rows of a group at one time, up to some
    thousands, and a writer would gather a hundred before it first looks at their bytes."""
    return Tables(index.sparkSession).write(index, **{"parquet.block.row.count.limit": 1})


def question_terms(questions: DataFrame, key: str = "item_id", column: str = "text") -> DataFrame:
    """item, term: the different words of each question. Rows of one id are one question; a null text has no words."""

    def run(batches):
        for batch in batches:
            for row, data, start, end, _ in word_stretches(batch.column(1), WORDED):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), strings(data, start, end)], names=["item", "term"])

    return questions.select(F.col(key).alias("item"), F.col(column).cast("string")).mapInArrow(run, T.StructType([T.StructField("item", questions.schema[key].dataType), T.StructField("term", T.StringType())])).distinct()


def weighted(index: DataFrame, terms: DataFrame) -> DataFrame:
    """item, term, weight: by how few documents of all shards hold the term; terms of no document go."""
    counts = index.select("documents", F.explode(F.arrays_zip("terms", "df")).alias("t")).select("documents", F.col("t.terms").alias("term"), F.col("t.df").alias("df"))
    counts = counts.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"), F.max("documents").alias("documents"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.col("documents") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return terms.join(counts, "term").select("item", "term", weight.alias("weight"))


def _best(score: np.ndarray, ids: np.ndarray, absent: np.ndarray, limit: int) -> np.ndarray:
    """The places of the ``limit`` highest scores above 0, all that tie with the last one included before ids decide (a null id last)."""
    if len(score) > limit:
        at = np.argpartition(score, len(score) - limit)[len(score) - limit :]
        at = np.flatnonzero(score >= max(1, int(score[at].min())))
    else:
        at = np.flatnonzero(score > 0)
    return at[np.lexsort((ids[at], absent[at], -score[at]))][:limit]


def search(index: DataFrame, questions: DataFrame, key: str = "item_id", column: str = "text", limit: int = BEST) -> DataFrame:
    """item, rank, doc_id, score: the ``limit`` best documents of each question with a score above 0, equal scores by ascending id.

    Questions without words, or whose words no document has, have no rows, as have all over an empty index. Questions are sent to the
    shards in blocks of at most ``BLOCK_ROWS`` rows (and one question more); a block's hits are written before the next is sent. A task
    keeps the best of all its shards, so what is shuffled is ``limit`` rows for each question and task. Runs jobs when called.
    """
    spark = index.sparkSession
    tables = Tables(spark)
    kind = questions.schema[key].dataType
    terms = tables.write(weighted(index, question_terms(questions, key, column)))
    blocks = max(1, -(-terms.count() // BLOCK_ROWS))
    fields = T.StructType([T.StructField("item", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = None
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")).collect()
        words = sorted({w for r in rows for w in r.terms})
        number = {w: k for k, w in enumerate(words)}
        asked = [(np.array([number[w] for w in r.terms]), np.array(r.weights, np.int64)) for r in rows]
        sent = spark.sparkContext.broadcast((words, [r.item for r in rows], asked))
        hits = index.select("ids", "terms", "df", "docs", "impacts").mapInArrow(_scorer(sent, limit, to_arrow_type(kind)), fields)
        if blocks > 1:
            hits = tables.write(hits)
            sent.unpersist()
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("item", "rank", "doc_id", "score")


def _scorer(sent, limit: int, kind: pa.DataType):
    def run(batches):
        words, items, asked = sent.value
        words = pa.array(words, pa.string())
        kept: list = [None] * len(items)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, terms, df = (batch.column(c).slice(k, 1).flatten() for c in range(3))
                docs, impacts = (np.frombuffer(batch.column(c)[k].as_buffer(), "<i4") for c in (3, 4))
                absent = ids.is_null().to_numpy(zero_copy_only=False)
                ids, df = ids.fill_null(0).to_numpy(), df.to_numpy()
                place = pc.index_in(words, terms).fill_null(-1).to_numpy()
                starts = np.concatenate([[0], np.cumsum(df, dtype=np.int64)])
                score = np.zeros(len(ids), np.int64)
                for q, (which, weights) in enumerate(asked):
                    at = place[which]
                    if not (at >= 0).any():
                        continue
                    score[:] = 0
                    for t, w in zip(at[at >= 0].tolist(), weights[at >= 0].tolist(), strict=True):
                        here = slice(starts[t], starts[t + 1])
                        score[docs[here]] += w * impacts[here].astype(np.int64)
                    best = _best(score, ids, absent, limit)
                    new = score[best], ids[best], absent[best]
                    if kept[q] is not None:
                        new = tuple(np.concatenate(x) for x in zip(kept[q], new, strict=True))
                        order = _best(*new, limit)
                        new = tuple(x[order] for x in new)
                    kept[q] = new
        for q, hits in enumerate(kept):
            if hits is not None and len(hits[0]):
                score, ids, absent = hits
                item = pa.array([items[q]] * len(score), kind)
                yield pa.RecordBatch.from_arrays([item, pa.array(ids, mask=absent), pa.array(score)], names=["item", "doc_id", "score"])

    return run


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 of all ``documents`` for each item of ``benchmark``."""
    index = written_index(build_index(table(spark, sf_dir, "documents")))
    return search(index, table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


OP13_SQL = r"""
WITH word AS (SELECT k, doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT k, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents))),
every AS (SELECT count(DISTINCT k) AS n_all, count(*) AS l_all FROM word),
length AS (SELECT k, any_value(doc_id) AS doc_id, 100 - 50 + (50 * count(*) * any_value(n_all)) // any_value(l_all) AS m FROM word, every GROUP BY k),
asked AS (SELECT DISTINCT item_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM benchmark)),
posting AS (SELECT k, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM asked) GROUP BY k, term),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, every GROUP BY term),
scored AS (SELECT item_id, posting.k, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM asked JOIN posting USING (term) JOIN weight USING (term) JOIN length ON length.k = posting.k GROUP BY item_id, posting.k)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scored JOIN length USING (k) WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 50
"""
