"""Retrieval: dense, lexical and hybrid ranking under an as-of cut-off, for many questions in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.retrieval import found_by, place_weights, rrf
from ..functions.stem import stemmed, stop_word
from ..functions.text import query_terms
from ..vocabulary import CANDIDATES, LAST_POSITION, RRF_K, STOP_WORDS, TOP_K
from . import scored
from .bitemporal import as_of as known_at

#: Query vectors that are compared with the chunks in one pass.
QUERY_BLOCK = 4_096
#: Chunks and queries of one matrix product, and hits after which a task keeps the nearest only.
ROWS, QUERIES, HELD = 1_024, 512, 1 << 18
#: Words that are sent to all tasks at most, and bytes of text that a task takes apart at a time.
SENT_TERMS, PIECE_BYTES = 20_000, 1 << 20
#: Hits that are sent to all texts at most.
SENT_HITS = 100_000
_IN_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def validate(query: str | None = None, limit: int = TOP_K, candidates: int = CANDIDATES, mode: str = "hybrid") -> None:
    """Parameters within their bounds, before a plan is made."""
    if query is not None and len(query) < 2:
        raise ValueError("a query has 2 characters at least")
    if not 1 <= limit <= 50 or not 10 <= candidates <= 200 or mode not in ("hybrid", "dense", "lexical"):
        raise ValueError("limit 1-50, candidates 10-200, mode hybrid, dense or lexical")


def corpus(chunks: DataFrame, documents: DataFrame, when=None) -> DataFrame:
    """Chunks with their document's provenance, as known at an instant."""
    own = ["document_id", "source_url", "doc_type", "team", "knowledge_time", "published_time"]
    return chunks.join(known_at(documents, when).select(*(c for c in own if c in documents.columns)), "document_id")


def _top(scored: DataFrame, order: list, limit: int, by: str = "question_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def asked_terms(questions: DataFrame, english: bool = False) -> DataFrame:
    """question_id, term: the different terms of each question (question_id, question). ``english``: words are split at whatever
    isn't a letter or digit, stop words go, and what is left is stemmed."""
    asked = questions.select("question_id", F.explode(F.array_distinct(F.transform(query_terms(F.col("question")), F.lower))).alias("term"))
    if not english:
        return asked
    parts = asked.select("question_id", F.explode(F.regexp_extract_all("term", F.lit("[a-z0-9]+"), F.lit(0))).alias("term"))
    return _stems(parts.where(~stop_word(F.col("term")))).select("question_id", F.col("stem").alias("term")).distinct()


def _stems(words: DataFrame) -> DataFrame:
    """``words`` with the stems of ``term``, each different word stemmed once."""
    return words.join(stemmed(words.select("term").distinct()), "term")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """chunk_id and text of the batches, about ``PIECE_BYTES`` of text at a time."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        edges = [0, *(np.flatnonzero(np.diff(size // PIECE_BYTES)) + 1).tolist(), batch.num_rows]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            yield batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All runs of ASCII letters and digits of lower-cased texts in order, how long each is, and how many a text has (null: none)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    text_end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    if not len(text_end) or not text_end[-1]:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    begin = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[begin : begin + int(text_end[-1])]
    inside = _IN_WORD[data]
    after = np.append(inside[:-1] & inside[1:], False)  # the next byte goes on with the word
    after[text_end[text_end > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after)
    inner = np.concatenate([[False], after[:-1]])
    length = ends - np.flatnonzero(inside & ~inner) + 1
    kept, offsets = data[inside], np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(kept))
    return words, length, np.diff(np.searchsorted(ends, text_end), prepend=0)


def _lists(row: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """For entries in ascending rows of ``n``: which rows have any, and where the list of each of these begins."""
    size = np.bincount(row, minlength=n)
    has = np.flatnonzero(size)
    return pa.array(has), pa.array(np.concatenate([[0], np.cumsum(size[has])]).astype(np.int32))


def _sent(rows: DataFrame) -> list | None:
    """The rows, if there are ``SENT_TERMS`` at most (a job that runs when this is called)."""
    few = rows.limit(SENT_TERMS + 1).repartition(1).collect()  # all parts at once, not one after the other
    return few if len(few) <= SENT_TERMS else None


def positions(chunks: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """stem, chunk_id, place, length: for each place of a word (from 1, stop words count as places and aren't kept) its stem, and how many
    words of the chunk are kept. The last place that is told apart is ``LAST_POSITION``, as in the text search whose rank this serves.

    With ``questions`` only the stems they ask for are kept. Up to ``SENT_TERMS`` words that have one are sent to all tasks, and a text
    is taken apart where it stands, as one row whose stems and places are lists; more words are joined, as rows of one place each. The
    different words of all chunks are read once for their stems, when this is called.
    """
    texts = chunks.select("chunk_id", F.lower("text").alias("text"))

    def different(batches):
        for _, piece in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pc.unique(_words(piece)[0])], names=["term"])

    vocabulary, sent = stemmed(texts.mapInArrow(different, "term string").distinct().where(~stop_word(F.col("term")))), None
    if questions is not None:
        vocabulary = vocabulary.join(asked_terms(questions, english=True).select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
        sent = _sent(vocabulary)
    terms, stems = (None, None) if sent is None else (pa.array([r[c] for r in sent], pa.string()) for c in ("term", "stem"))
    stop = pa.array(STOP_WORDS)
    fields = T.StructType([T.StructField("stem", T.ArrayType(T.StringType())), chunks.schema["chunk_id"], T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("length", T.IntegerType())])

    def places(batches):
        for ids, piece in _pieces(batches):
            words, _, n = _words(piece)
            row = np.repeat(np.arange(len(n)), n)
            place = np.minimum(np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1, LAST_POSITION).astype(np.int32)
            kept = ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)
            length = np.bincount(row[kept], minlength=len(n)).astype(np.int32)
            code = None if terms is None else pc.index_in(words, value_set=terms)
            at = np.flatnonzero(kept if terms is None else code.is_valid().to_numpy(zero_copy_only=False))
            has, offsets = _lists(row[at], len(n))
            found = words.take(pa.array(at)) if terms is None else stems.take(code.take(pa.array(at)))
            lists = (pa.ListArray.from_arrays(offsets, v) for v in (found, pa.array(place[at])))
            yield pa.RecordBatch.from_arrays([next(lists), ids.take(has), next(lists), pa.array(length).take(has)], names=fields.names)

    found = texts.mapInArrow(places, fields)
    if sent is not None:
        return found
    each = found.select(F.explode(F.arrays_zip(F.col("stem").alias("term"), "place")).alias("w"), "chunk_id", "length")
    return each.select("w.term", "chunk_id", "w.place", "length").join(vocabulary, "term").select("stem", "chunk_id", "place", "length")


def ranked(index: DataFrame, questions: DataFrame, limit: int = CANDIDATES, normalise: str | None = None, closeness: float = 0.0) -> DataFrame:
    """question_id, chunk_id, score, rank: chunks with any stem of the question by the text search rank over ``positions``.

    A stem of n places, of which the first ``RANK_POSITIONS`` count, gives the sum of 1/k**2 for k up to n, the sum over the question's stems is divided by their number, so that
    more matched stems weigh more than repeats. ``normalise``: "log" divides by 1 + ln(length), "length" by the length. ``closeness``
    adds, times this factor, 1/distance of the nearest places of each two stems that follow one another in the alphabet. Questions whose
    words are all stop words have no hit; ties go to the smaller chunk_id.
    """
    asked = asked_terms(questions, english=True)
    hits = scored.best(index, asked, "stem", ["place", "length"], scored.by_places(place_weights(), normalise, closeness), limit)
    return _top(hits, [F.desc("score"), F.asc("chunk_id")], limit)


def counts(chunks: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """term, chunk_id, tf: a row for each row of ``chunks`` that has words, with lists of its different words and of how often it has each;
    rows of one chunk_id aren't added up. With ``questions``, up to ``SENT_TERMS`` of their terms (a job that runs when this is called)
    are sent to all tasks and are the only words counted; if there are more, all words are. A text is counted where it stands: no shuffle."""
    sent = None if questions is None else _sent(asked_terms(questions).select("term").distinct())
    only = None if sent is None else pa.array([r.term for r in sent], pa.string())
    fields = T.StructType([T.StructField("term", T.ArrayType(T.StringType())), chunks.schema["chunk_id"], T.StructField("tf", T.ArrayType(T.LongType()))])

    def count(batches):
        for ids, piece in _pieces(batches):
            words, length, n = _words(piece)
            if only is None:
                coded = words.dictionary_encode()
                terms, code, use = coded.dictionary, coded.indices, length > 1
            else:
                terms, code = only, pc.index_in(words, value_set=only)
                use = (length > 1) & code.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(use)
            if len(at):
                row = np.repeat(np.arange(len(n)), n)[at]
                key, tf = np.unique(row * len(terms) + code.take(pa.array(at)).to_numpy(), return_counts=True)
                has, offsets = _lists(key // len(terms), len(n))
                lists = (pa.ListArray.from_arrays(offsets, v) for v in (terms.take(pa.array(key % len(terms))), pa.array(tf.astype(np.int64))))
                yield pa.RecordBatch.from_arrays([next(lists), ids.take(has), next(lists)], names=fields.names)

    return chunks.select("chunk_id", F.lower("text").alias("text")).mapInArrow(count, fields)


def postings(chunks: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """term, chunk_id, tf: write it once, bucketed by term, and searches read only the terms they ask for. With ``questions`` only their
    terms are counted."""
    each = counts(chunks, questions).select(F.explode(F.arrays_zip("term", "tf")).alias("w"), "chunk_id").select("w.term", "chunk_id", "w.tf")
    if questions is not None:
        each = each.join(asked_terms(questions).select("term").distinct(), "term", "left_semi")
    return each.groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))


def lexical(index: DataFrame, questions: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """question_id, chunk_id, score, rank: chunks with any of the question's terms, by the sum of saturating weights.

    ``index``: ``postings`` or ``counts`` (several counts of a term and chunk add up). A question without terms has no hit. Ties go to
    the smaller chunk_id. The questions are read when this is called.
    """
    hits = scored.best(index, asked_terms(questions), "term", ["tf"], scored.by_counts, limit, scored.compact_counts, counted=True)
    return _top(hits, [F.desc("score"), F.asc("chunk_id")], limit)


def matched(index: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, any_term, all_terms: how many chunks have any and how many all terms of each question that has a hit."""
    return scored.matched(index, asked_terms(questions))


def _unit(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which of the vectors have it (those of length 0, with a null or a component that isn't finite don't count), as unit vectors."""
    by: dict[int, list] = {}
    for k, v in enumerate(rows):
        if v is not None and len(v) and not any(x is None for x in v):
            by.setdefault(len(v), []).append(k)
    out = {}
    for n, which in by.items():
        v = np.array([rows[k] for k in which], float)
        norm = np.sqrt((v * v).sum(1))
        use = (norm > 0) & np.isfinite(norm)
        out[n] = np.array(which)[use], v[use] / norm[use, None]
    return out


class _Nearest:
    """The ``limit`` nearest chunks of each query so far, by rounded distance and chunk_id."""

    def __init__(self, queries: int, limit: int):
        self.limit, self.bound, self.held, self.size = limit, np.full(queries, np.inf), [], 0

    def add(self, which: np.ndarray, likeness: np.ndarray, ids: pa.Array, rows: np.ndarray) -> None:
        """``likeness``: cosines of the queries ``which`` and of the chunks ``rows`` of ``ids``."""
        raw = 1 - likeness
        bound = self.bound[which]
        if np.isinf(bound).any() and raw.shape[1] > self.limit:
            bound = np.minimum(bound, np.partition(raw, self.limit - 1, 1)[:, self.limit - 1])
        row, col = np.nonzero(raw <= bound[:, None] + 2e-9)  # none that rounding could put first is left out
        self.held.append((which[row].astype(np.int64), np.floor(raw[row, col] * 1e9 + 0.5) / 1e9, ids.take(pa.array(rows[col]))))
        self.size += len(row)
        if self.size > max(HELD, 4 * self.limit * len(self.bound)):
            self.prune()

    def prune(self) -> None:
        query, distance = (np.concatenate([h[k] for h in self.held]) for k in range(2))
        ids = pa.concat_arrays([h[2] for h in self.held])
        order = np.lexsort((pc.rank(ids, tiebreaker="first").to_numpy(), distance, query))
        by = query[order]
        rank = np.arange(len(by)) - np.searchsorted(by, by)
        last = order[rank == self.limit - 1]
        self.bound[query[last]] = distance[last]
        order = order[rank < self.limit]
        self.held, self.size = [(query[order], distance[order], ids.take(pa.array(order)))], len(order)


def dense(chunks: DataFrame, queries: DataFrame, limit: int = CANDIDATES, version: str | None = None) -> DataFrame:
    """question_id, chunk_id, distance, rank by exact cosine distance; ``queries``: question_id, vector.

    One pass over the chunks for each block of about ``QUERY_BLOCK`` queries, whose unit vectors travel to all tasks as one
    array. Parts of ``ROWS`` chunks by ``QUERIES`` queries are one matrix product, and a task keeps the ``limit`` nearest of each query
    over all of its chunks, so neither what it holds nor what it passes on grows with its chunks.
    """
    has = chunks.where(F.col("embedding").isNotNull())
    if version is not None:
        has = has.where(F.col("embedding_version") == version)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    part = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
    fields = T.StructType([T.StructField("query", T.LongType()), T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("distance", T.DoubleType())])
    found = None
    for b in range(blocks):
        block = queries.where(part == b).select("question_id", "vector").collect()
        sent = chunks.sparkSession.sparkContext.broadcast(_unit([r.vector for r in block]))

        def nearest(batches, sent=sent, most=len(block)):
            best = _Nearest(most, limit)
            for whole in batches:
                for batch in (whole.slice(at, ROWS) for at in range(0, whole.num_rows, ROWS)):
                    for n, (rows, v) in _unit(batch.column(1).to_pylist()).items():
                        which, q = sent.value.get(n, (np.zeros(0, int), None))
                        if len(rows):
                            for at in range(0, len(which), QUERIES):
                                best.add(which[at : at + QUERIES], q[at : at + QUERIES] @ v.T, batch.column(0), rows)
            if best.held:
                best.prune()
                query, distance, ids = best.held[0]
                yield pa.RecordBatch.from_arrays([pa.array(query), ids, pa.array(distance)], names=["query", "chunk_id", "distance"])

        ids = chunks.sparkSession.createDataFrame([(k, r.question_id) for k, r in enumerate(block)], T.StructType([T.StructField("query", T.LongType()), queries.schema["question_id"]]))
        one = has.select("chunk_id", "embedding").mapInArrow(nearest, fields).join(F.broadcast(ids), "query").select("question_id", "chunk_id", "distance")
        found = one if found is None else found.unionByName(one)
    return _top(found, [F.asc("distance"), F.asc("chunk_id")], limit)


def fuse(rankings: dict[str, DataFrame], k: int = RRF_K, limit: int = TOP_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (question_id, chunk_id, rank): the limit holds after fusion."""
    parts = None
    for name, ranked in rankings.items():
        one = ranked.select("question_id", "chunk_id", F.lit(name).alias("list"), "rank", rrf(F.col("rank"), k).alias("share"))
        parts = one if parts is None else parts.unionByName(one)
    pick = lambda name: F.min(F.when(F.col("list") == name, F.col("rank")))
    fused = parts.groupBy("question_id", "chunk_id").agg(F.round(F.sum("share"), 9).alias("score"), pick("dense").alias("dense_rank"), pick("lexical").alias("lexical_rank"), F.map_from_entries(F.collect_list(F.struct("list", "share"))).alias("contributions"))
    fused = fused.withColumn("found_by", found_by(F.col("dense_rank"), F.col("lexical_rank")))
    return _top(fused, [F.desc("score"), F.asc("chunk_id")], limit)


def hybrid(chunks: DataFrame, index: DataFrame, questions: DataFrame, embed_query: Callable[[DataFrame], DataFrame] | None, mode: str = "hybrid", limit: int = TOP_K, candidates: int = CANDIDATES) -> DataFrame:
    """Hits with mode_used: without an embedder a search falls back to lexical and says so."""
    validate(limit=limit, candidates=candidates, mode=mode)
    used = mode if embed_query is not None else "lexical"
    lists = {}
    if used in ("hybrid", "lexical"):
        lists["lexical"] = lexical(index, questions, candidates)
    if used in ("hybrid", "dense"):
        lists["dense"] = dense(chunks, embed_query(questions), candidates)
    return fuse(lists, limit=limit).withColumn("mode_used", F.lit(used))


def with_text(hits: DataFrame, chunks: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """``hits``, at most ``limit`` of each question, with the texts of their chunks (chunk_id, text). Up to ``SENT_HITS`` hits are sent to the
    texts, which stay where they are; of more, Spark chooses the join. The questions are counted when this is called."""
    few = questions.count() * limit <= SENT_HITS
    return (F.broadcast(hits) if few else hits).join(chunks.select("chunk_id", "text"), "chunk_id")


def serialised(hits: DataFrame) -> DataFrame:
    """What a caller gets: times as ISO text, the score rounded to six digits."""
    times = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c) for c in ("knowledge_time", "published_time") if c in hits.columns]
    rest = [c for c in hits.columns if c not in ("knowledge_time", "published_time", "score")]
    return hits.select(*rest, *times, F.round("score", 6).alias("score"))
