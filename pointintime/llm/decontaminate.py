"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: the words at its selected places are hashed, the others
may differ. Hashes of the benchmark's windows and of the documents' windows meet; around every hit the
two texts are laid side by side on that diagonal. An overlap counts when it has ``MIN_WORDS`` words, or the
whole item if that is shorter, of which four fifths are equal: of all runs of that many words or more, the one
with the best score (1 for an equal word, -4 for another) is taken, and it counts from a score of 0.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased, so punctuation, case
and white space don't matter. Items shorter than ``MIN_WORDS`` are sought as a whole by masks for their
length: one word in five may differ, so items of fewer than five words only match as they are. An item without a word matches nothing.

The benchmark's seeds are a table. A bitmap of fixed size of it spares the other seeds of the documents; what is left joins the
table by hash, both sides as runs of equal seeds (a word that is repeated is one), which gives runs of diagonals for a
text and an item. These go to the text, once for all its copies, with the items' words. Null and empty texts, empty tables: no
overlap. Each row of a repeated document has its results; rows of the benchmark with the same id and text are one item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDED, among, bitmap, mix, pieces, signed, table, word_hashes, written

#: Every run of 13 words or more with four fifths equal words holds a window that is equal under one of
#: these (runs of 26 or more hold a shorter one; a test enumerates the others).
MASKS = ("1111011", "11010001011", "1010001000111")
#: The same for whole items of fewer words, by their number of words.
SHORT_MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "10111", "11011", "11101"),
    6: ("11111", "101111", "110111", "111011", "111101"),
    7: ("111111", "1011111", "1101111", "1110111", "1111011", "1111101"),
    8: ("1111111", "10111111", "11011111", "11101111", "11110111", "11111011", "11111101"),
    9: ("11111111", "101111111", "110111111", "111011111", "111101111", "111110111", "111111011", "111111101"),
    10: ("1101111", "11110011", "110011011", "10101111", "11110101"),
    11: ("11011111", "111101011", "101110111", "1101011011", "1110110011", "110011111", "1111100101"),
    12: ("110111111", "1111101011", "1011110111", "11001101111", "11010111011", "111100011011", "1111110011", "111100110101"),
}
MIN_WORDS = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A run of words scores 0 or more when four fifths of them are equal.
_PENALTY = 4
#: Words that are laid side by side at a time.
_CELLS = 1 << 18


def _places(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _masks(n: int) -> tuple[str, ...]:
    """The masks for an item of ``n`` words."""
    return MASKS if n >= MIN_WORDS else SHORT_MASKS.get(n, ())


def _seeds(h: np.ndarray, places: list[int], n: int) -> np.ndarray:
    out = np.full(n, len(places) + 1000 * places[-1], np.uint64)
    for k, p in enumerate(places):
        out = (out ^ h[p : p + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        out ^= out >> np.uint64(31)
    return mix(out)


def _runs(h: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of seeds that are equal at consecutive places of one text."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(h))[: len(first)] - 1


def item_seeds(items: DataFrame) -> DataFrame:
    """item, h and the first and last place (a, z) of each run of equal seeds of each item; ``items``: item, text."""

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                w = word_hashes(data, np.array([0, len(data)]), WORDED)[0]
                for places in map(_places, _masks(len(w))):
                    n = len(w) - places[-1]
                    if n > 0:
                        s = _seeds(w, places, n)
                        a, z = _runs(s, np.arange(n), np.zeros(n, int))
                        out.append((np.full(len(a), item, np.int64), signed(s[a]), a, z))
            columns = zip(*out, strict=True) if out else [[np.zeros(0, np.int64)]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["item", "h", "a", "z"])

    return items.select("item", "text").mapInArrow(run, "item long, h long, a long, z long")


def doc_seeds(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """dk, h and the first and last place (i, j) of each run of equal seeds that the benchmark may have; ``docs``: text, dk."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    masks = [_places(m) for m in sorted({m for n in lengths for m in _masks(n)})]

    def run(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for first, _, data, offsets in pieces(batch.column(0)):
                h, doc = word_hashes(data, offsets, WORDED)
                begin = np.searchsorted(doc, doc)
                for places in masks:
                    n = len(h) - places[-1]
                    if n <= 0:
                        continue
                    s = signed(_seeds(h, places, n))
                    hit = np.flatnonzero(among(sent.value, s) & (doc[:n] == doc[places[-1] :]))
                    if len(hit):
                        own, at = s[hit], hit - begin[hit]
                        i, j = _runs(own, at, doc[hit])
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[first + doc[hit[i]]], own[i], at[i], at[j])], names=["dk", "h", "i", "j"])

    return docs.mapInArrow(run, "dk long, h long, i long, j long")


def best_overlap(h: np.ndarray, item: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """First word, words and equal words of the best overlap of a text and an item (word hashes) that counts, on the diagonals
    (place in the text - place in the item) of ``spans``, first and last."""
    least, best = min(MIN_WORDS, len(item)), None
    place = np.arange(len(item))
    for lo, hi in merged(spans):
        for at in range(lo, hi, step := max(1, _CELLS // len(item))):
            g = np.arange(at, min(at + step, hi))
            where = g[:, None] + place
            inside = (where >= 0) & (where < len(h))
            equal = h[where.clip(0, len(h) - 1)] == item
            gain = np.zeros((len(g), len(item) + 1), np.int64)
            np.cumsum(np.where(inside, np.where(equal, 1, -_PENALTY), -(1 << 30)), 1, out=gain[:, 1:])
            low = np.minimum.accumulate(gain, 1)[:, : len(item) + 1 - least]
            score = gain[:, least:] - low
            end, each = score.argmax(1), np.arange(len(g))
            begin = (gain == low[each, end][:, None]).argmax(1)
            n = end + least - begin
            score = score[each, end]
            same = (score + _PENALTY * n) // (1 + _PENALTY)
            for x in np.flatnonzero(score >= 0)[np.argsort(-same[score >= 0], kind="stable")[:1]].tolist():
                row = int(same[x]), -int(g[x]), int(g[x] + begin[x]), int(n[x])
                best = max(best or row, row)
    return best and (best[2], best[3], best[0])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of diagonals, each with its last one + 1."""
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y + 1)
        else:
            out.append([x, y + 1])
    return [(x, y) for x, y in out]


def text_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """dk, item_id, first_word, n_words, n_equal, overlap for each text of ``docs`` (text, dk: its hash) and item that overlap."""
    spark = docs.sparkSession
    items = written(benchmark.select(F.col("item_id").cast("long"), "text").distinct().withColumn("item", F.xxhash64("item_id", "text")))
    seeds = written(item_seeds(items))
    lengths = [r[0] for r in items.select(F.least(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)), F.lit(MIN_WORDS))).distinct().collect()]
    hits = doc_seeds(docs, lengths, bitmap(seeds, "h")).join(seeds, "h")
    spans = hits.select("dk", "item", F.struct((F.col("i") - F.col("z")).alias("lo"), (F.col("j") - F.col("a")).alias("hi")).alias("span")).distinct()
    met = spans.groupBy("dk", "item").agg(F.collect_list("span").alias("spans")).join(items, "item")
    asked = written(met.groupBy("dk").agg(F.collect_list(F.struct("item_id", "text", "spans")).alias("items")))
    sent = spark.sparkContext.broadcast(bitmap(asked, "dk"))

    def picked(batches):
        for batch in batches:
            yield batch.filter(pa.array(among(sent.value, batch.column(1).to_numpy())))

    def verify(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data = np.frombuffer((batch.column(1)[i].as_py() or "").encode(), np.uint8)
                h = word_hashes(data, np.array([0, len(data)]), WORDED)[0]
                for it in batch.column(2)[i].as_py():
                    data = np.frombuffer((it["text"] or "").encode(), np.uint8)
                    w = word_hashes(data, np.array([0, len(data)]), WORDED)[0]
                    best = best_overlap(h, w, [(s["lo"], s["hi"]) for s in it["spans"]])
                    if best:
                        rows.append((batch.column(0)[i].as_py(), it["item_id"], *best, best[2] / len(w)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.float64()], strict=True)], names=["dk", "item_id", "first_word", "n_words", "n_equal", "overlap"])

    texts = docs.mapInArrow(picked, "text string, dk long").groupBy("dk").agg(F.any_value("text").alias("text"))
    return written(texts.join(asked, "dk").select("dk", "text", "items").mapInArrow(verify, "dk long, item_id long, first_word long, n_words long, n_equal long, overlap double"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("dk"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document (row of ``docs``) and item that overlap: doc_id, item_id, first_word,
    n_words (of the overlap), n_equal, overlap (equal words / words of the item)."""
    found = text_overlaps(_keyed(docs), benchmark)
    ids = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dk"))
    return ids.join(found, "dk").drop("dk")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap an item; the columns stay as they are. Only texts that may be among
    these are shuffled."""
    found = text_overlaps(_keyed(docs), benchmark).select("dk").distinct()
    sent, names = docs.sparkSession.sparkContext.broadcast(bitmap(found, "dk")), docs.columns
    keyed = docs.select(F.struct(*names).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dk"))

    def part(batches, inside):
        for batch in batches:
            yield batch.filter(pa.array(among(sent.value, batch.column(1).to_numpy()) == inside))

    clean = keyed.mapInArrow(lambda batches: part(batches, False), keyed.schema)
    doubtful = keyed.mapInArrow(lambda batches: part(batches, True), keyed.schema)
    return clean.unionByName(doubtful.join(found, "dk", "left_anti").select("doc", "dk")).select("doc.*")


def op6_benchmark_overlaps(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
