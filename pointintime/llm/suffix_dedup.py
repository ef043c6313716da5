"""Removal of repeated passages: every byte within a ``LENGTH``-byte string that also starts elsewhere.

Suffixes are sorted one bucket at a time; long ties are settled by ranks of a difference-cover sample.

1. Buckets. A window of LENGTH bytes belongs to the bucket of its smallest ``GRAM``-byte gram (by hash), so equal
   windows fall into one bucket wherever they stand. Consecutive windows of one bucket form a block, about
   85 windows long. Blocks whose gram occurs once in the corpus hold no repeated window: they are most of
   the text and end here. A bitmap of fixed size of the repeated grams spares them the second pass.
2. Blocks. Blocks with equal text (gram and digest, 128 bits) are one class. Where a class has two members, all its windows
   repeat: so copies and the inside of shared passages are settled without being compared.
3. Suffix sort. What is left are the ends of shared passages. Of each such bucket the different blocks
   are laid out, and the suffixes at their windows are sorted in the order of their letters: by bucket and distance from its gram, by
   their first COVER bytes, then by the rank of the cover sample that follows within COVER bytes, last by their last bytes. The
   sample's positions lie in a difference cover modulo 31 counted from the bucket's gram, so equal windows meet the same
   sample; its ranks are computed once for a bucket, for suffixes that have a long tie. What has a common prefix of LENGTH bytes repeats.
   A bucket with many different blocks is dealt by the windows' distance from the gram, in ``PARTS`` ranges of distances however many
   blocks there are, and by the bytes that all windows of such a range share. Of equal segments within a part one is sorted; where
   a part has more than ``MOST`` different segments, their windows are counted by digest instead, so that no task holds it.
4. Verdicts go back to all blocks of the class, become byte runs of each text, and the runs are cut.

Null texts are empty; texts under LENGTH bytes lose nothing; copies of one text (repeated rows too) lose all
their bytes if they have LENGTH; a repeat within one text counts. Windows are compared by their bytes; equality of whole blocks
and of whole texts rests on digests. Only texts with a run are shuffled; others are passed on as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, among, bitmap, pieces, prefix, signed, slices, span_hash, table, written

LENGTH, GRAM = 200, 32
COVER = 31
#: A perfect difference set: every residue modulo 31 is a difference of two of its members.
_COVER_SET = (0, 1, 3, 8, 12, 18)
MANY, PARTS, MOST = 256, 8, 4_096
#: Bytes of blocks after which a task sorts the buckets that it holds.
HELD = 1 << 18
_STEP = np.array([next(d for d in range(COVER) if (r + d) % COVER in _COVER_SET) for r in range(COVER)])


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram hash, first window, document, first window from the document's beginning, windows, and whether windows of
    the block may equal each other (then its gram stands at the beginning of one that isn't the last)."""
    n, w = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    at = np.arange(n - GRAM + 1)
    grams = span_hash(prefix(data), at, at + GRAM)
    least, size = grams, 1
    while 2 * size <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + LENGTH <= offsets[1:][doc])
    least, doc, own = least[inside], doc[inside], grams[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(inside)))
    first = inside[begin]
    starts = own == least
    starts[begin[1:] - 1] = False
    starts[-1:] = False
    within = np.maximum.reduceat(starts, begin).astype(np.int64) if len(begin) else count
    return least[begin], first, doc[begin], first - offsets[doc[begin]], count, within


def parts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``pieces``: first document, byte of it that the piece begins with, bytes, offsets. A long document is several pieces,
    each with the first windows of the next; a block that is cut there is two blocks."""
    for first, _, data, offsets in pieces(column, PIECE):
        if len(data) <= 2 * PIECE:
            yield first, 0, data, offsets
        else:
            for at in range(0, len(data), PIECE):
                part = data[at : at + PIECE + LENGTH - 1]
                yield first, at, part, np.array([0, len(part)])


def _away(sums: np.ndarray, gram: np.ndarray, begins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far from each window the first gram of its bucket is; ``gram``: of each segment."""
    p = np.arange(len(sums) - GRAM)
    owner = np.repeat(np.arange(len(gram)), np.diff(begins))[: len(p)]
    stands = p[span_hash(sums, p, p + GRAM) == gram[owner]]
    return stands[np.searchsorted(stands, at)] - at


def _columns(text: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The ``size`` bytes from each place as numbers of up to eight bytes whose order is that of the letters."""
    out = []
    for k in range(0, size, 8):
        value = np.zeros(len(at), np.uint64)
        for j in range(k, min(k + 8, size)):
            value = (value << np.uint64(8)) | text[at + j]
        out.append(value)
    return out


def _sorted_by(group: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by (group, key, key, ...): the order, and where in it a new value begins."""
    order = np.lexsort((*keys[::-1], group))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in (group, *keys)], axis=0)
    return order, new


def cover_ranks(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The rank in letter order of the LENGTH - COVER bytes from each sample position; equal strings have one rank."""
    out = np.zeros(len(places), np.int64)
    if len(places):
        rows = np.lib.stride_tricks.sliding_window_view(text, LENGTH - COVER)[places]
        _, out = np.unique(np.ascontiguousarray(rows).view(f"S{LENGTH - COVER}").ravel(), return_inverse=True)
    return out


def repeated_windows(bucket: np.ndarray, text: np.ndarray, begins: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which windows occur twice. Segment i is text[begins[i]:begins[i + 1]], its windows begin at 0..windows[i] - 1, and
    ``bucket`` is the gram that they share.

    The suffixes at the windows are sorted by bucket and distance from its gram, by their first COVER bytes, by the rank of the
    cover sample that follows, and by their last COVER bytes; whatever is alone after a step is not compared further."""
    owner = np.repeat(np.arange(len(windows)), windows)
    at = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    away = _away(prefix(text), bucket, begins, at)
    out = np.zeros(len(at), bool)
    live = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    steps = (
        lambda i: [bucket[owner[i]], away[i]],
        lambda i: _columns(text, at[i], COVER),
        None,
        lambda i: _columns(text, at[i] + LENGTH - COVER, COVER),
    )
    for step in steps:
        if step is None:
            places, place = np.unique(at[live] + _STEP[(-away[live]) % COVER], return_inverse=True)
            keys = [cover_ranks(text, places)[place]]
        else:
            keys = step(live)
        order, new = _sorted_by(group, keys)
        number = np.cumsum(new) - 1
        several = (np.bincount(number) > 1)[number]
        live, group = live[order][several], number[several]
        if not len(live):
            return out
    out[live] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last+1 of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """text_hash and runs (array of first byte and last byte + 1, may overlap) of the texts that repeat something."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("dk", F.xxhash64("text"))

    def grams(batches):
        for batch in batches:
            for _, _, data, offsets in parts_of(batch.column(0)):
                a, _, _, _, _, within = blocks(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(within + 1)], names=["a", "k"])

    counted = keyed.select("text").mapInArrow(grams, "a long, k long").groupBy("a").agg(F.sum("k").alias("count"))
    sent = spark.sparkContext.broadcast(bitmap(counted.where("count > 1"), "a"))

    def candidates(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for first, base, data, offsets in parts_of(batch.column(0)):
                a, begin, doc, at, count, within = blocks(data, offsets)
                use = among(sent.value, a)
                whole = memoryview(np.ascontiguousarray(data))
                digest = np.array([xxhash.xxh3_64_intdigest(whole[x : x + m - 1 + LENGTH]) for x, m in zip(begin[use].tolist(), count[use].tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(a[use]), signed(digest), keys[first + doc[use]], base + at[use], count[use], within[use])], names=["a", "bh", "dk", "s", "m", "k"])

    found = keyed.select("text", "dk").mapInArrow(candidates, "a long, bh long, dk long, s long, m long, k long")
    rows = written(found.groupBy("a", "bh", "dk", "s", "m").agg(F.count("*").alias("c"), F.max("k").alias("k")))
    classes = written(rows.groupBy("a", "bh").agg(F.sum("c").alias("n"), F.min(F.struct("dk", "s")).alias("one"), F.min("m").alias("m"), F.max("k").alias("k")))
    buckets = classes.groupBy("a").agg(F.sum(F.col("n") + F.col("k")).alias("total"), F.count("*").alias("kinds"), F.min("n").alias("least"))
    mixed = written(buckets.where("total > 1 and least = 1").select("a", "kinds"))
    wanted = classes.join(mixed, "a").select("a", "bh", "n", "m", "kinds", F.col("one.dk").alias("dk"), F.col("one.s").alias("s"))
    asked = written(wanted.groupBy("dk").agg(F.collect_list(F.struct("a", "bh", "n", "m", "kinds", "s")).alias("blocks")))
    docs_sent = spark.sparkContext.broadcast(bitmap(asked, "dk"))

    def asked_for(batches):
        for batch in batches:
            yield batch.filter(pa.array(among(docs_sent.value, batch.column(1).to_numpy())))

    texts = keyed.select("text", "dk").mapInArrow(asked_for, "text string, dk long").groupBy("dk").agg(F.any_value("text").alias("text")).join(asked, "dk")

    def segments(batches):
        """Each block's text, in parts where the bucket has many blocks."""
        for batch in (part for batch in batches for part in slices(batch, 128)):
            out = []
            for text, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for b in wants:
                    s, m = b["s"], b["m"]
                    block = raw[s : s + m - 1 + LENGTH]
                    if b["kinds"] <= MANY:
                        out.append((b["a"], 0, 0, None, b["bh"], b["n"], 0, m, block))
                        continue
                    # windows of some distances from the gram go to one part, with those that have the same bytes where
                    # all windows of these distances overlap
                    step = (LENGTH - GRAM + 1) // PARTS
                    body = np.frombuffer(block, np.uint8)
                    away = _away(prefix(body), np.array([b["a"]]).view(np.uint64), np.array([0, len(body)]), np.arange(m))
                    part = away // step
                    edge = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(away) != -1)) + 1).tolist(), m]
                    for x, y in zip(edge[:-1], edge[1:], strict=True):
                        p = int(part[x])
                        gram = x + int(away[x])
                        core = xxhash.xxh3_64_intdigest(block[gram - p * step : gram - (p + 1) * step + 1 + LENGTH])
                        own = block[x : y - 1 + LENGTH]
                        out.append((b["a"], p, core - (1 << 63), xxhash.xxh3_64_intdigest(own) - (1 << 63), b["bh"], b["n"], x, y - x, own))
            columns = list(zip(*out, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 8 + [pa.binary()], strict=True)], names=["a", "part", "core", "seg", "bh", "n", "skip", "m", "body"])

    laid = written(texts.select("text", "blocks").mapInArrow(segments, "a long, part long, core long, seg long, bh long, n long, skip long, m long, body binary"))
    # of equal segments of a crowded bucket one is sorted; where there are two, all their windows repeat
    crowd = laid.where("seg is not null")
    keys = ("a", "part", "core")
    # a segment that occurs once has one block, which its row names: verdicts need not be joined back to it
    one = written(crowd.groupBy(*keys, "seg").agg(F.sum("n").alias("n"), F.min("m").alias("m"), F.any_value("body").alias("body"), F.min(F.struct("bh", "skip")).alias("block")))
    large = written(one.groupBy(*keys).agg(F.count("*").alias("segments")).where(F.col("segments") > MOST).select(*keys))
    segment = [*keys, F.col("block.bh").alias("bh"), F.col("block.skip").alias("skip"), "n", "m", "body"]
    sorted_ = laid.where("seg is null").select(*keys, "bh", "skip", "n", "m", "body").unionByName(one.join(large, [*keys], "left_anti").select(*segment))

    def window_digests(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            a, bh, skip, n, m = (batch.column(k).to_numpy() for k in range(5))
            owner = np.repeat(np.arange(batch.num_rows), m)
            digest = [xxhash.xxh3_64_intdigest(body[x : x + LENGTH]) for body, windows in zip(batch.column(5).to_pylist(), m.tolist(), strict=True) for x in range(windows)]
            x = skip[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[owner], signed(np.array(digest, np.uint64)), bh[owner], x, n[owner])], names=["a", "w", "bh", "x", "n"])

    apart = written(one.join(large, [*keys], "left_semi").select("a", F.col("block.bh").alias("bh"), F.col("block.skip").alias("skip"), "n", "m", "body").mapInArrow(window_digests, "a long, w long, bh long, x long, n long"))
    twice = apart.groupBy("a", "w").agg(F.count("*").alias("c")).where("c > 1").select("a", "w")
    counted_ = apart.where("n = 1").join(twice, ["a", "w"], "left_semi").select("a", "bh", "x", (F.col("x") + 1).alias("y"))

    def settle(batches):
        """Bucket after bucket; a bucket is complete within its task."""
        held: list = []

        def done() -> pa.RecordBatch:
            a, bh, skip, n, m, body = (np.array(c) if k != 5 else c for k, c in enumerate(zip(*((r[0], *r[3:]) for r in held), strict=True)))
            begins = np.concatenate([[0], np.cumsum([len(x) for x in body])])
            flags = repeated_windows(a.view(np.uint64), np.frombuffer(b"".join(body), np.uint8), begins, m)
            out, at = [], 0
            for i in range(len(m)):
                if n[i] == 1:
                    out += [(int(a[i]), int(bh[i]), int(skip[i]) + x, int(skip[i]) + y) for x, y in _runs(flags[at : at + m[i]])]
                at += m[i]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "bh", "x", "y"])

        size = 0
        for batch in (part for batch in batches for part in slices(batch)):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > HELD and row[:3] != held[-1][:3]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield done()

    settled = written(sorted_.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(settle, "a long, bh long, x long, y long"))
    same = one.where("n > 1").select(*keys, "seg")
    shared = crowd.where("n = 1").select(*keys, "seg", "bh", "skip", "m").join(same, [*keys, "seg"], "left_semi").select("a", "bh", F.col("skip").alias("x"), (F.col("skip") + F.col("m")).alias("y"))
    settled = settled.unionByName(counted_).unionByName(shared)
    verdicts = written(classes.where("n > 1").select("a", "bh", F.lit(0).cast("long").alias("x"), F.col("m").alias("y")).unionByName(settled))
    runs = rows.join(verdicts, ["a", "bh"]).select("dk", (F.col("s") + F.col("x")).alias("x"), (F.col("s") + F.col("y") - 1 + LENGTH).alias("y"))
    return written(runs.groupBy("dk").agg(F.collect_list(F.struct("x", "y")).alias("runs"))).withColumnRenamed("dk", "text_hash")


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[list[int]] = []
    for x, y in sorted(runs):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def cut(docs: DataFrame, fields: str, fn) -> DataFrame:
    """``fn(batch, texts as bytes, maximal runs)`` for all rows of ``docs``; only texts with a run are shuffled."""
    runs = repeated_runs(docs)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(runs, "text_hash"))
    place, names = docs.columns.index("text"), docs.columns
    # the row as one column: so no column of the user's can have the name of one of ours
    keyed = docs.select(F.struct(*names).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))

    def row(batch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(batch.column(0).flatten(), names=names)

    def whole(batches):
        for batch in batches:
            for b in slices(row(batch.filter(pa.array(~among(sent.value, batch.column(1).to_numpy()))))):
                yield fn(b, [(t or "").encode() for t in b.column(place).to_pylist()], [[]] * b.num_rows)

    def picked(batches):
        for batch in batches:
            yield batch.filter(pa.array(among(sent.value, batch.column(1).to_numpy())))

    def parts(batches):
        for batch in batches:
            for part in slices(batch):
                b = row(part)
                yield fn(b, [(t or "").encode() for t in b.column(place).to_pylist()], [merged([(r["x"], r["y"]) for r in x or []]) for x in part.column(2).to_pylist()])

    # written, so that no task runs two Python workers, one before and one after the join
    some = written(keyed.mapInArrow(picked, keyed.schema)).join(runs.withColumnRenamed("text_hash", "hash"), "hash", "left").select("doc", "hash", "runs")
    return keyed.mapInArrow(whole, fields).unionByName(some.mapInArrow(parts, fields))


def without_runs(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for x, y in runs:
        out.append(text[at:x])
        at = y
    return b"".join([*out, text[at:]])


def suffix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (doc_id, text)."""

    def fn(batch, texts, runs):
        removed = [sum(y - x for x, y in r) for r in runs]
        kept = [hashlib.sha256(without_runs(t, r)).hexdigest() for t, r in zip(texts, runs, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(r) for r in runs], pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", fn)


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with all repeated passages cut from the texts; broken characters at the edges go, too. Other
    columns stay; a null text stays null."""
    place, schema = docs.columns.index("text"), docs.schema

    def fn(batch, texts, runs):
        old = batch.column(place).to_pylist()
        new = [o if not r else without_runs(t, r).decode(errors="ignore") for o, t, r in zip(old, texts, runs, strict=True)]
        columns = [pa.array(new, pa.string()) if k == place else batch.column(k) for k in range(len(schema.names))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return cut(docs, schema, fn)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_digest(table(spark, sf_dir, "documents"))


#: The same rows, from every window of every text.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT row, p, hash(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT row, h, unnest(range(length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400)
), r AS (
  SELECT row, p FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)
), n AS (
  SELECT row, p, CASE WHEN p <= lag(p) OVER (PARTITION BY row ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM r
), g AS (
  SELECT row, p, sum(new) OVER (PARTITION BY row ORDER BY p) AS run FROM n
), b AS (
  SELECT row, run, min(p) AS a, max(p) + 200 AS z FROM g GROUP BY row, run
), c AS (
  SELECT b.row, b.a, b.z, coalesce(lag(b.z) OVER o, 0) AS before, row_number() OVER (PARTITION BY b.row ORDER BY b.a DESC) = 1 AS last FROM b WINDOW o AS (PARTITION BY b.row ORDER BY b.a)
), t AS (
  SELECT c.row, CAST(sum(c.z - c.a) AS BIGINT) AS n_removed, count(*) AS n_spans,
         string_agg(substr(d.h, 2 * c.before + 1, 2 * (c.a - c.before)) || CASE WHEN c.last THEN substr(d.h, 2 * c.z + 1) ELSE '' END, '' ORDER BY c.a) AS kept
  FROM c JOIN d USING (row) GROUP BY c.row
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(t.kept, d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (row)
"""
