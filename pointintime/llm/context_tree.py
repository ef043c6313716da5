"""Language-model scores: a unigram base and context-tree weighting over bytes.

Base: the sum over a text's tokens of log10((c + 0.1) / (N + 0.1 (V + 1))).

Model: every byte is eight binary decisions, each within the contexts of the last 0 to ``DEPTH`` bytes. A context's
node estimates a decision from its counts by Krichevsky and Trofimov; context-tree weighting mixes the
estimates of all depths, at each node one half for itself and one half for its children, so a node's
posterior weight follows from how well it coded the training text. Training counts are fixed when texts are scored. A
text is its bytes and an end (0xFF, never a byte of UTF-8) after ``DEPTH`` zero bytes; its score is log10 of its
probability, and -score * log2(10) / (bytes + 1) its code length per byte.

Counts of words and of byte grams come from whole texts of all training documents. Subtrees of depth two and more are
weighted by the task that holds their last two context bytes; the levels above are 256 * 255 numbers at most.
Scoring sends the most frequent ``FREQUENT`` words and grams to all tasks, a fixed bound; a text's other words and
grams meet their values in a join. So nothing that grows with the corpus is sent whole.

Null and empty texts: one token (the end), zero bytes and an end. Without training documents every count is 0
and each decision has probability one half. Repeated rows count as often as they stand, and get a score each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, remainder, signed, table, word_hashes, written

DEPTH = 4
FREQUENT = 1 << 19
#: Stands for the end of a document among the hashes of words.
END = np.uint64(0x5851F42D4C957F2D)
_HALF = np.log(0.5)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of every byte and end, packed to 40 bits, and the document of each."""
    n = len(offsets) - 1
    pad = DEPTH + 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros(len(data) + pad * n, np.int64)
    at = np.arange(len(data)) + pad * doc + DEPTH
    out[at] = data
    ends = offsets[1:] + pad * np.arange(n) + DEPTH
    out[ends] = 255
    at, doc = np.concatenate([at, ends]), np.concatenate([doc, np.arange(n)])
    key = out[DEPTH:].copy()
    for k in range(1, pad):
        key += out[DEPTH - k : len(out) - k] << (8 * k)
    return key[at - DEPTH], doc


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(docs: DataFrame) -> DataFrame:
    """kind (0 word, 1 gram), key, n (in all documents), t (in training documents); ``docs``: text, train."""

    def run(batches):
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            found: dict[tuple[int, int], list] = {}
            for first, last, data, offsets in pieces(batch.column(0)):
                h, doc = word_hashes(data, offsets)
                g, owner = grams(data, offsets)
                own = train[first:last]
                for kind, of, use in ((0, 1, signed(h[own[doc]])), (0, 1, np.full(int(own.sum()), signed(np.array([END]))[0])), (1, 1, g[own[owner]]), (1, 0, g[~own[owner]])):
                    found.setdefault((kind, of), []).append(np.unique(use, return_counts=True))
            for (kind, of), parts in found.items():
                keys, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n.astype(np.int64)), pa.array(n.astype(np.int64) * of)], names=["kind", "key", "n", "t"])

    return docs.mapInArrow(run, "kind int, key long, n long, t long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _bits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The node (1..255) and the decision of each of a byte's eight steps, as columns."""
    step = np.arange(8)
    return (1 << step) | (x[:, None] >> (8 - step)), (x[:, None] >> (7 - step)) & 1


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 1/2: Stirling's series after a shift by 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


def _weighted(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each node's decisions and the node's own posterior weight; ``below``: of its children."""
    own = _log_kt(zeros, ones)
    if below is None:
        return own, np.ones(len(keys))
    both = np.logaddexp(_HALF + own, _HALF + below)
    return both, np.exp(_HALF + own - both)


def subtrees(key: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """For grams of complete contexts of two bytes: the probability of each of their eight decisions as mixed from depth
    ``DEPTH`` up to 2, and the nodes of depth 2 with their log probability."""
    node, bit = _bits(key & 255)
    levels, below = [], None
    for depth in range(DEPTH, 1, -1):
        context = (key >> 8) & ((1 << (8 * depth)) - 1)
        seen = t > 0
        flat = ((context[seen, None] << 8) | node[seen]).ravel()
        count = np.repeat(t[seen], 8).astype(float)
        keys, place = np.unique(flat, return_inverse=True)
        ones = np.bincount(place, count * bit[seen].ravel(), minlength=len(keys))
        zeros = np.bincount(place, count, minlength=len(keys)) - ones
        if below is not None:  # nodes of the level below, summed for their parent
            up_keys, up = below
            parent = ((up_keys >> 8) & ((1 << (8 * depth)) - 1)) << 8 | (up_keys & 255)
            sums = np.bincount(np.searchsorted(keys, parent), up, minlength=len(keys))
        log_p, weight = _weighted(keys, zeros, ones, None if below is None else sums)
        levels.append((keys, zeros, ones, weight, context))
        below = keys, log_p
    p = np.full(node.shape, 0.5)
    for keys, zeros, ones, weight, context in levels:
        want = (context[:, None] << 8) | node
        at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
        if not len(keys):
            continue
        there = keys[at] == want
        estimate = (np.where(bit == 1, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1)
        p = np.where(there, weight[at] * estimate + (1 - weight[at]) * p, 0.5)
    keys, log_p = below
    top = levels[-1]
    return p, pd.DataFrame({"c1": (keys >> 8) & 255, "node": keys & 255, "zeros": top[1], "ones": top[2], "log_p": log_p})


def gram_values(counts: DataFrame) -> DataFrame:
    """key, n and value (log10 of the byte's probability in its context) of every gram of the corpus."""
    dealt = counts.where("kind = 1").select("key", "n", "t").repartition(F.expr("(key div 256) % 65536"))

    def weigh(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key, n, t = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in range(3))
        p, nodes = subtrees(key, t)
        none = np.full(len(nodes), -1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * 8, pa.int32()), pa.array(p.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), lists], names=["key", "n", "p"])
        values = nodes[["zeros", "ones", "log_p"]].to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * 3, pa.int32()), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(-1 - (nodes["c1"].to_numpy() * 256 + nodes["node"].to_numpy())), pa.array(none), lists], names=["key", "n", "p"])

    both = written(dealt.mapInArrow(weigh, "key long, n long, p array<double>"))
    rows = both.where("key < 0").groupBy("key").agg(F.sum(F.col("p")[0]).alias("zeros"), F.sum(F.col("p")[1]).alias("ones"), F.sum(F.col("p")[2]).alias("below")).toPandas()
    place = (-1 - rows["key"]).to_numpy(np.int64)
    zeros, ones, below = np.zeros((3, 65536))
    zeros[place], ones[place], below[place] = rows["zeros"], rows["ones"], rows["below"]
    log_p, weight = _weighted(place, zeros, ones, below)
    shape = lambda x: x.reshape(256, 256).sum(0)
    _, weight_0 = _weighted(np.arange(256), shape(zeros), shape(ones), shape(np.where(zeros + ones > 0, log_p, 0)))
    upper = (zeros, ones, weight), (shape(zeros), shape(ones), weight_0)

    def finish(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            p = batch.column(2).flatten().to_numpy().reshape(-1, 8)
            node, bit = _bits(key & 255)
            for (z, o, w), at in zip(upper, ((((key >> 8) & 255) << 8)[:, None] | node, node), strict=True):
                estimate = (np.where(bit == 1, o[at], z[at]) + 0.5) / (z[at] + o[at] + 1)
                p = np.where(z[at] + o[at] > 0, w[at] * estimate + (1 - w[at]) * p, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.log10(p).sum(1))], names=["key", "n", "value"])

    return both.where("key >= 0").mapInArrow(finish, "key long, n long, value double")


class Lookup:
    """Values of 64-bit keys in an open table: many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.int64(size - 1)
        self.place = np.full(size, -1, np.int32)
        self.keys, self.values, self.probes = keys, values, 0
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            self.probes += 1
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]
            lost = self.place[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(20)).astype(np.int64) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Where each key's value stands; -1 for keys that aren't there."""
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            at = self.place[slot]
            hit = at >= 0
            hit[hit] = self.keys[at[hit]] == keys[left[hit]]
            out[left[hit]] = at[hit]
            on = (at >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) & self.mask
            if not len(left):
                break
        return out


def _frequent(values: DataFrame) -> Lookup:
    """The most frequent rows (key, n, value), ``FREQUENT`` at most; equal counts stay together."""
    size = F.floor(F.log2("n") * 8).cast("int")
    steps = sorted(values.groupBy(size.alias("size")).count().collect(), reverse=True)
    total, least = 0, None
    for s, n in steps:
        total += n
        if total > FREQUENT:
            break
        least = s
    rows = values.where(size >= least).select("key", "value").toPandas() if least is not None else pd.DataFrame({"key": [], "value": []})
    return Lookup(rows["key"].to_numpy(np.int64), rows["value"].to_numpy(float))


def scored(docs: DataFrame, train) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of each row of ``docs`` (doc_id, text);
    ``train``: a condition on the rows that are learned from."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    counts = written(counted(rows.select("text", "train")))
    total, kinds = counts.where("kind = 0").agg(F.coalesce(F.sum("t"), F.lit(0)), F.count("*")).first()
    words = counts.where("kind = 0").select("key", "n", F.log10(F.col("t") + 0.1).alias("value"))
    values = written(gram_values(counts))
    sent = spark.sparkContext.broadcast((_frequent(words), _frequent(values)))
    unseen = float(np.log10(0.1))

    def run(batches):
        word_table, gram_table = sent.value
        for batch in batches:
            n = batch.num_rows
            tokens, known, base, score, rare = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), [[] for _ in range(n)]
            for first, last, data, offsets in pieces(batch.column(1)):
                k = last - first
                h, doc = word_hashes(data, offsets)
                g, owner = grams(data, offsets)
                h, doc = np.concatenate([signed(h), np.full(k, signed(np.array([END]))[0])]), np.concatenate([doc, np.arange(k)])
                tokens[first:last] = np.bincount(doc, minlength=k)
                for kind, lookup, keys, of, sums in ((0, word_table, h, doc, base), (1, gram_table, g, owner, score)):
                    at = lookup(keys)
                    hit = at >= 0
                    sums[first:last] = np.bincount(of[hit], lookup.values[at[hit]], minlength=k)
                    if not kind:
                        known[first:last] = np.bincount(of[hit], minlength=k)
                    for d, x in zip(of[~hit].tolist(), keys[~hit].tolist(), strict=True):
                        rare[first + d].append((kind, x))
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rare])])
            flat = [x for r in rare for x in r]
            pairs = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int64())], names=["kind", "key"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            size = pa.array([len((x or "").encode()) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), size, lists], names=["doc_id", "train", "n_tokens", "known", "base", "score", "n_bytes", "rare"])

    fields = "doc_id long, train boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<struct<kind:int,key:long>>"
    partly = rows.select(F.col("doc_id").cast("long"), "text", "train").mapInArrow(run, fields)
    partly = written(partly.withColumn("row", F.monotonically_increasing_id()))
    rest = partly.select("row", F.explode("rare").alias("r")).groupBy("row", F.col("r.kind").alias("kind"), F.col("r.key").alias("key")).agg(F.count("*").alias("times"))
    of = words.select(F.lit(0).alias("kind"), "key", "value").unionByName(values.select(F.lit(1).alias("kind"), "key", "value"))
    found = rest.join(of, ["kind", "key"], "left").groupBy("row").agg(
        F.sum(F.when(F.col("kind") == 0, F.coalesce("value", F.lit(unseen)) * F.col("times")).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(F.col("kind") == 1, F.col("value") * F.col("times")).otherwise(0.0)).alias("more_score"),
        F.sum(F.when((F.col("kind") == 0) & F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    out = partly.drop("rare").join(found, "row", "left")
    bottom = float(np.log10(total + 0.1 * (kinds + 1)))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"), "n_bytes")


def op8_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, remainder(F.col("doc_id"), 10) != 0).drop("n_bytes")
