"""Near-duplicate documents by SetSketch registers.

A document's set are its distinct word shingles (hashes of ``SHINGLE`` consecutive words). Its sketch has
``REGISTERS`` registers; register r of a set is the largest K = floor(1 - log_b x) over its elements, where x are
exponentially distributed with rate A, truncated to 0..LIMIT. Registers merge by maximum and are
locality-sensitive: the chance that one agrees grows with the Jaccard similarity.

1. Rows with the same set (found by a hash of the whole set) are one class, represented by one row; only
   representatives go on. So groups of copies are never expanded.
2. Bands of registers (6 at a threshold of 0.85, 5 at 0.8) are hashed to bucket keys; a link at the threshold is missed with
   a probability under 1e-8. Buckets with one representative go away.
3. Stars: in every bucket each member is paired with the member that shares most buckets with others, the likeliest centre of
   a group of copies. Pairs whose jointly estimated similarity is far below the threshold go; the others are verified on
   full sets. Verified links are closed transitively. What stays outside a bucket's largest component is then paired
   with ``PIVOTS`` members of that component at once.
4. What the stars leave are members outside their bucket's largest component. Where a bucket has few of them they are
   paired with the members of its other components; in the others, members are paired that have one of
   their rarest shingles in common, which loses no link (prefix filter). Members of one component are never paired.

The text of each representative that has a bucket in common with another is written once, with its sketch, and all rounds
verify from that table; tables of a round are removed when the next one is written.

Null and empty texts have an empty set, no link, and are their own component. A null id comes after all others: a
component of such rows only has a null component_id, and all of them are kept. Repeated rows are copies like any others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, mix, pieces, signed, slices, table, word_hashes

REGISTERS = 240
BASE_B = 1.02
RATE_A = 20.0
LIMIT = 1022
PIVOTS = 6
SLACK = 0.15
#: Buckets with more pairs than this left after the stars are compared by prefixes.
FEW = 64
_SLOTS = 1 << 20
_LOG_B = np.log(BASE_B)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents of a piece, and where each document's begin."""
    h, doc = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = mix(out + h[i : i + len(out)] + np.uint64(i + 1)) if len(out) else out
    whole = doc[: len(out)] == doc[k - 1 : k - 1 + len(out)] if len(out) else np.zeros(0, bool)
    values, owner = [out[whole]], [doc[: len(out)][whole]]
    begin = np.concatenate([[0], np.cumsum(count)])
    for d in np.flatnonzero((count > 0) & (count < k)).tolist():  # fewer words than a shingle: the sequence is one
        v = np.zeros(1, np.uint64)
        for i, x in enumerate(h[begin[d] : begin[d + 1]]):
            v = mix(v + x + np.uint64(i + 1))
        values.append(v + np.uint64(count[d]))
        owner.append(np.array([d]))
    v, o = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    return v, np.searchsorted(o, np.arange(n + 1))


_SEEDS = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64)).astype(np.uint32)
_ADD, _TIMES = _SEEDS[:REGISTERS], _SEEDS[REGISTERS:] | np.uint32(1)


def registers(values: np.ndarray) -> np.ndarray:
    """The sketch of one set."""
    if not len(values):
        return np.zeros(REGISTERS, np.int64)
    most = np.zeros(REGISTERS, np.uint32)
    for at in range(0, len(values), 1024):  # the largest hash gives the smallest exponential value
        h = (values[at : at + 1024, None].astype(np.uint32) ^ _ADD) * _TIMES
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        np.maximum(most, h.max(0), out=most)
    x = -np.log1p(-(2.0**32 - most - 0.5) / 2.0**32) / RATE_A
    return np.clip(np.floor(1 - np.log(x) / _LOG_B), 0, LIMIT).astype(np.int64)


def rows_of(percent: int) -> int:
    """Registers in a band: a link at the threshold is missed with a probability under 1e-8."""
    return 6 if percent >= 85 else 5 if percent >= 80 else 4 if percent >= 70 else 3


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity for each pair of sketches (rows), the set sizes being known.

    With D+ and D- the numbers of registers in which a or b is larger, the log-likelihood is
    D+ log p(u - vJ) + D- log p(v - uJ) + D0 log(1 - p(u - vJ) - p(v - uJ)),  p(x) = -log_b(1 - x (b - 1) / b),
    u and v being the shares of the sizes in their sum. A grid of J is enough for a filter.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = REGISTERS - more - less
    grid = np.linspace(0, 1, 101)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE_B - 1) / BASE_B) / _LOG_B
    for j in grid:
        up, down = p(u - v * j), p(v - u * j)
        like = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + equal * np.log(np.maximum(1 - up - down, 1e-12))
        like = np.where(j <= np.minimum(u / v, v / u) + 0.01, like, -np.inf)
        at = np.where(like > best, j, at)
        best = np.maximum(best, like)
    return at


def sketched(docs: DataFrame, k: int, rows: int) -> DataFrame:
    """id, n (set size), node (hash of the whole set), text_hash, sketch and bands; ``docs``: id, text."""

    def run(batches):
        for batch in (part for batch in batches for part in slices(batch, 2048)):
            n_set, code, sketch, bands = [], [], [], []
            for first, last, data, offsets in pieces(batch.column(1)):
                v, begin = shingles(data, offsets, k)
                for d in range(last - first):
                    own = v[begin[d] : begin[d + 1]]
                    n_set.append(len(own))
                    spread = mix(own + np.uint64(len(own)))
                    code.append(spread.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mix(spread), initial=np.uint64(len(own))))
                    r = registers(own)
                    sketch.append(r.astype(np.int16).tobytes())
                    key = np.arange(REGISTERS // rows, dtype=np.uint64)
                    for column in r.reshape(-1, rows).T.astype(np.uint64):
                        key = mix(key + column * np.uint64(0x9FB21C651E98DF25))
                    bands.append(signed(key))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * (REGISTERS // rows), pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            node = pa.array(signed(mix(np.array(code, np.uint64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_set, pa.int64()), node, batch.column(2), pa.array(sketch, pa.binary()), lists], names=["id", "n", "node", "text_hash", "sketch", "bands"])

    read = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    return read.mapInArrow(run, "id long, n long, node long, text_hash long, sketch binary, bands array<long>")


def _near(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, n_a, n_b, sketch_a, sketch_b) whose estimated similarity may reach ``least``."""

    def run(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            n = batch.num_rows
            sketch = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int16).reshape(n, REGISTERS) for c in (4, 5)]
            j = similarity(*sketch, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(j >= least - SLACK))

    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union; ``bodies``: node, text."""

    def run(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            keep = np.zeros(batch.num_rows, bool)
            last: dict[bytes, np.ndarray] = {}
            for i, both in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                sets = []
                for t in both:
                    if t not in last:
                        if len(last) >= 64:
                            last.clear()
                        last[t] = shingles(np.frombuffer(t, np.uint8), np.array([0, len(t)]), k)[0]
                    sets.append(last[t])
                shared = len(np.intersect1d(*sets, assume_unique=True))
                keep[i] = 100 * shared >= percent * (len(sets[0]) + len(sets[1]) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    rows = pairs.join(bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """x, y: all nodes of ``links`` (a, b) with the smallest node that each reaches, but for those smallest ones.

    Alternates large and small stars until every node has one edge and no root has any; rounds grow with the logarithm of
    the longest path. What is joined is written first, so that Spark can split the hub of a large star.
    """
    edges = tables.write(links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    while True:
        ends = edges.select(F.col("x").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("y").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            return edges
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = tables.write(both.groupBy("x").agg(F.least(F.min("y"), F.min("x")).alias("m")))
        large = tables.write(edges.select(F.col("y").alias("x"), F.col("x").alias("y")).join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct())
        low = tables.write(large.groupBy("x").agg(F.min("y").alias("m")))
        star = large.join(low, "x").select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y"))
        old, edges = edges, tables.write(star.where("x <> y").distinct())
        tables.drop(old, least, large, low)


def prefixes(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """node, token, place: the rarest n - ceil(n * percent / 100) + 1 shingles of each set (``texts``: node, text), in order.

    Two sets of the similarity have at least one such shingle in common, whatever fixed order decides what is rare; before
    the first one they share nothing, so what is left of both sets from there on bounds their intersection. The order is by counts of ``_SLOTS`` hash slots, a table of fixed size, then by hash.
    """

    def sets(batch):
        for t in batch.column(1).to_pylist():
            yield shingles(np.frombuffer(t, np.uint8), np.array([0, len(t)]), k)[0]

    def slots(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            found = np.concatenate([np.zeros(0, np.uint64), *sets(batch)]) & np.uint64(_SLOTS - 1)
            slot, n = np.unique(found.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

    rows = texts.mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_SLOTS, np.int64)
    counts[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            nodes, tokens, places = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for node, own in zip(batch.column(0).to_pylist(), sets(batch), strict=True):
                n = len(own) - (len(own) * percent + 99) // 100 + 1
                order = np.lexsort((own, sent.value[(own & np.uint64(_SLOTS - 1)).astype(np.int64)]))
                tokens.append(own[order[:n]])
                nodes.append(np.full(min(n, len(own)), node, np.int64))
                places.append(np.arange(min(n, len(own))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *nodes])), pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(places))], names=["node", "token", "place"])

    return texts.mapInArrow(rarest, "node long, token long, place long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text), and what rows can be told by that have
    no id or share one: text_hash, and component (the same for all rows of a component, null for empty sets)."""
    tables = Tables(docs.sparkSession)
    write, drop = tables.write, tables.drop
    base = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    known = write(sketched(base, shingle, rows_of(percent)))
    who = F.struct(F.col("id").isNull().alias("none"), "id")
    reps = write(known.where("n > 0").groupBy("node").agg(F.min(who).alias("who"), F.min("text_hash").alias("text_hash"), F.any_value(F.struct("n", "sketch", "bands")).alias("r")).select("node", "who", "text_hash", "r.*"))
    member = reps.select("node", F.explode("bands").alias("bucket"))
    sizes = write(member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    shared = write(member.join(sizes, "bucket").select("bucket", "node", "size"))
    central = write(shared.groupBy("node").agg(F.sum("size").alias("c")))
    buckets = write(shared.join(central, "node").select("bucket", "node", "c"))
    hubs = write(buckets.groupBy("bucket").agg(F.max(F.struct("c", "node")).alias("hub")).select("bucket", F.col("hub.node").alias("hub")))
    texts = base.groupBy(F.xxhash64("text").alias("text_hash")).agg(F.any_value("text").cast("binary").alias("text"))
    bodies = write(texts.join(reps.join(central, "node", "left_semi").select("node", "text_hash", "n", "sketch"), "text_hash").drop("text_hash"))
    drop(sizes, shared, central)

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (bodies.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        alike = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        near = write(_near(pairs.join(b, "b").join(a, "a").where(alike), percent / 100))
        found = write(verified(near, bodies, shingle, percent))
        drop(near)
        return found

    def joined(root: DataFrame, links: DataFrame) -> DataFrame:
        """``root`` (x, y: a node and its root) with the components that ``links`` connect as one."""
        for c in "ab":
            of = root.select(F.col("x").alias(c), F.col("y").alias(f"root_{c}"))
            links = links.join(of, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        met = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), tables)
        top = met.select(F.col("x").alias("y"), F.col("y").alias("top"))
        out = write(root.join(top, "y", "left").select("x", F.coalesce("top", "y").alias("y")).unionByName(met))
        drop(root, met)
        return out

    def left(root: DataFrame) -> tuple[DataFrame, DataFrame]:
        """bucket, node, root of the members of buckets with several components, with the largest one's root (top); and by
        bucket the members of that component (pivots) that the others are compared with."""
        placed = buckets.join(root, buckets["node"] == root["x"], "left").select("bucket", "node", F.coalesce("y", "node").alias("root"), "c")
        pivots = [F.max(F.struct("c", "node")).alias("p0"), *(F.max(F.struct(F.xxhash64("node", F.lit(r)).alias("c"), "node")).alias(f"p{r}") for r in range(1, PIVOTS))]
        groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), *pivots)
        best = F.struct("n", "root", F.array(*(F.col(f"p{r}.node") for r in range(PIVOTS))).alias("pivots"))
        split = groups.groupBy("bucket").agg(F.max(best).alias("best"), F.count("*").alias("kinds")).where("kinds > 1")
        split = write(split.select("bucket", F.col("best.root").alias("top"), F.col("best.pivots").alias("pivots")))
        return write(placed.join(split, "bucket").drop("c", "pivots")), split

    done = write(buckets.join(hubs, "bucket").where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    links = linked(done)
    root = components(links, tables)
    drop(hubs, links)
    rest, split = left(root)
    outer = rest.where("root <> top").join(split.select("bucket", F.explode("pivots").alias("pivot")), "bucket")
    outer = outer.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    pairs = write(outer.join(done, ["a", "b"], "left_anti"))
    drop(rest, split)
    links = linked(pairs)
    root = joined(root, links)
    drop(links)
    done = done.unionByName(pairs)

    rest, _ = left(root)
    main = F.col("root") == F.col("top")
    work = write(rest.groupBy("bucket").agg(F.count_if(~main).alias("minors"), F.count("*").alias("size")))
    few = rest.join(work.where(F.col("minors") * F.col("size") <= FEW).select("bucket"), "bucket")
    many = rest.join(work.where(F.col("minors") * F.col("size") > FEW).select("bucket"), "bucket")
    nodes = write(many.groupBy("node").agg(F.min("root").alias("root"), F.max(~main).alias("minor")))
    kept = prefixes(bodies.join(nodes, "node", "left_semi").select("node", "text"), shingle, percent).join(nodes, "node")
    both = few.select(F.col("bucket").alias("key"), "node", "root", (~main).alias("minor"), F.lit(0).cast("long").alias("place")).unionByName(kept.select(F.col("token").alias("key"), "node", "root", "minor", "place"))
    both = write(both.join(bodies.select("node", "n"), "node"))
    drop(rest, work, nodes)
    x = both.where("minor").select("key", F.col("node").alias("x"), F.col("root").alias("root_x"), F.col("n").alias("n_x"), (F.col("n") - F.col("place")).alias("left_x"))
    y = both.select("key", F.col("node").alias("y"), F.col("root").alias("root_y"), F.col("n").alias("n_y"), (F.col("n") - F.col("place")).alias("left_y"), "minor")
    alike = f"least(n_x, n_y) * 100 >= greatest(n_x, n_y) * {percent} and least(left_x, left_y) * {100 + percent} >= (n_x + n_y) * {percent}"
    pairs = x.join(y, (x["key"] == y["key"]) & F.expr(f"root_x <> root_y and (not minor or x < y) and {alike}")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = linked(pairs.join(done, ["a", "b"], "left_anti"))
    root = joined(root, links)
    drop(both, links, buckets, bodies)

    owned = write(reps.join(root, reps["node"] == root["x"], "left").select("node", "who", F.coalesce("y", "node").alias("root")))
    least = write(owned.groupBy("root").agg(F.min("who").alias("component")))
    classes = write(owned.join(least, "root").select(F.col("node").alias("class"), F.col("root").alias("component"), F.col("component.id").alias("least")))
    drop(reps, root, owned, least)
    out = known.select("id", "n", "text_hash", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(classes, F.col("node") == F.col("class"), "left")
    least = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), least.alias("component_id"), F.col("id").eqNullSafe(least).alias("kept"), "text_hash", "component")


def op9_setsketch_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("text_hash", "component")


#: The same rows, from all pairs of sets with a shingle in common.
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS shingles FROM d
), k AS (
  SELECT row, doc_id, CAST(len(shingles) AS BIGINT) AS n, md5(array_to_string(list_sort(shingles), chr(10))) AS class, shingles FROM s
), c AS (
  SELECT class, min(doc_id) AS id, any_value(n) AS n, any_value(shingles) AS shingles FROM k WHERE n > 0 GROUP BY class
), e AS (
  SELECT class, n, unnest(shingles) AS x FROM c
), p AS (
  SELECT a.class AS a, b.class AS b FROM e a JOIN e b ON a.x = b.x AND a.class < b.class AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r AS (
  SELECT class AS a, class AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), g AS (
  SELECT r.a AS class, min(c.id) AS component_id FROM r JOIN c ON c.class = r.b GROUP BY r.a
)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.n > 0 THEN g.component_id ELSE k.doc_id END AS component_id,
       k.n = 0 OR k.doc_id IS NOT DISTINCT FROM g.component_id AS kept
FROM k LEFT JOIN g ON k.n > 0 AND g.class = k.class
"""
