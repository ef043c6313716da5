"""How far the sources of a language differ in the words that they use: an audit with exact integer arithmetic.

Words are counted by DuckDB inside Spark's tasks, first for runs of documents, then for shards: all rows of a language and a word
meet in one shard, by their hash. A shard gives sums for pairs of sources and its best words of each; Spark adds and ranks them.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Tables, table
from .terms import LETTERED, strings, word_stretches

#: A word counts in a language from so many documents on; so many words of a source are reported.
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
SCALE = 1_000_000_000
#: Bytes of words that DuckDB counts at one time, rows of counts that a task holds before it adds them up.
RUN_BYTES, HELD_ROWS = 4 << 20, 1 << 20
#: Groups (language, source) that are sent to all tasks at most; more are joined by a shuffle.
SENT_GROUPS = 50_000
#: Parts in which the best words of a source are ranked before the last ranking.
PARTS = 16

_COUNTS = "lang string, source string, term string, n long, documents long"
_KEPT = "lang string, source string, term string, n long, total long, one long"
_SUMS = "part string, lang string, source string, item string, n long, value decimal(38,0)"


def _database() -> duckdb.DuckDBPyConnection:
    """In memory, one thread, nothing on a disk."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": "", "preserve_insertion_order": False})


def _asked(db: duckdb.DuckDBPyConnection, sql: str, **tables: pa.Table) -> pa.Table:
    for name, value in tables.items():
        db.register(name, value)
    out = db.sql(sql).to_arrow_table()
    for name in tables:
        db.unregister(name)
    return out


def _batches(found: pa.Table, schema: pa.Schema):
    yield from found.cast(schema).to_batches(max_chunksize=1 << 16)


_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("documents", pa.int64())])
_KEPT_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("one", pa.int64())])
_SUMS_ARROW = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("value", pa.decimal128(38, 0))])


def _counted(batches):
    """(lang, source, text) to the counts of runs of documents. A row is a document; the stretches of a long one are added up first."""
    db = _database()
    for batch in batches:
        labels = pa.table({"doc": pa.array(range(batch.num_rows), pa.int64()), "lang": batch.column(0), "source": batch.column(1)})
        tokens, size, held, rows = [], 0, [], 0

        def counted():
            """The tokens so far as rows of document and word."""
            return _asked(db, "SELECT doc, term, count(*) AS n FROM t GROUP BY doc, term", t=pa.concat_tables(tokens))

        def summed():
            each = "SELECT doc, term, sum(n) AS n FROM t GROUP BY doc, term"
            return _asked(db, f"SELECT lang, source, term, sum(n) AS n, count(*) AS documents FROM ({each}) JOIN labels USING (doc) GROUP BY lang, source, term", t=pa.concat_tables(held), labels=labels)

        for doc, norm, start, end, whole in word_stretches(batch.column(2), LETTERED):
            tokens.append(pa.table({"doc": pa.array(doc), "term": strings(norm, start, end)}))
            size += len(norm)
            if size >= RUN_BYTES:
                held.append(counted())
                rows, tokens, size = rows + held[-1].num_rows, [], 0
                if rows >= HELD_ROWS and whole:
                    yield from _batches(summed(), _COUNTS_ARROW)
                    held, rows = [], 0
        if tokens:
            held.append(counted())
        if held:
            yield from _batches(summed(), _COUNTS_ARROW)


def _merged(least: int):
    """Counts of a shard to its kept words: total is the language's count, ``one`` marks one row of each word."""
    add = "SELECT lang, source, term, sum(n) AS n, sum(documents) AS documents FROM t GROUP BY lang, source, term"

    def run(batches):
        db, held, rows = _database(), [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 2 * HELD_ROWS:
                held = _asked(db, add, t=pa.Table.from_batches(held)).cast(_COUNTS_ARROW).to_batches()
                rows = 0
        if held:
            kept = f"""WITH g AS ({add}) SELECT lang, source, term, n, sum(n) OVER w AS total, (source = min(source) OVER w)::BIGINT AS one
                FROM g WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(documents) OVER w >= {least}"""
            yield from _batches(_asked(db, kept, t=pa.Table.from_batches(held)), _KEPT_ARROW)

    return run


def _summed(top: int):
    """Kept words of a shard, with the sizes of their group and language, to partial sums of pairs, counts of counts and best words.

    A pair's sum over all words is V f(p0, q0), what each side's own words change in that, and what words of both change again;
    p0 is the share of a word that a source doesn't have. Only the last part needs both sources of a word.
    """
    f = "((({0}) - ({1})) * (({0}) - ({1}))) // ({1})"
    both = f"{f.format('a.p', 'b.p')}::HUGEINT - {f.format('a.p', 'b.p0')} - {f.format('a.p0', 'b.p')} + {f.format('a.p0', 'b.p0')}"

    def run(batches):
        held = list(batches)
        if not held:
            return
        db = _database()
        db.register("t", pa.Table.from_batches(held))
        db.execute(f"""CREATE TEMP TABLE r AS SELECT lang, source, term, n, (1 + {SCALE}::HUGEINT * (n + 1) // (size + terms))::BIGINT AS p,
            (1 + {SCALE} // (size + terms))::BIGINT AS p0, (1 + {SCALE}::HUGEINT * (total + 1) // (lang_size + terms))::BIGINT AS q FROM t""")
        db.unregister("t")
        held.clear()
        pairs = f"SELECT 'pair' AS part, a.lang, a.source, b.source AS item, 0::BIGINT AS n, sum({both})::DECIMAL(38, 0) AS value FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL"
        counts = "SELECT 'count' AS part, lang, source, '' AS item, n, count(*)::DECIMAL(38, 0) AS value FROM r GROUP BY ALL"
        best = f"SELECT 'term' AS part, lang, source, term AS item, n, ({f.format('p', 'q')})::DECIMAL(38, 0) AS value FROM r WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {top}"
        for sql in (pairs, counts, best):
            yield from _batches(db.sql(sql).to_arrow_table(), _SUMS_ARROW)

    return run


def _f(p: str, q: str):
    return F.expr(f"cast((({p}) - ({q})) * (({p}) - ({q})) div ({q}) as decimal(38,0))")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: for each other source of the language the divergence over all kept words;
    part ``term``: the words that a source has beyond its language's share, the ``top`` best.

    A word is a run of letters or non-ASCII characters, A-Z lower-cased; a language keeps those of at least ``least`` documents. Every row
    is a document, repeated ones too. A null text, lang or source is ''; an empty text has no words, yet its group counts. A language that
    keeps no word has pairs of value 0. Equal values rank by the item's bytes. An empty table gives an empty result; other columns
    don't matter. A long text is counted in stretches. Runs jobs when called: counts are written once.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    named = docs.select(blank("lang"), blank("source"), blank("text"))
    kept = tables.write(named.mapInArrow(_counted, _COUNTS).repartition("lang", "term").mapInArrow(_merged(least), _KEPT))

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.sum("one").alias("terms"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = tables.write(groups.fillna(0, ["size", "lang_size", "terms"]))
    small = F.broadcast if groups.count() <= SENT_GROUPS else lambda df: df

    sized = kept.select("lang", "source", "term", "n", "total").join(small(groups), ["lang", "source"])
    sums = tables.write(sized.repartition("lang", "term").mapInArrow(_summed(top), _SUMS))
    tables.drop(kept)

    rare = F.expr(f"1 + {SCALE}L div (size + terms)")
    shares = groups.where("terms > 0").select("lang", "source", "size", "terms", rare.alias("p0"))
    item = shares.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = shares.join(small(item), "lang").where("source <> item").select("lang", "source", "item", (_f("p0", "q0") * F.col("terms")).alias("value"))
    seen = sums.where("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("words"))
    share = F.expr(f"cast(1 + (cast({SCALE} as decimal(38,0)) * (n + 1)) div (size + terms) as long)")
    seen = seen.join(small(shares), ["lang", "source"]).withColumn("p", share).join(small(item), "lang").where("source <> item")
    own = seen.select("lang", "source", "item", ((_f("p", "q0") - _f("p0", "q0")) * F.col("words")).alias("value"))
    other = seen.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), ((_f("q0", "p") - _f("q0", "p0")) * F.col("words")).alias("value"))
    common = sums.where("part = 'pair'").select("lang", "source", "item", "value")
    without = groups.where("terms = 0").select("lang", "source")
    none = without.join(without.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("decimal(38,0)").alias("value"))
    parts = [x.withColumn("value", F.col("value").cast("decimal(38,0)")) for x in (base, own, other, common, none)]
    pairs = parts[0]
    for one in parts[1:]:
        pairs = pairs.unionByName(one)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))

    order = [F.desc("value"), F.asc("item")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    words = sums.where("part = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value")).withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(PARTS)))
    words = ranked(words, "lang", "source", "deal").where(F.col("rank") <= top).drop("rank", "deal")
    words = ranked(words, "lang", "source").where(F.col("rank") <= top)
    out = ranked(pairs, "lang", "source").withColumn("part", F.lit("pair")).unionByName(words.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d)),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, v.term, coalesce(n.n, 0) AS n FROM g JOIN v ON g.lang = v.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s))::BIGINT AS p FROM c WINDOW s AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s))::BIGINT AS q FROM l WINDOW s AS (PARTITION BY lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
word AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM every
UNION ALL
SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM word
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200
"""
