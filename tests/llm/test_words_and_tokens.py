"""Source audit, BPE and lexical search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointintime.llm import bpe, divergence, lexical, terms

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
PATH = public_tokenizers.path("byte_bpe_50k.json")


def found(pattern, text):
    return [w.translate(LOWER) for w in re.findall(pattern, text or "")]


def audit(rows, least, top):
    """The contract word by word: every kept word in every group."""
    letters = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    rows = [(lang or "", source or "", found(letters, text)) for lang, source, text in rows]
    out = []
    for lang in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for _, _, w in own for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= least)

        def shares(words, kept=kept):
            c = Counter(words)
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}, c

        whole, _ = shares([t for _, _, w in own for t in w])
        groups = {s: shares([t for _, x, w in own if x == s for t in w]) for s in {x for _, x, _ in own}}
        for s, (p, c) in groups.items():
            pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, (q, _) in groups.items() if o != s]
            words = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if c[t] and p[t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", words, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(5)
    words = ["the", "Of", "naïve", "été", "Straße", "data", "x1y", "cat", "dog", "日本語", "EÉ"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for k in range(160):
        text = " ".join(rng.choice(words[: 8 + k % 40]) for _ in range(rng.randrange(0, 40)))
        rows.append((["en", "fr", None][k % 3], [f"s{k % 5}", None, ""][0 if k % 7 else 1 + k % 2], [text, None, "", "  \n"][0 if k % 11 else 1 + k % 3]))
    rows += rows[:9] + [("one", "a", "rare words here"), ("one", "b", "other words"), ("none", "a", None), ("none", "b", "1 2 3"), ("alone", "a", "x x x")]
    return rows + [("fr", "long", "Chat noir, " * 90_000 + "été " * 3 + "x" * 700_000)]


@pytest.mark.parametrize(("held", "sent", "top"), [(1 << 20, 50_000, 200), (10, 0, 4)])
def test_source_divergence(spark, sourced, held, sent, top, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    monkeypatch.setattr(divergence, "SENT_GROUPS", sent)
    docs = spark.createDataFrame([(k, *r, 7) for k, r in enumerate(sourced)], "n long, lang string, source string, text string, item int").repartition(5)
    got = divergence.source_divergence(docs, 3, top).collect()
    assert sorted(map(tuple, got)) == audit(sourced, 3, top)
    assert divergence.source_divergence(docs.where("false")).count() == 0


def rank_all(docs, items, limit):
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    counts = [(i, Counter(found(word, t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_all, l_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item in sorted({i for i, _ in items}):
        asked = {t for i, text in items if i == item for t in found(word, text)}
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:limit], 1)]
    return out


@pytest.mark.parametrize(("shard", "block"), [(8 << 20, 1 << 18), (600, 10)])
def test_lexical_search(spark, shard, block, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", block)
    rng = random.Random(3)
    words = [f"W{k}" for k in range(60)] + ["naïve", "Été", "don't", "a_b"]
    text = lambda: " ".join(words[min(int(rng.expovariate(0.08)), 63)] for _ in range(rng.randrange(1, 30)))
    docs = [(k, text()) for k in range(300)]
    docs += [(k, docs[7][1]) for k in range(300, 420)] + docs[:20] + [(None, docs[3][1]), (None, docs[3][1]), (500, None), (501, ""), (502, "- !"), (503, "w1 w2 filler_" * 60_000 + "w3")]
    items = [(k, text()) for k in range(12)] + [(12, docs[7][1]), (13, None), (14, "..."), (15, "unheard"), (5, "w59 w58")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, score int").repartition(4)
    index = lexical.build_index(frame)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in lexical.search(index, asked, limit=50).collect()]
    assert sorted(got, key=lambda r: r[:2]) == rank_all(docs, items, 50)
    assert lexical.search(lexical.build_index(frame.where("false")), asked).count() == 0
    assert lexical.search(index, asked.where("false")).count() == 0


def test_lexical_shards_are_row_groups(spark, tmp_path, monkeypatch):
    """A reader holds a row group at one time, so a task's memory doesn't grow with the shards of a file."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", 600)
    rng, kept, search = random.Random(4), [], lexical.search
    monkeypatch.setattr(lexical, "search", lambda index, *more: kept.append(index) or search(index, *more))
    docs = [(k, " ".join(f"w{rng.randrange(90)}" for _ in range(8))) for k in range(3000)] + [(3000, "w1 w2 " * 50_000)]
    items = [(k, f"w{k} w{k + 1} w{k + 50}") for k in range(9)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in lexical.op13_lexical_search(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[:2]) == rank_all(docs, items, 50)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept[0].inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 5 and max(groups) == 1


def encoded(table, texts):
    out = [[] for _ in texts]
    for first, last, ids, starts in bpe.encode_texts(table, pa.array(texts, pa.string())):
        for k in range(last - first):
            out[first + k] += ids[starts[k] : starts[k + 1]].tolist()
    return out


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def same(library, texts):
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoded(bpe.vocabulary(PATH), texts) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet=" '\tsltrevdm1a\n!é日\x85"), st.sampled_from(["<|endoftext|>", "<|endof", "text|>"])), max_size=8))
def test_bpe_as_the_library(parts):
    library = tokenizers.Tokenizer.from_file(PATH) if not hasattr(test_bpe_as_the_library, "kept") else test_bpe_as_the_library.kept
    test_bpe_as_the_library.kept = library
    same(library, [*parts, "".join(parts)])


def test_bpe_every_code_point_and_long_texts(library):
    every = [chr(c) for c in range(0x3500) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xA000, 0x20000, 13) if not 0xD800 <= c < 0xE000]
    same(library, [f"a{c}1 {c}b '{c}" for c in every])
    same(library, ["x" * 200_000 + " y" * 300_000, "ab " * 200_000 + "aab" * 60_000 + "<|endoftext|>" + "é" * 300_000, None, ""])


def test_bpe_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    monkeypatch.setattr(bpe, "RUN_BYTES", 50)
    monkeypatch.setattr(bpe, "NEW_BYTES", 4)
    rng = random.Random(2)
    same(library, ["".join(rng.choice("abc  d'") for _ in range(rng.randrange(60))) for _ in range(1500)])


def test_bpe_round_trip(spark, library):
    texts = ["Some text, isn't it?", None, "", "  \n", "日本 é\u0000x", "<|endoftext|>", "again", "again"]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(2)
    both = bpe.decode(bpe.encode(rows, PATH), PATH).withColumn("numbers", bpe.unpacked("ids"))
    for r in both.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.numbers == ids and bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(rows.where("false"), PATH).count() == 0
    assert [r.again for r in bpe.encode(rows, PATH, decoded="again").orderBy("doc_id").collect()] == [t or "" for t in texts]
    broken = spark.createDataFrame([(1, np.array([222, 100, 222], "<u4").tobytes())], "k int, ids binary")
    assert bpe.decode(broken, PATH).first().decoded == library.decode([222, 100, 222], skip_special_tokens=False)


def test_bpe_query(spark, library, tmp_path):
    texts = ["one two", None, "x" * 5000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe.op12_bpe_round_trip(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        digest = lambda b: hashlib.sha256(b).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest((texts[r.doc_id] or "").encode()))


def test_distinct_words_of_equal_hashes(monkeypatch):
    data = np.frombuffer(b"abcabdabcxxabd", np.uint8)
    start = np.array([0, 3, 6, 9, 11])
    end = np.array([3, 6, 9, 11, 14])
    monkeypatch.setattr(terms, "span_hash", lambda sums, a, b: np.zeros(len(a), np.uint64))
    first, which = terms.distinct(data, start, end)
    word = lambda k: data[start[k] : end[k]].tobytes()
    assert [word(first[w]) for w in which] == [word(k) for k in range(5)] and len(first) == 3
