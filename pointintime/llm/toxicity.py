"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

The kernel of two strings is the number of three-letter subsequences they share, each weighted by
DECAY to the power of the letters that it spans in both; spans over ``SPAN`` letters count nothing. So
gaps and inserted letters cost weight, but don't hide a word. Kernels are normalised to 1 for equal
strings. Landmarks z give the map phi(s) = K_zz^(-1/2) k_z(s), and a linear machine with squared hinge
loss on phi is trained. Its margin is linear in k_z(s), hence in the weighted subsequences of s: scoring a
string is a sum over its letter triples of one table of ``ALPHABET``**3 weights, divided by the string's norm.

Strings are the words of a sentence, after punctuation within them is taken out and single letters in a row
("i d i o t") are joined; a sentence's margin is the largest of its words', a text's that of its sentences.
Training sentences come from labelled documents: all sentences of a clean document are negative; a
sentence of a toxic document is positive where it holds a string that marks toxic documents (by the
likelihood ratio of its document counts, corrected for the number of strings that could pass at all). They are
found in rounds, each among the toxic documents that hold none found so far (``marking``). Nothing depends on how rows are dealt
to tasks. Negatives are drawn at random, then once more among the strings
of clean documents with the largest margins. The toxic shares of labelled texts, made monotone, turn margins into probabilities.

Fitting takes a bounded sample of about ``MAX_SAMPLE`` labelled documents; scores use all rows and
whole texts, long ones a stretch at a time. Null and empty texts have no string and get the lowest score; repeated rows
get a score each; of several labels of one id
the largest counts; without toxic labels every score is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, appended, mix, pieces, remainder, share, signed, slices, table, texts, word_hashes, written

MAX_SAMPLE = 8_000
THRESHOLD = 0.3
DECAY = 0.7
SPAN = 6
LENGTH = 18
LANDMARKS = 128
#: Where there are more positive strings than landmarks for them, so many of them are landmarks at most.
POSITIVE_LANDMARKS = 1_024
#: The chance that any string without a link to toxic documents becomes positive.
ERROR = 0.05
#: Strings under this share of the strongest one's likelihood ratio are judged again in the next round.
BESIDE = 0.2
#: Strings of clean documents that are drawn as negatives; half as many are the worst of all.
MAX_STRINGS = 3_000
RIDGE = 0.05
#: Strings that get their margins at a time, bytes of text whose strings are found at a time, and margins that a task remembers.
SLICE, STRETCH, REMEMBERED = 4_096, 1 << 18, 100_000
#: Bytes that two stretches of a long text have in common.
OVERLAP = 256
_MARKS = bytes(i for i in range(33, 128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122))
_LOWER = bytes(SPACED)
_SINGLES = re.compile(rb"(?:(?<= )|^)(?:[a-z0-9] +){3,}[a-z0-9](?= |$)")
#: Letters are numbers below this: 1 to 26 for a to z, 27 for digits, the last for a string's beginning, and the rest for other
#: characters by their code points.
ALPHABET = 64
_BEGIN = ALPHABET - 1


def _codes() -> np.ndarray:
    """The letter of every code point, 0 for marks. Neighbours in Unicode, as the letters of one script are, differ."""
    low = np.arange(0x110000)
    for c in (*range(0xC0, 0x590), *range(0x10A0, 0x10FF), *range(0x1E00, 0x2000), *range(0xFF21, 0xFF3B)):
        low[c] = ord(chr(c).lower()[0])
    out = 28 + low % (_BEGIN - 28)
    out[:128] = 0
    out[48:58] = 27
    out[65:91] = out[97:123] = np.arange(1, 27)
    return out


_CODE = _codes()


def _letters(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all strings one after another, and how many each has (characters that are none are left out)."""
    data = np.frombuffer(b"".join(many), np.uint8)
    owner = np.repeat(np.arange(len(many)), [len(s) for s in many])[(data & 0xC0) != 0x80]
    c = _CODE[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    return c[c > 0], np.bincount(owner[c > 0], minlength=len(many))
_TRIPLES = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def strings(text: bytes) -> set[bytes]:
    """The different strings of a text."""
    norm = text.translate(_LOWER, _MARKS)
    out = set(norm.split())
    out.update(m.group().replace(b" ", b"") for m in _SINGLES.finditer(norm))
    return out


def coded(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers, a row for each ``LENGTH`` letters (rows of a long string overlap by half), and
    the string of each row. ``_BEGIN`` marks a string's beginning, 0 stands for nothing."""
    parts, owner = [], []
    letters, size = _letters(many)
    ends = np.cumsum(size)
    for k, (a, b) in enumerate(zip((ends - size).tolist(), ends.tolist(), strict=True)):
        c = np.concatenate([[_BEGIN], letters[a:b]])
        for at in range(0, max(1, len(c) - LENGTH // 2), LENGTH // 2) if len(c) > LENGTH else (0,):
            parts.append(c[at : at + LENGTH])
            owner.append(k)
    out = np.zeros((len(parts), LENGTH + SPAN), np.int64)
    size = np.array([len(p) for p in parts], int)
    out[np.repeat(np.arange(len(parts)), size), np.concatenate([np.arange(n) for n in size]) if len(parts) else []] = np.concatenate(parts) if parts else []
    return out, np.array(owner, int)


def coded_fast(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``coded`` for many strings at once."""
    c, size = _letters(many)
    owner, n = np.repeat(np.arange(len(many)), size), size + 1
    long = np.flatnonzero(n > LENGTH)
    begin = np.concatenate([[0], np.cumsum(n - 1)])[:-1]
    at = np.arange(len(c)) - begin[owner] + 1
    out = np.zeros((len(many), LENGTH + SPAN), np.int64)
    out[:, 0] = _BEGIN
    short = at < LENGTH
    out[owner[short], at[short]] = c[short]
    if len(long):
        more, who = coded([many[k] for k in long])
        first = np.concatenate([[True], who[1:] != who[:-1]])
        return np.concatenate([out, more[~first]]), np.concatenate([np.arange(len(many)), long[who[~first]]])
    return out, np.arange(len(many))


def _triples(x: np.ndarray):
    """For each place and gap pattern: the triples' codes (0 where there is none) and their weight."""
    for i in range(LENGTH - 2):
        one = x[:, i]
        for a, b in _TRIPLES:
            two, three = x[:, i + a], x[:, i + b]
            yield (one * ALPHABET + two) * ALPHABET + three, three > 0, DECAY ** (b + 1)


def norms(x: np.ndarray) -> np.ndarray:
    """The square root of each string's kernel with itself."""
    parts = list(_triples(x))
    codes = np.stack([np.where(ok, code, 0) for code, ok, _ in parts], 1)
    weight = np.stack([np.where(ok, w, 0.0) for _, ok, w in parts], 1)
    order = np.argsort(codes, 1)
    codes, weight = np.take_along_axis(codes, order, 1), np.take_along_axis(weight, order, 1)
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    total = np.bincount(group, weight.ravel())
    row = np.repeat(np.arange(len(x)), codes.shape[1])[new.ravel()]
    return np.sqrt(np.bincount(row, total**2, minlength=len(x))) + 1e-9


def table_of(x: np.ndarray) -> np.ndarray:
    """The normalised weights of all triples, a column for each string."""
    out = np.zeros((ALPHABET**3, len(x)), np.float32)
    for code, ok, w in _triples(x):
        rows = np.flatnonzero(ok)
        np.add.at(out, (code[rows], rows), w)
    return out / norms(x).astype(np.float32)


def kernels(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernels of strings and landmarks (``table_of`` them)."""
    out = np.zeros((len(x), landmarks.shape[1]))
    for code, ok, w in _triples(x):
        out += landmarks[code] * (w * ok)[:, None]
    return out / norms(x)[:, None]


class SubsequenceSVM:
    """The trained machine: one weight for each triple, a bias, and the curve from margins to probabilities."""

    def __init__(self, positive: list[bytes], negative: list[bytes], seed: int = 0):
        rng = np.random.default_rng(seed)
        words = [s.decode() for s in positive]
        spread = [(s[: (k := int(rng.integers(1, len(s))))] + chr(int(rng.integers(97, 123))) + s[k:]).encode() for s in words if len(s) > 3 for _ in range(2)]
        strings_ = positive + spread + negative
        x, owner = coded(strings_)
        y = np.where(owner < len(positive) + len(spread), 1.0, -1.0)
        own = np.flatnonzero(owner < len(positive))
        n_marks = min(len(own), POSITIVE_LANDMARKS)
        marks = np.concatenate([own[np.arange(n_marks) * len(own) // max(1, n_marks)], np.flatnonzero(y < 0)[: LANDMARKS // 4]])
        blocks = [marks[at : at + LANDMARKS] for at in range(0, len(marks), LANDMARKS)]
        against = lambda rows: np.concatenate([kernels(rows, table_of(x[b])) for b in blocks], 1)
        gram = against(x[marks])
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        use = value > 1e-6 * value.max()
        root = vector[:, use] / np.sqrt(value[use])
        phi = against(x) @ root
        phi = np.concatenate([phi, np.ones((len(phi), 1))], 1)
        cost = np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0).clip(0.1, 20)
        loss = lambda v: RIDGE * v @ v + (cost * np.maximum(0, 1 - y * (phi @ v)) ** 2).sum()
        w = np.zeros(phi.shape[1])
        for _ in range(60):  # Newton steps for the squared hinge loss, halved until the loss falls
            on = y * (phi @ w) < 1
            a = phi[on] * cost[on, None]
            step, now = np.linalg.solve(a.T @ phi[on] + RIDGE * np.eye(len(w)), a.T @ y[on]) - w, loss(w)
            size = 1.0
            while size > 1e-4 and loss(w + size * step) > now:
                size /= 2
            if size <= 1e-4 or np.abs(size * step).max() < 1e-7:
                break
            w = w + size * step
        each = root @ w[:-1]
        self.weights = sum(table_of(x[b]) @ each[at * LANDMARKS : (at + 1) * LANDMARKS] for at, b in enumerate(blocks)).astype(np.float32)
        self.bias = float(w[-1])
        self.knots, self.shares = np.array([-1.0, 1.0]), np.array([0.0, 1.0])

    def margins(self, many: list[bytes]) -> np.ndarray:
        """The margin of each string."""
        out = np.full(len(many), self.bias - 1.0)
        for at in range(0, len(many), SLICE):
            x, owner = coded_fast(many[at : at + SLICE])
            total = np.zeros(len(x), np.float32)
            square = np.zeros(len(x), np.float32)
            for i in range(LENGTH - 2):
                live = np.flatnonzero(x[:, i + 2])
                if not len(live):
                    break
                y = x[live]
                one = y[:, i] * ALPHABET
                for a, b in _TRIPLES:
                    three = y[:, i + b]
                    ok = three > 0
                    total[live] += self.weights[(one + y[:, i + a]) * ALPHABET + three] * (ok * np.float32(DECAY ** (b + 1)))
                    square[live] += ok * np.float32(DECAY ** (2 * b + 2))
            # the norm is the least where no triple repeats: strings that could matter get the exact one
            exact = np.flatnonzero(total > 0)
            scale = np.sqrt(np.maximum(square, 1e-9))
            if len(exact):
                scale[exact] = norms(x[exact])
            np.maximum.at(out, at + owner, total / scale + self.bias)
        return out

    def fit_probability(self, margin: np.ndarray, toxic: np.ndarray) -> None:
        """A curve that never falls through the margins of labelled texts: neighbours whose toxic shares fall are pooled until none do."""
        order = np.lexsort((toxic, margin))
        pools: list[list[float]] = []  # toxic texts, texts, sum of margins
        for m, t in zip(margin[order].tolist(), toxic[order].tolist(), strict=True):
            pools.append([t, 1.0, m])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
        self.knots = np.array([m / n for _, n, m in pools])
        self.shares = np.array([(t + 0.1) / (n + 0.2) for t, n, _ in pools])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        """Between the pools' means along straight lines; a small part rises with the margin everywhere."""
        return 0.99 * np.interp(margin, self.knots, np.maximum.accumulate(self.shares)) + 0.01 / (1 + np.exp(-np.clip(4 * margin, -40, 40)))


def stretches(text: memoryview) -> Iterator[bytes]:
    """A text a stretch at a time; stretches of a long one begin and end between words where they can."""
    at, n = 0, len(text)
    while n - at > 2 * STRETCH:
        part = bytes(text[at : at + STRETCH])
        end = max(part.rfind(b" "), part.rfind(b"\n"))
        end = end if end > STRETCH // 2 else STRETCH
        yield part[:end]
        back = part.find(b" ", end - OVERLAP, end)
        at += back if back > 0 else end - OVERLAP
    yield bytes(text[at:])


def _margins(column: pa.Array, model: SubsequenceSVM, seen: dict[int, dict[bytes, float]]) -> np.ndarray:
    """The largest margin of each text's strings; what is held at a time doesn't grow with the batch.

    ``seen`` remembers margins from batch to batch: those of the last ``REMEMBERED`` strings or so (0), and of as many before
    them (1), from which a string that comes again moves back; so frequent ones stay."""
    out = np.full(len(column), model.bias - 1.0)
    for first, last, data, offsets in pieces(column, STRETCH):
        whole = memoryview(data)
        each = [(k, strings(part)) for k in range(first, last) for part in stretches(whole[offsets[k - first] : offsets[k - first + 1]])]
        if len(seen.setdefault(0, {})) > REMEMBERED:
            seen[0], seen[1] = {}, seen[0]
        values, old = seen[0], seen.setdefault(1, {})
        new = set().union(*(s for _, s in each)).difference(values)
        again = new.intersection(old)
        values.update((s, old[s]) for s in again)
        new = list(new.difference(again))
        values.update(zip(new, model.margins(new).tolist(), strict=True))
        for k, own in each:
            out[k] = max(out[k], max(map(values.__getitem__, own), default=out[k]))
    return out


def least_ratio(found: dict[int, int], toxic_share: float) -> float:
    """The likelihood ratio above which a string is significant, by Bonferroni's correction over the strings that
    could reach it (Tarone): ``found`` has the number of strings by the number of their documents. A string of n
    documents reaches 2 n ln(1 / share) at most; a ratio of g has a chance below exp(-g / 2)."""
    left, most = sum(found.values()), 2 * math.log(1 / toxic_share) if toxic_share < 1 else 0.0
    for n in sorted(found):
        least = 2 * math.log(max(1, left) / ERROR)
        if most * n >= least:
            return least
        left -= found[n]
    return 2 * math.log(max(1, left) / ERROR)


def marking(held: dict[str, tuple[int, list[int]]], often: dict[int, int], n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """The strings that mark toxic documents, and all that would at first.

    ``held`` has for each string its clean documents and the rows of its toxic ones. A round takes the significant strings of which most
    documents are toxic and whose likelihood ratio is ``BESIDE`` of the strongest one's or more: weaker ones often just stand beside it.
    All others are judged again by the toxic documents that hold none of those, so that a rare string is judged among few
    documents; rounds end when none is significant.
    """
    names = sorted(held)
    c = np.array([held[s][0] for s in names], float)
    number: dict[int, int] = {}
    row = np.array([number.setdefault(r, len(number)) for s in names for r in held[s][1]], int)
    owner = np.repeat(np.arange(len(names)), [len(held[s][1]) for s in names])
    size = np.array([len(s) for s in names])
    open_, left = np.ones(len(row), bool), n_toxic
    kept: list[str] = []
    strong: list[str] = []
    while len(names) and left:
        t, base = np.bincount(owner[open_], minlength=len(names)).astype(float), left / (left + n_clean)
        expected = (t + c) * base
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.round(2 * (np.where(t > 0, t * np.log(t / expected), 0) + np.where(c > 0, c * np.log(c / (t + c - expected)), 0)), 6)
        ok = (t > expected) & (t > c) & (g > least_ratio(often, base))
        found = np.flatnonzero(ok & (g >= BESIDE * g[ok].max(initial=0)))
        found = found[np.lexsort((found, -size[found], -g[found]))]
        before = len(kept)
        for k in found.tolist():
            if not any(names[k].startswith(x) or x.startswith(names[k]) for x in kept):
                kept.append(names[k])
        strong = strong or [names[k] for k in found.tolist()]
        if len(kept) == before:
            break
        gone = np.zeros(len(number), bool)
        gone[row[open_ & np.isin(owner, found)]] = True
        open_ &= ~gone[row]
        left -= int(gone.sum())
    return kept, strong


def _families(sample: DataFrame) -> DataFrame:
    """One row of each group of copies with one label: those whose smallest hash of three words in a row is the same. Copies share rare
    words, which would mark toxic documents if each of them counted."""

    def hashed(batches):
        for batch in (part for batch in batches for part in slices(batch)):
            least = np.zeros(batch.num_rows, np.uint64)
            for first, last, data, offsets in pieces(batch.column(0)):
                h, doc = word_hashes(data, offsets)
                same = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, int)
                own = np.full(last - first, 0xFFFFFFFFFFFFFFFF, np.uint64)
                np.minimum.at(own, doc[same], mix(h[same] + np.uint64(3) * h[same + 1] + np.uint64(7) * h[same + 2]))
                few = np.flatnonzero(np.bincount(doc, minlength=last - first) < 3)
                alone = np.isin(doc, few)
                np.minimum.at(own, doc[alone], h[alone])
                least[first:last] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(least))], names=["text", "toxic", "family"])

    return sample.mapInArrow(hashed, "text string, toxic long, family long").groupBy("family", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def _labelled(docs: DataFrame, labels: DataFrame, max_sample: int, seed: int) -> DataFrame:
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = named.count()
    picked = named.where(share(F.col("doc_id"), f"t{seed}") < max_sample / max(n, 1))
    return docs.select("doc_id", "text").join(picked, "doc_id")


def train_toxicity(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, seed: int = 0) -> SubsequenceSVM | None:
    """``labels``: doc_id, toxic (1 or 0); only rows with a label are learned from."""
    known = written(_families(_labelled(docs, labels, max_sample, seed).select("text", (F.col("toxic") == 1).cast("long").alias("toxic"))))
    sample = written(known.withColumn("row", F.monotonically_increasing_id()))
    n_toxic, n_clean = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n_toxic:
        return None

    def held(batches):
        """Row, label and each of the row's strings, with their beginnings of four letters on."""
        for batch in (part for batch in batches for part in slices(batch)):
            data, offsets = texts(batch.column(0))
            whole = memoryview(data)
            rows, toxic, words = [], [], []
            for a, b, row, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = {w for w in (w.decode() for w in strings(bytes(whole[a:b]))) if len(w) > 2}
                own |= {w[:k] for w in own for k in range(4, min(len(w), 9))}
                words += own
                rows += [row] * len(own)
                toxic += [t] * len(own)
                if len(words) > REMEMBERED:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(toxic, pa.int64()), pa.array(words, pa.string())], names=["row", "toxic", "s"])
                    rows, toxic, words = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(toxic, pa.int64()), pa.array(words, pa.string())], names=["row", "toxic", "s"])

    pairs = sample.select("text", "row", "toxic").mapInArrow(held, "row long, toxic long, s string")
    counts = written(pairs.groupBy("s").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")))
    often = {r[0]: r[1] for r in counts.groupBy(F.least(F.col("t") + F.col("c"), F.lit(1_000)).alias("n")).count().collect()}
    likely = counts.where("t > c and t > 1")
    marks = pairs.where("toxic = 1").join(likely, "s").groupBy("s").agg(F.first("c").alias("c"), F.sort_array(F.collect_list("row")).alias("rows"))
    kept, strong = marking({r.s: (r.c, r.rows) for r in marks.orderBy("s").collect()}, often, n_toxic, n_clean)
    positive = [s.encode() for s in kept]
    if not positive:
        return None
    more = [s.encode() for s in strong if s not in kept and s.startswith(tuple(kept))]
    clean = counts.where("c > 0 and 2 * t <= c").select("s")
    kinds = clean.count()
    drawn = sorted(r[0].encode() for r in clean.where(share(F.col("s"), f"n{seed}") < MAX_STRINGS / max(1, kinds)).collect())
    drawn = [drawn[k] for k in np.random.default_rng(seed).permutation(len(drawn))]
    first = SubsequenceSVM(positive + more, drawn or [b"the"], seed)

    def hard(batches):
        for batch in batches:
            words = [w.encode() for w in batch.column(0).to_pylist()]
            m = first.margins(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m)], names=["s", "m"])

    worst = [r[0].encode() for r in clean.mapInArrow(hard, "s string, m double").orderBy(F.desc("m"), "s").limit(MAX_STRINGS // 2).collect()]
    model = SubsequenceSVM(positive + more, worst + drawn or [b"the"], seed)

    def scored(batches):
        seen: dict[int, dict[bytes, float]] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_margins(batch.column(0), model, seen)), batch.column(1)], names=["m", "toxic"])

    fit = np.array(sorted(tuple(r) for r in sample.select("text", F.col("toxic").cast("long")).mapInArrow(scored, "m double, toxic long").collect()), float)
    model.fit_probability(fit[:, 0], fit[:, 1])
    return model


def toxicity_scores(docs: DataFrame, model: SubsequenceSVM | None) -> DataFrame:
    """``docs`` with toxic_score (a column of that name is replaced)."""
    seen: dict[int, dict[bytes, float]] = {}

    def run(batch):
        return [np.zeros(batch.num_rows) if model is None else model.probability(_margins(batch.column("text"), model, seen))]

    return appended(docs, [("toxic_score", T.DoubleType(), pa.float64())], run)


def without_toxic(docs: DataFrame, model: SubsequenceSVM | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score under the threshold; its columns stay as they are."""
    if model is None:
        return docs

    def run(batches):
        seen: dict[int, dict[bytes, float]] = {}
        for batch in batches:
            yield batch.filter(pa.array(model.probability(_margins(batch.column("text"), model, seen)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def train_held_in(spark, sf_dir: str) -> SubsequenceSVM | None:
    """The model of the queries: labels only of rows whose remainder isn't 2."""
    training = remainder(F.col("doc_id"), 4) != 2
    return train_toxicity(table(spark, sf_dir, "documents").where(training), table(spark, sf_dir, "labels").where(training))


def op2_toxicity_ssk(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, train_held_in(spark, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
