"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents marked good) and unlabelled documents are enough: with the class prior pi
the risk of a scorer g is  pi * R_P(g, +) + max(0, R_U(g, -) - pi * R_P(g, -)),  the non-negative
unbiased risk. The scorer is a small network over statistics of a whole text (bytes, words, repeated
words, word runs and lines); the loss is logistic, so its output is a probability.

The class prior is estimated from positives and unlabelled rows alone (labels other than positive are never read): a first scorer is
trained on one half of the sample; on the other half, the share of unlabelled rows above a score divided by the share of positives above it
is at least the prior, whatever the score, so the least of these ratios is taken, with an allowance for the sizes of the samples.

Fitting takes a bounded sample: about ``MAX_SAMPLE`` positives and as many unlabelled rows, drawn by a
hash of the id, twice as many at the very most (where an id is repeated). Scores are computed for all rows, whole texts. Null and empty texts are scored by their
(all zero) statistics; a null label is no label; of several labels of one id the largest counts; repeated rows get a
score each. With no positive at all every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, appended, mix, pieces, prefix, remainder, share, span_hash, table, words

MAX_SAMPLE = 8_000
THRESHOLD = 0.7
HIDDEN = 12
_LINES = np.arange(256, dtype=np.uint8)
_LINES[32] = 33
_LINES[10] = 32
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
_CLASS[128:] = 6
for _k, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[_c] = 7 + _k
_N_CLASS = 40
N_FEATURES = _N_CLASS + 10


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different values each document has."""
    if not len(h):
        return np.zeros(n)
    key = mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc[first], minlength=n).astype(float)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each document."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(owner * _N_CLASS + _CLASS[data], minlength=n * _N_CLASS).reshape(n, _N_CLASS) / size[:, None]
    norm, start, end, doc = words(data, offsets, SPACED)
    h = span_hash(prefix(norm), start, end)
    count = np.bincount(doc, minlength=n).astype(float)
    per_word = np.maximum(count, 1)
    letter = (_CLASS[data] == 1) | (_CLASS[data] == 2) | (_CLASS[data] == 6)
    marks = np.bincount(doc, (~letter[end - 1]).astype(float), minlength=n) / per_word
    three = h[2:] + np.uint64(3) * h[1:-1] + np.uint64(7) * h[:-2] if len(h) > 2 else h[:0]
    inside = doc[2:] == doc[:-2] if len(h) > 2 else np.zeros(0, bool)
    runs = np.bincount(doc[2:][inside], minlength=n) if len(h) > 2 else np.zeros(n)
    line_norm, line_start, line_end, line_doc = words(data, offsets, _LINES)
    lines = np.bincount(line_doc, minlength=n).astype(float)
    line_hash = span_hash(prefix(line_norm), line_start, line_end)
    length = (end - start).astype(float)
    extra = [
        np.log1p(count) / 10,
        np.bincount(doc, length, minlength=n) / per_word / 10,
        np.sqrt(np.maximum(np.bincount(doc, length**2, minlength=n) / per_word - (np.bincount(doc, length, minlength=n) / per_word) ** 2, 0)) / 10,
        _distinct(doc, h, n) / per_word,
        marks,
        1 - _distinct(doc[2:][inside], three[inside], n) / np.maximum(runs, 1) if len(h) > 2 else np.zeros(n),
        1 - _distinct(line_doc, line_hash, n) / np.maximum(lines, 1),
        np.log1p(lines) / 10,
        np.bincount(doc, (length == 1).astype(float), minlength=n) / per_word,
        np.bincount(doc, ((_CLASS[data] == 2)[start] & (_CLASS[data] == 2)[end - 1]).astype(float), minlength=n) / per_word,
    ]
    out = np.concatenate([np.sqrt(classes), np.array(extra).T], axis=1).astype(np.float32)
    out[np.diff(offsets) == 0] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk_and_gradient(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """The non-negative risk of the network ``w`` on positives and unlabelled rows, and the gradient that is followed: where the
    negative part has been fitted below nothing, that of the part with its sign turned."""
    x = np.concatenate([p, u])
    hidden = np.tanh(x @ w[0] + w[1])
    g = hidden @ w[2] + w[3]
    s, n = _sigmoid(g), len(p)
    loss = np.logaddexp(0, g)  # of calling a row negative; -g + loss is that of calling it positive
    negative = loss[n:].mean() - prior * loss[:n].mean()
    d = np.zeros(len(x))
    if negative >= 0:
        d[:n] = -prior * (1 - s[:n]) / n - prior * s[:n] / n
        d[n:] = s[n:] / len(u)
    else:
        d[:n] = prior * s[:n] / n
        d[n:] = -s[n:] / len(u)
    back = np.outer(d, w[2]) * (1 - hidden**2)
    return float(prior * (loss[:n] - g[:n]).mean() + max(0.0, negative)), [x.T @ back, back.sum(0), hidden.T @ d, d.sum()]


class PUModel:
    """One hidden layer, trained on the non-negative unbiased risk with Adam."""

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0, steps: int = 1000, batch: int = 512):
        rng = np.random.default_rng(seed)
        both = np.concatenate([positives, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-3
        p, u = (np.clip((x - self.mean) / self.scale, -6, 6) for x in (positives, unlabelled))
        k = p.shape[1]
        w = [rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(prior / (1 - prior)))]
        m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        for t in range(1, steps + 1):
            _, grads = risk_and_gradient(w, p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)], prior)
            grads = [grads[0] + 1e-4 * w[0], grads[1], grads[2] + 1e-4 * w[2], grads[3]]
            rate = 0.01 * min(1, 3 * (1 - t / (steps + 1)))
            for i, q in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * q
                v[i] = 0.999 * v[i] + 0.001 * q * q
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return _sigmoid(np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])


def class_prior(positives: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> float:
    """The share of positives among the unlabelled rows, from the features of both."""
    rng = np.random.default_rng(seed)
    halves = [(x[order[::2]], x[order[1::2]]) for x, order in ((x, rng.permutation(len(x))) for x in (positives, unlabelled))]
    if min(len(h) for pair in halves for h in pair) == 0:
        return 0.5
    first = PUModel(halves[0][0], halves[1][0], 0.5, seed)
    p, u = np.sort(first(halves[0][1])), np.sort(first(halves[1][1]))
    score = np.concatenate([p, u])
    above_p = 1 - np.searchsorted(p, score, "left") / len(p)
    above_u = 1 - np.searchsorted(u, score, "left") / len(u)
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    use = above_p > 0
    best = np.argmin((above_u[use] + slack) / above_p[use])
    return float(np.clip(above_u[use][best] / above_p[use][best], 0.01, 0.99))


def _features_of(docs: DataFrame) -> np.ndarray:
    """The statistics of a bounded sample, in the driver."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                rows = features(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], names=["x"])

    rows = docs.select("text").mapInArrow(run, "x binary").collect()
    return np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.float32).reshape(-1, N_FEATURES).astype(float)


def train_quality(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, seed: int = 0) -> PUModel | None:
    """``labels``: doc_id, quality (1 is a trusted positive). Uses no row of which the id is not given."""
    named = labels.where(F.col("doc_id").isNotNull() & (F.col("quality") == 1)).select("doc_id").distinct()
    good, total = named.count(), docs.count()
    if not good or not total:
        return None
    picked = named.where(share(F.col("doc_id"), f"p{seed}") < max_sample / good)
    positives = _features_of(docs.join(picked, "doc_id", "left_semi").limit(2 * max_sample))
    unlabelled = _features_of(docs.where(share(F.col("doc_id"), f"u{seed}") < max_sample / total).limit(2 * max_sample))
    if not len(positives) or not len(unlabelled):
        return None
    return PUModel(positives, unlabelled, class_prior(positives, unlabelled, seed), seed)


def quality_scores(docs: DataFrame, model: PUModel | None) -> DataFrame:
    """``docs`` with quality_score, the probability that the text is good."""

    def run(batch):
        if model is None:
            return [np.full(batch.num_rows, 0.5)]
        return [np.concatenate([np.zeros(0), *(model(features(data, offsets).astype(float)) for _, _, data, offsets in pieces(batch.column("text")))])]

    return appended(docs, [("quality_score", T.DoubleType(), pa.float64())], run)


def op1_quality_pu(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    training = remainder(F.col("doc_id"), 4) != 2
    model = train_quality(docs.where(training), labels.where(training))
    scored = quality_scores(docs, model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
