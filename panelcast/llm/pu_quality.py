"""Quality classifier by positive-unlabelled learning.

Trusted positives are training documents labelled 1; the unlabelled set is
training web text of any or no label, whose labels are not used.  A small
network over text statistics is trained in numpy to minimise the non-negative
unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

(where the bracket is negative, the step is taken up its slope instead), with
the class prior estimated as the positive share of labelled training rows.
Both sets are samples bounded by a parameter and chosen by a hash of the id;
the statistics (a fixed number per document) are made in tasks from whole
texts.  A two-parameter logistic fit on labelled training rows calibrates the
score.

Defined results: null counts as the empty text; empty texts are scored like
any other.  Without positives the score of every row is the prior (0.5
without labels).  Repeated rows get equal scores; several labels of one
document count as several rows; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import binary_views, bounded_batches, id_bucket, mix64, segment_sum, slices

_SYMBOLS = b".,!?|*#$%&@<>{}[]()/\\=_-:;\"'~^+"
N_FEATURES = len(_SYMBOLS) + 16
PART = 1 << 22  # bytes described at once


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    slope: float
    offset: float
    constant: float | None = None


_CLASS = np.zeros((256, 8), np.float32)
_CLASS[97:123, 0] = 1
_CLASS[65:91, 1] = 1
_CLASS[48:58, 2] = 1
_CLASS[32, 3] = 1
_CLASS[[9, 11, 12, 13], 4] = 1
_CLASS[10, 5] = 1
_CLASS[128:, 6] = 1
_CLASS[:, 7] = 1 - _CLASS[:, :7].sum(1)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fixed text statistics of the documents ``data[at[k]:at[k+1]]``."""
    n = len(at) - 1
    lo, hi = at[:-1], at[1:]
    size = np.maximum(1, hi - lo).astype(np.float64)
    out = np.zeros((n, N_FEATURES))
    doc = np.repeat(np.arange(n), hi - lo)
    if len(data):
        counts = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    else:
        counts = np.zeros((n, 256))
    out[:, :len(_SYMBOLS)] = counts[:, list(_SYMBOLS)] / size[:, None]
    k = len(_SYMBOLS)
    out[:, k:k + 8] = (counts @ _CLASS) / size[:, None]
    k += 8
    # words: runs of bytes above the space; their hash comes from prefix sums of mixed bytes
    inside = data > 32
    first = inside.copy()
    edge = lo[lo < len(data)]
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if len(starts):
        last = np.ones(len(data), bool)
        last[:-1] = ~inside[1:]
        last[edge[edge > 0] - 1] = True
        ends = np.flatnonzero(inside & last) + 1
        lower = data | ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        position = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(data)))).astype(np.uint64) \
            if starts[0] == 0 else np.arange(len(data), dtype=np.uint64) - np.concatenate(
                [np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))]).astype(np.uint64)
        mixed = mix64(lower.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + position)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        word = total[ends] - total[starts]
        owner = doc[starts]
        words = np.bincount(owner, minlength=n).astype(np.float64)
        per = np.maximum(1, words)
        same = np.zeros(len(word))
        same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        out[:, k] = np.bincount(owner, same, minlength=n) / per
        # pairs of words that the document has already had
        pair = mix64(word + np.uint64(3) * np.roll(word, 1)) >> np.uint64(24)
        key = (owner.astype(np.uint64) << np.uint64(40)) | pair
        key.sort()
        again = np.zeros(len(key))
        again[1:] = key[1:] == key[:-1]
        out[:, k + 1] = np.bincount((key >> np.uint64(40)).astype(np.int64), again, minlength=n) / per
        lengths = (ends - starts).astype(np.float64)
        mean = np.bincount(owner, lengths, minlength=n) / per
        out[:, k + 2] = mean / 10
        out[:, k + 3] = np.bincount(owner, (lengths > 20).astype(float), minlength=n) / per
        out[:, k + 4] = np.bincount(owner, (lengths == 1).astype(float), minlength=n) / per
        ended = data[ends - 1]
        symbol = (ended < 128) & (_CLASS[ended, 7] > 0) & ~np.isin(ended, np.frombuffer(b".,", np.uint8))
        out[:, k + 5] = np.bincount(owner, symbol.astype(float), minlength=n) / per
        out[:, k + 6] = np.log1p(words) / 10
    same_byte = np.zeros(len(data))
    if len(data) > 1:
        same_byte[1:] = data[1:] == data[:-1]
    out[:, k + 7] = segment_sum(same_byte, lo, hi) / size
    return out


def described(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Statistics of every row of a batch; a text over ``PART`` bytes has the mean of its parts, weighted by their length."""
    out = np.zeros((len(offs) - 1, N_FEATURES))
    for i, j in slices(offs, min(1 << 20, PART)):
        size = int(offs[j] - offs[i])
        if size <= PART:
            out[i:j] = statistics(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            continue
        for a in range(0, size, PART):  # one row
            part = data[offs[i] + a:offs[i] + min(a + PART, size)]
            out[i] += statistics(part, np.array([0, len(part)]))[0] * (len(part) / size)
    return out


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs, _ = binary_views(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("kind"), pa.array(list(described(data, offs)), pa.list_(pa.float64()))], ["kind", "x"])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, hidden: int = 16, epochs: int = 40, batch: int = 256,
             rate: float = 0.01, seed: int = 5) -> tuple:
    """Weights of a one-hidden-layer network minimising the non-negative PU risk with the logistic loss (Adam)."""
    rng = np.random.default_rng(seed)
    d = xp.shape[1]
    theta = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0

    def back(x, coef):
        h = np.maximum(0, x @ theta[0] + theta[1])
        g = coef(h @ theta[2] + theta[3][0])
        gh = np.outer(g, theta[2]) * (h > 0)
        return [x.T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()])]

    rounds = max(1, max(len(xp), len(xu)) // batch)
    for _ in range(epochs):
        for _ in range(rounds):
            p, u = xp[rng.integers(0, len(xp), batch)], xu[rng.integers(0, len(xu), batch)]
            score = lambda x: np.maximum(0, x @ theta[0] + theta[1]) @ theta[2] + theta[3][0]
            fp, fu = score(p), score(u)
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            # logistic loss: l(+) = log(1+e^-f), l(-) = log(1+e^f)
            minus = [a - b for a, b in zip(back(u, lambda f: _sigmoid(f) / batch), back(p, lambda f: prior * _sigmoid(f) / batch))]
            if negative >= 0:
                plus = back(p, lambda f: -prior * _sigmoid(-f) / batch)
                grad = [a + b for a, b in zip(plus, minus)]
            else:
                grad = [-a for a in minus]
            t += 1
            for k, g in enumerate(grad):
                g = g + 1e-4 * theta[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                theta[k] = theta[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return tuple(theta)


def _calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of y on f (Newton steps with a small ridge)."""
    a, b = 1.0, 0.0
    x = np.stack([f, np.ones_like(f)], 1)
    for _ in range(50):
        p = _sigmoid(a * f + b)
        g = x.T @ (p - y) + 1e-2 * np.array([a - 1, b])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.05)), float(b)


def train(docs: DataFrame, labels: DataFrame, positives: int = 6000, unlabelled: int = 12000, labelled: int = 8000) -> QualityModel:
    """Fit on documents (doc_id, text) and labels (doc_id, quality), both already cut to training rows."""
    lab = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    sizes = {r["quality"]: r["n"] for r in lab.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs = docs.count()
    n_pos, n_lab = sizes.get(1, 0), sum(sizes.values())
    empty = (np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0, 0.0)
    if not n_pos or not n_docs:
        return QualityModel(*empty, constant=0.5 if not n_lab else n_pos / n_lab)
    prior = n_pos / n_lab
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    again = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("unlabelled")), F.lit(1 << 30)) / float(1 << 30)
    # the labelled sample is bounded, so its ids are: pick them first, then meet the texts
    chosen = lab.filter(draw < min(1.0, max(positives, labelled) / n_lab)).select("doc_id", F.col("quality").alias("kind"))
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text")
    known = docs.filter(draw < min(1.0, max(positives, labelled) / n_lab)).select("doc_id", text).join(chosen, "doc_id")
    other = docs.filter(again < min(1.0, unlabelled / n_docs)).select(text, F.lit(-1).alias("kind"))
    got = known.select("kind", "text").unionByName(other.select("kind", "text")).mapInArrow(
        _featurise, "kind int, x array<double>").toArrow()
    kind = np.asarray(got.column("kind"))
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES)
    xp, xu, xl, yl = x[kind == 1], x[kind == -1], x[kind >= 0], kind[kind >= 0]
    if not len(xp) or not len(xu):
        return QualityModel(*empty, constant=prior)
    mean, scale = xu.mean(0), np.maximum(xu.std(0), 1e-4)
    put = lambda z: np.clip((z - mean) / scale, -6, 6)
    w1, b1, w2, b2 = fit_nnpu(put(xp), put(xu), prior)
    model = QualityModel(mean, scale, w1, b1, w2, float(b2[0]), 1.0, 0.0)
    f = raw_score(model, xl)
    model.slope, model.offset = _calibrate(f, yl.astype(float)) if len(set(yl.tolist())) > 1 else (1.0, 0.0)
    return model


def raw_score(model: QualityModel, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    return np.maximum(0, z @ model.w1 + model.b1) @ model.w2 + model.b2


def _scorer(shared, threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SimpleNamespace(**shared.value)
        for batch in batches:
            data, offs, _ = binary_views(batch.column("text"))
            score = np.full(batch.num_rows, 0.5 if model.constant is None else model.constant)
            if model.constant is None:
                score = _sigmoid(model.slope * raw_score(model, described(data, offs)) + model.offset)
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(rest + [pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             [c for c in batch.schema.names if c != "text"] + ["score", "predicted"])

    return run


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` without text, with ``score`` and ``predicted``; docs needs doc_id, held_out and text."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))
    return docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(
        _scorer(shared, threshold), "doc_id long, held_out boolean, score double, predicted int")


def fit_for(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0) -> QualityModel:
    cut = id_bucket("doc_id", fold) != held
    return train(bounded_batches(docs).select("doc_id", "text").filter(cut), labels.filter(cut))


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0) -> DataFrame:
    """Score every row of ``documents``; labels of the held-out fold are never read."""
    rows = docs.select("doc_id", "text", (id_bucket("doc_id", fold) == held).alias("held_out"))
    return score(rows, fit_for(docs, labels, fold, held))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Filtering form: the rows of ``docs``, all columns, that the classifier does not reject."""
    model = fit_for(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = SimpleNamespace(**shared.value)
        for batch in batches:
            data, offs, _ = binary_views(batch.column("text"))
            if use.constant is None:
                keep = _sigmoid(use.slope * raw_score(use, described(data, offs)) + use.offset) >= threshold
            else:
                keep = np.full(batch.num_rows, use.constant >= threshold)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
