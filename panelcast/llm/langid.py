"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte 3-grams and 4-grams
(ASCII letters lower-cased, digits folded), followed by a linear softmax.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy on the driver, over a sample bounded by a parameter (about
``per_language`` documents of each language, chosen by a hash of the id); each
sampled document arrives as at most ``BUCKETS`` feature counts, made in tasks.
A temperature fitted on a part of the sample calibrates the probability, and
a rejection threshold is the least score whose accepted part of that
calibration set is right at ``precision``.

Prediction folds embeddings and softmax into one table (BUCKETS x languages,
a fixed size) and adds its rows for every n-gram of the whole text.

Defined results: null texts and texts without a letter give ``und`` with
score 0; so does every text when nothing could be learned.  Repeated rows
each get the same answer, an empty table gives no rows, other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import binary_views, bounded_batches, id_bucket, segment_sum, slices

BUCKETS = 1 << 16
UNKNOWN = "und"
PART = 1 << 22  # bytes handled at once
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray          # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def gram_ids(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the 3-gram and of the 4-gram that ends at each byte (the first ones use what came before)."""
    x = np.concatenate([np.full(3, 32, np.uint8), _FOLD[data]]).astype(np.uint32)
    three = (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]
    four = three | (x[:-3] << np.uint32(24))
    shift = np.uint32(32 - 15)
    return ((three * np.uint32(2654435761)) >> shift).astype(np.int32), \
        (((four ^ (four >> np.uint32(15))) * np.uint32(2246822519)) >> shift).astype(np.int32) + (BUCKETS >> 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs, _ = binary_views(batch.column("text"))
        ids, counts = [], []
        for i in range(batch.num_rows):
            three, four = gram_ids(data[offs[i]:offs[i + 1]])
            total = np.bincount(three, minlength=BUCKETS) + np.bincount(four, minlength=BUCKETS)
            at = np.flatnonzero(total)
            ids.append(at.astype(np.int32))
            counts.append((total[at] / max(1, total.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
            ["lang", "ids", "counts"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: DataFrame, per_language: int = 800, dim: int = 16, epochs: int = 8, rate: float = 0.5,
          precision: float = 0.99, seed: int = 7) -> LanguageModel | None:
    """Fit on ``docs`` (doc_id, text, lang) with a language; None if there is none."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    rows = known.filter(draw < share[F.col("lang")]).select("lang", F.col("text").cast("binary").alias("text")) \
        .mapInArrow(_features, "lang string, ids array<int>, counts array<float>").toArrow().to_pydict()
    names = sorted(sizes)
    order = np.random.default_rng(seed).permutation(len(rows["lang"]))
    x = [(np.asarray(rows["ids"][i], np.int64), np.asarray(rows["counts"][i], np.float32)) for i in order]
    y = np.array([names.index(rows["lang"][i]) for i in order], np.int64)
    held = max(1, len(x) // 5) if len(x) >= 10 else 0
    rng = np.random.default_rng(seed)
    emb = (rng.standard_normal((BUCKETS, dim)) / dim).astype(np.float32)
    soft = (rng.standard_normal((dim, len(names))) * 0.1).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    steps, done = epochs * (len(x) - held), 0
    for _ in range(epochs):
        for i in rng.permutation(np.arange(held, len(x))):
            lr = rate * (1 - done / steps)
            done += 1
            ids, w = x[i]
            mean = w @ emb[ids]
            g = _softmax(mean @ soft + bias).astype(np.float32)
            g[y[i]] -= 1
            back = soft @ g
            soft -= lr * np.outer(mean, g)
            bias -= lr * 0.1 * g
            # an embedding moves by its share of the text, scaled up because shares are small
            emb[ids] -= (lr * 20) * np.outer(np.minimum(w, 0.02), back)
    table = (emb @ soft).astype(np.float32)
    temperature, threshold = 1.0, 0.0
    if held:
        z = np.stack([w @ table[ids] + bias for ids, w in x[:held]])
        loss = lambda t: -np.log(np.maximum(_softmax(z * t)[np.arange(held), y[:held]], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        p = _softmax(z * temperature)
        best, right = p.max(1), p.argmax(1) == y[:held]
        down = np.argsort(-best, kind="stable")
        good = np.cumsum(right[down]) / np.arange(1, held + 1) >= precision
        threshold = float(best[down][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return LanguageModel(names, table, bias.astype(np.float64), temperature, threshold)


def _has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode("utf-8", "replace")))


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and SimpleNamespace(**shared.value)
        for batch in batches:
            data, offs, null = binary_views(batch.column("text"))
            n = batch.num_rows
            pred, score, accepted = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
            for i, j in slices(offs) if model else ():
                z = np.zeros((j - i, len(model.languages)))
                size = np.maximum(1, offs[i + 1:j + 1] - offs[i:j]) * 2
                for first in range(int(offs[i]), int(offs[j]), PART):  # more than one part only for a single long text
                    three, four = gram_ids(data[first:min(first + PART, offs[j])])
                    lo, hi = (np.clip(x - first, 0, len(three)) for x in (offs[i:j], offs[i + 1:j + 1]))
                    for c in range(0, len(model.languages), 4):  # few columns at a time bound the temporaries
                        own = np.ascontiguousarray(model.table[:, c:c + 4])
                        z[:, c:c + 4] += segment_sum(own[three] + own[four], lo, hi) / size[:, None]
                p = _softmax((z + model.bias) * model.temperature)
                best = p.argmax(1)
                for k in range(i, j):
                    if not null[k] and _has_letter(data[offs[k]:offs[k + 1]].tobytes()):
                        pred[k] = model.languages[best[k - i]]
                        score[k] = min(1.0, p[k - i, best[k - i]])
                        accepted[k] = score[k] >= model.threshold
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score),
                 pa.array(accepted)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): ``accepted`` is false where calibrated rejection would abstain."""
    shared = docs.sparkSession.sparkContext.broadcast(model and dict(vars(model)))  # BUCKETS x languages floats, bounded
    return docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(
        _predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def identify_documents(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """Train on the rows outside the held-out fold and predict every row of ``documents``."""
    split = bounded_batches(docs).select("doc_id", "text", "lang", (id_bucket("doc_id", fold) == held).alias("held_out"))
    return predict(split, train(split.filter(~F.col("held_out"))))
