"""Language-model scoring by online logistic context mixing.

Texts are lower-cased (A-Z) byte words, split at white space, and one end token.  A word
is predicted in two steps: the bits of its 10-bit class (five bits of a hash
of its last two bytes, five of the whole word), then the word within its
class by add-one smoothed counts, so the probabilities of all words sum to
one.  Each class bit is predicted from hashed contexts: none, the word
before, the two words before, the endings of the two words before, and an
adaptive state of the text itself.  The predictions meet as logits in a
mixer whose weight set is gated by the bit's number and by how often its
context has been seen; weights, the adaptive state and a final refinement
table (adaptive probability map) learn online while the text is read.  Texts
are read in lanes of ``LANE`` words, each of which begins with fresh weights
but knows its true context, so a long text is many lanes and a task advances
all lanes of a block together.

Learning covers every training row: word counts are a grouped sum; context
counts are tables of a fixed size, filled in tasks, added up block by block
after one shuffle, and broadcast (about 16 MB, whatever the corpus).  Word
counts have no such bound: only the ``FREQUENT`` commonest words at most are
broadcast; the other words of a text meet their counts in a join.

Defined results: null counts as the empty text, whose only token is the end;
without training rows N and V are 0; repeated rows are scored once each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import bounded_batches, checkpointed, id_bucket, mix64, slices, binary_views, worker_cache

BITS = 10
CLASSES = 1 << BITS
CONTEXTS = 1 << 10
TABLES = 3
CELLS = TABLES * CONTEXTS * CLASSES
CELL_BLOCK = 1 << 14
FREQUENT = 1 << 18
INTERNED = 500_000
LANE = 512
LANES = 512
WEIGHT, WEIGHT_RATE, STATE_RATE, MAP_RATE = 0.25, 0.015, 0.35, 0.03
END = b""


def node_place(bit: int, prefix: int) -> int:
    """Place of the node of the code tree that decides ``bit`` after the bits ``prefix``.

    Two levels, then twice four levels below each of their ends lie together,
    so that the nodes of a class are in few cache lines.
    """
    top, first, step = (0, 0, 4) if bit < 2 else (2, 4, 15) if bit < 6 else (6, 64, 16)
    under = bit - top
    return first + step * (prefix >> under) + (1 << under) - 1 + (prefix & ((1 << under) - 1))


NODES = np.array([[node_place(b, k >> (BITS - b)) for b in range(BITS)] for k in range(CLASSES)], np.int64)
WIDTH = 64 + CLASSES
CODE = np.array([[(k >> (BITS - 1 - b)) & 1 for b in range(BITS)] for k in range(CLASSES)], np.float32)


class Interner(defaultdict):
    """Word -> index into growing columns: full hash, hash of the ending, class."""

    def __init__(self):
        import xxhash

        super().__init__(itertools.count().__next__)
        self.hash64 = xxhash.xxh64_intdigest
        self.words: list[bytes] = []
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def indexes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        words.append(END)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.words) < len(self):
            fresh = list(itertools.islice(self, len(self.words), None))
            self.words += fresh
            full = np.fromiter(map(self.hash64, fresh), np.uint64, len(fresh))
            ending = np.fromiter((self.hash64(w[-2:], 1) for w in fresh), np.uint64, len(fresh))
            self.known = tuple(map(np.append, self.known, (full, ending, word_class(full, ending))))
        return self.known


def word_class(full: np.ndarray, ending: np.ndarray) -> np.ndarray:
    half = np.uint64(1 << (BITS // 2))
    return ((ending % half) * half + (mix64(full) >> np.uint64(40)) % half).astype(np.int64)


def interner() -> Interner:
    cache = worker_cache("lm")
    if "words" not in cache or len(cache["words"]) > INTERNED:
        cache["words"] = Interner()
    return cache["words"]


def contexts(full: np.ndarray, ending: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashed contexts (TABLES x words) of the words of texts that begin at ``starts``."""
    def before(x: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[first] = 0
        return out

    one, tail = before(full, starts), before(ending, starts)
    two, tail2 = before(one, starts), before(tail, starts)
    keys = (one + np.uint64(0x9E3779B97F4A7C15), one * np.uint64(3) + two * np.uint64(0xC2B2AE3D27D4EB4F), tail * np.uint64(5) + tail2 * np.uint64(0x165667B19E3779F9))
    return np.stack([(mix64(k) >> np.uint64(54)).astype(np.int64) for k in keys])


def _blocks(batch: pa.RecordBatch, most: int = 4 << 20):
    """(first row, words index, starts) of slices of a batch's texts."""
    data, offs, _ = binary_views(batch.column("text"))
    for i, j in slices(offs, most):
        words = interner()
        each = [words.indexes(data[offs[k]:offs[k + 1]].tobytes()) for k in range(i, j)]
        sizes = np.array([len(e) for e in each], np.int64)
        yield i, words, np.concatenate(each), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["token", "n"])

    total: Counter = Counter()
    for batch in batches:
        data, offs, _ = binary_views(batch.column("text"))
        for i in range(batch.num_rows):
            total.update(data[offs[i]:offs[i + 1]].tobytes().lower().split())
            if len(total) > INTERNED:
                yield out(total)
                total = Counter()
        total[END] += batch.num_rows
    if total:
        yield out(total)


def _class_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for batch in batches:
        words = batch.column("token").to_pylist()
        full = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        ending = np.fromiter((xxhash.xxh64_intdigest(w[-2:], 1) for w in words), np.uint64, len(words))
        k = word_class(full, ending)
        np.add.at(n, k, np.asarray(batch.column("n")))
        v += np.bincount(k, minlength=CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(n), pa.array(v)], ["k", "n", "v"])


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(CELLS, np.int64)
    for batch in batches:
        for _, words, index, starts, _ in _blocks(batch):
            full, ending, k = words.columns()
            ctx = contexts(full[index], ending[index], starts)
            for t in range(TABLES):
                cells[t * CONTEXTS * CLASSES:(t + 1) * CONTEXTS * CLASSES] += np.bincount(ctx[t] * CLASSES + k[index], minlength=CONTEXTS * CLASSES)
    at = [b for b in range(CELLS // CELL_BLOCK) if cells[b * CELL_BLOCK:(b + 1) * CELL_BLOCK].any()]
    wide = np.int64 if cells.max(initial=0) > 2_000_000_000 else np.int32
    for b in at:
        yield pa.RecordBatch.from_arrays(
            [pa.array([b], pa.int32()), pa.array([cells[b * CELL_BLOCK:(b + 1) * CELL_BLOCK].astype(wide).tobytes()], pa.binary())], ["block", "counts"])


def _cells_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64 if len(raw) == 8 * CELL_BLOCK else np.int32).astype(np.int64)


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}  # at most CELLS / CELL_BLOCK arrays
    for batch in batches:
        for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            total[b] = total[b] + _cells_of(raw) if b in total else _cells_of(raw)
    for b, cells in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([cells.tobytes()], pa.binary())], ["block", "counts"])


def node_logits(leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From counts of classes per context: logit of a one, and how often seen (0, 1, 2), of every node of the code tree."""
    rows = len(leaf)
    logit, seen = np.zeros((rows, WIDTH), np.float32), np.zeros((rows, WIDTH), np.uint8)
    for b in range(BITS):
        n = leaf.reshape(rows, 1 << b, 2, 1 << (BITS - 1 - b)).sum(-1)
        at = NODES[::1 << (BITS - b), b]
        logit[:, at] = np.log((n[:, :, 1] + 0.4) / (n[:, :, 0] + 0.4))
        seen[:, at] = (n.sum(-1) >= 4).astype(np.uint8) + (n.sum(-1) >= 64)
    return logit, seen


def learn(train: DataFrame) -> tuple[SimpleNamespace, DataFrame]:
    """The model (bounded, for broadcast) and the checkpointed table (token, n) of all training words."""
    raw = train.select(F.col("text").cast("binary").alias("text"))
    counts = checkpointed(raw.mapInArrow(_count_words, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # a count above which there are at most FREQUENT words, from a histogram over logarithmic steps
    step = F.floor(F.log2("n") * 8).cast("int").alias("step")
    have, least = 0, None
    for r in sorted(counts.groupBy(step).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("n")).collect(), key=lambda r: -r["step"]):
        if have + r["v"] > FREQUENT:
            break
        have, least = have + r["v"], r["n"]
    frequent = [] if least is None else counts.filter(F.col("n") >= least).collect()
    totals = counts.mapInArrow(_class_totals, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    in_class = np.ones(CLASSES)
    for r in totals:
        in_class[r["k"]] = r["n"] + r["v"] + 1
    cells = np.zeros(CELLS, np.int64)
    for r in raw.mapInArrow(_count_contexts, "block int, counts binary").repartition("block").mapInArrow(
            _add_blocks, "block int, counts binary").toLocalIterator():
        cells[r["block"] * CELL_BLOCK:(r["block"] + 1) * CELL_BLOCK] += _cells_of(r["counts"])
    tables = [node_logits(t) for t in cells.reshape(TABLES, CONTEXTS, CLASSES)]
    model = SimpleNamespace(
        n=whole["n"], v=whole["v"], least=least,
        frequent={bytes(r["token"]): math.log10(r["n"] + 1) for r in frequent}, log_in_class=np.log10(in_class),
        plain=node_logits(cells.reshape(TABLES, CONTEXTS, CLASSES)[0].sum(0)[None, :])[0][0],
        logits=[t[0].ravel() for t in tables], seen=tables[1][1].ravel())
    return model, counts


def class_bits(model, k: np.ndarray, ctx: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per text: log10 probability of the class bits of its words, by online mixing."""
    lane_of, lane_at, lane_len = [], [], []
    for d, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
        for a in range(0, n, LANE):
            lane_of.append(d)
            lane_at.append(s + a)
            lane_len.append(min(LANE, n - a))
    of, at, size = (np.asarray(x, np.int64) for x in (lane_of, lane_at, lane_len))
    order = np.argsort(-size, kind="stable")
    of, at, size = of[order], at[order], size[order]
    # few lanes at a time: what they learn stays in the processor's cache
    got = [lane_bits(model, k, ctx, at[i:i + LANES], size[i:i + LANES]) for i in range(0, len(of), LANES)]
    return np.bincount(of, np.concatenate(got) if got else None, minlength=len(starts))


def lane_bits(model, k: np.ndarray, ctx: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Per lane (its first word and number of words, longest first): log10 probability of the class bits of its words."""
    lanes, inputs = len(at), TABLES + 2
    flat_state = np.tile(model.plain, lanes)
    flat_w = np.full((lanes * BITS * 3, inputs), WEIGHT, np.float32)
    bins = 17
    flat_r = np.tile((1 / (1 + np.exp(-(np.arange(bins) - 8.0)))).astype(np.float32), lanes * BITS)
    got = np.zeros(lanes)
    active = np.searchsorted(-size, -np.arange(int(size.max())), side="left")
    of_state = np.arange(lanes, dtype=np.int64)[:, None] * WIDTH
    of_bit = np.arange(lanes * BITS, dtype=np.int64).reshape(lanes, BITS)
    of_w, of_r = of_bit * 3, of_bit * bins
    inputs_of = np.empty((lanes, BITS, inputs), np.float32)
    each_input = np.arange(lanes * BITS).repeat(inputs)
    row = np.dtype((np.void, flat_w.itemsize * inputs))  # a weight set as one item, which is stored faster than its parts
    rows_w = flat_w.view(row)[:, 0]
    for t, n in enumerate(active.tolist()):
        i = at[:n] + t
        word = k.take(i)
        nodes, bits = NODES.take(word, axis=0), CODE.take(word, axis=0)
        x = inputs_of[:n]
        x[:, :, 0] = model.plain.take(nodes)
        for c in range(TABLES):
            cell = (ctx[c].take(i) * WIDTH)[:, None] + nodes
            x[:, :, 1 + c] = model.logits[c].take(cell)
            if c == 1:
                gate = model.seen.take(cell)
        where = of_state[:n] + nodes
        own = flat_state.take(where)
        x[:, :, -1] = own
        slot = of_w[:n] + gate
        w = flat_w.take(slot, axis=0)
        dot = np.einsum("nbi,nbi->nb", w, x)
        np.minimum(np.maximum(dot, -8, out=dot), 8, out=dot)
        p = 1 / (1 + np.exp(-dot))
        w += (WEIGHT_RATE * (bits - p)).take(each_input[:w.size]).reshape(w.shape) * x
        rows_w[slot] = w.view(row)[:, :, 0]
        flat_state[where] = own + STATE_RATE * (bits - 1 / (1 + np.exp(-own)))
        cell = of_r[:n] + np.rint(dot + 8).astype(np.int64)
        fine = flat_r.take(cell)
        flat_r[cell] = fine + MAP_RATE * (bits - fine)
        final = 0.6 * p + 0.4 * fine
        np.minimum(np.maximum(final, 1e-5, out=final), 1 - 1e-5, out=final)
        got[:n] += np.log10(np.abs(1 - bits - final)).sum(1, dtype=np.float64)
    return got


_OUT = "rid long, token binary, tf long, doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, log_counts double, part double"


def _scorer(shared):
    names = [c.split()[0] for c in _OUT.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = SimpleNamespace(**shared.value)
        rid = TaskContext.get().partitionId() << 33
        seen, logs = None, np.zeros(0)
        for batch in batches:
            ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            _, offs, _ = binary_views(batch.column("text"))
            for first, words, index, starts, sizes in _blocks(batch):
                full, ending, k = words.columns()
                if words is not seen:
                    seen, logs = words, np.zeros(0)
                logs = np.append(logs, np.full(len(full) - len(logs), np.nan))  # of each word by index: nan where not asked yet
                mine = logs[index]
                fresh = np.unique(index[np.isnan(mine)])
                if len(fresh):
                    logs[fresh] = [model.frequent.get(words.words[u], -1.0) for u in fresh.tolist()]
                    mine = logs[index]
                part = class_bits(model, k[index], contexts(full[index], ending[index], starts), starts, sizes)
                part -= np.add.reduceat(model.log_in_class[k[index]], starts)
                rare = mine < 0
                known = np.add.reduceat((~rare).astype(np.int64), starts)
                log_counts = np.add.reduceat(np.where(rare, 0.0, mine), starts)
                n, base = len(starts), rid
                rid += n
                span = range(first, first + n)
                # one row a text; its token can't be a word, and spreads the rows
                rows = [list(range(base, base + n)), [b" %d" % r for r in range(base, base + n)], [0] * n,
                        [ids[r] for r in span], [held[r] for r in span], (offs[first + 1:first + n + 1] - offs[first:first + n]).tolist(),
                        sizes.tolist(), known.tolist(), log_counts.tolist(), part.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)
                if rare.any():
                    doc = np.repeat(np.arange(n), sizes)[rare]
                    pair, tf = np.unique(doc * len(full) + index[rare], return_counts=True)
                    which = (pair % len(full)).tolist()
                    m = len(pair)
                    cols = [pa.array(base + pair // len(full)), pa.array([words.words[u] for u in which], pa.binary()), pa.array(tf, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols + [pa.nulls(m, t) for t in kinds[3:]], names)

    return run


def score_texts(docs: DataFrame, model: SimpleNamespace, counts: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))
    rows = docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(_scorer(shared), _OUT)
    others = counts if model.least is None else counts.filter(F.col("n") < model.least)
    c = F.coalesce(F.col("n"), F.lit(0))
    summed = rows.join(others, "token", "left").groupBy("rid").agg(
        *[F.max(x).alias(x) for x in ("doc_id", "held_out", "n_bytes", "n_tokens", "part")],
        (F.max("n_known") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.max("log_counts") + F.sum(F.col("tf") * F.log10(c + 1))).alias("log_counts"))
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(math.log10(model.n + model.v + 1))
    score = F.col("log_counts") + F.col("part")
    bits = -score * F.lit(math.log2(10)) / F.greatest(F.col("n_bytes"), F.lit(1))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"),
                         base.alias("base_score"), score.alias("score"), bits.alias("bits_per_byte"))


def score_documents(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """Learn from the rows outside the held-out fold and score every row of ``documents``."""
    rows = bounded_batches(docs).select("doc_id", (id_bucket("doc_id", fold) == held).alias("held_out"), "text")
    model, counts = learn(rows.filter(~F.col("held_out")))
    return score_texts(rows, model, counts)
