"""Near-duplicate detection by order MinHash, verified by banded alignment.

A text is its lower-cased words between white space; its k-mers are runs of five words (a shorter
text is one k-mer), labelled by which occurrence in the text they are.  Each
of ``SKETCHES`` random orders picks the ``PICKED`` smallest labelled k-mers and
lists them in the order of the text, so two texts agree on a sketch only if
they share these k-mers in the same order.  Texts that agree on a sketch are
candidates; a candidate pair is a link if the banded alignment of the words
gives 1 - edits / longer length >= ``SIMILARITY``.  Classes are the connected
components of the links; equal texts are one node from the start.

Scale: a sketch is made where the text is read; equal texts meet as one row
each (partial aggregation).  Sketch rows (two integers) are range-partitioned
by key and node, so a key that a third of all texts share spans many tasks;
in each run of equal keys a text is first paired with the run's first (the
first few with each other), and runs that cross partitions are tied together.
Only paired texts travel to be aligned: first each text with the partner it
agrees with most often, then the pairs that these links have not connected
already.  That settles runs of near copies.  A longer run whose texts are then
still in several classes (texts on a shared template, whose first is a
stranger to the others) is gone through whole, block against block
(:func:`open_links`): every two of its texts in different classes are aligned
unless their lengths or histograms of words and word pairs prove them too far
apart.  So any two texts that agree on a sketch are connected or known not to
be near.

Defined results: a null text is a class of its own; empty texts equal each
other; repeated rows share a class; the class id is the smallest doc_id of the class (null if
none of its rows has one); an empty table gives no rows; other columns pass
through the filtering form and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import binary_views, bounded_batches, boxed, checkpointed, mix64, slices, texts, worker_cache, written

WORDS, PICKED, SKETCHES, SIMILARITY = 5, 3, 40, 0.8
SALTS = 8
ALL_PAIRS = 6           # in a run of equal keys, the first few are paired with each other
BINS, PAIR_BINS = 256, 512  # of a text's histograms of words and of neighbouring words
BLOCK = 512             # texts of a run that meet another block's at once
CELL_BYTES = 4 << 20    # and their bytes, but for a single longer text
CHUNK = 1 << 15
_ORDERS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _WordHashes(dict):
    def __init__(self):
        import xxhash

        super().__init__()
        self.hash64 = xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        out = self[word] = self.hash64(word)
        return out


def word_hashes(text: bytes) -> np.ndarray:
    cache = worker_cache("minhash")
    if "word_hashes" not in cache:
        cache["word_hashes"] = _WordHashes()
    words = text.lower().split()
    return np.fromiter(map(cache["word_hashes"].__getitem__, words), np.uint64, len(words))


def labelled_kmers(hashes: np.ndarray) -> np.ndarray:
    """Hash of every k-mer together with its number among equal ones, in text order."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(WORDS, n)
    own = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        own = mix64(own + hashes[j:n - k + 1 + j])
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(own))
    occurrence = np.empty(len(own), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return mix64(own + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(labels: np.ndarray) -> np.ndarray:
    """SKETCHES keys: the hash of the smallest labels of each order, taken in text order."""
    n, take = len(labels), min(PICKED, len(labels))
    if not n:
        return np.zeros(0, np.uint64)
    rows = np.arange(SKETCHES)
    best = None
    for at in range(0, n, CHUNK):  # long texts in parts: the smallest of the parts' smallest
        value = labels[None, at:at + CHUNK] * _ORDERS[:, None]
        value ^= value >> np.uint64(29)
        got = []
        for _ in range(min(take, value.shape[1])):
            i = value.argmin(1)
            got.append((value[rows, i], i + at))
            value[rows, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
        new = (np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1))
        if best is not None:
            both = [np.concatenate([x, y], 1) for x, y in zip(best, new)]
            order = np.argsort(both[0], axis=1, kind="stable")[:, :take]
            new = tuple(np.take_along_axis(x, order, 1) for x in both)
        best = new
    places = np.sort(best[1], axis=1)
    key = (rows + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(places.shape[1]):
        key = mix64(key * np.uint64(31) + labels[places[:, j]])
    return key


def histogram(hashes: np.ndarray) -> np.ndarray:
    """Numbers of words, and of pairs of neighbouring words, by the last bits of their hashes, up to 255."""
    pairs = mix64(hashes[:-1] * np.uint64(31) + hashes[1:])
    counts = [np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) for h, n in ((hashes, BINS), (pairs, PAIR_BINS))]
    return np.minimum(np.concatenate(counts), 255).astype(np.uint8)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs, null = binary_views(batch.column("text"))
        out, size, bins = [], [], []
        for i in range(batch.num_rows):
            hashes = word_hashes(data[offs[i]:offs[i + 1]].tobytes())
            out.append(None if null[i] else sketch(labelled_kmers(hashes)).tobytes())
            size.append(len(hashes))
            bins.append(histogram(hashes).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("same"), pa.array(out, pa.binary()), pa.array(size, pa.int64()), pa.array(bins, pa.binary())],
            ["doc_id", "same", "sketch", "words", "bins"])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = np.asarray(batch.column("node"))
        data, offs, _ = binary_views(batch.column("sketch"))
        if offs[-1] == offs[0]:
            continue
        keys = np.frombuffer(data[offs[0]:offs[-1]].tobytes(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(nodes, (offs[1:] - offs[:-1]) // 8))], ["key", "node"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) within runs of equal keys of sorted rows.

    ``key`` is set on rows that tie partitions together (b = 0) and on those that name a run with texts not paired
    with all others (b = 1).
    """
    def out(a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], ["a", "b", "key"])

    first_run, keys, nodes = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.zeros(0, np.int64)  # first node of the run of each held row, and its place in the run
    place = np.zeros(0, np.int64)
    keep = ALL_PAIRS
    for batch in batches:
        k, v = np.asarray(batch.column("key")), np.asarray(batch.column("node"))
        if not len(k):
            continue
        if first_run is None:
            first_run = (int(k[0]), int(v[0]))
        held = len(keys)
        k, v = np.concatenate([keys, k]), np.concatenate([nodes, v])
        at = np.arange(len(k))
        new = np.concatenate([[True], k[1:] != k[:-1]])
        start = np.maximum.accumulate(np.where(new, at, 0))
        where, first = at - start, v[start]
        if held:  # the run that goes on from the last batch
            same = k == keys[0]
            where[same] += place[0]
            first[same] = head[0]
        a, b = [], []
        fresh = at >= held
        for back in range(1, keep):
            j = at - back
            ok = fresh & (j >= 0) & (k == k[np.maximum(j, 0)]) & (where < keep)
            a.append(v[j[ok]])
            b.append(v[at[ok]])
        star = fresh & (where >= keep)
        a.append(first[star])
        b.append(v[star])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield out(np.minimum(a, b), np.maximum(a, b), [None] * len(a))
        long = np.unique(k[fresh & (where == keep)])
        if len(long):
            yield out(np.zeros(len(long), np.int64), np.ones(len(long), np.int64), long)
        tail = at[k == k[-1]][-keep:]
        keys, nodes, head, place = k[tail], v[tail], first[tail], where[tail]
    if first_run is not None:
        yield out([first_run[1], int(head[-1])], [0, 0], [first_run[0], int(keys[-1])])


def _sketch_rows(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("sketch").isNotNull()).select("node", "sketch").mapInArrow(_explode, "key long, node long")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs and the runs they do not cover; nodes has node and sketch.

    (a, b, agree): distinct pairs a < b of nodes that some sketches bring together, and how many; (key): runs in which
    not all have met all, among them those that may go on in another partition.
    """
    found = checkpointed(_sketch_rows(nodes).repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(
        _runs, "a long, b long, key long").groupBy("a", "b", "key").agg(F.count(F.lit(1)).alias("agree")))
    marks = found.filter(F.col("key").isNotNull())
    # a few rows per partition: the heads of its outer runs
    ends = marks.filter("b = 0").select("key", F.col("a").alias("node"))
    least = ends.groupBy("key").agg(F.min("node").alias("a"))
    ties = ends.join(least, "key").filter("a < node").select("a", F.col("node").alias("b"), F.lit(1).cast("long").alias("agree"))
    own = found.filter(F.col("key").isNull() & (F.col("a") != F.col("b"))).select("a", "b", "agree")
    return own.unionByName(ties).groupBy("a", "b").agg(F.sum("agree").alias("agree")), marks.select("key").distinct()


def _may_be_near(words: np.ndarray, bins: np.ndarray, own_words: int, own_bins: np.ndarray) -> np.ndarray:
    """Which of the texts could be near the one in hand: false only if lengths or histograms prove the opposite.

    e edits leave at least longer - e words and longer - 1 - 2 e pairs of neighbours in common.
    """
    longer = np.maximum(words, own_words)
    allowed = (longer * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    least = np.minimum(bins, own_bins)
    near = np.abs(words - own_words) <= allowed
    for part, kept in ((least[:, :BINS], longer - allowed), (least[:, BINS:], longer - 1 - 2 * allowed)):
        # counts end at 255: such a bin may hold any number
        near &= (part.sum(1, dtype=np.int64) >= kept) | (part == 255).any(1)
    return near


def _cell(rows: pa.Table) -> pa.Table:
    """Links a < b of a cell's rows (of one block, or one of either) that have different labels.

    Two texts may meet in several runs; they are aligned in the one with the smallest key.
    """
    node, label, words, side = (np.asarray(rows.column(c)) for c in ("node", "label", "words", "side"))
    data, offs, _ = binary_views(rows.column("bins"))
    bins = data[offs[0]:offs[-1]].reshape(-1, BINS + PAIR_BINS)
    key, one = rows.column("key")[0].as_py(), rows.column("one")[0].as_py()
    keys = [set(x) for x in rows.column("keys").to_pylist()]
    text = [word_hashes(t) for t in texts(rows.column("text").combine_chunks())]
    a, b = [], []
    for i in range(len(node)) if one else np.flatnonzero(side == 0).tolist():
        met = (label != label[i]) & ((node > node[i]) if one else (side == 1))
        at = np.flatnonzero(met)
        at = at[_may_be_near(words[at], bins[at], words[i], bins[i])]
        at = [k for k in at.tolist() if min(keys[i] & keys[k]) == key]
        for p in range(0, len(at), 256):
            near = np.array(at[p:p + 256])[aligned([(text[i], text[k]) for k in at[p:p + 256]])]
            a.append(np.full(len(near), node[i]))
            b.append(node[near])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def open_links(nodes: DataFrame, runs: DataFrame, labels: DataFrame, texts_of) -> DataFrame:
    """(a, b): links a < b of texts that meet in one of ``runs`` and are in different classes.

    A run is dealt into blocks of at most ``BLOCK`` texts and about ``CELL_BYTES`` of text; a task aligns two of them.
    """
    rows = checkpointed(_sketch_rows(nodes).join(runs, "key").join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label")))
    several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    rows = checkpointed(rows.join(several, "key"))
    each = rows.groupBy("node").agg(F.first("label").alias("label"), F.collect_set("key").alias("keys"))  # at most SKETCHES keys
    text = texts_of(each.join(nodes, "node").select("node", F.col("same").alias("w_same"), F.col("rep").alias("w_rep")))
    each = each.join(nodes.select("node", "words", "bins"), "node").join(text, "node")
    sizes = rows.join(text.select("node", F.octet_length("text").alias("bytes")), "node").groupBy("key").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / BLOCK, F.sum("bytes") / CELL_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = rows.select("key", "node").join(sizes, "key").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") == F.col("other")).alias("one"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return dealt.join(each, "node").groupBy("key", "low", "high").applyInArrow(_cell, "a long, b long")


def _banded(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distances of pairs of words within a band, all pairs in step; -1 where it is over the band."""
    n = np.array([len(x) for x in a])
    m = np.array([len(x) for x in b])
    out = np.full(len(a), -1, np.int64)
    out[(n == 0) & (m <= band)] = m[(n == 0) & (m <= band)]
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return out
    width, longest = 2 * band + 1, int(n[order[0]])
    left = np.full((len(order), longest), 1, np.uint64)
    right = np.full((len(order), longest + width), 2, np.uint64)
    for r, p in enumerate(order.tolist()):
        left[r, :n[p]] = a[p] | np.uint64(4)
        right[r, band:band + m[p]] = (b[p] | np.uint64(4))[:longest + width - band]
    far = 1 << 20
    slope = np.arange(width, dtype=np.int32)
    prev = np.broadcast_to(np.where(slope >= band, slope - band, far).astype(np.int32), (len(order), width)).copy()
    sizes = n[order]
    for i in range(longest):
        live = int(np.searchsorted(-sizes, -(i + 1), side="right"))
        prev = prev[:live]
        cur = prev + (left[:live, i, None] != right[:live, i:i + width])
        cur[:, :-1] = np.minimum(cur[:, :-1], prev[:, 1:] + 1)
        cur -= slope
        np.minimum.accumulate(cur, axis=1, out=cur)
        cur += slope
        prev = cur
        done = np.flatnonzero(sizes[:live] == i + 1)
        for r in done.tolist():
            p = order[r]
            off = m[p] - n[p] + band
            if 0 <= off < width and cur[r, off] <= band:
                out[p] = cur[r, off]
    return out


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether 1 - edits / longer length >= similarity, for every pair of word arrays (exactly)."""
    ok = np.zeros(len(pairs), bool)
    most = np.zeros(len(pairs), np.int64)
    todo: list[tuple[int, np.ndarray, np.ndarray]] = []
    for p, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        allowed = most[p] = int(longer * (1 - similarity) + 1e-9)
        if abs(len(a) - len(b)) > allowed:
            continue
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        head = int(differ[0]) if len(differ) else short
        a, b = a[head:], b[head:]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
        tail = int(differ[0]) if len(differ) else short
        a, b = a[:len(a) - tail], b[:len(b) - tail]
        if not len(a) or not len(b):
            ok[p] = max(len(a), len(b)) <= allowed
            continue
        # words in common, counted in 4096 bins (more than there are): a lower bound of the edits
        common = np.minimum(np.bincount((a & np.uint64(4095)).astype(np.int64), minlength=4096),
                            np.bincount((b & np.uint64(4095)).astype(np.int64), minlength=4096)).sum()
        if max(len(a), len(b)) - common <= allowed:
            todo.append((p, a, b))
    band = 16
    while todo:
        todo.sort(key=lambda x: len(x[1]))
        rest, at = [], 0
        while at < len(todo):
            # pairs of like length together, a bounded number of cells per step
            upto = at + max(1, min(256, (1 << 18) // (2 * band + 1), (1 << 21) // max(1, len(todo[at][1]) + 2 * band)))
            part = todo[at:upto]
            at = upto
            d = _banded([x[1] for x in part], [x[2] for x in part], band)
            for (p, a, b), edits in zip(part, d.tolist()):
                if edits >= 0:
                    ok[p] = edits <= most[p]
                elif band < most[p]:
                    rest.append((p, a, b))
        todo, band = rest, band * 4
    return ok


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = binary_views(batch.column("text_a")), binary_views(batch.column("text_b"))
        keep = []
        for i, j in slices(one[1] + two[1], 4 << 20):
            pairs = [(word_hashes(one[0][one[1][r]:one[1][r + 1]].tobytes()), word_hashes(two[0][two[1][r]:two[1][r + 1]].tobytes()))
                     for r in range(i, j)]
            keep.append(aligned(pairs))
        mask = pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, by label spreading with pointer jumps."""
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = written(labels.join(near, "node").join(jump, "label", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near", "root").alias("label")))
        changed = new.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, same, class_id, class_key): the class of every row; ``same`` is the digest of its text."""
    rows = bounded_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"))
    made = rows.mapInArrow(_sketches, "doc_id long, same binary, sketch binary, words long, bins binary")
    nodes = checkpointed(made.filter(F.col("same").isNotNull()).groupBy("same").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("words").alias("words"),
        F.first("bins").alias("bins"))
        .withColumn("node", F.monotonically_increasing_id()))
    pairs, uncovered = candidates(nodes)
    size = nodes.select("node", "words", "same", "rep")
    a, b = (size.select(*[F.col(c).alias(f"{c}_{x}") for c in size.columns]) for x in "ab")
    # texts whose lengths differ by more cannot be that near; a text without words has no near one but its copies
    fit = checkpointed(pairs.join(a, F.col("a") == F.col("node_a")).join(b, F.col("b") == F.col("node_b")).filter(
        F.least("words_a", "words_b") >= F.greatest("words_a", "words_b") * F.lit(SIMILARITY - 1e-9)).select(
        "a", "b", "agree", "same_a", "same_b", "rep_a", "rep_b"))

    def linked(some: DataFrame, text: DataFrame) -> DataFrame:
        side = lambda x: text.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
        return checkpointed(some.select("a", "b").join(side("b"), "b").join(side("a"), "a").select(
            "a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        return checkpointed(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_rep")) & (F.col("same") == F.col("w_same"))).select(
            "node", "text").dropDuplicates(["node"]))

    text = texts_of(fit.select(F.col("a").alias("node"), F.col("same_a").alias("w_same"), F.col("rep_a").alias("w_rep")).unionByName(
        fit.select(F.col("b").alias("node"), F.col("same_b").alias("w_same"), F.col("rep_b").alias("w_rep"))).distinct())
    # each text with the partner it agrees with most, then the pairs not connected by then
    first = fit.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a"))
    links = linked(first, text)
    label = components(links)
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    apart = fit.select("a", "b").join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").filter(
        F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    links = links.unionByName(linked(apart, text))
    labels = components(links)
    # runs whose texts have not all met: those still in different classes
    more = checkpointed(open_links(nodes, uncovered, labels, texts_of))
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    joined = nodes.select("node", "same", "rep", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = joined.groupBy("label").agg(F.min("rep").alias("class_id"), F.min(F.struct(F.col("rep").isNull(), "rep", "same")).alias("k"))
    # texts that are alone keep their own id; the others' classes are spread over salts, as a text may have very many copies
    several = joined.filter((F.col("copies") > 1) | F.col("label").isNotNull()).join(ids, "label").filter(
        (F.col("copies") > 1) | (F.col("same") != F.col("k.same"))).select(
        "same", "class_id", F.col("k.same").alias("class_key"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    every = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    every = every.withColumn("same_", F.coalesce("same", F.concat(F.lit("null").cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    out = every.join(several.withColumnRenamed("same", "same_"), ["same_", "salt"], "left")
    alone = F.col("class_key").isNull()
    return out.select("doc_id", "same", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("class_key", "same").alias("class_key"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row."""
    return classes(docs).select("doc_id", "class_id")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """Filtering form: one row, all columns, of every class (that of the smallest doc_id; any of repeated rows)."""
    own = F.unhex(F.md5(F.col("text").cast("binary"))).alias("own")
    keep = classes(docs).filter(F.col("same").isNotNull() & (F.col("same") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))) \
        .select(F.col("doc_id").alias("rep"), F.col("same").alias("rep_text")).distinct()
    with_text = docs.filter(F.col("text").isNotNull()).select(boxed(docs).alias("all"), F.col("doc_id").alias("id"), own)
    kept = with_text.join(keep, F.col("id").eqNullSafe(F.col("rep")) & (F.col("own") == F.col("rep_text")), "left_semi")
    # repeated rows of a kept document: one stays
    return kept.dropDuplicates(["id", "own"]).select("all.*").unionByName(docs.filter(F.col("text").isNull()))
