"""Packing documents into fixed-length token sequences by swap-based local search.

Tokenisation and placement both run in tasks.  A document becomes its token
ids plus the end id; only documents over ``capacity`` are cut.  Pieces (a few
integers each, no text) are dealt by a hash of their content, so no source or
length class meets in one task, and packed in bounded blocks:

1. each piece, longest first, goes to the fullest bin that takes it;
2. local search over the underfull bins takes the emptiest bin and tries to
   move one of its pieces to a fuller bin, to exchange one piece for one, or
   two pieces for one; the step of greatest increase of the squared fill is
   taken, bins that run empty vanish, and the search ends when no step gains
   or the number of bins has reached the sum of lengths over the capacity;
3. pieces of bins that stay clearly underfull are carried into the task's
   next block.

Defined results: null text counts as empty (the end id alone); repeated rows
are packed once each; an empty table gives no rows; other columns are not
read.  Identifiers of sequences are unique but otherwise arbitrary.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import bounded_batches, texts, worker_cache

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Pieces(dict):
    """Pre-token (lower case) -> its ids as bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.model = tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalnum():  # byte-level letters of ASCII are themselves
            ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = np.asarray(ids, "<u4").tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = out
        return out


class WordIds(dict):
    """Chunk between spaces -> its ids as little-endian 32-bit bytes.

    The tokenizer never joins over white space, so a text's ids are those of
    its chunks.  Plain Latin chunks are cut with the vocabulary's own
    pre-token rule and looked up piece by piece; all others, and those that
    might hold a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = _Pieces(self.tokenizer)
        self.plain = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
        self.cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            out = b""
        elif self.plain(chunk) and "<|" not in chunk:
            out = b"".join(map(self.pieces.__getitem__, self.cut(chunk.lower())))
        else:
            out = np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(chunk) <= 48:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def word_ids(path: str) -> WordIds:
    cache = worker_cache("packing")
    if ("ids", path) not in cache:
        cache["ids", path] = WordIds(path)
    return cache["ids", path]


def _tokenise(path: str | None, capacity: int):
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path(VOCABULARY)
        words = word_ids(where)
        for batch in batches:
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                ids = words.ids((raw or b"").decode("utf-8", "replace")) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; ``path`` names a vocabulary file all executors can read."""
    return bounded_batches(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_tokenise(path, capacity), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        k = bisect_left(gaps, (lengths[i], -1))
        if k < len(gaps):
            gap, b = gaps.pop(k)
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        if gap > lengths[i]:
            insort(gaps, (gap - lengths[i], b))
    return bins


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Move, one-for-one and two-for-one steps from the emptiest bins while the squared fill grows."""
    size = np.asarray(lengths, np.int64)
    least = -(-int(size.sum()) // capacity)
    fill = np.array([int(size[b].sum()) for b in bins], np.int64)
    alive = int((fill > 0).sum())
    where = np.empty(len(size), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    members = [list(b) for b in bins]
    tried: set[int] = set()
    while alive > least:
        open_bins = [b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b not in tried]
        if len(open_bins) < 2:
            break
        e = min(open_bins, key=lambda b: (fill[b], b))
        room = capacity - fill
        others = np.flatnonzero((room > 0) & (fill >= max(1, int(fill[e]))) & (np.arange(len(fill)) != e))
        best = (0, None)
        if len(others):
            out_items = np.flatnonzero(np.isin(where, others))
            y, fy, ry = size[out_items], fill[where[out_items]], room[where[out_items]]
            mine = sorted(members[e], key=lambda i: (-size[i], i))
            one = {}
            for i in mine:
                one.setdefault(int(size[i]), (i,))
            two = {}
            for a in range(min(len(mine), 24)):
                for b in range(a + 1, min(len(mine), 24)):
                    two.setdefault(int(size[mine[a]] + size[mine[b]]), (mine[a], mine[b]))
            for x, give in one.items():  # move: the fullest bin with room
                ok = others[room[others] >= x]
                if len(ok):
                    b = int(ok[np.argmax(fill[ok])])
                    gain = 2 * x * int(fill[b] - fill[e] + x)
                    if gain > best[0]:
                        best = (gain, (give, None, b))
            for x, give in [*one.items(), *two.items()]:  # exchange for one piece y of a fuller bin
                d = x - y
                gain = np.where((d > 0) & (d <= ry), 2 * d * (fy - fill[e] + d), 0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (int(gain[k]), (give, int(out_items[k]), int(where[out_items[k]])))
        if best[1] is None:
            tried.add(e)
            continue
        give, take, b = best[1]
        for i in give:
            members[e].remove(i)
            members[b].append(i)
            where[i] = b
        if take is not None:
            members[b].remove(take)
            members[e].append(take)
            where[take] = e
        fill[b], fill[e] = size[members[b]].sum(), size[members[e]].sum() if members[e] else 0
        tried.discard(b)
        if not members[e]:
            alive -= 1
            tried.clear()
    return [m for m in members if m]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(lengths, best_fit(lengths, capacity), capacity)


def _packer(capacity: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []
        schema = None

        def emit(rows: pa.Table, last: bool):
            nonlocal count
            lengths = rows.column("length").to_pylist()
            order, seq, offset, keep = [], [], [], []
            for items in pack(lengths, capacity):
                if not last and sum(lengths[i] for i in items) < capacity * 0.97:
                    keep += items
                    continue
                at = 0
                for i in items:
                    order.append(i)
                    seq.append(base + count)
                    offset.append(at)
                    at += lengths[i]
                count += 1
            done = rows.take(pa.array(order, pa.int64())).combine_chunks()
            done = done.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            return done, rows.take(pa.array(keep, pa.int64()))

        for batch in batches:
            schema = batch.schema
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                done, rest = emit(pa.Table.from_batches(held, schema), False)
                yield from done.to_batches()
                # a block that closes nothing would only grow: close it all
                if rest.num_rows * 2 > block:
                    done, rest = emit(rest, True)
                    yield from done.to_batches()
                held = rest.to_batches()
        if schema is not None and held:
            done, _ = emit(pa.Table.from_batches(held, schema), True)
            yield from done.to_batches()

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block: int = 32_768) -> DataFrame:
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    return pieces.repartition(key).sortWithinPartitions(key, "doc_id", "piece").mapInArrow(
        _packer(capacity, block), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(pieces_of(docs, path, capacity), capacity)
