"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash over the last 32 bytes (a table value per byte, shifted left once
per step) cuts a text wherever its top bits are zero, between ``MIN_CHUNK``
and ``MAX_CHUNK`` bytes after the last cut and never inside a character.
Cuts depend on content alone, so an insertion shifts no chunk but its own.
Chunks get a 128-bit digest; every occurrence but the first (smallest doc_id,
then start) of a digest is a duplicate, and runs of adjacent duplicate chunks
of at least ``MIN_RUN`` bytes are removed.

Scale: chunks travel as five integers, without text.  Each task first meets
its own chunks and sends one candidate per digest, so a chunk that a third of
all documents share arrives once per block of a task; the occurrences already
known to be duplicates are dealt by a hash of their own.  One shuffle by digest
finds the first occurrences in a stream, one by document brings the spans to
the texts.

Defined results: null text counts as empty (and stays null in the filtering
form); texts shorter than a run stay whole; repeated rows of a document count
as one occurrence and are cut alike; null ids come last in the order; other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import cuts
from panelcast.llm.common import binary_views, bounded_batches, mix64

MIN_CHUNK, MAX_CHUNK, MIN_RUN = 24, 192, 100
CUT_BITS = 5
BLOCK = 150_000
LENGTH_BITS = 12

#: Table of the gear hash: 256 values from a fixed mixing rule.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of GEAR[byte] << distance over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if step < len(h):
            h[step:] += h[:-step] << np.uint32(step)
    return h


def cut_points(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text; the last is its length."""
    n = len(data)
    if n == 0:
        return []
    starts_char = np.append((data[1:] & 0xC0) != 0x80, True)
    wanted = np.flatnonzero((gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) & starts_char) + 1
    out, last = [], 0
    for c in [*wanted.tolist(), n]:
        while c - last > MAX_CHUNK:
            last += MAX_CHUNK
            back = 0
            while back < 3 and (data[last - back] & 0xC0) == 0x80:
                back += 1
            last -= back
            out.append(last)
        if c - last >= MIN_CHUNK:
            out.append(c)
            last = c
    if last < n:
        out.append(n)
    return out


def _block(parts: list) -> pa.RecordBatch:
    """One candidate per digest; the other occurrences marked by the sign of ``packed`` and dealt by their own hash."""
    hi, lo, doc, row, packed = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((packed, row, doc, lo, hi))
    hi, lo, doc, row, packed = hi[order], lo[order], doc[order], row[order], packed[order]
    same = np.zeros(len(hi), bool)
    same[1:] = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(hi))))
    later = same & ((doc != doc[first]) | (row != row[first]) | (packed != packed[first]))
    keep = later | ~same
    hi[later] = mix64((doc[later].astype(np.uint64) * np.uint64(31)) ^ row[later].astype(np.uint64) ^ packed[later].astype(np.uint64)).astype(np.int64)
    lo[later] = 0
    packed[later] |= np.int64(-(1 << 63))
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (hi, lo, doc, row, packed)], ["hi", "lo", "doc", "row", "packed"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    parts, held = [], 0
    for batch in batches:
        data, offs, _ = binary_views(batch.column("text"))
        docs, rows = batch.column("__doc").to_pylist(), batch.column("__row").to_pylist()
        for i in range(batch.num_rows):
            own = data[offs[i]:offs[i + 1]]
            ends = cut_points(own)
            if not ends:
                continue
            raw = own.tobytes()
            digest = xxhash.xxh3_128_digest
            both = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip([0, *ends], ends)]), np.int64).reshape(-1, 2)
            end = np.asarray(ends, np.int64)
            start = np.concatenate([[0], end[:-1]])
            packed = (start << LENGTH_BITS) | (end - start)
            parts.append((both[:, 0], both[:, 1], np.full(len(end), docs[i], np.int64), np.full(len(end), rows[i], np.int64), packed))
            held += len(end)
            if held >= BLOCK:
                yield _block(parts)
                parts, held = [], 0
    if parts:
        yield _block(parts)


def _duplicates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, document and place: the spans that are not their digest's first occurrence."""
    last = None  # (hi, lo, doc, row, packed) of the first occurrence of the digest in hand
    for batch in batches:
        hi, lo, doc, row, packed = (np.asarray(batch.column(c)) for c in ("hi", "lo", "doc", "row", "packed"))
        known = packed < 0
        at = np.flatnonzero(~known)
        dup = known.copy()
        if len(at):
            h, w, d, r, p = hi[at], lo[at], doc[at], row[at], packed[at]
            if last is not None:
                h, w, d, r, p = (np.concatenate([[x], y]) for x, y in zip(last, (h, w, d, r, p)))
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            later = same & ((d != d[first]) | (r != r[first]) | (p != p[first]))
            dup[at] = later[1:] if last is not None else later
            f = first[-1]
            last = (h[f], w[f], d[f], r[f], p[f])
        packed = packed[dup] & np.int64((1 << 63) - 1)
        start = packed >> LENGTH_BITS
        size = packed & np.int64((1 << LENGTH_BITS) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[dup]), pa.array(row[dup]), pa.array(start), pa.array(start + size)],
            ["__doc", "__row", "start", "end"])


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(__doc, __row, start, end) of every chunk that is not the first of its digest."""
    chunks = cuts.keyed(bounded_batches(docs).select("doc_id", "text")).select("__doc", "__row", F.col("text").cast("binary").alias("text")) \
        .mapInArrow(_chunks, "hi long, lo long, doc long, row long, packed long")
    return chunks.repartition("hi").sortWithinPartitions("hi", "lo", "doc", "row", "packed").mapInArrow(
        _duplicates, "__doc long, __row long, start long, end long")


def dedup_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cuts.digests(docs, duplicate_spans(docs), MIN_RUN)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts."""
    return cuts.cut_texts(docs, duplicate_spans(docs), MIN_RUN)
