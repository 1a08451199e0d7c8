"""Exact substring dedup by suffix sorting with linear grouping.

Every byte covered by a ``LENGTH``-byte string that also starts earlier
(smaller doc_id, or same document, earlier start) is removed.  The suffix sort
(:func:`suffix_order`) works by grouping: suffixes are first put into groups
of equal Lyndon prefixes, processed in descending order with pointers to the
previous smaller suffix; then one ascending pass emits the order inside every
group, with no renaming and no recursion.  Suffixes with the same first
``LENGTH`` bytes are neighbours in that order; all but the earliest of them
are repeats.

What makes it a distributed job is that equal strings can be made to meet:
the string's least hashed 24-byte window (its minimizer) depends on content
alone.  Consecutive starts with the same minimizer form a *piece*.

1. Pieces travel as five integers to their minimizer; equal pieces collapse
   to their first occurrence (already inside each task), whose copies are
   repeats as a whole.  A minimizer with one distinct piece is done.
2. The distinct pieces of the other minimizers travel with their bytes (100 to
   176 each).  Stretches none of whose strings can recur (by a hash of every
   string) are left out, equal stretches collapse again, and what is left of a
   minimizer is suffix-sorted as one text.
3. A minimizer with more than ``HOT`` distinct pieces, such as the edge of a
   passage that a third of all documents share, is dealt further: a string
   that has o bytes before the minimizer goes to the key of the 2^i <= o bytes
   before it and of the bytes after it that all such strings have, so equal
   strings still meet and unequal ones part.

Defined results: null text counts as empty; texts under ``LENGTH`` bytes stay
whole; repeated rows of a document count as one occurrence and are cut alike;
null ids come last in the order; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import cuts
from panelcast.llm.common import binary_views, bounded_batches, checkpointed, mix64

LENGTH, GRAM = 100, 24
SIDE = LENGTH - GRAM          # bytes of a string outside its minimizer
HOT = 2048
BLOCK = 150_000
PART = 1 << 22                # starts handled at once in a long text
COUNT_BITS, ANCHOR_BITS = 7, 7  # packed: start, number of starts, place of the minimizer
KNOWN = np.int64(-(1 << 63))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
#: Numbers of bytes before the minimizer that are dealt together: 0, 1, 2-3, 4-7, ...
STEPS = [(0, 0)] + [(1 << i, min((2 << i) - 1, SIDE)) for i in range(SIDE.bit_length())]


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every ``length`` bytes, by doubling."""
    powers, width, total, have = _BYTES[data], 1, None, 0
    left = length
    while left:
        if left & 1:
            if total is None:
                total, have = powers, width
            else:  # the bytes so far, then `width` more
                n = len(data) - have - width + 1
                total = total[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + powers[have:have + n]
                have += width
        left >>= 1
        if left:
            n = len(data) - 2 * width + 1
            powers = powers[:max(0, n)] * np.uint64(pow(_BASE, width, 1 << 64)) + powers[width:width + max(0, n)]
            width *= 2
    return mix64(total)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (width - have)], x[width - have:]) if width > have else x


def pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer hash, first start, number of starts, place of the minimizer) of the pieces of one text part."""
    grams = window_hashes(data, GRAM)
    tagged = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)  # ties: the leftmost
    place = (sliding_least(tagged, SIDE + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(place)))
    return grams[place[first]].view(np.int64), first, count, place[first]


def suffix_order(text) -> list[int]:
    """Suffix array of a sequence of small integers, by Lyndon grouping.

    Phase 1 keeps the groups in a linked order.  For the highest unprocessed
    group, each member finds the nearest earlier suffix in a lower group; the
    suffixes found grow their Lyndon prefix by the group's, once per member
    that found them, and leave their group for new ones right above it, the
    more often found the higher.  Phase 2 takes suffixes in ascending order,
    starting with the empty one; those whose Lyndon prefix ends where the
    taken suffix begins are next in their groups.
    """
    n = len(text)
    if n == 0:
        return []
    members: list[list[int]] = []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    for c in sorted(by_symbol):
        for i in by_symbol[c]:
            group[i] = len(members)
        members.append(by_symbol[c])
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    size = [len(m) for m in members]
    done = bytearray(n)
    before = [-1] * n
    top = len(members) - 1
    now = top
    while now >= 0:
        own = members[now]
        if own and size[now]:
            own = [i for i in own if group[i] == now]
            own.sort()
            members[now] = own
            found: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and (done[p] or group[p] == now):
                    p = before[p]
                before[i] = p
                if p >= 0:
                    found[p] = found.get(p, 0) + 1
            for i in own:
                done[i] = 1
            if found:
                split: dict[tuple[int, int], list[int]] = {}
                for p, times in found.items():
                    split.setdefault((group[p], times), []).append(p)
                for (g, times) in sorted(split, key=lambda x: (x[0], -x[1])):
                    # highest count first, each placed right above the old group
                    movers = split[g, times]
                    if len(movers) == size[g]:
                        continue
                    new = len(members)
                    members.append(movers)
                    size.append(len(movers))
                    size[g] -= len(movers)
                    for p in movers:
                        group[p] = new
                    up = above[g]
                    below.append(g)
                    above.append(up)
                    above[g] = new
                    if up >= 0:
                        below[up] = new
                    else:
                        top = new
        now = below[now]
    start = [0] * len(members)
    g, at = top, n
    while g >= 0:
        at -= size[g]
        start[g] = at
        g = below[g]
    order = [0] * n
    placed = bytearray(n)
    taken = n
    k = 0
    while True:
        p = taken - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            order[start[g]] = p
            start[g] += 1
            p = before[p]
        if k == n:
            return order
        taken = order[k]
        k += 1


def repeats(stretches: list[bytes], places: list[tuple], length: int = LENGTH) -> list[tuple[int, int]]:
    """(stretch, start) of every string that some stretch has at an earlier place; ``places`` orders the stretches' first bytes.

    A place is (document, row, start); stretches of one document don't share starts.
    """
    text = b"\0".join(stretches)
    # bytes move up by one so that the separator is the smallest symbol
    symbols = [b + 1 for b in text]
    owner, at = [], 0
    for s, x in enumerate(stretches):
        if s:
            symbols[at - 1] = 0
        owner.append(at)
        at += len(x) + 1
    valid = bytearray(len(text))
    whose = [0] * len(text)
    for s, x in enumerate(stretches):
        a = owner[s]
        m = len(x) - length + 1
        valid[a:a + m] = b"\1" * m
        whose[a:a + m] = [s] * m
    out: list[tuple[int, int]] = []
    last, best = None, None
    for i in suffix_order(symbols):
        if not valid[i]:
            continue
        s = whose[i]
        doc, row, start = places[s]
        here = ((doc, row, start + i - owner[s]), s, i - owner[s])
        if last is not None and text[i:i + length] == last:
            if here[0] < best[0]:
                out.append(best[1:])
                best = here
            elif here[0] > best[0]:
                out.append(here[1:])
        else:
            last, best = text[i:i + length], here
    return out


def _collapse(parts: list) -> pa.RecordBatch:
    """One row per (minimizer, digest); further occurrences are marked and dealt by their own hash."""
    key, digest, doc, row, packed = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((packed, row, doc, digest, key))
    key, digest, doc, row, packed = key[order], digest[order], doc[order], row[order], packed[order]
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    later = same & ((doc != doc[first]) | (row != row[first]) | (packed != packed[first]))
    keep = later | ~same
    key[later] = mix64((doc[later].astype(np.uint64) * np.uint64(31)) ^ row[later].astype(np.uint64) ^ packed[later].astype(np.uint64)).astype(np.int64)
    digest[later] = 0
    packed[later] |= KNOWN
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, digest, doc, row, packed)], ["key", "digest", "doc", "row", "packed"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    parts, held = [], 0
    for batch in batches:
        data, offs, _ = binary_views(batch.column("text"))
        docs, rows = batch.column("__doc").to_pylist(), batch.column("__row").to_pylist()
        for i in range(batch.num_rows):
            size = int(offs[i + 1] - offs[i])
            for a in range(0, size - LENGTH + 1, PART):
                own = data[offs[i] + a:offs[i] + min(size, a + PART + LENGTH - 1)]
                key, first, count, place = pieces(own)
                raw = own.tobytes()
                ends = (first + count + (LENGTH - 1)).tolist()
                marks = np.fromiter((digest(raw[s:e]) for s, e in zip(first.tolist(), ends)), np.uint64, len(ends)).view(np.int64)
                packed = (((first + a) << COUNT_BITS | count) << ANCHOR_BITS) | (place - first)
                parts.append((key, marks, np.full(len(key), docs[i], np.int64), np.full(len(key), rows[i], np.int64), packed))
                held += len(key)
                if held >= BLOCK:
                    yield _collapse(parts)
                    parts, held = [], 0
    if parts:
        yield _collapse(parts)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    anchor = packed & np.int64((1 << ANCHOR_BITS) - 1)
    packed = packed >> ANCHOR_BITS
    count = packed & np.int64((1 << COUNT_BITS) - 1)
    return packed >> COUNT_BITS, count, anchor


_MET = "__doc long, __row long, start long, end long, key long, anchor int, hot boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by minimizer, digest and place: repeated pieces (no key), and distinct pieces of minimizers with several."""
    def out(doc, row, packed, key, hot):
        start, count, anchor = _unpack(packed)
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(row), pa.array(start), pa.array(start + count + (LENGTH - 1)),
             pa.nulls(n, pa.int64()) if key is None else pa.array(key), pa.array(anchor.astype(np.int32)), pa.array(hot if key is not None else np.zeros(n, bool))],
            [c.split()[0] for c in _MET.split(", ")])

    none = np.zeros(0, np.int64)
    wait = [none] * 4                 # (key, doc, row, packed) of the last minimizer's distinct pieces so far (HOT + 1 at most are held)
    gone, hot_key = 0, None           # pieces of a hot minimizer already sent
    last_digest, last_first = None, (0, 0, 0)
    for batch in batches:
        key, digest, doc, row, packed = (np.asarray(batch.column(c)) for c in ("key", "digest", "doc", "row", "packed"))
        known = packed < 0
        if known.any():
            yield out(doc[known], row[known], packed[known] & ~KNOWN, None, None)
            key, digest, doc, row, packed = (x[~known] for x in (key, digest, doc, row, packed))
        if not len(key):
            continue
        lead = 0
        if last_digest is not None:   # put the first occurrence in hand before the batch
            lead = 1
            key, digest, doc, row, packed = (np.concatenate([[x], y]) for x, y in zip((*last_digest, *last_first), (key, digest, doc, row, packed)))
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        later = same & ((doc != doc[first]) | (row != row[first]) | (packed != packed[first]))
        if later.any():
            yield out(doc[later], row[later], packed[later], None, None)
        f = int(first[-1])
        last_digest, last_first = (key[f], digest[f]), (doc[f], row[f], packed[f])
        fresh = ~same
        fresh[:lead] = False
        key, doc, row, packed = key[fresh], doc[fresh], row[fresh], packed[fresh]
        if not len(key):
            continue
        key, doc, row, packed = (np.concatenate([x, y]) for x, y in zip(wait, (key, doc, row, packed)))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        if gone and key[0] != hot_key:
            gone = 0
        extra = np.zeros(len(start), np.int64)
        if gone:
            extra[0] = gone
        number = np.repeat(count + extra, count)
        complete = np.ones(len(key), bool)
        tail = int(start[-1])
        if count[-1] + extra[-1] <= HOT:
            complete[tail:] = False
        send = complete & (number > 1)
        if send.any():
            yield out(doc[send], row[send], packed[send], key[send], number[send] > HOT)
        if complete[tail:].all():
            gone, hot_key = int(count[-1] + extra[-1]), key[-1]
            wait = [none] * 4
        else:
            gone = 0
            wait = [key[tail:], doc[tail:], row[tail:], packed[tail:]]
    if len(wait[0]) > 1:
        yield out(wait[1], wait[2], wait[3], wait[0], np.zeros(len(wait[0]), bool))


_SENT = "key long, doc long, row long, start long, size int, text binary"


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of distinct pieces, those of hot minimizers dealt further; equal ones collapse within a block."""
    import xxhash

    names = [c.split()[0] for c in _SENT.split(", ")]

    def flush(rows: list) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:4])
        met: dict[tuple[int, bytes], tuple] = {}
        out = []
        for key, doc, row, start, text in rows:
            if met.setdefault((key, text), (doc, row, start)) == (doc, row, start):
                out.append((key, doc, row, start, len(text), text))
            else:
                out.append((xxhash.xxh3_64_intdigest(b"%d %d %d" % (doc, row, start)) - (1 << 63), doc, row, start, len(text), None))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names)

    rows: list = []
    for batch in batches:
        data, offs, _ = binary_views(batch.column("text"))
        docs, ids = batch.column("__doc").to_pylist(), batch.column("__row").to_pylist()
        for i, own in enumerate(batch.column("open")):
            v = own.values
            raw = data[offs[i]:offs[i + 1]].tobytes()
            for key, start, end, anchor, hot in zip(*(v.field(j).to_pylist() for j in range(5))):
                if not hot:
                    rows.append((key, docs[i], ids[i], start, raw[start:end]))
                    continue
                at = start + anchor
                most, least = anchor, anchor - (end - start - LENGTH)  # bytes before the minimizer
                for step, (low, high) in enumerate(STEPS):
                    a, b = max(low, least), min(high, most)
                    if a <= b:
                        common = raw[at - low:at + GRAM + SIDE - high]
                        sub = xxhash.xxh3_64_intdigest(common, (key ^ (step * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                        rows.append((sub, docs[i], ids[i], at - b, raw[at - b:at - a + LENGTH]))
            if len(rows) >= 50_000:
                yield flush(rows)
                rows = []
    if rows:
        yield flush(rows)


_SPANS = "__doc long, __row long, start long, end long"


def _sorted_groups(key, doc, row, start, data, offs) -> list[tuple]:
    """Repeated spans (doc, row, start, end) within whole groups of rows sorted by key, document and place."""
    out: list[tuple] = []
    n = len(key)
    size = np.diff(offs)
    owner = np.repeat(np.arange(n), size)
    inside = np.arange(len(data)) - np.repeat(offs[:-1], size)
    valid = inside <= (size[owner] - LENGTH)
    starts = np.flatnonzero(valid)
    if len(data) < LENGTH or not len(starts):
        return out
    marks = mix64(window_hashes(data, LENGTH)[starts] ^ mix64(key.view(np.uint64))[owner[starts]])
    order = np.argsort(marks, kind="stable")
    ranked = marks[order]
    twin = np.zeros(len(ranked), bool)
    equal = ranked[1:] == ranked[:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    recurs = np.zeros(len(starts), bool)
    recurs[order[twin]] = True
    starts = starts[recurs]           # ascending; runs of neighbours in one row are stretches
    if not len(starts):
        return out
    new = np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (owner[starts[1:]] != owner[starts[:-1]])])
    a = starts[new]
    b = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1])
    raw = data.tobytes()
    whose = owner[a]
    at, group, stretches, places, copies = 0, None, [], [], {}

    def close() -> None:
        for s, i in repeats(stretches, places):
            d, of, first = places[s]
            out.append((d, of, first + i, first + i + LENGTH))

    for r, x, y in zip(whose.tolist(), a.tolist(), b.tolist()):
        if key[r] != group:
            if stretches:
                close()
            group, stretches, places, copies = key[r], [], [], {}
        text = raw[x:y + LENGTH]
        here = (int(doc[r]), int(row[r]), int(start[r]) + x - int(offs[r]))
        if text in copies:
            if here != copies[text]:
                out.append((*here, here[2] + len(text)))
        else:
            copies[text] = here
            stretches.append(text)
            places.append(here)
    if stretches:
        close()
    return out


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(spans: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*spans)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [c.split()[0] for c in _SPANS.split(", ")])

    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        data, offs, _ = binary_views(rows.column("text"))
        data, offs = data[offs[0]:offs[-1]], offs - offs[0]
        key, doc, row, start = (np.asarray(rows.column(c)) for c in ("key", "doc", "row", "start"))
        return out(_sorted_groups(key, doc, row, start, data, offs))

    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        known = np.asarray(rows.column("text").is_null())
        if known.any():
            doc, row, start, size = (np.asarray(rows.column(c))[known] for c in ("doc", "row", "start", "size"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(row), pa.array(start), pa.array(start + size)], [c.split()[0] for c in _SPANS.split(", ")])
            rows = rows.filter(pa.array(~known))
        if not rows.num_rows:
            continue
        held.append(rows)
        count += rows.num_rows
        if count >= 20_000:
            whole = pa.concat_tables(held)
            key = np.asarray(whole.column("key"))
            edge = int(np.flatnonzero(key == key[-1])[0])
            if edge:
                yield settle(whole.slice(0, edge))
            held = [whole.slice(edge)]
            count = whole.num_rows - edge
    if held:
        yield settle(pa.concat_tables(held))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(__doc, __row, start, end): spans whose union is what the contract removes."""
    texts = cuts.keyed(bounded_batches(docs).select("doc_id", "text")).select("__doc", "__row", F.col("text").cast("binary").alias("text"))
    made = texts.mapInArrow(_pieces, "key long, digest long, doc long, row long, packed long")
    met = checkpointed(made.repartition("key").sortWithinPartitions("key", "digest", "doc", "row", "packed").mapInArrow(_meet, _MET), release=True)
    open_ = met.filter(F.col("key").isNotNull()).groupBy("__doc", "__row").agg(
        F.collect_set(F.struct("key", "start", "end", "anchor", "hot")).alias("open"))
    sent = texts.dropDuplicates(["__doc", "__row"]).join(open_, ["__doc", "__row"]).mapInArrow(_send, _SENT)
    found = checkpointed(sent.repartition("key").sortWithinPartitions("key", "doc", "row", "start").mapInArrow(_sort, _SPANS), release=True)
    return met.filter(F.col("key").isNull()).select("__doc", "__row", "start", "end").unionByName(found)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return cuts.digests(docs, repeated_spans(docs))
