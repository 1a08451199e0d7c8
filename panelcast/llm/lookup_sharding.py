"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table,
``(offset + j * skip) mod M``.  The shards take turns; in its turn a shard
claims the next free slot of its permutation, until all slots are taken, so
shares differ by one slot at most and removing a shard moves few other keys.

A key's slot is ``md5(key)[:15 hex] mod M``; the table (M rows of two
integers, a size fixed by the parameter and independent of the data) is
broadcast, so placement is one hash lookup per row with no shuffle.

Defined results: a null key goes to the slot of the empty string; rows with
equal keys share a shard; an empty table gives no rows; other columns of the
input pass through unless they bear an output name (``slot``, ``shard``),
which the output replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
HEX_DIGITS = 15  # 60 bits: fits a signed 64-bit integer


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX_DIGITS], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Index of the owning shard for every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct and at least one")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the table size must be a prime, at least the number of shards")
    offset = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    at = list(offset)
    left = slots
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``."""
    lookup = df.sparkSession.createDataFrame(
        [(j, shards[i]) for j, i in enumerate(fill_table(shards, slots))], "slot long, shard string")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    return df.select(*keep, slot_of(F.col(f"`{key}`"), slots).alias("slot")).join(F.broadcast(lookup), "slot").select(
        *keep, "slot", "shard")


def place_documents(docs: DataFrame, n_shards: int = 64) -> DataFrame:
    """(doc_id, slot, shard) of every document, for shards ``shard-000`` and so on."""
    return place(docs.select("doc_id"), "doc_id", [f"shard-{i:03d}" for i in range(n_shards)])
