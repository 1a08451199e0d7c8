"""Prefix trie of rebuilt conversations by a splitter skeleton.

Rebuilding: the turns of a conversation come in order of ``turn`` (null
first); its first h turns are replaced by the first h of conversation
``c - c % 5`` (all it has if fewer, none if it is absent), with h the unsigned
crc32 of the decimal id modulo 9.  Then every distinct sequence of first
turns is a node of the trie.

A turn is 24 bytes (16 of a digest of role and text, 8 of the text's length),
a conversation is its turns' bytes one after the other, so binary order of
``(path, conv_id)`` is a depth-first order of the trie.  Texts never travel;
what is sorted is 24 bytes a turn, one row a conversation.

1. The rows are range-partitioned and sorted by ``(path, conv_id)`` into
   shards.  ``conv_id`` is part of the key, so a path that a third of all
   conversations share is cut into as many shards as its size asks for.
2. A node whose members lie in several shards begins both neighbours of a
   shard border.  These shared beginnings are the splitter paths; their trie,
   the skeleton, is broadcast.  It has at most ``SKELETON_NODES`` nodes: with
   more, the job starts over with half as many shards (one shard has only the
   root).
3. Every shard is read once, in order, with a stack.  It finishes all nodes
   outside the skeleton, and gives one partial aggregate for each skeleton
   node it meets.
4. Partial aggregates are reduced by ``groupBy`` and summed up the skeleton.

The digest of a skeleton node's ending ids is sequential by its definition.
Shards send ids in packed ascending blocks, and one task streams the blocks
of a node through the hash, holding one at a time.

Defined results: rows with null ``conv_id`` belong to no conversation and are
left out; null role or text counts as empty; turns with equal ``turn`` are
ordered by role, then by the digest of the turn; repeated rows are repeated
turns; an empty table has no nodes; further columns are ignored.  One
conversation is one row (24 bytes a turn), so a single conversation is bounded
by a row's 2 GB, about 80 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import checkpointed

UNIT = 24
FAMILY = 5          # conversations c - c % FAMILY lend their first turns
BORROWED = 9        # h is below this
TURNS_PER_SHARD = 200_000
SKELETON_NODES = 200_000
BLOCK_IDS = 8_192   # ids of one packed block of a skeleton node's endings
FLUSH = 20_000      # finished rows of one Arrow batch

PIECES = ("kind int, skeleton int, conv_id long, depth long, parent_skeleton int, parent_conv_id long, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, ends string")
NODE, PARTIAL, ENDS = 0, 1, 2
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, units): a conversation's turns in order, each as 48 hexadecimal digits."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    unit = F.concat(digest, F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), 16, "0"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), unit.alias("unit")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["unit"].alias("units"))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every rebuilt conversation."""
    own = own_turns(conversations)
    lent = own.filter(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("lender"), F.slice("units", 1, BORROWED - 1).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("int")
    none = F.array().cast("array<string>")
    rows = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("lender"), h.alias("h"),
                      F.slice("units", h + 1, F.greatest(F.size("units") - h, F.lit(0))).alias("rest"))
    units = F.concat(F.slice(F.coalesce("lent", none), F.lit(1), F.col("h")), F.col("rest"))
    return rows.join(lent, "lender", "left").select("conv_id", F.unhex(F.array_join(units, "")).alias("path"))


def shared_units(a: bytes, b: bytes) -> int:
    """How many whole turns two paths begin with in common."""
    n, k = min(len(a), len(b)) // UNIT, 0
    if a[:n * UNIT] == b[:n * UNIT]:
        return n
    while a[k * UNIT:(k + 1) * UNIT] == b[k * UNIT:(k + 1) * UNIT]:
        k += 1
    return k


def _ends_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last path of a shard."""
    first = last = shard = None
    for b in batches:
        if b.num_rows:
            if first is None:
                first, shard = b.column("path")[0].as_py(), b.column("shard")[0].as_py()
            last = b.column("path")[b.num_rows - 1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "first": pa.array([first], pa.binary()),
                                          "last": pa.array([last], pa.binary())})


def _splitter_trie(most: int):
    """Rows (node, parent, unit) of the trie of shared beginnings of neighbouring shards; one row with node -1 beyond ``most``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: dict[tuple[int, bytes], int] = {}
        before, seen = None, False
        for b in batches:
            for first, last in zip(b.column("first").to_pylist(), b.column("last").to_pylist()):
                seen = True
                node = 0
                for k in range(shared_units(before, first) if before is not None and len(trie) < most else 0):
                    node = trie.setdefault((node, first[k * UNIT:(k + 1) * UNIT]), len(trie) + 1)
                    if len(trie) >= most:
                        break
                before = last
        nodes = [(i, p, u) for (p, u), i in trie.items()] if len(trie) < most else [(-1, 0, b"")]
        if seen:
            cols = list(zip(*nodes)) or [(), (), ()]
            yield pa.RecordBatch.from_pydict({"node": pa.array(cols[0], pa.int32()), "parent": pa.array(cols[1], pa.int32()),
                                              "unit": pa.array(cols[2], pa.binary())})
    return run


class _Open:
    """A node on the stack of a shard."""

    __slots__ = ("skeleton", "size", "least", "n", "children", "leaves", "saved", "ends", "block", "waiting")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.size = skeleton, size
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.block, self.waiting = None, [], []


def _finish_shard(trie: dict[tuple[int, bytes], int]):
    """Nodes outside the skeleton whole, skeleton nodes as partial aggregates and blocks of ending ids."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in PIECES.split(", ")]
    nothing = hashlib.sha256().hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        stack: list[_Open] = []
        path = b""

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        def pack(node: _Open) -> None:
            if node.block:
                rows.append((ENDS, node.skeleton, node.block[0], None, None, None, None, None, None, None, ",".join(map(str, node.block))))
                node.block = []

        def close() -> None:
            node, depth = stack.pop(), len(stack)
            rows.extend(r[:5] + (node.least,) + r[6:] for r in node.waiting)
            if node.skeleton >= 0:
                pack(node)
                rows.append((PARTIAL, node.skeleton, node.least, None, None, None, node.n, node.children, node.leaves, node.saved, None))
            else:
                node.leaves = node.leaves or 1
                node.saved += (node.n - 1) * node.size
            if stack:
                up = stack[-1]
                up.n += node.n
                up.least = node.least if up.least is None else min(up.least, node.least)
                if node.skeleton < 0:
                    up.children += 1
                    up.leaves += node.leaves
                    up.saved += node.saved
                    done = (NODE, None, node.least, depth, up.skeleton if up.skeleton >= 0 else None, None, node.n, node.children,
                            node.leaves, node.saved, node.ends.hexdigest() if node.ends else nothing)
                    (rows if up.skeleton >= 0 else up.waiting).append(done)

        for b in batches:
            for conv, now in zip(b.column("conv_id").to_pylist(), b.column("path").to_pylist()):
                if not stack:
                    stack.append(_Open(0, 0))
                keep = shared_units(path, now)
                while len(stack) > keep + 1:
                    close()
                for k in range(len(stack) - 1, len(now) // UNIT):
                    unit = now[k * UNIT:(k + 1) * UNIT]
                    above = stack[-1].skeleton
                    stack.append(_Open(trie.get((above, unit), -1) if above >= 0 else -1, int.from_bytes(unit[16:], "big")))
                path, top = now, stack[-1]
                top.n += 1
                top.least = conv if top.least is None else min(top.least, conv)
                if top.skeleton >= 0:
                    top.block.append(conv)
                    if len(top.block) >= BLOCK_IDS:
                        pack(top)
                elif top.ends is None:
                    top.ends = hashlib.sha256(str(conv).encode())
                else:
                    top.ends.update(f",{conv}".encode())
                if len(rows) >= FLUSH:
                    yield batch()
        while stack:
            close()
            if len(rows) >= FLUSH:
                yield batch()
        if rows:
            yield batch()
    return run


def _digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a skeleton node, streamed over its blocks in order."""
    node, sha = None, None

    def one() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"skeleton": pa.array([node], pa.int32()), "ends": pa.array([sha.hexdigest()], pa.string())})

    for b in batches:
        for k, block in zip(b.column("skeleton").to_pylist(), b.column("ends").to_pylist()):
            if k != node:
                if node is not None:
                    yield one()
                node, sha = k, hashlib.sha256(block.encode())
            else:
                sha.update(b"," + block.encode())
    if node is not None:
        yield one()


def _summed(trie: dict[tuple[int, bytes], int], parts: dict[int, tuple], digests: dict[int, str]) -> list[tuple]:
    """(skeleton, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), leaves and savings summed up the skeleton.

    A node's number is larger than its parent's, so one pass from the last to the first will do.
    """
    above = {i: (p, int.from_bytes(u[16:], "big")) for (p, u), i in trie.items()}
    depth = {0: 0}
    for i in sorted(above):
        depth[i] = depth[above[i][0]] + 1
    total = {i: list(x) for i, x in parts.items()}  # least, n, children, leaves, saved
    out = []
    for i in sorted(total, reverse=True):
        least, n, children, leaves, saved = total[i]
        leaves = leaves if children else 1
        parent = None
        if i:
            up, size = above[i]
            saved += (n - 1) * size
            total[up][2] += 1
            total[up][3] += leaves
            total[up][4] += saved
            parent = total[up][0]
        out.append((i, least, depth[i], parent, n, children, leaves, saved, digests.get(i, hashlib.sha256().hexdigest())))
    return out


def prefix_trie(paths: DataFrame, turns: int, skeleton_nodes: int = SKELETON_NODES, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, path); ``turns``, the rows it came from, sets the number of shards."""
    spark = paths.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // TURNS_PER_SHARD))
    sorted_paths = checkpointed(paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
                                .select("conv_id", "path", F.spark_partition_id().alias("shard")))
    while True:
        borders = sorted_paths.mapInArrow(_ends_of_shards, "shard int, first binary, last binary")
        found = borders.repartition(1).sortWithinPartitions("shard").mapInArrow(
            _splitter_trie(skeleton_nodes), "node int, parent int, unit binary").toArrow()
        if shards == 1 or -1 not in found.column("node").to_pylist():
            break
        shards = max(1, shards // 2)
        sorted_paths = checkpointed(paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
                                    .select("conv_id", "path", F.spark_partition_id().alias("shard")))
    trie = {(p, u): i for i, p, u in zip(*(found.column(c).to_pylist() for c in ("node", "parent", "unit")))}
    sent = spark.sparkContext.broadcast(trie)
    pieces = checkpointed(sorted_paths.mapInArrow(lambda it: _finish_shard(sent.value)(it), PIECES))
    partial = pieces.filter(F.col("kind") == PARTIAL).groupBy("skeleton").agg(
        F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"))
    blocks = pieces.filter(F.col("kind") == ENDS).select("skeleton", "conv_id", "ends")
    digests = blocks.repartition("skeleton").sortWithinPartitions("skeleton", "conv_id").select("skeleton", "ends").mapInArrow(
        _digest_blocks, "skeleton int, ends string")
    top = _summed(trie, {r[0]: tuple(r)[1:] for r in partial.collect()}, {r.skeleton: r.ends for r in digests.collect()})
    skeleton = spark.createDataFrame(top, "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, "
                                          "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    known = F.broadcast(skeleton.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above")))
    local = pieces.filter(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256").join(known, "parent_skeleton", "left")
    local = local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return local.select(*OUT).unionByName(skeleton.select(*OUT))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations."""
    return prefix_trie(rebuilt_paths(conversations), conversations.count())


#: The same nodes in DuckDB's SQL, by prefix lists; crc32 is spelled out bit by bit (3988292384 is its polynomial, a fixed value).
ORACLE_SQL = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 5 AS lender, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda acc, b: xor(xor(acc, b) >> 1, 3988292384 * (xor(acc, b) & 1))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM own)),
turns AS (
  SELECT i.c, 0 AS part, o.k, o.role, o.text FROM ids i JOIN own o ON o.c = i.lender AND o.k <= i.h
  UNION ALL
  SELECT i.c, 1, o.k, o.role, o.text FROM ids i JOIN own o ON o.c = i.c AND o.k > i.h),
paths AS (
  SELECT i.c, coalesce(p.path, []) AS path
  FROM ids i LEFT JOIN (SELECT c, list({'role': role, 'text': text} ORDER BY part, k) AS path FROM turns GROUP BY c) p USING (c)),
members AS (
  SELECT c, d, path[1:d] AS key, len(path) = d AS ends
  FROM (SELECT c, path, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (
  SELECT d, key, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(key[d].text) END AS saved
  FROM members GROUP BY d, key),
linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id,
         (SELECT count(*) FROM nodes x WHERE x.d = n.d + 1 AND x.key[1:n.d] = n.key) AS n_children
  FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.key = n.key[1:n.d - 1])
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children,
       count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens, a.ends_sha256
FROM linked a JOIN linked b ON b.d >= a.d AND b.key[1:a.d] = a.key
GROUP BY a.conv_id, a.d, a.key, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
"""
