"""Merkle manifest of a dataset by checkpoint-and-recompute.

Every row is a leaf (SHA-256 of its columns, each as byte count, ``:``, value,
or ``-`` for null).  The leaves of a language, ascending by id, form a binary
tree; the languages' roots, ordered by language, form one more.  The last node
of a level may be alone; it is hashed by itself.

Only every ``LEVELS``-th level is stored, as rows of up to ``2 ** LEVELS``
neighbouring nodes: the aligned subtree that hangs below one node of the next
stored level.  Levels in between are never written.  A proof takes, from the
last stored level down, one stored row and the proof of the node above it,
computes the interior nodes of this subtree again, gives each stored node its
siblings, and forgets the interior.

* Leaves are hashed at the scan; texts never travel.
* Leaves get their place by a range sort on (language, id, leaf, scan place),
  so a language, an id or a repeated row that a third of the table shares is
  spread over many tasks.  A shard needs to know only where its first language
  goes on: one number a shard.
* A shard packs its leaves into stored rows before anything is shuffled.

Defined results: a null language comes before all others and has a tree of its
own; null ids come first; equal ids are ordered by their leaf's hash; rows
repeated as a whole are leaves of their own; a null id is never tampered with;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import checkpointed

LEVELS = 8
TAMPER_EVERY = 7
LEFT, RIGHT = b"\x01", b"\x02"  # on which side the sibling of a step stands
ALONE = b"\x00"


def H(*hexes: bytes) -> bytes:
    return hashlib.sha256(b"".join(hexes)).hexdigest().encode()


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*cols: Column) -> Column:
    """The leaf's digest as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in cols]).cast("binary"), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(tree, id, leaf, tampered, place); ``tampered`` is the changed row's leaf where a row is to be changed, else null."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    hit = F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_EVERY == 0
    more = n_chars.cast("decimal(20,0)") + 1
    return docs.select(
        F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("tree"), doc_id.cast("long").alias("id"),
        leaf_hash(doc_id, source, lang, n_chars, text).alias("leaf"),
        F.when(hit & n_chars.isNotNull(), leaf_hash(doc_id, source, lang, more, text)).alias("tampered"),
        F.monotonically_increasing_id().alias("place"))


def _starts(stats: list) -> dict[int, int]:
    """For each shard, how many leaves of its first tree lie in the shards before it."""
    out, before, carried = {}, None, 0
    for shard, first, last, n_last in sorted(stats):
        out[shard] = carried if first == before else 0
        carried = n_last + (out[shard] if first == last else 0)
        before = last
    return out


def _packed(starts: dict[int, int], size: int):
    """Leaves of a sorted shard as (tree, block, at, ids, leaves, tampered): pieces of stored rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at, keep = None, 0, []

        def piece(rows: list, first: int) -> dict:
            return {"tree": tree, "block": first // size, "at": first, "ids": [r[0] for r in rows],
                    "leaves": b"".join(r[1] for r in rows), "tampered": [r[2] for r in rows]}

        for b in batches:
            out = []
            schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("ids", pa.list_(b.schema.field("id").type)),
                                ("leaves", pa.binary()), ("tampered", pa.list_(pa.binary()))])
            for shard, t, i, leaf, bad in zip(*(b.column(c).to_pylist() for c in ("shard", "tree", "id", "leaf", "tampered"))):
                if t != tree:
                    if keep:
                        out.append(piece(keep, at - len(keep)))
                    at, keep = starts[shard] if tree is None else 0, []
                    tree = t
                keep.append((i, leaf, bad))
                at += 1
                if at % size == 0:
                    out.append(piece(keep, at - len(keep)))
                    keep = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if keep:
            yield pa.RecordBatch.from_pylist([piece(keep, at - len(keep))], schema)
    return run


def interior(nodes: list[bytes], block: int, levels: int) -> list[list[bytes]]:
    """All levels of an aligned subtree from its stored nodes up to its top.

    Only the first subtree of a stored level can be a whole tree; then it ends
    where one node is left.  Every other one goes up all ``levels``.
    """
    up = levels if block else min(levels, (len(nodes) - 1).bit_length())
    out = [nodes]
    for _ in range(up):
        at = out[-1]
        out.append([H(*at[k:k + 2]) for k in range(0, len(at), 2)])
    return out


def _hexes(packed: bytes) -> list[bytes]:
    text = packed.hex().encode()
    return [text[k:k + 64] for k in range(0, len(text), 64)]


def _with_top(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = [bytes.fromhex(interior(_hexes(x), k, levels)[-1][0].decode())
                    for k, x in zip(b.column("block").to_pylist(), b.column("leaves").to_pylist())]
            yield b.append_column("top", pa.array(tops, pa.binary()))
    return run


def _add_top(df: DataFrame, levels: int) -> DataFrame:
    kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return checkpointed(df.mapInArrow(_with_top(levels), f"{kinds}, top binary"))


def build(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Stored levels of the trees of ``leaves`` (tree, id, leaf, tampered, place), the leaves first.

    A level has rows (tree, block, leaves: its up to 2 ** levels nodes' digests
    in a row, top: the node above them); the first has ids and tampered leaves too.
    """
    size = 1 << levels
    kind = dict(leaves.dtypes)["id"]
    order = ["tree", "id", "leaf", "place"]
    shards = checkpointed(leaves.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "tree", "id", "leaf", "tampered", F.spark_partition_id().alias("shard")))
    counts = shards.groupBy("shard", "tree").agg(F.count("*").alias("n"))
    stats = counts.groupBy("shard").agg(F.min("tree"), F.max("tree"), F.max_by("n", "tree"))
    starts = _starts([tuple(r) for r in stats.collect()])
    pieces = shards.mapInArrow(_packed(starts, size),
                               f"tree string, block long, at long, ids array<{kind}>, leaves binary, tampered array<binary>")
    parts = F.sort_array(F.collect_list(F.struct("at", "ids", "leaves", "tampered")))
    whole = pieces.groupBy("tree", "block").agg(parts.alias("p"))
    stored = [_add_top(whole.select("tree", "block", F.flatten("p.ids").alias("ids"), _joined(F.col("p.leaves")).alias("leaves"),
                                    F.flatten("p.tampered").alias("tampered")), levels)]
    while not stored[-1].filter(F.col("block") > 0).isEmpty():
        below = stored[-1].select("tree", "block", "top")
        rows = below.groupBy("tree", F.expr(f"block div {size}").alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("block", "top")))["top"].alias("p"))
        stored.append(_add_top(rows.select("tree", F.col("up").alias("block"), _joined(F.col("p")).alias("leaves")), levels))
    return stored


def _joined(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def _steps(levels: list[list[bytes]], k: int) -> bytes:
    """The siblings of stored node ``k`` up to the subtree's top: a side, then the digest, for each level."""
    out = []
    for at in levels[:-1]:
        other = k ^ 1
        out.append((LEFT if other < k else RIGHT) + bytes.fromhex(at[other].decode()) if other < len(at) else ALONE)
        k >>= 1
    return b"".join(out)


def read_steps(steps: bytes) -> list[tuple[bytes, bytes]]:
    """(side, sibling's hex digest; empty where the node is alone) from the leaf up."""
    out, at = [], 0
    while at < len(steps):
        side = steps[at:at + 1]
        long = 0 if side == ALONE else 32
        out.append((side, steps[at + 1:at + 1 + long].hex().encode()))
        at += 1 + long
    return out


def fold(leaf: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for side, other in steps:
        leaf = H(leaf) if side == ALONE else H(other, leaf) if side == LEFT else H(leaf, other)
    return leaf


def _one_level_down(levels: int, stored_size: int):
    """Proofs of the nodes of a stored row: (tree, block: the node's number, steps, subroot, root)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("tree", "block", "leaves", "steps", "subroot", "root"))
            for tree, block, packed, steps, subroot, root in zip(*cols):
                all_levels = interior(_hexes(packed), block, levels)
                n = len(all_levels[0])
                yield pa.RecordBatch.from_pydict({
                    "tree": [tree] * n, "block": pa.array(range(block * stored_size, block * stored_size + n), pa.int64()),
                    "steps": pa.array([_steps(all_levels, k) + steps for k in range(n)], pa.binary()),
                    "subroot": pa.array([subroot] * n, pa.binary()), "root": pa.array([root] * n, pa.binary())})
    return run


def _leaf_proofs(levels: int, kind: pa.DataType):
    """Proofs of the leaves: (id, leaf, tampered, steps, subroot, root)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("block", "ids", "leaves", "tampered", "steps", "subroot", "root"))
            for block, ids, packed, tampered, steps, subroot, root in zip(*cols):
                all_levels = interior(_hexes(packed), block, levels)
                n = len(ids)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(ids, kind), "leaf": pa.array([packed[32 * k:32 * k + 32] for k in range(n)], pa.binary()),
                    "tampered": pa.array(tampered, pa.binary()),
                    "steps": pa.array([_steps(all_levels, k) + steps for k in range(n)], pa.binary()),
                    "subroot": pa.array([subroot] * n, pa.binary()), "root": pa.array([root] * n, pa.binary())})
    return run


def extract(stored: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, tampered, steps, subroot, root) of every leaf; ``above`` (tree, steps, subroot, root) goes on from each tree's root."""
    proofs = above.select("tree", F.lit(0).cast("long").alias("block"), "steps", "subroot", "root")
    for level in reversed(stored[1:]):
        rows = level.select("tree", "block", "leaves").join(proofs, ["tree", "block"])
        proofs = rows.mapInArrow(_one_level_down(levels, 1 << levels), "tree string, block long, steps binary, subroot binary, root binary")
    kind = dict(stored[0].dtypes)["ids"].removeprefix("array<").removesuffix(">")
    rows = stored[0].select("tree", "block", "ids", "leaves", "tampered").join(proofs, ["tree", "block"])
    return rows.mapInArrow(_leaf_proofs(levels, pa.int64() if kind == "bigint" else pa.string()),
                           f"id {kind}, leaf binary, tampered binary, steps binary, subroot binary, root binary")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The proof of every row: (id, leaf, tampered, steps, subroot, root)."""
    trees = build(leaves_of(docs), levels)
    subroots = trees[-1].filter(F.col("block") == 0).select(
        F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("tampered"),
        F.lit(0).cast("long").alias("place"))
    whole = build(subroots, levels)
    root = whole[-1].select("tree", F.unhex(F.lit("")).alias("steps"), F.col("top").alias("subroot"), F.col("top").alias("root"))
    above = extract(whole, root, levels).select(F.col("id").alias("tree"), "steps", F.col("leaf").alias("subroot"), "root")
    return extract(trees, checkpointed(above), levels)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        proof, folded = [], []
        for leaf, tampered, steps in zip(*(b.column(c).to_pylist() for c in ("leaf", "tampered", "steps"))):
            steps = read_steps(steps)
            proof.append(H(*[other for _, other in steps]).decode())
            folded.append(fold((tampered or leaf).hex().encode(), steps).decode())
        root = [x.hex() for x in b.column("root").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "doc_id": b.column("id"), "leaf": pa.array([x.hex() for x in b.column("leaf").to_pylist()], pa.string()),
            "subroot": pa.array([x.hex() for x in b.column("subroot").to_pylist()], pa.string()), "root": pa.array(root, pa.string()),
            "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == r for f, r in zip(folded, root)], pa.bool_())})


def verify_documents(docs: DataFrame) -> DataFrame:
    """Every row's proof, and what folding it gives after the tampering of the contract."""
    return manifest(docs).mapInArrow(_verified, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                                "folded_root string, verified boolean")


#: The same rows in DuckDB's SQL, every level held; crc32 is spelled out bit by bit (3988292384 is its polynomial, a fixed value).
ORACLE_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, source, n_chars, text, xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda acc, b: xor(xor(acc, b) >> 1, 3988292384 * (xor(acc, b) & 1))), 4294967295) % 7 = 0 AS hit
  FROM documents),
fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS n,
    CASE WHEN n_chars IS NULL THEN '-' WHEN NOT coalesce(hit, false) THEN strlen(n_chars::VARCHAR) || ':' || n_chars
         ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS bad_n,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM rows),
hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || n || tail) AS leaf, sha256(head || bad_n || tail) AS given FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
lower_tree AS (
  SELECT tree, 0 AS lvl, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM lower_tree WHERE n > 1
  GROUP BY tree, lvl, i // 2, n),
subroots AS (
  SELECT tree, h AS subroot, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS lvl, i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM upper_tree WHERE n > 1 GROUP BY lvl, i // 2, n),
top AS (SELECT h AS root, lvl AS height FROM upper_tree WHERE n = 1),
marked AS (
  SELECT row_number() OVER () AS r, l.*, s.subroot, s.height, s.i AS tree_i, top.root, top.height AS top_height
  FROM leaves l JOIN subroots s USING (tree), top),
folded AS (
  SELECT r, 0 AS lvl, given AS h, '' AS proof, tree, i, height, tree_i, top_height FROM marked
  UNION ALL
  SELECT f.r, f.lvl + 1,
         sha256(CASE WHEN s.h IS NULL THEN f.h
                     WHEN (CASE WHEN f.lvl < f.height THEN f.i >> f.lvl ELSE f.tree_i >> (f.lvl - f.height) END) % 2 = 1 THEN s.h || f.h
                     ELSE f.h || s.h END),
         f.proof || coalesce(s.h, ''), f.tree, f.i, f.height, f.tree_i, f.top_height
  FROM folded f LEFT JOIN (
      SELECT tree, lvl, i, h, 0 AS above FROM lower_tree UNION ALL SELECT '', lvl, i, h, 1 FROM upper_tree) s
    ON s.above = (CASE WHEN f.lvl < f.height THEN 0 ELSE 1 END)
   AND s.tree = (CASE WHEN f.lvl < f.height THEN f.tree ELSE '' END)
   AND s.lvl = (CASE WHEN f.lvl < f.height THEN f.lvl ELSE f.lvl - f.height END)
   AND s.i = xor(CASE WHEN f.lvl < f.height THEN f.i >> f.lvl ELSE f.tree_i >> (f.lvl - f.height) END, 1)
  WHERE f.lvl < f.height + f.top_height)
SELECT m.doc_id, m.leaf, m.subroot, m.root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = m.root AS verified
FROM marked m JOIN folded f ON f.r = m.r AND f.lvl = m.height + m.top_height
"""
