"""Cutting byte spans out of documents: shared by the substring operators.

A document is known by ``(__doc, __row)``: its id (null ids count as the
largest) and a 64-bit hash of id and text, so that repeated rows share their
spans and rows that share an id but not a text do not, however many they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import binary_views, bounded_batches

LAST = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__doc`` and ``__row``."""
    return docs.withColumns({
        "__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)),
        "__row": F.xxhash64("doc_id", "text")})


def merged(starts: np.ndarray, ends: np.ndarray, least: int = 1) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or adjacent spans, at least ``least`` long."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    lo = starts[new]
    hi = reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    return [(int(a), int(b)) for a, b in zip(lo, hi) if b - a >= least]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` keyed, with ``__at``: the array of (start, end) of its spans, or null.

    ``spans`` has __doc, __row, start, end; a document's spans are as many as
    its text allows, so the array is bounded by the text beside it.
    """
    gathered = spans.groupBy("__doc", "__row").agg(
        F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("__at"))
    return keyed(bounded_batches(docs)).join(gathered, ["__doc", "__row"], "left")


def _spans_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    none = np.zeros(0, np.int64)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for v in column:
        if not v.is_valid:
            yield none, none
        else:
            flat = v.values
            yield np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("end")).astype(np.int64)


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def digests(docs: DataFrame, spans: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, _ = binary_views(batch.column("text"))
            size, removed, count, sha = [], [], [], []
            for i, (starts, ends) in enumerate(_spans_of(batch.column("__at"))):
                text = data[offs[i]:offs[i + 1]].tobytes()
                runs = merged(starts, ends, least)
                size.append(len(text))
                removed.append(sum(b - a for a, b in runs))
                count.append(len(runs))
                sha.append(hashlib.sha256(_kept(text, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(count, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs.select("doc_id", "text"), spans).select(
        "doc_id", F.col("text").cast("binary").alias("text"), "__at").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(docs: DataFrame, spans: DataFrame, least: int = 1) -> DataFrame:
    """``docs``, all rows and columns, with the spans cut out of ``text`` and ``n_chars`` (if there) counted anew."""
    others = [c for c in docs.columns if c != "text"]
    place = {c: f"c{i}" for i, c in enumerate(others)}  # names that can't clash with those used here
    plain = docs.select(*[F.col(f"`{c}`").alias(place[c]) for c in others], "doc_id", "text")
    inner = [*place.values(), "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, null = binary_views(batch.column("text"))
            out: list[str | None] = []
            for i, (starts, ends) in enumerate(_spans_of(batch.column("__at"))):
                text = data[offs[i]:offs[i + 1]].tobytes()
                out.append(None if null[i] else _kept(text, merged(starts, ends, least)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in inner], inner)

    cut = with_spans(plain, spans).select(*inner, "__at")
    cut = cut.mapInArrow(run, cut.drop("__at").schema)
    if "n_chars" in place:
        cut = cut.withColumn(place["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(place.get(c, c)).alias(c) for c in docs.columns])
