"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become arrays of token hashes (lower-cased runs of letters and digits).
A fixed mask looks at five of nine consecutive tokens and ignores the rest, so
a substituted word spoils only the windows that look at it; the three masks
together find every alignment of 15 tokens with up to three substitutions.
Benchmark windows and document windows with equal masked hashes are joined,
and around each hit the ``FLANK`` tokens on both sides (as far as the
benchmark text goes) are compared in place: the hit is a verified overlap if
at least ``share`` of these tokens agree.

Scale: documents are never shuffled.  The benchmark's masked hashes set bits
of a fixed-size filter (``FILTER_BITS``, two bits a hash, 512 KB whatever the
size of the benchmark), which reaches tasks as a scalar subquery; only windows
that pass it leave the scan, with the tokens around them.  They are dealt by
hash and a salt, the benchmark windows (distinct contents only) carrying one
copy per salt, so a passage that a third of all documents share is spread out.

Defined results: null texts, empty texts and texts under nine tokens overlap
with nothing; equal benchmark texts each count as an item; repeated rows of a
document count once; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import boxed, row_key

SPAN = 9
MASKS = ((0, 1, 3, 7, 8), (0, 1, 2, 7, 8), (0, 2, 3, 5, 8))
FLANK = 6
SHARE = 0.8
FILTER_BITS = 1 << 22
SALTS = 16
SEPARATOR = r"[^\p{L}\p{N}]+"


def token_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), SEPARATOR), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def masked_hash(mask: int, tokens: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(tokens, at + F.lit(o)) for o in MASKS[mask]])


def _bits(key: Column) -> tuple[Column, Column]:
    top = F.lit(FILTER_BITS - 1)
    return key.bitwiseAND(top), F.shiftrightunsigned(key, 32).bitwiseAND(top)


def _word(bit: Column) -> Column:
    return F.shiftright(bit, 6).cast("int")


def _flag(bit: Column) -> Column:
    """1 << (bit mod 64) as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


def filter_words(seeds: DataFrame) -> DataFrame:
    """One row: the filter's FILTER_BITS / 64 words in order."""
    one, two = _bits(F.col("key"))
    bits = seeds.select(F.explode(F.array(one, two)).alias("bit"))
    words = bits.select(_word(F.col("bit")).alias("word"), _flag(F.col("bit")).alias("flag"))
    zero = seeds.sparkSession.range(0, FILTER_BITS // 64, 1, 4).select(
        F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("flag"))
    whole = words.unionByName(zero).groupBy("word").agg(F.bit_or("flag").alias("flag"))
    return whole.agg(F.array_sort(F.collect_list(F.struct("word", "flag"))).alias("w")).select(F.col("w.flag").alias("words"))


def windows(tokens: DataFrame) -> DataFrame:
    """Every position at which a mask fits: tokens' columns and ``at``."""
    return tokens.filter(F.size("tokens") >= SPAN).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.lit(SPAN))).alias("at"))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, at, mask, key, around, lead): ``around`` has the tokens to compare, ``lead`` of them before the window."""
    items = benchmark.select(F.col(item).alias("item"), token_hashes(F.col("text")).alias("tokens"))
    lead = F.least(F.col("at"), F.lit(FLANK))
    return windows(items).select(
        "item", "at", lead.alias("lead"),
        F.slice("tokens", F.col("at") - lead + 1, lead + F.lit(SPAN + FLANK)).alias("around"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), masked_hash(m, F.col("tokens"), F.col("at")).alias("key"))
                            for m in range(len(MASKS))])).alias("seed"),
    ).select("item", "at", "lead", "around", F.col("seed.mask").alias("mask"), F.col("seed.key").alias("key"),
             F.xxhash64("around", "lead", "seed.mask").alias("content"))


def overlaps(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Verified overlaps: (row, doc_id, doc_at, item, item_at, agreeing, compared), distinct."""
    bench = benchmark_windows(benchmark)
    contents = bench.select("key", "mask", "lead", "around", "content").distinct()
    bits = filter_words(contents.select("key").distinct()).scalar()
    tokens = docs.select("doc_id", row_key("doc_id", "text").alias("row"), token_hashes(F.col("text")).alias("tokens"))

    def passes(key: Column) -> Column:
        one, two = _bits(key)
        have = lambda b: F.get(bits, _word(b)).bitwiseAND(_flag(b)) != F.lit(0)
        return have(one) & have(two)

    keys = [masked_hash(m, F.col("tokens"), F.col("at")) for m in range(len(MASKS))]
    hit = passes(keys[0])
    for k in keys[1:]:
        hit = hit | passes(k)
    # `before` may run over the start of the text: the part there is, and how long it is
    before = F.least(F.col("at"), F.lit(FLANK))
    found = windows(tokens).filter(hit).select(
        "doc_id", "row", "at", before.alias("before"),
        F.slice("tokens", F.col("at") - before + 1, before + F.lit(SPAN + FLANK)).alias("near"),
        F.explode(F.array(*keys)).alias("key")).withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)))
    salted = contents.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = found.join(salted, ["key", "salt"])
    # position i of `around` stands at i - lead + before of `near`
    agreeing = F.aggregate(
        F.sequence(F.lit(0), F.size("around") - 1), F.lit(0),
        lambda n, i: n + F.when(F.get("around", i) == F.get("near", i - F.col("lead") + F.col("before")), 1).otherwise(0))
    verified = joined.select("row", "doc_id", "at", "content", F.size("around").alias("compared"), agreeing.alias("agreeing")) \
        .filter(F.col("agreeing") >= F.ceil(F.col("compared") * F.lit(share)))
    members = bench.select("content", "item", F.col("at").alias("item_at")).distinct()
    salted_members = members.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return verified.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS))).join(
        salted_members, ["content", "salt"]).select(
        "row", "doc_id", F.col("at").alias("doc_at"), "item", "item_at", "agreeing", "compared").distinct()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, n_overlaps, first_at, most_agreeing) of every document and item with a verified overlap."""
    return overlaps(docs, benchmark, share).groupBy("doc_id", F.col("item").alias("item_id")).agg(
        F.countDistinct("doc_at", "item_at").alias("n_overlaps"),
        F.min("doc_at").cast("long").alias("first_at"),
        F.max("agreeing").cast("long").alias("most_agreeing"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Filtering form: the rows of ``docs``, all columns, without a verified overlap with any benchmark item."""
    bad = overlaps(docs, benchmark, share).select("row").distinct()
    return docs.select(boxed(docs).alias("all"), row_key("doc_id", "text").alias("row")).join(bad, "row", "left_anti").select("all.*")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATOR}'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '{SEPARATOR}'), lambda x: x <> '') AS t FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT doc_id, t, unnest(range(0, len(t) - {SPAN - 1})) AS p FROM d WHERE len(t) >= {SPAN}),
bw AS (SELECT item_id, t, unnest(range(0, len(t) - {SPAN - 1})) AS q FROM b WHERE len(t) >= {SPAN}),
ds AS ({" UNION ALL ".join(f"SELECT doc_id, t, p, {m} AS mask, concat_ws(' ', {', '.join(f't[p + {o + 1}]' for o in MASKS[m])}) AS k FROM dw" for m in range(len(MASKS)))}),
bs AS ({" UNION ALL ".join(f"SELECT item_id, t, q, {m} AS mask, concat_ws(' ', {', '.join(f't[q + {o + 1}]' for o in MASKS[m])}) AS k FROM bw" for m in range(len(MASKS)))}),
hits AS (SELECT doc_id, item_id, p, q, ds.t AS dt, bs.t AS bt FROM ds JOIN bs USING (mask, k)),
cmp AS (SELECT doc_id, item_id, p, q, greatest(q - {FLANK}, 0) AS lo, least(q + {SPAN + FLANK}, len(bt)) AS hi,
  len(list_filter(range(greatest(q - {FLANK}, 0), least(q + {SPAN + FLANK}, len(bt))),
    lambda i: p + i - q >= 0 AND bt[i + 1] IS NOT DISTINCT FROM dt[p + i - q + 1])) AS agreeing FROM hits)
SELECT doc_id, item_id, count(DISTINCT (p, q)) AS n_overlaps, min(p)::BIGINT AS first_at, max(agreeing)::BIGINT AS most_agreeing
FROM cmp WHERE agreeing >= ceil((hi - lo) * {SHARE}) GROUP BY doc_id, item_id
"""
