"""Each operator on null, empty, long, repeated and clashing input; and on empty tables."""

import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from panelcast.llm import (chunk_dedup, langid, lookup_sharding, mixing_lm, order_minhash, pu_quality, spaced_seed,  # noqa: E402
                           stable_ann, suffix_dedup, swap_packing)

PER_ROW = {
    "langid": lambda s, d: langid.identify_documents(d),
    "lm": lambda s, d: mixing_lm.score_documents(d),
    "quality": lambda s, d: pu_quality.score_documents(d, fx.labels(s)),
    "sharding": lambda s, d: lookup_sharding.place_documents(d, 7),
    "classes": lambda s, d: order_minhash.near_duplicate_classes(d),
    "chunks": lambda s, d: chunk_dedup.dedup_digests(d),
    "suffixes": lambda s, d: suffix_dedup.dedup_digests(d),
}
FILTERS = {
    "keep_good": lambda s, d: pu_quality.keep_good(d, fx.labels(s)),
    "keep_one_each": lambda s, d: order_minhash.keep_one_each(d),
    "dedup_texts": lambda s, d: chunk_dedup.dedup_texts(d),
    "drop_contaminated": lambda s, d: spaced_seed.drop_contaminated(d, fx.benchmark(s)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_per_row_whatever_the_row(spark, name):
    docs = fx.awkward(spark)
    plain = sorted(map(str, PER_ROW[name](spark, docs).collect()))
    assert len(plain) == docs.count()
    again = sorted(map(str, PER_ROW[name](spark, fx.clashing(docs)).collect()))
    assert [x.split("score")[0] for x in plain] == [x.split("score")[0] for x in again]
    none = PER_ROW[name](spark, fx.none_of(spark))
    assert none.count() == 0 and none.columns


@pytest.mark.parametrize("name", FILTERS)
def test_filters_return_the_columns_they_got(spark, name):
    docs = fx.awkward(spark)
    for frame in (docs, fx.clashing(docs), fx.none_of(spark)):
        out = FILTERS[name](spark, frame)
        assert out.columns == frame.columns and [t for _, t in out.dtypes] == [t for _, t in frame.dtypes]
        assert out.count() <= frame.count()


def test_language_of_texts_without_letters(spark):
    got = {r.doc_id: r for r in langid.identify_documents(fx.awkward(spark)).collect()}
    for i in (4, 5, 6, 8):
        assert got[i].lang_pred == "und" and got[i].score == 0
    assert got[9].lang_pred in ("en", "fr", "de") and 0 <= got[9].score <= 1
    untaught = fx.awkward(spark).withColumn("lang", fx_null())
    assert {r.lang_pred for r in langid.identify_documents(untaught).collect()} == {"und"}


def fx_null():
    from pyspark.sql import functions as F
    return F.lit(None).cast("string")


def test_quality_without_labels_scores_the_prior(spark):
    none = fx.labels(spark).limit(0)
    assert {(r.score, r.predicted) for r in pu_quality.score_documents(fx.awkward(spark), none).collect()} == {(0.5, 1)}


def test_classes_of_copies_nulls_and_empties(spark):
    got = {}
    for r in order_minhash.near_duplicate_classes(fx.awkward(spark)).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert got[1] == got[2] == got[3] == {1}          # a copy and a near copy
    assert got[4] == {4} and got[5] == {5} and got[7] == {7} and got[None] == {None}
    kept = [r.doc_id for r in order_minhash.keep_one_each(fx.awkward(spark)).collect()]
    assert kept.count(7) == 1 and 1 in kept and 2 not in kept and 3 not in kept and 4 in kept


def test_contamination_of_short_null_and_equal_items(spark):
    docs = spark.createDataFrame([(1, "so " + fx.prose(77, 40) + " end"), (2, "too short"), (3, None), (4, ""), (1, "so " + fx.prose(77, 40) + " end")],
                                 "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in spaced_seed.contaminated_pairs(docs, fx.benchmark(spark)).collect()}
    assert got == {(1, 4), (1, 5)}
    assert spaced_seed.contaminated_pairs(docs, fx.benchmark(spark).limit(0)).count() == 0
    assert spaced_seed.contaminated_pairs(docs.limit(0), fx.benchmark(spark)).count() == 0


def test_packing_of_awkward_rows(spark):
    got = swap_packing.pack_documents(fx.clashing(fx.awkward(spark))).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in fx.awkward(spark).collect()}
    assert [r.length for r in got if r.doc_id == 4] == [1]
    assert sum(r.doc_id == 7 for r in got) == 2
    assert swap_packing.pack_documents(fx.none_of(spark)).count() == 0


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]),
            (6, [2.0, 0.0]), (7, [3.0, 0.0]), (8, [0.0, 1.0]), (9, [1.0, 0.0, 0.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (50, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in stable_ann.nearest_fiftieths(df.withColumn("dim", F.lit(1)).withColumn("score", F.lit(0))).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 8, 0.0)]
    assert stable_ann.nearest_fiftieths(df.limit(0)).count() == 0
