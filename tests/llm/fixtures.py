"""Small hand-made tables with the awkward cases every operator has to take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with what operators use inside.
CLASHING = {"key": 1, "score": 2.5, "token": "t", "node": 7, "start": 3, "piece": 4, "label": "x", "words": 9, "shard": "s",
            "slot": 11, "tokens": "y", "row": 12, "a": 13, "b": 14, "same": "z", "__at": 1}


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tu", "me", "sa", "lo", "vi", "ne", "pa", "du", "fe"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(words))


def awkward(spark):
    """Null and empty texts, nulls in every column, ties, repeated rows, a long text, copies, a near copy, non-Latin text."""
    base = prose(1, 120)
    near = base.split()
    near[40], near[90] = "changed", "twice"
    rows = [(1, base, "en", "s", len(base)), (2, base, "en", "s", len(base)), (3, " ".join(near), "en", None, 0),
            (4, None, "en", "s", None), (5, "", None, "s", 0), (6, "   \n\t ", "fr", "s", 5), (None, prose(2, 60), "fr", "s", None),
            (7, prose(3, 80), None, None, 1), (7, prose(3, 80), None, None, 1), (8, "12 34 !!", "de", "s", 8),
            (9, prose(4, 6000), "de", "s", None), (10, "Größe été 漢字 ñandú <|endoftext|> 'tis İstanbul ﬁ é", "de", "s", 3),
            (11, "a", "en", "s", 1), (12, prose(5, 30) + " " + base[:400] + " " + prose(6, 30), "en", "s", 1),
            (13, "word " * 400, "en", "s", 1), (14, "x" * 30000, "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def none_of(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    from pyspark.sql import functions as F
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def benchmark(spark):
    return spark.createDataFrame([(0, prose(1, 120)[:180]), (1, None), (2, ""), (3, "too short"), (4, prose(77, 40)), (5, prose(77, 40))],
                                 "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 0, 0), (7, 1, 1), (7, 1, 1), (9, None, 0), (None, 1, 0), (13, 0, 0)],
                                 "doc_id long, quality int, toxic int")
