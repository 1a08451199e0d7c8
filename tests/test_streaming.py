"""The stateless classifier over a file stream gives the batch result."""

from pyspark.sql import functions as F

from panelcast.functions import rules
from panelcast.sources.files import staging_path
from panelcast.sources.tables import panel_air
from panelcast.streaming import classify, run_available

COLS = ["tanggal", "stasiun", *rules.POLLUTANTS]


def test_stream_equals_batch(spark):
    a = panel_air(spark, "/root/testdata/sf0.001")
    src = staging_path(spark, "stream-src")
    a.select(F.date_format("date", "yyyy-MM-dd").alias("tanggal"), F.col("station").alias("stasiun"),
             *[F.col(p).cast("string").alias(p) for p in rules.POLLUTANTS]).write.option("header", True).csv(src)
    sink = staging_path(spark, "stream-sink")
    run_available(spark, src, COLS, sink)
    got = spark.read.parquet(sink)
    batch = classify(spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in COLS)).csv(src))
    assert got.count() == batch.count() == a.count()
    assert got.exceptAll(batch).count() == 0
