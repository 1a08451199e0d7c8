"""Stateless operators on ``readStream`` frames.

The reference has no streams (SURVEY section 2.12): every input is a file read
whole.  What carries over is that the row-local expressions (text cleaning,
date parsing, arithmetic, rule categories) are plain column expressions, so a
stream of raw measurement files can be cleaned and classified as it arrives.
Row-frame windows (lags, fills) stay batch-only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import dates, rules, text
from ..functions.encode import collapse_category
from ..session import ensure_checkpoint_dir


def classify(raw: DataFrame, pollutant_text: Mapping[str, str] | None = None,
             station_text: str = "stasiun", date_text: str = "tanggal") -> DataFrame:
    """Typed, classified rows from raw text rows: batch or streaming alike."""
    cols = pollutant_text or {p: p for p in rules.POLLUTANTS}
    typed = raw.select(text.station_code(station_text).alias("station"),
                       dates.parse_date(date_text).alias("date"),
                       *[text.to_number(c).alias(p) for p, c in cols.items()])
    kat = rules.rule_category({p: p for p in cols})
    return typed.withColumns({"kategori": kat, "category": collapse_category(kat),
                              "is_unhealthy": rules.any_unhealthy({p: p for p in cols})})


def run_available(spark: SparkSession, source: str, columns, sink: str, sep: str = ",") -> None:
    """Process every file currently in ``source`` (CSV, all STRING) once and append the
    classified rows to a Parquet ``sink``; progress lives under the shared
    checkpoint folder, so a restarted job resumes where it stopped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    stream = spark.readStream.schema(schema).option("header", True).option("sep", sep).csv(source)
    ckpt = ensure_checkpoint_dir(spark).rstrip("/") + "/panelcast-streams/" + hashlib.md5(sink.encode()).hexdigest()
    q = (classify(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
