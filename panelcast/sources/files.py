"""File readers for raw yearly / per-station files (SRC1-SRC6, SRC10).

Every column is read as STRING (explicit schema, no inference) and typed
later by the cleaning expressions, as the raw files mix layouts.  File-level
facts (year, station) come from ``_metadata.file_path``, so they are known
per row without listing files on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

BOM = "﻿"


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/panelcast-staging/{name}-{uuid.uuid4().hex}"


def read_delimited(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = ",",
                   header: bool = True) -> DataFrame:
    """Delimited text with a positional column list, all STRING (SRC1, SRC3).

    The header line (if any) is skipped and names come from ``columns`` by
    position, so files of one layout family can differ in header spelling.
    """
    return (spark.read.option("header", header).option("sep", sep).option("quote", '"')
            .option("recursiveFileLookup", "true").option("mode", "PERMISSIVE")
            .schema(string_schema(columns)).csv(path if isinstance(path, str) else list(path)))


def with_file_facts(df: DataFrame, year_regex: str | None = r"(\d{4})",
                    station_regex: str | None = None, keep_path: bool = False) -> DataFrame:
    """Add ``file_year`` / ``file_station`` parsed from the file path (SRC1, SRC5)."""
    path = F.col("_metadata.file_path")
    out = df
    if year_regex:
        y = F.regexp_extract(path, year_regex, 1)
        out = out.withColumn("file_year", F.when(y != "", y.cast("int")))
    if station_regex:
        out = out.withColumn("file_station", F.upper(F.regexp_extract(path, station_regex, 1)))
        out = out.withColumn("file_station", F.when(F.col("file_station") != "", F.col("file_station")))
    if keep_path:
        out = out.withColumn("file_path", path)
    return out


def scan_yearly(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",",
                year_regex: str = r"(\d{4})[^/]*/[^/]+$", years: Sequence[int] | None = None) -> DataFrame:
    """One layout family of yearly files; ``file_year`` from the path; optional year
    filter (SRC1, SRC2).  An ingest ordinal (file, position) is added for
    first-value semantics later."""
    df = with_file_facts(read_delimited(spark, path, columns, sep), year_regex, keep_path=True)
    if years is not None:  # before the numbering: the filter on the path then prunes files
        df = df.where(F.col("file_year").isin(*years))
    return df.withColumn("_ingest", F.struct(F.col("file_path").alias("f"), F.monotonically_increasing_id().alias("i"))) \
        .drop("file_path")


def scan_per_station(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",",
                     station_regex: str = r"(dki\d)") -> DataFrame:
    """One file per station, station code from the file name (SRC5)."""
    return with_file_facts(read_delimited(spark, path, columns, sep), None, station_regex)


def read_preamble_table(spark: SparkSession, path: str, year_regex: str = r"(\d{4})[^/]*/[^/]+$") -> DataFrame:
    """Two-column text tables with a BOM, preamble lines and a trailing total (SRC4).

    Lines are read as text; the BOM is stripped, the name / number split on the
    first comma, and only lines whose second field is all digits and whose
    first field is non-empty are kept.  Totals are removed later by the name
    lookup (unmapped names drop out).
    """
    t = spark.read.option("recursiveFileLookup", "true").text(path)
    t = with_file_facts(t, year_regex)
    line = F.regexp_replace(F.col("value"), BOM, "")
    name = F.trim(F.regexp_extract(line, r"^([^,]*),", 1))
    num = F.trim(F.regexp_extract(line, r"^[^,]*,(.*)$", 1))
    return (t.select("file_year", name.alias("name"), num.alias("count_txt"))
             .where((F.col("name") != "") & F.col("count_txt").rlike(r"^\d+$"))
             .select("file_year", "name", F.col("count_txt").cast("long").alias("count")))


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Re-read an intermediate panel with its declared schema (SRC6)."""
    return spark.read.schema(schema).parquet(path)


def report_cells(cells: DataFrame, columns: Sequence[str], skip_rows: int = 5,
                 pages_per_period: int = 3) -> DataFrame:
    """Cell tables extracted from reports (SRC10): ``(table_no, row_no, c0..cN)``.

    Header rows (``row_no < skip_rows``) are dropped, cells get positional
    names, and the report period is ``table_no div pages_per_period``.
    """
    cs = [c for c in cells.columns if c.startswith("c") and c[1:].isdigit()]
    cs = sorted(cs, key=lambda c: int(c[1:]))[:len(columns)]
    return (cells.where(F.col("row_no") >= skip_rows)
                 .select(F.floor(F.col("table_no") / pages_per_period).cast("int").alias("period"),
                         "table_no", "row_no", *[F.col(c).alias(n) for c, n in zip(cs, columns)]))
