"""Delimited files that each bring their own header and dialect (SRC1, SRC3, PRJ1).

One job takes the first line of every file, works out its separator and where
each canonical column stands, and gives one row per file.  Lines are joined to
that table by path and cut by the map of their own file, so files of any mix
of layouts can lie in one folder and no layout has to be declared.  The table
has a row per file; whether it is broadcast is left to the planner, which
knows its size when the join runs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import BOM

SEPARATORS = (",", ";", "\t", "|")


def split_fields(line: Column, sep: Column, separators: Sequence[str] = SEPARATORS) -> Column:
    """The fields of a line; quoted ones may hold the separator and doubled quotes."""
    out = None
    for s in separators:
        cls = "\\" + s if s == "|" else s
        # the separator put in front makes every field, empty ones too, a match of at least one character
        fields = F.regexp_extract_all(F.concat(F.lit(s), line), F.lit(f'{cls}[ ]*("[^"]*(?:""[^"]*)*"|[^{cls}]*)'), F.lit(1))
        out = F.when(sep == s, fields) if out is None else out.when(sep == s, fields)
    bare = lambda f: F.when(
        f.rlike(r'(?s)^".*"$'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    return F.transform(out, bare)


def separator_of(line: Column, separators: Sequence[str] = SEPARATORS) -> Column:
    """The separator that occurs most often outside quotes; the first of them on a tie."""
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    counts = [F.struct(F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))), F.lit(-i).alias("r"), F.lit(s).alias("s"))
              for i, s in enumerate(separators)]
    return F.greatest(*counts)["s"]


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(path if isinstance(path, str) else list(path))
    return text.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))


def file_headers(lines: DataFrame, columns: Sequence[str], aliases: Mapping[str, str],
                 separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """(file_path, header, sep, places): one row per file; ``places`` holds the position of each canonical column, 0 if absent.

    Header names are trimmed, lower-cased and looked up in ``aliases``; of
    several columns with one canonical name the first counts.
    """
    first = (lines.where(F.col("block") == 0).withColumn("n", F.monotonically_increasing_id())
             .groupBy("file_path").agg(F.min_by("value", "n").alias("header")))
    clean = F.regexp_replace("header", BOM, "")
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    names = F.transform(split_fields(clean, F.col("sep"), separators), lambda f: F.lower(F.trim(f)))
    named = F.transform(names, lambda f: F.coalesce(F.try_element_at(known, f), f))
    places = F.array(*[F.coalesce(F.array_position("named", F.lit(c)), F.lit(0)).cast("int") for c in columns])
    return (first.withColumn("sep", separator_of(clean, separators)).withColumn("named", named)
            .select("file_path", "header", "sep", places.alias("places")))


def read_headed(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], aliases: Mapping[str, str],
                year_regex: str = r"(\d{4})[^/]*/[^/]+$", separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """(file_path, file_year, every canonical column as STRING) of all files below ``path``.

    A column that a file lacks, an empty field, or a line too short gives NULL.  Blank
    lines and repeats of the file's header are left out.  Quoted fields may not
    hold line breaks.
    """
    lines = _lines(spark, path)
    heads = file_headers(lines, columns, aliases, separators)
    rows = lines.select("file_path", "value").where(F.trim("value") != "").join(heads, "file_path")
    rows = rows.where(F.col("value") != F.col("header")).select(
        "file_path", "places", split_fields(F.col("value"), F.col("sep"), separators).alias("f"))
    year = F.regexp_extract("file_path", year_regex, 1)
    cells = [F.when(F.col("places")[i] > 0, F.nullif(F.get("f", F.col("places")[i] - 1), F.lit(""))).alias(c) for i, c in enumerate(columns)]
    return rows.select("file_path", F.when(year != "", year.cast("int")).alias("file_year"), *cells)
