"""Distributions over a corpus of profiles. Long form, (value, count) rows, since values can be null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def token_frequencies(profiles: DataFrame) -> DataFrame:
    """(token, n_files)."""
    return profiles.select(F.explode("description_tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n_files"))


def common_tokens(frequencies: DataFrame, least: int) -> DataFrame:
    """Tokens of at least ``least`` files: most frequent first, then by token."""
    return frequencies.where(F.col("n_files") >= least).orderBy(F.desc("n_files"), "token")


def unique_tokens(frequencies: DataFrame) -> DataFrame:
    """Tokens of one file only, in order."""
    return frequencies.where("n_files = 1").select("token").orderBy("token")


def preamble_frequencies(profiles: DataFrame) -> DataFrame:
    return profiles.where("description_preamble is not null").groupBy(F.col("description_preamble").alias("preamble")).agg(F.count("*").alias("n_files"))


def ifd_count_distribution(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("ifd_count").agg(F.count("*").alias("n_files"))


def mode_ifd_count(distribution: DataFrame) -> DataFrame:
    """(ifd_count, n_files): the most frequent section count; of equally frequent ones the largest. No row without files."""
    best = F.max(F.struct("n_files", "ifd_count")).alias("m")
    return distribution.agg(best).where("m is not null").select("m.ifd_count", "m.n_files")


def position_distributions(profiles: DataFrame) -> DataFrame:
    """(position, field, value, n_files): of width, height, compression and tile size at each section number; null values count."""
    at = profiles.select(F.explode("ifds").alias("x")).select(
        F.col("x.ifd_index").alias("position"),
        F.explode(
            F.array(
                F.struct(F.lit("width").alias("field"), F.col("x.width").cast("string").alias("value")),
                F.struct(F.lit("height").alias("field"), F.col("x.height").cast("string").alias("value")),
                F.struct(F.lit("compression").alias("field"), F.col("x.compression").cast("string").alias("value")),
                F.struct(F.lit("tile").alias("field"), F.concat_ws("x", "x.tile_width", "x.tile_height").alias("value")),
            )
        ).alias("f"),
    )
    value = F.when(F.col("f.value") != "", F.col("f.value"))
    return at.groupBy("position", F.col("f.field").alias("field"), value.alias("value")).agg(F.count("*").alias("n_files"))


def _order(field: str, value: str):
    """Numbers by size (null first), tile sizes by width, then height."""
    first = F.substring_index(value, "x", 1).cast("long")
    second = F.substring_index(value, "x", -1).cast("long")
    return F.struct(F.coalesce(first, F.lit(-1)).alias("a"), F.coalesce(second, F.lit(-1)).alias("b"))


def position_modes(distributions: DataFrame) -> DataFrame:
    """(position, field, value, n_files): the most frequent value; of equally frequent ones the largest, null least."""
    best = F.max_by(F.struct("value", "n_files"), F.struct("n_files", _order("field", "value")))
    return distributions.groupBy("position", "field").agg(best.alias("m")).select("position", "field", "m.value", "m.n_files")


def top_values(distributions: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` most frequent values of each position and field with their ranks from 1, ties by value, null first; ``more`` counts the rest."""
    w = Window.partitionBy("position", "field")
    ranked = distributions.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n_files"), _order("field", "value"))))
    ranked = ranked.withColumn("more", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return ranked.where(F.col("rank") <= n)


def size_range(files: DataFrame) -> DataFrame:
    """(min_size, max_size), 0 and 0 without files."""
    return files.agg(F.coalesce(F.min("file_size"), F.lit(0)).alias("min_size"), F.coalesce(F.max("file_size"), F.lit(0)).alias("max_size"))
