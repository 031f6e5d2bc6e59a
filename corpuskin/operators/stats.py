"""Statistics of files and of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_stats(files: DataFrame, ifds: DataFrame, units: DataFrame) -> DataFrame:
    """One row per file: units by kind, payload bytes, pyramid levels (sections without a role), roles, tile sizes, compressions."""
    u = units.groupBy("file_id").agg(
        F.count_if(F.col("kind") == 0).alias("tile_count"),
        F.count_if(F.col("kind") == 1).alias("strip_count"),
        F.sum("length").alias("payload_bytes"),
    )
    both = F.col("tile_width").isNotNull() & F.col("tile_height").isNotNull()
    i = ifds.groupBy("file_id").agg(
        F.count_if(F.col("role").isNull()).alias("pyramid_levels"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("ifd_index", "role")))), lambda x: x["role"]).alias("roles"),
        F.sort_array(F.collect_set(F.when(both, F.concat_ws("x", "tile_width", "tile_height")))).alias("tile_sizes"),
        F.sort_array(F.collect_set("compression")).alias("compressions"),
    )
    out = files.select("file_id", "path", "file_size").join(u, "file_id", "left").join(i, "file_id", "left")
    return out.fillna(0, ["tile_count", "strip_count", "payload_bytes", "pyramid_levels"])


def corpus_totals(stats: DataFrame) -> DataFrame:
    """One row: files, bytes, units, payload, and what is no payload (0 at least)."""
    size, payload = F.coalesce(F.sum("file_size"), F.lit(0)), F.coalesce(F.sum("payload_bytes"), F.lit(0))
    return stats.agg(
        F.count("*").alias("files"),
        size.alias("total_bytes"),
        F.coalesce(F.sum("tile_count"), F.lit(0)).alias("tiles"),
        F.coalesce(F.sum("strip_count"), F.lit(0)).alias("strips"),
        payload.alias("payload_bytes"),
        F.greatest(size - payload, F.lit(0)).alias("overhead_bytes"),
    )


def compression_files(stats: DataFrame) -> DataFrame:
    """(compression, n_files): files that use it, not sections."""
    return stats.select(F.explode("compressions").alias("compression")).groupBy("compression").agg(F.count("*").alias("n_files"))


def geometry_files(stats: DataFrame) -> DataFrame:
    """(tile_size, n_files)."""
    return stats.select(F.explode("tile_sizes").alias("tile_size")).groupBy("tile_size").agg(F.count("*").alias("n_files"))


def ambiguous_strips(ifds: DataFrame) -> DataFrame:
    """Strips whose role stayed open in files of four sections or more: not the first, with units, and not named label or macro."""
    from pyspark.sql import Window

    text = F.coalesce(F.lower("description"), F.lit(""))
    n = F.count("*").over(Window.partitionBy("file_id"))
    open_ = F.col("role").isNull() & F.col("tile_width").isNull() & ~F.contains(text, F.lit("label")) & ~F.contains(text, F.lit("macro"))
    return ifds.withColumn("_n", n).where(open_ & (F.col("unit_count") > 0) & (F.col("_n") >= 4) & (F.col("ifd_index") > 0)).drop("_n")
