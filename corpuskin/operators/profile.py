"""Profiles of files: their sections in order, the tokens of their descriptions, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskin.functions.labels import description_tokens, preamble

SECTION = ["ifd_index", "width", "height", "compression", "tile_width", "tile_height", "unit_count", "role"]


def build_profiles(ifds: DataFrame) -> DataFrame:
    """One row per file: file_id, ifd_count, ifds, description_tokens, description_preamble.

    ``ifds`` is the array of sections by index; a section is tiled if it has a tile width. Tokens are those of any
    section, sorted. The preamble is the first non-empty one. A file's sections are gathered: containers hold at most a
    thousand or so.
    """
    rows = ifds.select(
        "file_id",
        F.struct(*SECTION[:4], F.col("tile_width").isNotNull().alias("is_tiled"), *SECTION[4:]).alias("ifd"),
        F.coalesce(description_tokens(F.col("description")), F.array().cast("array<string>")).alias("tokens"),
        preamble(F.col("description")).alias("pre"),
    )
    return rows.groupBy("file_id").agg(
        F.count("*").alias("ifd_count"),
        F.sort_array(F.collect_list("ifd")).alias("ifds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("description_tokens"),
        F.min_by(F.col("pre"), F.when(F.col("pre").isNotNull(), F.col("ifd.ifd_index"))).alias("description_preamble"),
    )


def structural_signature(profiles: DataFrame) -> DataFrame:
    """(file_id, signature): ``n=3 [0:100x80/c=7/tiled=64x64] [1:50x40/c=?/strip] ...``."""

    def part(x: Column) -> Column:
        tiled = x["tile_width"].isNotNull() & x["tile_height"].isNotNull()
        layout = F.when(tiled, F.concat(F.lit("tiled="), x["tile_width"], F.lit("x"), x["tile_height"])).otherwise("strip")
        code = F.coalesce(x["compression"].cast("string"), F.lit("?"))
        return F.concat(F.lit("["), x["ifd_index"], F.lit(":"), x["width"], F.lit("x"), x["height"], F.lit("/c="), code, F.lit("/"), layout, F.lit("]"))

    head = F.concat(F.lit("n="), F.col("ifd_count").cast("string"))
    return profiles.select("file_id", F.concat_ws(" ", head, F.transform("ifds", part)).alias("signature"))


def detect_role(is_strip: Column, subfile_type: Column, description: Column) -> Column:
    """The role of a section by itself: strips named label or macro, else thumbnails, whose subfile type is 0; null for tiled ones."""
    text = F.coalesce(F.lower(description), F.lit(""))
    named = F.when(F.contains(text, F.lit("label")), "label").when(F.contains(text, F.lit("macro")), "macro").when(subfile_type == 0, "thumbnail")
    return F.when(is_strip, named)


def resolve_label_macro(ifds: DataFrame) -> DataFrame:
    """``ifds`` with roles settled by the file: of exactly two strips without one, the smaller is the label and the other the macro.

    A single one takes what the file's only label or macro strip leaves. Equal areas: the earlier one is the label.
    """
    open_ = F.col("tile_width").isNull() & F.col("role").isNull()
    file = Window.partitionBy("file_id")
    counted = ifds.withColumn("_open", open_).withColumn("_n", F.sum(open_.cast("int")).over(file))
    known = F.col("tile_width").isNull() & F.col("role").isin("label", "macro")
    counted = counted.withColumn("_known", F.sum(known.cast("int")).over(file)).withColumn("_which", F.max(F.when(known, F.col("role"))).over(file))
    by_area = Window.partitionBy("file_id", "_open").orderBy(F.col("width") * F.col("height"), "ifd_index")
    ranked = counted.withColumn("_rank", F.row_number().over(by_area))
    two = F.when(F.col("_rank") == 1, "label").otherwise("macro")
    one = F.when(F.col("_known") == 1, F.when(F.col("_which") == "label", "macro").otherwise("label"))
    role = F.when(F.col("_open") & (F.col("_n") == 2), two).when(F.col("_open") & (F.col("_n") == 1), one).otherwise(F.col("role"))
    return ranked.withColumn("role", role).drop("_open", "_n", "_known", "_which", "_rank")
