"""Adapters: parquet tables as files, sections and data units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskin.functions.fnv import coarse_fingerprint

#: Codes that stand for a compression scheme where the tables have none: of languages and of roles.
LANG_CODES = {"en": 1, "de": 5, "fr": 7, "es": 8}
ROLE_CODES = {"user": 7, "assistant": 33003}


def _code(column: str, codes: dict[str, int]):
    out = None
    for name, code in codes.items():
        out = F.when(F.col(column) == name, code) if out is None else out.when(F.col(column) == name, code)
    return out.cast("int")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, file_size): a file per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("file_size"))


def document_lines(spark: SparkSession, sf_dir: str, fingerprints: bool = True) -> DataFrame:
    """A unit per line of each document, with its payload; the language stands for the compression."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("file_id"), _code("lang", LANG_CODES).alias("compression"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("unit_index", "line"))
    units = rows.select("file_id", F.lit(0).alias("ifd_index"), "unit_index", F.lit(0).alias("kind"), "compression", F.octet_length("line").cast("long").alias("length"), F.col("line").cast("binary").alias("payload"))
    if fingerprints:
        units = units.withColumn("coarse_fp", coarse_fingerprint(F.col("kind"), F.col("length"), F.col("compression"), F.col("payload")))
    return units


def with_offsets(units: DataFrame) -> DataFrame:
    """Adds each unit's offset in its file, where units stand one after another with a byte between them."""
    before = Window.partitionBy("file_id").orderBy("ifd_index", "unit_index").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("offset", F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0)))


def source_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, units): a file per source of documents (-1 for none), a unit per document with its text's SHA-256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.coalesce(F.regexp_replace("source", "[^0-9]", "").cast("long"), F.lit(-1))
    rows = docs.select(number.alias("file_id"), F.coalesce("source", F.lit("-")).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("length"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("strong_hash"))
    return rows.groupBy("file_id", "path").agg(F.sum("length").alias("file_size")), rows


def conversation_ifds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section per turn of each conversation: its text is the description, characters and blank-separated pieces its dimensions."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tile = F.when(F.col("role") == "assistant", 256).cast("int")
    return turns.select(
        F.col("conv_id").alias("file_id"),
        F.col("turn").cast("int").alias("ifd_index"),
        F.length("text").alias("width"),
        F.size(F.split("text", " ", -1)).alias("height"),
        _code("role", ROLE_CODES).alias("compression"),
        tile.alias("tile_width"),
        (tile / 2 + 64 * (F.col("conv_id") % 2)).cast("int").alias("tile_height"),
        F.size(F.split("text", "\n", -1)).alias("unit_count"),
        F.when(F.col("role") == "system", "macro").alias("role"),
        F.col("text").alias("description"),
    )


def document_ifds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section per document: its whole text is the description, its language the compression; characters and lines its dimensions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None)
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.lit(0).alias("ifd_index"),
        F.length("text").alias("width"),
        F.size(F.split("text", "\n", -1)).alias("height"),
        _code("lang", LANG_CODES).alias("compression"),
        none.cast("int").alias("tile_width"),
        none.cast("int").alias("tile_height"),
        F.lit(1).alias("unit_count"),
        none.cast("string").alias("role"),
        F.col("text").alias("description"),
    )


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long")
    return turns.groupBy(F.col("conv_id").alias("file_id")).agg(F.concat(F.lit("conv-"), F.first("conv_id").cast("string")).alias("path"), size.alias("file_size"))


def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit per line of each turn: tiles where the turn is tiled, else strips."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = turns.select(F.col("conv_id").alias("file_id"), F.col("turn").cast("int").alias("ifd_index"), "role", F.posexplode(F.split("text", "\n", -1)).alias("unit_index", "line"))
    return rows.select("file_id", "ifd_index", "unit_index", F.when(F.col("role") == "assistant", 0).otherwise(1).alias("kind"), F.octet_length("line").cast("long").alias("length"))


def conversation_descriptions(spark: SparkSession, sf_dir: str, groups: DataFrame) -> DataFrame:
    """(group_id, path, ifd_index, bytes) of the files in ``groups`` (file_id, group_id)."""
    ifds = conversation_ifds(spark, sf_dir).select("file_id", "ifd_index", F.col("description").cast("binary").alias("bytes"))
    path = F.concat(F.lit("conv-"), F.lpad(F.col("file_id").cast("string"), 10, "0"))
    return ifds.join(groups.select("file_id", "group_id"), "file_id").select("group_id", path.alias("path"), "ifd_index", "bytes")
