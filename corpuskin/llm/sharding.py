"""Sharding by weighted rendezvous hashing of stable record keys. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskin.plans.shared import ranked

#: 13 hexadecimal digits: 52 bits, exact in a double.
_DIGITS = 13


def _draw(key: Column, shard: int) -> Column:
    """A key's draw for a shard, in (0, 1): the same on every engine and at every time."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}"))
    bits = F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score ``-weight / ln(draw)`` is highest. A shard's share of the keys is its share of the weights.

    Adding shards at the end leaves the old ones' scores as they are, so that a key moves only if a new shard wins it.
    A null key is a key like any other (the empty string's).
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("each shard needs a weight over 0")
    scores = [F.struct((F.lit(-float(w)) / F.log(_draw(key, i))).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["i"]).cast("int")


def shard_records(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    key: str = "doc_id",
    text: str = "text",
    grown_weight: float = 1.0,
) -> DataFrame:
    """One row per input row: ``key``, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has none and the checksum 0. ``slot`` numbers each shard's
    rows from 0 without gaps, by key (nulls first), then checksum, then arbitrarily; repeated rows get a slot each.
    ``grown_shard`` is the shard with one more shard of ``grown_weight``. Input columns of other names are left out, so
    they can't clash. An empty table gives an empty result.
    """
    words = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(words).cast("long") + 1).alias("size"),
        F.crc32(words.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col(key), weights).alias("shard"),
        rendezvous_shard(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
    )
    placed = ranked(rows, "shard", [key, "text_crc32"], "slot", "shards")
    return placed.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB, for all columns. The checksum is the bytewise CRC-32 over a table built by its polynomial.
ORACLE_OP10 = """
WITH RECURSIVE t(i, c, k) AS (
  SELECT r.range, r.range::UBIGINT, 0 FROM range(256) r
  UNION ALL SELECT i, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), e AS (
  SELECT doc_id, size,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(range(0, size - 1), lambda i: (strpos('0123456789ABCDEF', h[(2*i+1)::BIGINT]) - 1)::UBIGINT * 16 + (strpos('0123456789ABCDEF', h[(2*i+2)::BIGINT]) - 1)::UBIGINT),
      lambda s, x: xor(s >> 8, l[(xor(s, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM d, tab
), s AS (
  SELECT doc_id, size, text_crc32,
    list_transform(range(9), lambda i: ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || i::VARCHAR), 1, 13))::BIGINT) AS v FROM e
), p AS (
  SELECT *, (list_position(v[1:8], list_max(v[1:8])) - 1)::INT AS shard, (list_position(v, list_max(v)) - 1)::INT AS grown_shard FROM s
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard FROM p
"""
