"""Incremental manifests: each new batch of units is matched with all units seen so far.

An extension for corpora that grow: batches come from a stream of unit rows (for instance, of manifests that jobs write
as Parquet). Each batch is appended to the store once, under its batch number, so that a batch that is run again after a
failure replaces itself; the matches are those of its units with the store and with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskin.operators.dedup import KEY


def match_batch(batch: DataFrame, batch_id: int, store: str, matches: str) -> None:
    """Writes ``store``/batch=N (the units) and ``matches``/batch=N (new unit, seen unit: equal in kind, compression, length, fingerprint)."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
    every = spark.read.option("basePath", store).parquet(store).where(F.col("batch") <= batch_id)
    new = every.where(F.col("batch") == batch_id)
    old = every.select(*[F.col(k).alias(f"seen_{k}") for k in ["file_id", "ifd_index", "unit_index", *KEY]], F.col("batch").alias("seen_batch"))
    on = None
    for k in KEY:
        one = new[k].eqNullSafe(old[f"seen_{k}"])
        on = one if on is None else on & one
    unit = F.struct("file_id", "ifd_index", "unit_index")
    seen = F.struct("seen_file_id", "seen_ifd_index", "seen_unit_index")
    pairs = new.join(old, on).where((F.col("seen_batch") < batch_id) | (seen < unit))
    pairs.select("file_id", "ifd_index", "unit_index", "seen_file_id", "seen_ifd_index", "seen_unit_index", "length").write.mode("overwrite").parquet(f"{matches}/batch={batch_id}")


def follow(spark: SparkSession, units: DataFrame, store: str, matches: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream: ``units`` is a streaming DataFrame of unit rows; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = units.writeStream.foreachBatch(lambda df, n: match_batch(df, n, store, matches)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
