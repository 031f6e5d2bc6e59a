"""Helpers that several operators share: durable intermediate tables, ranks without a single task, connected components.

Everything here survives the loss of executors: lineage is cut only by tables written to the folder that the cluster
names in ``spark.checkpoint.dir``, never by executor-local copies.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a temporary folder on a local master (tests); on a cluster, whose machines wouldn't share that
    folder, a ValueError.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="corpuskin-")
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


#: How intermediate tables are written: without success marks, and to mounted folders without checksum files and without the
#: process that Hadoop's checksum file system starts for each file to set its mode.
_PLAIN = {
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}

#: Folders that :func:`materialize` wrote and nothing has deleted yet.
_written: set[str] = set()


#: Tables above this aren't broadcast unless a plan names them: Spark judges by the bytes of Parquet files, and what the driver
#: builds of those takes many times as much.
BROADCAST_BYTES = 256 << 10


def small_broadcasts(spark: SparkSession) -> None:
    """Lowers the session's thresholds for broadcast joins to ``BROADCAST_BYTES``: several of the default 10 MB at once are too much for a driver of 750 MB."""
    read = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        now = spark.conf.get(name, None)  # the adaptive one has no value of its own as a rule
        if now and not now.startswith("-") and read(now) > BROADCAST_BYTES:  # below 0: none at all
            spark.conf.set(name, str(BROADCAST_BYTES))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: later stages start from the written table.

    Tables last until :func:`discard` or :func:`sweep`, or the driver's end: results may still read them.
    """
    spark = df.sparkSession
    small_broadcasts(spark)
    path = f"{work_dir(spark).rstrip('/')}/corpuskin-{label}-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.options(**_PLAIN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files behind tables that are written: it does once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.discard(path)


def sweep(spark: SparkSession | None = None) -> None:
    """Deletes the tables that :func:`materialize` wrote. For a driver that runs on, once it has written its results; at the driver's end it is done by itself."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in sorted(_written):
        _delete(spark, path)


@atexit.register
def _sweep_at_the_end() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        sweep()


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`materialize` wrote, once nothing reads it any more."""
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        if "/corpuskin-" in root:
            for path in [p for p in _written if p.rsplit("/", 1)[-1] == root.rsplit("/", 1)[-1]] or [root]:
                _delete(df.sparkSession, path)


def squared(left: DataFrame, right: DataFrame, rows: int = 4096) -> DataFrame:
    """All pairs of a row of ``left`` and one of ``right``, for operators whose result is all pairs.

    Both sides are cut into blocks of about ``rows`` rows at most, and joined on pairs of blocks: the work is dealt over
    the pairs, and no side is broadcast unless it is known to be small.
    """
    n = max(8, -(-left.count() // rows))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda df: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    a = left.withColumn("_i", own(left)).withColumn("_j", every)
    b = right.withColumn("_j", own(right)).withColumn("_i", every)
    # few rows make many pairs: by their bytes, adaptive execution would put them all in one task
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(tasks, "_i", "_j").join(b.repartition(tasks, "_i", "_j"), ["_i", "_j"]).drop("_i", "_j")


def ranked(df: DataFrame, group: str, order: list[str], out: str, label: str) -> DataFrame:
    """Adds ``out``: the row's place (from 0, gapless) within ``group``, ordered by ``order`` and then arbitrarily.

    No group is gathered in one task: rows are range-partitioned by (group, order, row number), so that even a group of
    equal rows is split, numbered within their partition, and shifted by the prefix sums of the partitions' counts. The
    prefix table has a row for each (partition, group) that occurs, at most partitions + groups, whatever the input.
    """
    base = materialize(df, label)
    by = [group, *order, "_row"]
    dealt = (
        base.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_part", F.spark_partition_id())
        # the lower 33 bits number the rows within the partition
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    dealt = materialize(dealt.drop("_row"), f"{label}-dealt")
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    counts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_base")
    joined = dealt.join(counts, dealt[group].eqNullSafe(counts["_g"]) & (dealt["_part"] == counts["_p"]))
    return joined.withColumn(out, F.col("_at") + F.col("_base")).drop("_g", "_p", "_base", "_part", "_at")


#: Edges that a task writes at a time in the rounds of connected components.
EDGES_A_FILE = 250_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge to another one.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step is an aggregate with map-side combine
    and an equi-join that adaptive execution can split, so that a hub with many neighbours is not one task's work. Each
    round is written to the shared folder; the one before it is deleted.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen, n = None, now.count()
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(small_least, "u")
        small = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        # rounds keep to about as many edges as there are: few files where these are few
        after = materialize(small.coalesce(max(1, -(-n // EDGES_A_FILE))), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(now)
        now, n = after, mark[0]
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
