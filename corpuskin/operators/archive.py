"""What the members of an archetype share byte by byte in their descriptions, and its encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

MIN_SHARED = 4
#: Fixed values of the encoding: a gap's marker; shared bytes follow their length as four bytes, least first.
GAP = b"\xff\xff\xff\xff"


def shared_runs(descriptions: DataFrame, least: int = MIN_SHARED) -> DataFrame:
    """(group_id, ifd_index, run_start, run_end): maximal runs of positions at which all members of a group agree.

    ``descriptions`` are (group_id, path, ifd_index, bytes). A group's first path is its representative; members without
    bytes at a section are skipped there, and a representative alone shares all of its bytes. Positions are compared by an
    aggregate with map-side combine, so a group's size doesn't matter; a window orders one description's positions.
    """
    if least < 1:
        raise ValueError("least must be 1 or more")
    first = descriptions.groupBy("group_id").agg(F.min("path").alias("_lead"))
    rows = descriptions.where("bytes is not null").join(first, "group_id").select("group_id", "ifd_index", "path", "_lead", F.col("bytes").alias("h"))
    lead = rows.where("path = _lead").select("group_id", "ifd_index", F.col("h").alias("hl"))
    others = rows.where("path <> _lead").select("group_id", "ifd_index", "h")
    n_others = others.groupBy("group_id", "ifd_index").agg(F.count("*").alias("others"))
    byte = lambda text, i: F.substring(text, i + 1, F.lit(1))  # noqa: E731  of binaries, in constant time
    shorter = F.least(F.length("h"), F.length("hl"))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    # only positions at which a member agrees with the representative become rows
    equal = others.join(lead, ["group_id", "ifd_index"]).select("group_id", "ifd_index", F.explode(F.filter(places, lambda i: byte(F.col("h"), i) == byte(F.col("hl"), i))).alias("pos"))
    agreed = equal.groupBy("group_id", "ifd_index", "pos").agg(F.count("*").alias("n")).join(n_others, ["group_id", "ifd_index"]).where("n = others")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("group_id", "ifd_index").orderBy("pos"))
    runs = agreed.withColumn("_i", island).groupBy("group_id", "ifd_index", "_i").agg(F.min("pos").alias("run_start"), (F.max("pos") + 1).alias("run_end")).drop("_i")
    alone = lead.join(n_others, ["group_id", "ifd_index"], "left_anti").select("group_id", "ifd_index", F.lit(0).alias("run_start"), F.length("hl").alias("run_end"))
    return runs.unionByName(alone).where(F.col("run_end") - F.col("run_start") >= least)


def segments(descriptions: DataFrame, least: int = MIN_SHARED) -> DataFrame:
    """(group_id, ifd_index, seg_no, kind, bytes): per section of the representative, shared bytes and gaps in order.

    A section without bytes or without shared runs is one gap.
    """
    first = descriptions.groupBy("group_id").agg(F.min("path").alias("path"))
    lead = descriptions.join(first, ["group_id", "path"]).select("group_id", "ifd_index", "bytes")
    runs = shared_runs(descriptions, least).groupBy("group_id", "ifd_index").agg(F.sort_array(F.collect_list(F.struct("run_start", "run_end"))).alias("runs"))
    joined = lead.join(runs, ["group_id", "ifd_index"], "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<run_start:int,run_end:int>>")))
    gap = lambda at: F.struct(at.alias("at"), F.lit("gap").alias("kind"), F.lit(None).cast("binary").alias("bytes"))

    def run(r, i):
        before = F.when(i == 0, F.lit(0)).otherwise(F.col("runs")[i - 1]["run_end"])
        held = F.struct(r["run_start"].alias("at"), F.lit("shared").alias("kind"), F.substring(F.col("bytes"), r["run_start"] + 1, r["run_end"] - r["run_start"]).alias("bytes"))
        return F.when(r["run_start"] > before, F.array(gap(before), held)).otherwise(F.array(held))

    inner = F.flatten(F.transform("runs", run))
    tail = F.col("runs")[F.size("runs") - 1]["run_end"]
    listed = F.when(F.size("runs") == 0, F.array(gap(F.lit(0)))).otherwise(F.concat(inner, F.when(tail < F.length("bytes"), F.array(gap(tail))).otherwise(F.filter(inner, lambda _: F.lit(False)))))
    out = joined.select("group_id", "ifd_index", F.posexplode(listed).alias("seg_no", "s"))
    return out.select("group_id", "ifd_index", "seg_no", F.col("s.kind").alias("kind"), F.col("s.bytes").alias("bytes"))


def encode_segments(rows: DataFrame) -> DataFrame:
    """(group_id, bytes): a group's segments in order, encoded. A group is as large as its representative's descriptions."""
    size = F.length("bytes")
    head = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(size, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(4)])
    made = F.when(F.col("kind") == "gap", F.lit(GAP)).otherwise(F.concat(head, F.col("bytes")))
    listed = rows.select("group_id", F.struct("ifd_index", "seg_no", made.alias("b")).alias("s")).groupBy("group_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return listed.select("group_id", F.aggregate("s", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["b"])).alias("bytes"))


def archetype_bytes(descriptions: DataFrame, least: int = MIN_SHARED) -> DataFrame:
    """(group_id, bytes) of each group with a member. Raises ValueError if there are no members at all."""
    if not descriptions.head(1):
        raise ValueError("an archetype needs members")
    return encode_segments(segments(descriptions, least))
