"""Column helpers for the text operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of whole texts that go to Python at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows a batch for Python to ``BATCH_ROWS``, if it has more.

    The default of 10,000 is meant for rows of numbers: with texts, a batch takes tens of megabytes, several times a task,
    outside of the executor's heap and in the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_id(text: Column) -> Column:
    """128 bits of a text, for what depends on the text alone."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("b"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column) -> Column:
    """Exclusive prefix sums of an array of numbers, in about n times sqrt(n) steps, so that thousands of matches in one text stay cheap."""
    add = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def sums(s: Column) -> Column:
        v, chunk = s["v"], s["chunk"]
        n = F.size(v)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
        totals = F.transform(starts, lambda j: add(F.slice(v, j * chunk + 1, chunk)))
        bases = lambda t: F.transform(t, lambda _, j: add(F.slice(t, F.lit(1), j)))
        nth = lambda i: F.floor(i / chunk).cast("int")
        each = lambda b: F.transform(v, lambda _, i: b[nth(i)] + add(F.slice(v, nth(i) * chunk + 1, i % chunk)))
        return let(totals, lambda t: let(bases(t), each))

    chunk = lambda v: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"))
    return let(values, lambda v: let(F.struct(v.alias("v"), chunk(v).alias("chunk")), sums))
