"""Repeated passages by sparse suffixes at content-selected positions.

A suffix is retained where a run of ``seed`` words has the least hash among the runs of a window of ``least`` words
(a minimiser): any passage of ``least`` words that occurs twice has its suffix retained at the same word both times.
Suffixes whose first ``seed`` words no other one has go. The rest are told apart by the stretch around the retained word,
over all windows that select it: equal stretches are one class, however many copies there are. Where a seed has several
classes, these are sorted by the words that follow the retained word, then by those before it; each is compared with its
neighbours in that order, and the match extended left and right. A window that neither neighbour has, of a class with
further ones of its seed, is looked up among theirs, so that the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskin.llm.simhash import word_pieces
from corpuskin.llm.textcols import small_batches
from corpuskin.plans.shared import discard, materialize, release

LEAST_WORDS, SEED_WORDS = 50, 16
#: An odd base, invertible modulo 2^64, so that the hash of any run of words is a difference of prefix sums.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18


def word_hashes(text: str | None) -> np.ndarray:
    """A hash per word (runs of other bytes than ASCII white space, A-Z folded)."""
    parts = [
        np.fromiter(map(xxhash.xxh64_intdigest, piece), np.uint64, len(piece))
        for piece in word_pieces((text or "").encode("utf-8", "replace").lower())
    ]
    return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint64)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Runs:
    """Hashes of any run of a text's words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _powers(_INVERSE, n), out=self.sums[1:], dtype=np.uint64)
        self.shift = _powers(_BASE, n + 1)

    def hashes(self, starts: np.ndarray, lengths) -> np.ndarray:
        x = (self.sums[starts + lengths] - self.sums[starts]) * self.shift[starts]
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def selected(runs: Runs, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``least`` words its retained word, and the hashes of all seeds."""
    if runs.n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = runs.hashes(np.arange(runs.n - seed + 1), seed)
    wide = least - seed + 1
    view = np.lib.stride_tricks.sliding_window_view(seeds, wide)
    at = np.concatenate([view[i : i + _SLICE].argmin(1) for i in range(0, len(view), _SLICE)])
    return at + np.arange(len(at)), seeds


def _retained(rows: DataFrame, key: str, least: int, seed: int) -> DataFrame:
    """(key, _k, n_words, seeds): the seeds' hashes at the retained words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, seeds = [], []
            for i in range(b.num_rows):
                runs = Runs(word_hashes(b.column(2)[i].as_py()))
                at, h = selected(runs, least, seed)
                counts.append(runs.n)
                seeds.append(h[np.unique(at)].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), _lists(seeds)], names=[key, "_k", "n_words", "seeds"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, _k struct<a:bigint,b:bigint>, n_words bigint, seeds array<bigint>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64)))


#: What tells a class: its seed, the hash of its stretch, the retained word's place in it, and the number of windows.
CLASS = ["seed", "stretch", "rel", "wide"]


def _places(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """(_r, times, seed, stretch, rel, wide, first) of the retained words of (_text, _r, times, met) whose seeds are in ``met``.

    ``wide`` windows, from word ``first`` on, select the word, which is the ``rel``-th after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], [[], [], [], [], []]
            for i in range(b.num_rows):
                runs = Runs(word_hashes(b.column(0)[i].as_py()))
                at, h = selected(runs, least, seed)
                met = np.array(b.column(3)[i].as_py(), np.int64)
                cuts = np.nonzero(np.diff(at))[0] + 1  # windows that select the same word adjoin
                first = np.concatenate([[0], cuts])
                last = np.concatenate([cuts, [len(at)]]) - 1
                own = h[at[first]].view(np.int64)
                keep = np.isin(own, met)
                first, last, own = first[keep], last[keep], own[keep]
                rows.append(np.full(len(own), i, np.int64))
                stretch = runs.hashes(first, last - first + least).view(np.int64)
                for c, x in zip(cols, (own, stretch, at[first] - first, last - first + 1, first), strict=True):
                    c.append(x)
            whole = [np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64) for c in (rows, *cols)]
            at_row = pa.array(whole[0])
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            made = [pa.array(c).cast(t) for c, t in zip(whole[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1).take(at_row), b.column(2).take(at_row), *made], names=["_r", "times", *CLASS, "first"])

    return texts.select("_text", "_r", "times", "met").mapInArrow(run, "_r bigint, times bigint, seed bigint, stretch bigint, rel int, wide int, first bigint")


def _suffixes(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """(seed, stretch, rel, wide, n, classes, right, left) of (_text, want): the words after the seed, and those before it, last first.

    A word is four bytes of its hash, the highest first, so that the order of the bytes is that of the words.
    """
    fields = [*CLASS, "n", "classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, right, left = [], [], []
            for i in range(b.num_rows):
                words = (word_hashes(b.column(0)[i].as_py()) & np.uint64(0xFFFFFFFF)).astype(">u4")
                for w in b.column(1)[i].as_py():
                    at = w["first"] + w["rel"]
                    rows.append(w)
                    right.append(words[at + seed : w["first"] + w["wide"] - 1 + least].tobytes())
                    left.append(words[w["first"] : at][::-1].tobytes())
                if len(rows) >= 20_000 or i == b.num_rows - 1:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                    made = [pa.array([w[f] for w in rows], t) for f, t in zip(fields, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*made, pa.array(right, pa.binary()), pa.array(left, pa.binary())], names=[*fields, "right", "left"])
                    rows, right, left = [], [], []

    return texts.select("_text", "want").mapInArrow(run, "seed bigint, stretch bigint, rel int, wide int, n bigint, classes bigint, right binary, left binary")


def common_words(a: bytes, b: bytes) -> int:
    """How many words two runs of them begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    x, y = np.frombuffer(a, "<u4", n // 4), np.frombuffer(b, "<u4", n // 4)
    return int((x != y).argmax())


def _neighbours(suffixes: DataFrame, least: int, seed: int) -> DataFrame:
    """(seed, stretch, rel, wide, ranges, open) of sorted suffixes: the windows that a neighbour has too, and whether others of the seed may have more."""

    def shared(x: tuple, y: tuple) -> tuple[range, range]:
        """The windows that two suffixes have in common, by their numbers in each: the match, extended to both sides."""
        after, before = seed + common_words(x[6], y[6]), common_words(x[7], y[7])
        of = lambda s: range(max(0, s[2] - before), max(0, min(s[3], s[2] + after - least + 1)))
        return of(x), of(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        got: list[range] = []
        out: list[tuple] = []

        def close() -> None:
            ranges = sorted((r.start, r.stop) for r in got if len(r))
            covered = len({i for s, e in ranges for i in range(s, e)})
            alone = held[4] == 1 and covered < held[3] and not (held[5] == 2 and got)  # of two classes that were compared nothing is left
            out.append((*held[:4], [{"lo": s, "hi": e} for s, e in ranges], alone))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ranges: list[range] = []
                if held is not None:
                    if held[0] == row[0]:
                        a, z = shared(held, row)
                        got.append(a)
                        ranges.append(z)
                    close()
                held, got = row, ranges
            if len(out) >= 10_000:
                yield _told(out)
                out.clear()
        if held is not None:
            close()
        if out:
            yield _told(out)

    return suffixes.select(*CLASS, "n", "classes", "right", "left").mapInArrow(run, "seed bigint, stretch bigint, rel int, wide int, ranges array<struct<lo:int,hi:int>>, open boolean")


def _told(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*CLASS, "ranges", "open"])


def _windows(suffixes: DataFrame, least: int, seed: int) -> DataFrame:
    """(seed, stretch, rel, wide, i, digest): the 128-bit hash of each window's words other than the seed's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at, digests = [], [], []
            for k, (rel, wide, right, left) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)):
                for i in range(wide):
                    rows.append(k)
                    at.append(i)
                    digests.append(xxhash.xxh3_128_digest(b"%d:" % (rel - i) + left[: 4 * (rel - i)] + right[: 4 * (i + least - rel - seed)]))
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(taken) for c in range(4)), pa.array(at, pa.int32()), pa.array(digests, pa.binary())], names=[*CLASS, "i", "digest"])

    return suffixes.select(*CLASS, "right", "left").mapInArrow(run, "seed bigint, stretch bigint, rel int, wide int, i int, digest binary")


def _repeated_windows(classes: DataFrame, texts: DataFrame, least: int, seed: int) -> DataFrame:
    """(seed, stretch, rel, wide, lo, hi): the windows of each class that another class or copy has.

    ``classes`` are (seed, stretch, rel, wide, n, at) and ``texts`` a function from (_r, want) to those rows' (_text, want).
    """
    copied = classes.where("n > 1").select(*CLASS, F.lit(0).alias("lo"), F.col("wide").alias("hi"))
    several = classes.groupBy("seed").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1").select("seed", "classes")
    several = materialize(several, "several")
    wanted = classes.join(several, "seed").groupBy("at._r").agg(F.collect_list(F.struct(*CLASS, "n", "classes", F.col("at.first").alias("first"))).alias("want"))
    suffixes = materialize(_suffixes(texts(wanted), least, seed), "suffixes")
    by = ["seed", "right", "left"]
    # range partitions split a seed that many classes share; neighbours in two partitions aren't compared, and stay open
    release(classes.sparkSession)
    told = materialize(_neighbours(suffixes.repartitionByRange(*by).sortWithinPartitions(*by), least, seed), "neighbours")
    near = told.select(*CLASS, F.explode("ranges").alias("x")).select(*CLASS, "x.lo", "x.hi")
    open_ = told.where("open").select("seed").distinct()
    windows = materialize(_windows(suffixes.join(open_, "seed", "left_semi"), least, seed), "windows")
    twice = windows.groupBy("seed", "digest").agg(F.count("*").alias("c")).where("c > 1").select("seed", "digest")
    further = windows.join(twice, ["seed", "digest"], "left_semi").select(*CLASS, F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"))
    ranges = materialize(copied.unionByName(near).unionByName(further), "ranges")
    for table in (several, suffixes, told, windows):
        discard(table)
    release(ranges.sparkSession)
    return ranges


def _merge(rows: DataFrame) -> DataFrame:
    """(_r, spans): the union of each text's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                joined: list[dict] = []
                for r in sorted((x["start"], x["end"]) for x in b.column(1)[i].as_py()):
                    if joined and r[0] <= joined[-1]["end"]:
                        joined[-1]["end"] = max(joined[-1]["end"], r[1])
                    else:
                        joined.append({"start": r[0], "end": r[1]})
                out.append(joined)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["_r", "spans"])

    return rows.mapInArrow(run, "_r bigint, spans array<struct<start:bigint,end:bigint>>")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """One row per input row: ``key``, n_words, spans (array<struct<start, end>>, words from 0, end exclusive).

    ``spans`` is the union of all runs of ``least`` words that occur at another place too, in this row or another one.
    Words are runs of other bytes than ASCII white space; A-Z count as a-z. A null text has no words; a text of fewer
    words than ``least`` has no spans. Rows of equal key and text repeat each other. Other columns are left out.
    """
    if not 0 < seed <= least:
        raise ValueError("seed must be 1 to least")
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    # 128 bits of key and text: rows that have them in common are equal
    same = F.struct(F.xxhash64(F.col(key), body).alias("a"), F.xxhash64(body, F.lit(1), F.col(key)).alias("b"))
    rows = docs.select(F.col(key).alias(key), same.alias("_k"), body.alias("_text"))
    retained = materialize(_retained(rows, key, least, seed).withColumn("_r", F.monotonically_increasing_id()), "retained")
    seeds = retained.select("_r", F.explode("seeds").alias("seed"))
    # written, so that adaptive execution can split a hot seed in the join: right above an aggregate it can't
    met = materialize(seeds.groupBy("seed").count().where("count > 1").select("seed"), "repeated")
    # which of a text's seeds have an equal one elsewhere: at most a text's own, so a row is no larger than its text
    found = seeds.join(met, "seed", "left_semi").groupBy("_r").agg(F.collect_set("seed").alias("met"))
    found = retained.select("_r", "_k").join(found, "_r").groupBy("_k").agg(F.min("_r").alias("_r"), F.count("*").alias("times"), F.first("met").alias("met"))
    found = materialize(found, "met")
    discard(met)
    release(docs.sparkSession)
    # of equal rows one is read, and counts for all
    read = lambda chosen: rows.select("_k", "_text").join(chosen, "_k").dropDuplicates(["_k"])
    places = materialize(_places(read(found), least, seed), "places")
    classes = materialize(places.groupBy(*CLASS).agg(F.sum("times").alias("n"), F.min(F.struct("_r", "first")).alias("at")), "classes")
    release(docs.sparkSession)
    ranges = _repeated_windows(classes, lambda wanted: read(found.select("_k", "_r").join(wanted, "_r")), least, seed)
    whole = places.join(ranges, CLASS).select("_r", (F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi") - 1 + least).alias("end"))
    spans = _merge(whole.groupBy("_r").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    spans = found.select("_k", "_r").join(spans, "_r").select("_k", "spans")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return retained.select(key, "_k", "n_words").join(spans, "_k", "left").select(key, "n_words", F.coalesce("spans", none).alias("spans"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeated_passages(docs)
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_repeated"),
        F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))).alias("spans"),
        (F.size("spans") > 0).alias("repeated"),
    )


#: Every run of 50 words, by the MD5 of its words; runs that occur twice, joined where they touch.
ORACLE_OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT r, unnest(range(len(w) - 49)) AS i, unnest(list_transform(range(len(w) - 49), lambda i: md5(array_to_string(w[i+1:i+50], ' ')))) AS h FROM d WHERE len(w) >= 50),
y AS (SELECT r, i FROM x WHERE h IN (SELECT h FROM x GROUP BY h HAVING count(*) > 1)),
z AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS c FROM y),
k AS (SELECT r, i, sum(c) OVER (PARTITION BY r ORDER BY i) AS k FROM z),
s AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY r, k),
t AS (SELECT r, sum(b - a)::BIGINT AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_repeated, coalesce(spans, '') AS spans, n IS NOT NULL AS repeated FROM d LEFT JOIN t ON d.r = t.r
"""
