"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window of an item is a set of shingles (pairs of adjoining words) that must be contained whole, so that its prefix, the
shingles of which at least one must occur, is its rarest shingle alone. Shingles are ordered by the number of distinct
texts that contain them. Windows of an item that have the same rarest shingle at the same word are one row, its anchor.
The documents' shingles that may be anchors (a Bloom filter of bounded size tells) are joined with the anchors on the
shingle; of the words around both the match is extended to both sides (position), and the windows that fit into it
(length) are contained, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskin.llm.textcols import fresh, small_batches, text_id
from corpuskin.plans.shared import materialize

#: Folds A-Z and blanks what is no ASCII digit, ASCII letter or byte beyond ASCII, so that what is left between blanks are the words.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))

#: Bits of a Bloom filter: so many a shingle, a power of two between these; beyond the largest (16 MB) more shingles pass it, and the join removes them.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27
PROBES = 4


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def shingle_hashes(words: list[bytes], size: int = 2) -> np.ndarray:
    """64-bit hashes of the pairs of adjoining words, or of the words themselves."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    x = w * np.uint64(0x9E3779B97F4A7C15) if size == 1 else w[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[1:]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Bloom:
    """Which 64-bit hashes may be in a set."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where hashes that may be in the set stand."""
        at = np.arange(len(h))
        for k in range(PROBES):
            a, b = h[at] & self.mask, (h[at] >> np.uint64(32) | np.uint64(1)) & self.mask
            bit = (a + np.uint64(k) * b) & self.mask
            at = at[(self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return at

    @classmethod
    def of(cls, hashes: DataFrame) -> Bloom:
        """Of a column ``h`` (long): the bits are set on the executors; at most ``MOST_BITS`` reach the driver."""
        n = hashes.select("h").distinct().count()
        bits = LEAST_BITS
        while bits < min(MOST_BITS, BITS_EACH * n):
            bits *= 2
        mask = F.lit(bits - 1)
        a, b = F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1)).bitwiseAND(mask)
        places = F.explode(F.array(*[(a + F.lit(k) * b).bitwiseAND(mask) for k in range(PROBES)]))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
        slots = hashes.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(one).alias("word")).toPandas()
        words = np.zeros(bits // 64, np.uint64)
        words[slots["slot"].to_numpy(np.int64)] = slots["word"].to_numpy(np.int64).view(np.uint64)
        return cls(words)


def _sizes(shingles: DataFrame) -> list[int]:
    """The sizes of shingles that occur: single words only where an item has but one."""
    return sorted(r["size"] for r in shingles.select("size").distinct().collect())


def _item_shingles(items: DataFrame, shingle: int) -> DataFrame:
    """(_i, size, at, h) of (_i, text): all shingles of each item, of the single word of an item of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w = words_of(b.column(1)[i].as_py())
                if w:
                    size = min(shingle, len(w))
                    h = shingle_hashes(w, size).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b.column(0)[i].as_py())), pa.array(np.full(len(h), size), pa.int32()), pa.array(np.arange(len(h)), pa.int32()), pa.array(h)], names=["_i", "size", "at", "h"])

    return items.select("_i", "text").mapInArrow(run, "_i bigint, size int, at int, h bigint")


def _often(texts: DataFrame, bloom, sizes: list[int]) -> DataFrame:
    """(h, n): in how many texts each shingle is that may be wanted; counted within a batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for i in range(b.num_rows):
                w = words_of(b.column(0)[i].as_py())
                for n in sizes:
                    h = shingle_hashes(w, n)
                    found.append(np.unique(h[known.places(h)]))
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])

    return texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def anchors_of(n_words: int, hashes: np.ndarray, often: np.ndarray, width: int, size: int) -> list[tuple[int, int, int, int]]:
    """(word, first window, last window, words of a window) of each anchor: windows whose rarest shingle stands at that word, unless it is nowhere.

    Ties go to the smaller hash, then to the first word. ``size`` is the words of a shingle.
    """
    width = min(width, n_words)
    order = np.empty(len(hashes), np.int64)
    order[np.lexsort((np.arange(len(hashes)), hashes, often))] = np.arange(len(hashes))
    view = np.lib.stride_tricks.sliding_window_view(order, width - size + 1)
    at = view.argmin(1) + np.arange(len(view))
    cuts = np.nonzero(np.diff(at))[0] + 1  # a total order: windows that choose the same word adjoin
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts, [len(at)]]) - 1
    return [(int(at[s]), int(s), int(e), width) for s, e in zip(first, last, strict=True) if often[at[s]] > 0]


def _anchors(priced: DataFrame, width: int) -> DataFrame:
    """(h, item, rel, wide, width, around) of (item, text, size, shingles: array<struct<at, h, n>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w = words_of(b.column(1)[i].as_py())
                known = b.column(3)[i].as_py()
                h = np.array([x["h"] for x in known], np.int64)
                rows = anchors_of(len(w), h, np.array([x["n"] for x in known], np.int64), width, b.column(2)[i].as_py())
                cols = list(zip(*((int(h[p]), p - s, e - s + 1, n, b" ".join(w[s : e + n])) for p, s, e, n in rows), strict=True)) or [()] * 5
                names = pa.array([b.column(0)[i].as_py()] * len(rows), pa.string())
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), names, *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], names=["h", "item", "rel", "wide", "width", "around"])

    return priced.select("item", "text", "size", "shingles").mapInArrow(run, "h bigint, item string, rel int, wide int, width int, around binary")


_GRAMS = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("around", pa.binary())]))


def _grams(texts: DataFrame, bloom, sizes: list[int], width: int, others: list[str]) -> DataFrame:
    """(others..., n_words, grams) of (others..., text): the shingles that may be anchors, each with the words that a window around it could have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for b in batches:
            counts, grams = [], []
            for i in range(b.num_rows):
                w = words_of(b.column(len(others))[i].as_py())
                counts.append(len(w))
                made = []
                for n in sizes:
                    h = shingle_hashes(w, n)
                    for at in known.places(h).tolist():
                        left = min(at, max(0, width - n))
                        made.append({"h": int(h[at].view(np.int64)), "at": at, "left": left, "around": b" ".join(w[at - left : at + max(n, width)])})
                grams.append(made)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(grams, _GRAMS)], names=[*others, "n_words", "grams"])

    kinds = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in others)
    return texts.select(*others, "_text").mapInArrow(run, kinds + "n_words bigint, grams array<struct<h:bigint,at:bigint,left:int,around:binary>>")


def contained(around: list[bytes], left: int, item: list[bytes], rel: int, wide: int, width: int) -> tuple[int, int]:
    """(first, last + 1) of the ``wide`` windows of ``item`` that occur where its word ``rel`` meets word ``left`` of ``around``."""
    before = 0
    while before < min(left, rel) and around[left - before - 1] == item[rel - before - 1]:
        before += 1
    after = 0
    while after < min(len(around) - left, len(item) - rel) and around[left + after] == item[rel + after]:
        after += 1
    return max(0, rel - before), max(0, min(wide, rel + after - width + 1))


def _verified(met: DataFrame) -> DataFrame:
    """(_t, item, start, end): the words of a text that windows of an item cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, ends = [], [], []
            for i, (at, left, around, rel, wide, width, item) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)):
                first, stop = contained(around.split(b" "), left, item.split(b" "), rel, wide, width)
                if first < stop:
                    rows.append(i)
                    starts.append(at - rel + first)
                    ends.append(at - rel + stop - 1 + width)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(taken), b.column(1).take(taken), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["_t", "item", "start", "end"])

    return met.select("_t", "item", "at", "left", "words", "rel", "wide", "width", "around").mapInArrow(run, "_t struct<a:bigint,b:bigint>, item string, start bigint, end bigint")


def _matched(rows: DataFrame, benchmark: DataFrame, width: int, item: str, item_text: str, others: list[str]) -> tuple[DataFrame, DataFrame]:
    """((others..., _t, n_words) of ``rows`` (others..., _t, _text), (_t, item, start, end))."""
    spark = rows.sparkSession
    small_batches(spark)
    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    items = materialize(named.withColumn("_i", F.monotonically_increasing_id()), "items")
    shingles = materialize(_item_shingles(items, min(2, width)), "shingles")
    sizes = _sizes(shingles)
    wanted = spark.sparkContext.broadcast(Bloom.of(shingles))
    often = _often(rows.select("_text"), wanted, sizes)
    priced = shingles.join(often, "h", "left").groupBy("_i", "size").agg(F.array_sort(F.collect_list(F.struct("at", "h", F.coalesce("n", F.lit(0).cast("long")).alias("n")))).alias("shingles"))
    anchors = materialize(_anchors(items.join(priced, "_i"), width), "anchors")
    chosen = spark.sparkContext.broadcast(Bloom.of(anchors))
    read = materialize(_grams(rows, chosen, sizes, width, [*others, "_t"]), "grams")
    # equal texts are matched once
    texts = read.where(F.size("grams") > 0).groupBy("_t").agg(F.first("grams").alias("grams")).select("_t", F.explode("grams").alias("g"))
    grams = texts.select("_t", "g.h", "g.at", "g.left", F.col("g.around").alias("words"))
    return read.drop("grams"), _verified(grams.join(anchors, "h"))


def contaminated_words(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per input row: ``key``, n_words, hits (array<struct<start, end>>: runs of hit words, end exclusive), items.

    ``items`` are the ids, as strings, sorted and distinct, of the items of which a window occurs. Null texts have no
    words; an item without words has no windows; items that share windows each count. A null item id counts as the empty
    string. An empty benchmark hits nothing. Rows are judged by their texts alone: keys may repeat or be null, be of any
    type, and have any name but n_words, hits or items.
    """
    if key in ("n_words", "hits", "items"):
        raise ValueError(f"the key can't be named {key}")
    rows = docs.select(F.col(key).alias("_key"), text_id(F.col(text)).alias("_t"), F.col(text).alias("_text"))
    read, found = _matched(rows, benchmark, width, item, item_text, ["_key"])
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(a, x):
        last = F.try_element_at(a, F.lit(-1))
        join = F.coalesce(last["end"] >= x["start"], F.lit(False))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(join, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(wider))).otherwise(F.concat(a, F.array(x)))

    per_text = found.groupBy("_t").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    per_text = materialize(per_text, "found")  # a text with many copies can be split in the join only if no aggregate stands right below
    joined = read.join(per_text.select("_t", F.aggregate("hits", empty, add).alias("hits"), "items"), "_t", "left")
    return joined.select(F.col("_key").alias(key), "n_words", F.coalesce("hits", empty).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated_words(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


#: Each window as its words joined by blanks; windows' places in the documents by an equal join of all runs of as many words.
ORACLE_OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda i: array_to_string(w[i+1:i+10], ' '))) AS s FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, unnest(range(len(w) - n + 1)) AS i, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i+1:i+n], ' '))) AS s FROM d, sizes WHERE len(w) >= n),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM m) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN i ON d.r = i.r
"""


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs: rows are judged by their texts, which null ones and ones without words pass. All columns stay, whatever their names."""
    _, found = _matched(docs.select(text_id(F.col(text)).alias("_t"), F.col(text).alias("_text")), benchmark, width, item, item_text, [])
    bad = materialize(found.select(F.col("_t.a").alias("_a"), F.col("_t.b").alias("_b")).distinct(), "contaminated")
    own = text_id(F.col(text))
    at = fresh(docs, "_t")
    return docs.withColumn(at, own).join(bad, (F.col(f"{at}.a") == bad["_a"]) & (F.col(f"{at}.b") == bad["_b"]), "left_anti").drop(at)
