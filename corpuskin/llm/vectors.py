"""Near-duplicate embeddings by randomly rotated binary codes with stored correction factors.

A vector's code is the signs of its randomly rotated coordinates, a bit each. With the length of the vector's projection
on the code (the correction factor) the code gives an unbiased estimate of its inner product with another vector, of which
four bits a rotated coordinate are kept, and bounds of the estimate's error (Gao and Long, 2024). Codes, factors and these
short forms are made once and stored; estimates are bit counts.

Vectors meet in buckets, which are sign bits of further random rotations. Only the stored forms are dealt to the buckets.
There the estimates' upper confidence bounds decide which pairs need exact computation, and only vectors of such pairs
follow them to their buckets, where cosines are computed in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskin.plans.shared import connected_components, materialize

THRESHOLD = 0.95
#: Pairs of exactly the threshold's cosine share a bucket in at least one table with at least this probability; closer ones with a higher.
RECALL = 0.999
#: Half-width of the estimates' confidence interval, in their standard deviations.
SURE = 4.0
#: Rows of a bucket that one block takes; a larger bucket is split into blocks, each pair of which is a unit of work.
BLOCK = 1024
SEED = 20240605
#: Bits of a rotated coordinate in the short form of a vector.
PLANES = 4


@lru_cache(maxsize=64)
def rotation(dim: int, number: int, columns: int | None = None) -> np.ndarray:
    """The first ``columns`` columns (all: None) of a random orthogonal matrix: the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, number]).normal(size=(dim, columns or dim)))
    return q * np.sign(np.diag(r))


def tables_for(rows: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): as many bits as keep a bucket of unrelated vectors at about 8, and the tables that the recall needs."""
    bits = max(1, min(dim, 31, math.ceil(math.log2(max(2, rows / 8)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1


def bucket_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A column of bucket numbers for each table."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([(unit @ rotation(unit.shape[1], t + 1, bits) > 0) @ weights for t in range(tables)], 1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    n, dim = bits.shape
    padded = np.zeros((n, -(-dim // 64) * 64), bool)
    padded[:, :dim] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


class Codes:
    """Of vectors of length 1: sign codes and their factors; short forms as bit planes, with offset, step and sum."""

    def __init__(self, dim: int, code: np.ndarray, factor: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray):
        self.dim, self.code, self.factor, self.planes, self.low, self.step = dim, code, factor, planes, low, step

    @classmethod
    def of(cls, unit: np.ndarray) -> Codes:
        dim = unit.shape[1]
        turned = unit @ rotation(dim, 0)
        factor = np.abs(turned).sum(1) / math.sqrt(dim)
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), 1e-30)
        # rounded up or down at random, so that the short form is unbiased
        dither = np.random.default_rng([SEED, dim]).random(dim)
        level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, (1 << PLANES) - 1).astype(np.int64)
        planes = np.stack([_packed((level >> k & 1).astype(bool)) for k in range(PLANES)], 1)
        return cls(dim, _packed(turned > 0), factor, planes, low, step)

    def take(self, rows: np.ndarray) -> Codes:
        return Codes(self.dim, self.code[rows], self.factor[rows], self.planes[rows], self.low[rows], self.step[rows])

    def bounds(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, standard deviations) of the inner products of our short forms with the vectors that ``other``'s codes are of."""
        count = lambda x: np.bitwise_count(x).sum(-1, dtype=np.int64)
        ones = np.zeros((len(self.code), len(other.code)), np.int64)
        for k in range(PLANES):
            for w in range(self.code.shape[1]):
                ones += np.bitwise_count(self.planes[:, k, w, None] & other.code[None, :, w]).astype(np.int64) << k
        levels = sum(count(self.planes[:, k]) << k for k in range(PLANES))
        inside = self.low[:, None] * count(other.code) + self.step[:, None] * ones  # the sum of the coordinates whose bit is set
        total = (self.low * self.dim + self.step * levels)[:, None]
        estimate = (2 * inside - total) / math.sqrt(self.dim) / other.factor
        spread = np.maximum(0, 1 - other.factor**2) / max(1, self.dim - 1) + self.step[:, None] ** 2 / 4
        return estimate, np.sqrt(spread) / other.factor

    def maybe_near(self, other: Codes, threshold: float, sure: float = SURE) -> np.ndarray:
        """Which pairs' inner products may reach the threshold, by the estimates' upper confidence bounds."""
        estimate, error = self.bounds(other)
        return estimate + sure * error >= threshold - 1e-9


def _parsed(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction: no null or non-finite component and a length over 0."""
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(sound)


#: A bucket of a table, the two blocks of it that meet, and the own block of a row.
UNIT = ["dim", "table", "bucket", "i", "j"]


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``key``, n_links, component_id, kept (``key`` = component_id).

    Links have a cosine of at least ``threshold`` in double precision, between vectors of one dimension. Vectors without
    a direction link with nothing and are their own components; so are all where nothing links. Equal vectors are one
    node and count each other. A pair at the threshold itself is found with probability ``recall`` at least.
    Keys may be of any type that has an order; rows that repeat a key and vector are linked copies. A row without a key
    links like any other; its component is named after the smallest key in it, or null if there is none, and it is
    ``kept`` only in the latter case. Other columns are left out.
    """
    rows = vectors.select(F.col(key).alias("_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    nodes = _parsed(rows, "v").groupBy("v").agg(F.min("_id").alias("least"), F.count("*").alias("mult"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    dims = {r["d"]: r["count"] for r in nodes.groupBy(F.size("v").alias("d")).count().collect()}  # a row per dimension
    plans = {d: tables_for(n, d, threshold, recall) for d, n in dims.items()}
    coded = materialize(_coded(nodes, plans), "codes")

    on = UNIT[:3]
    dealt = coded.select("node", "dim", F.posexplode("keys").alias("table", "bucket"))
    blocks = dealt.groupBy(*on).count().where("count > 1").select(*on, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    # rows alone in their bucket go; of a large bucket, a row goes to each pair of blocks that has its own
    units = dealt.join(blocks, on).withColumn("own", own).withColumn("pair", F.explode(pairs)).select(*on, "pair.i", "pair.j", "own", "node")
    short = units.join(coded.drop("dim"), "node").select(*UNIT, "own", "node", F.slice("keys", F.lit(1), F.col("table")).alias("before"), "code", "factors")
    hits = materialize(_by_unit(short, _screened(threshold), "own int, node bigint, before array<int>", ["own", "node", "before"]), "hits")

    exact = hits.join(nodes.select("node", "v", "mult"), "node").select(*UNIT, "own", "node", "before", "v", "mult")
    found = materialize(_by_unit(exact, _linked(threshold), "node bigint, n bigint, least bigint", ["node", "n", "least"], keep_unit=False), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    graph = connected_components(found.select(F.col("node").alias("src"), F.col("least").alias("dst")))
    placed = nodes.join(counts, "node", "left").join(graph, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(named, "component").select(F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    joined = rows.join(placed, rows["v"] == placed["_v"], "left")
    component = F.when(F.col("_v").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return joined.select(F.col("_id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _arrays(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(items, where each row's begin and the last one's end)."""
    starts = column.offsets.to_numpy()
    return column.flatten().to_numpy(), starts - starts[0]


def _coded(nodes: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """(node, dim, keys, code, factors): buckets; sign code and planes as words; factor, offset and step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, starts = _arrays(b.column(1))
            sizes = np.diff(starts)
            for d in np.unique(sizes):
                here = np.nonzero(sizes == d)[0]
                unit = _unit(flat[starts[here][:, None] + np.arange(d)])
                c = Codes.of(unit)
                words = np.concatenate([c.code, c.planes.reshape(len(here), -1)], 1).view(np.int64)
                keys = bucket_keys(unit, *plans[int(d)])
                lists = lambda x, t: pa.array(list(x), pa.list_(t))
                made = [pa.array(np.full(len(here), d), pa.int32()), lists(keys.astype(np.int32), pa.int32()), lists(words, pa.int64()), lists(np.stack([c.factor, c.low, c.step], 1), pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(here)), *made], names=["node", "dim", "keys", "code", "factors"])

    return nodes.select("node", "v").mapInArrow(run, "node bigint, dim int, keys array<int>, code array<bigint>, factors array<double>")


def _by_unit(rows: DataFrame, work: Callable, schema: str, names: list[str], keep_unit: bool = True) -> DataFrame:
    """``work`` of each unit's rows, which a task takes one after another: the first five columns tell units apart.

    ``work`` gets a table of a unit's rows and gives lists of columns, or None.
    """
    dealt = rows.repartition(*UNIT).sortWithinPartitions(*UNIT)
    head = "dim int, table int, bucket int, i int, j int, " if keep_unit else ""
    out_schema = _arrow(head + schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at: tuple | None = None
        out: list[list] = []

        def close() -> None:
            table = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if table.num_rows > 1 and (got := work(table, at)) is not None:
                n = len(got[0])
                out.append([*(np.full(n, x, np.int32) for x in at), *got] if keep_unit else got)

        def flush() -> pa.RecordBatch:
            columns = [[x for part in column for x in part] if isinstance(column[0], list) else np.concatenate(column) for column in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)

        for b in batches:
            heads = np.stack([b.column(k).to_numpy() for k in range(5)], 1)
            cuts = [0, *(np.nonzero((heads[1:] != heads[:-1]).any(1))[0] + 1), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                unit = tuple(heads[s].tolist()) if e > s else at
                if held and unit != at:
                    close()
                    held = []
                held.append(b.slice(s, e - s))
                at = unit
            if sum(len(x[-1]) for x in out) > 10_000:
                yield flush()
        if held:
            close()
        if out:
            yield flush()

    return dealt.mapInArrow(run, head + schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def _sides(own: np.ndarray, at: tuple) -> tuple[np.ndarray, np.ndarray]:
    left = np.nonzero(own == at[3])[0]
    return (left, left) if at[3] == at[4] else (left, np.nonzero(own == at[4])[0])


def _new_pairs(near: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs that are ``near`` and met in no earlier table, whose buckets are ``before``."""
    i, j = np.nonzero(near)
    if left is right:
        i, j = i[i < j], j[i < j]
    i, j = left[i], right[j]
    if before.shape[1] and len(i):
        first = (before[i] != before[j]).all(1)
        i, j = i[first], j[first]
    return i, j


def _screened(threshold: float) -> Callable:
    """Of a unit's codes, the rows that have a pair which may be near and is new."""

    def work(rows: pa.RecordBatch, at: tuple) -> list | None:
        n, dim = rows.num_rows, at[0]
        own, node = rows.column(5).to_numpy(), rows.column(6).to_numpy()
        before = _arrays(rows.column(7))[0].reshape(n, -1)
        words = _arrays(rows.column(8))[0].view(np.uint64).reshape(n, -1)
        factors = _arrays(rows.column(9))[0].reshape(n, 3)
        w = words.shape[1] // (1 + PLANES)
        codes = Codes(dim, words[:, :w], factors[:, 0], words[:, w:].reshape(n, PLANES, w), factors[:, 1], factors[:, 2])
        left, right = _sides(own, at)
        i, j = _new_pairs(codes.take(left).maybe_near(codes.take(right), threshold), left, right, before)
        hit = np.unique(np.concatenate([i, j]))
        return [own[hit], node[hit], [before[k].tolist() for k in hit]] if len(hit) else None

    return work


def _linked(threshold: float) -> Callable:
    """Of a unit's vectors: (row, linked copies) counts and (row, least row of its part) edges of the new pairs."""

    def work(rows: pa.RecordBatch, at: tuple) -> list | None:
        n = rows.num_rows
        order = np.argsort(rows.column(6).to_numpy(), kind="stable")  # so that the least row is the least node
        own, node, mult = (rows.column(k).to_numpy()[order] for k in (5, 6, 9))
        before = _arrays(rows.column(7))[0].reshape(n, -1)[order]
        unit = _unit(_arrays(rows.column(8))[0].reshape(n, at[0]))[order]
        left, right = _sides(own, at)
        i, j = _new_pairs(unit[left] @ unit[right].T >= threshold - 1e-9, left, right, before)
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold  # the same sum for a pair wherever it meets
        i, j = i[near], j[near]
        if not len(i):
            return None
        count = np.zeros(n, np.int64)
        np.add.at(count, i, mult[j])
        np.add.at(count, j, mult[i])
        # each row points to the least one that it reaches within the unit: as many edges as rows
        label = np.arange(n)
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        hit = np.nonzero(count)[0]
        return [node[hit], count[hit], node[label[hit]]]

    return work


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs, and the components by all pairs that reach each other.
ORACLE_OP3 = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT vec_id, v FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT a AS n, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON r.n = p.a),
l AS (SELECT a, count(DISTINCT b) AS n FROM p GROUP BY 1), c AS (SELECT n, min(c) AS c FROM r GROUP BY 1)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, coalesce(c.c, e.vec_id) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN l ON l.a = e.vec_id LEFT JOIN c ON c.n = e.vec_id
"""
