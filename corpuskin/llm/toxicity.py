"""Toxicity scores by a factorization machine over hashed terms: pairwise interactions beside linear weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskin.llm.textcols import small_batches
from corpuskin.plans.shared import materialize

#: Labelled rows that training takes at most, a documented bound: half of them of each label where there are as many.
SAMPLE_ROWS = 6000
#: Hashed terms that the model keeps: those further from independent of the label than this, in standard deviations, in as many rows at least.
LEAST_Z, LEAST_ROWS = 3.0, 3
#: One of so many sampled rows calibrates the score and teaches nothing else.
APART = 5
#: A word gives itself and its beginnings of so many bytes: insults are inflected.
PREFIXES = (4, 5, 6)
#: Bytes of words that a worker keeps the terms of, then it starts anew; longer words aren't kept.
CACHE_BYTES, CACHE_WORD = 16 << 20, 64

#: Folds A-Z and blanks ASCII marks: words are runs of ASCII letters and digits and of characters beyond ASCII.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


@dataclass(frozen=True)
class ToxicModel:
    """Bias; for each hashed term kept (``hashes``) its input value, linear weight and factor row; the logistic calibration (slope, offset) of the raw score."""

    hashes: np.ndarray
    values: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float
    offset: float


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "replace").translate(_FOLD).split())


def hashed_terms(word: bytes) -> tuple[int, ...]:
    """32-bit hashes of a word's terms: so many values that a corpus' vocabulary hardly meets the few thousand kept."""
    return (zlib.crc32(b"=" + word), *(zlib.crc32(b"^" + word[:n]) for n in PREFIXES if len(word) >= n))


def _raw(model: ToxicModel, at: np.ndarray) -> float:
    """bias + weighted sum + sum of pairwise products, which are half of (sum)^2 - sum of squares, on a damped scale."""
    x = model.values[at]
    v = model.factors[at] * x[:, None]
    s = v.sum(0)
    z = float(model.bias + model.linear[at] @ x + 0.5 * (s @ s - (v * v).sum()))
    return float(np.sign(z) * np.log1p(abs(z)))  # damped, so that texts full of evidence don't flatten the calibration


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Up to ``limit`` labelled rows as arrays of kept terms (ids, y, h), the kept terms' hashes and their input values.

    Half of the rows are of each label where there are as many, those with the smallest hashes of the key: the same ones
    whatever the partitions. Rows whose label or key is null are left out; a key that is labelled twice counts with its
    larger label, one that several rows have with its smallest text. All terms of the whole texts are counted, on the
    executors; only counts of terms to keep and the rows' kept terms reach the driver.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    marks = marks.withColumn("h", F.pmod(F.xxhash64("_id"), F.lit(1 << 40)))
    own = docs.select(F.col(key).alias("_id"), F.col(text).alias("text"))
    marks = materialize(marks.join(own.select("_id").distinct(), "_id", "left_semi"), "marks")
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect() if r["y"] in (0, 1)}
    few = min((0, 1), key=lambda y: counts.get(y, 0))
    share = {few: min(counts.get(few, 0), limit // 2)}
    share[1 - few] = min(counts.get(1 - few, 0), limit - share[few])
    drawn = [marks.where(F.col("y") == y).orderBy("h", "_id").limit(n).select("_id", "y", "h") for y, n in share.items()]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # ``limit`` rows at most
    rows = materialize(own.join(chosen, "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("h").alias("h")), "sample").select("text", "y", "h")
    fit = rows.where(F.col("h") % APART != 0)
    n = {r["y"]: r["count"] for r in fit.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    none = np.zeros(0, np.uint32)
    if not n1 or not n0:
        return pd.DataFrame({"ids": [], "y": [], "h": []}), none, none.astype(float)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, y = [distinct_terms(b.column(0)[i].as_py()) for i in range(b.num_rows)], b.column(1).to_numpy()
            flat = np.concatenate([*ids, none])
            hashes, at, often = np.unique(flat, return_inverse=True, return_counts=True)
            toxic = np.bincount(at, np.repeat(y, [len(x) for x in ids]), len(hashes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(often), pa.array(toxic)], names=["term", "n", "pos"])

    terms = fit.select("text", "y").mapInArrow(count, "term bigint, n bigint, pos bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    mean = F.col("n") / (n0 + n1)
    z = F.abs(F.col("pos") / n1 - (F.col("n") - F.col("pos")) / n0) / F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0) + 1e-12)
    kept = terms.withColumn("z", z).where((F.col("z") > LEAST_Z) & (F.col("n") >= LEAST_ROWS)).select("term", "z").toPandas().sort_values("term")
    hashes, values = kept["term"].to_numpy().astype(np.uint32), np.clip((kept["z"].to_numpy(float) - LEAST_Z) / 3, 0.1, 1.0)
    sent = spark.sparkContext.broadcast(hashes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_found(sent.value, distinct_terms(b.column(0)[i].as_py())) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([_lists(ids), b.column(1), b.column(2)], names=["ids", "y", "h"])

    got = rows.mapInArrow(place, "ids array<int>, y int, h bigint").toPandas().sort_values(["h", "y"], ignore_index=True)
    return got, hashes, values


def distinct_terms(text: str | None) -> np.ndarray:
    """The hashes of all distinct terms of a text, sorted."""
    return np.array(sorted({h for w in words(text) for h in hashed_terms(w)}), np.uint32)


def _found(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of those of ``ids`` that are kept."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(hashes, ids), len(hashes) - 1)
    return at[hashes[at] == ids]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int32)))


def train(rows: pd.DataFrame, hashes: np.ndarray, values: np.ndarray, rank: int = 4, epochs: int = 20, rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> ToxicModel:
    """AdaGrad on the logistic loss, labels weighted to count alike; a fifth of the rows calibrates the score.

    Without both labels there is nothing to learn: the model scores 0.5 for every text.
    """
    rng = np.random.default_rng(seed)
    data = [(np.asarray(x, np.int64), int(y), int(h)) for x, y, h in zip(rows["ids"], rows["y"], rows["h"], strict=True)]
    placed, held = [d[:2] for d in data if d[2] % APART], [d[:2] for d in data if not d[2] % APART]
    n1 = sum(y for _, y in placed)
    if not n1 or n1 == len(placed):
        none = np.zeros(0, np.uint32)
        return ToxicModel(none, none.astype(float), 0.0, none.astype(float), np.zeros((0, rank)), 1.0, 0.0)
    linear, factors, bias = np.zeros(len(hashes)), rng.normal(0, 0.05, (len(hashes), rank)), 0.0
    gl, gf, gb = np.full(len(hashes), 1e-2), np.full((len(hashes), rank), 1e-2), 1e-2
    weigh = {1: len(placed) / (2 * n1), 0: len(placed) / (2 * (len(placed) - n1))}
    for _ in range(epochs):
        for k in rng.permutation(len(placed)):
            at, y = placed[k]
            x = values[at]
            v = factors[at]
            s = x @ v
            z = bias + linear[at] @ x + 0.5 * (s @ s - ((v * x[:, None]) ** 2).sum())
            g = weigh[y] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if len(at):
                a = g * x + decay * linear[at]
                gl[at] += a * a
                linear[at] -= rate * a / np.sqrt(gl[at])
                a = g * (x[:, None] * s - v * (x * x)[:, None]) + decay * v
                gf[at] += a * a
                factors[at] = v - 0.3 * rate * a / np.sqrt(gf[at])
    model = ToxicModel(hashes, values, bias, linear, factors, 1.0, 0.0)
    slope, offset = _calibrate([(_raw(model, at), y) for at, y in held])
    return replace(model, slope=slope, offset=offset)


def _calibrate(scored: list[tuple[float, int]], steps: int = 300) -> tuple[float, float]:
    """Logistic calibration by Newton steps on rows that training hasn't seen, with smoothed targets (Platt, 1999)."""
    z, y = np.array([s for s, _ in scored], float), np.array([t for _, t in scored], float)
    n1, n0 = y.sum(), (1 - y).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, z.std())
    x = np.stack([z / scale, np.ones_like(z)], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - t) + 1e-3 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-6) / scale), float(w[1])


def with_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` with toxic_score (0 to 1) from all distinct terms of the whole text. Null and empty texts have no terms and get the model's score for none. A column of that name is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("toxic_score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # terms of the bounded sample
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        place = {int(h): i for i, h in enumerate(model.hashes)}
        seen: dict[bytes, tuple[int, ...]] = {}  # the kept terms of words
        held = 0
        for b in batches:
            texts, scores = b.column(b.schema.get_field_index(text)), []
            for i in range(b.num_rows):
                if held > CACHE_BYTES:
                    seen.clear()
                    held = 0
                at: set[int] = set()
                for w in words(texts[i].as_py()):
                    got = seen.get(w)
                    if got is None:
                        got = tuple(place[h] for h in hashed_terms(w) if h in place)
                        if len(w) <= CACHE_WORD:
                            seen[w] = got
                            held += 120 + len(w)
                    if got:
                        at.update(got)
                z = _raw(model, np.array(sorted(at), np.int64))
                scores.append(float(1 / (1 + np.exp(-np.clip(model.slope * z + model.offset, -500, 500)))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "toxic_score"])

    return docs.mapInArrow(run, schema)


def fit_toxic_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> ToxicModel:
    return train(*training_rows(docs, labels, key=key))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))  # a null id is in no fold, and has no label
    model = fit_toxic_model(docs, labels.where(~held))
    found = with_toxicity(docs, model)
    return found.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))
