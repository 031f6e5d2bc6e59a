import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskin.llm import vectors as v


def brute(ids, x, threshold=0.95):
    u = v._unit(x)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    comp = {i: i for i in ids}
    for _ in ids:
        for a in range(len(ids)):
            comp[ids[a]] = min([comp[ids[a]], *(comp[ids[b]] for b in np.nonzero(near[a])[0])])
    return {i: (int(near[a].sum()), comp[i]) for a, i in enumerate(ids)}


@pytest.mark.parametrize("block", [1024, 9])
def test_brute_force(spark, block):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(12, 64))
    x = np.concatenate([c[rng.integers(0, 12, 200)] + rng.normal(0, 0.1, (200, 64)), rng.normal(size=(100, 64))])
    x = np.concatenate([x, x[:30], 3 * x[:5]])
    ids = [int(i) for i in rng.permutation(len(x)) + 50]
    df = spark.createDataFrame([(i, [float(a) for a in r], 1, 2) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, n_links int, component_id int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in v.near_vectors(df, block=block).collect()}
    assert got == brute(ids, x)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    pairs = []
    for _ in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        pairs += [a, 0.952 * a + np.sqrt(1 - 0.952**2) * b]
    df = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(pairs)], "vec_id long, embedding array<double>")
    assert sum(r["n_links"] > 0 for r in v.near_vectors(df).collect()) >= 0.98 * len(pairs)


def test_vectors_without_a_direction(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [inf, 1.0]), (11, [1e300, 0.0]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in v.near_vectors(df).collect()}
    assert got == {**{i: (0, i, True) for i in (1, 2, 3, 4, 5, 9, 10, 12)}, 6: (3, 6, True), 7: (3, 6, False), 8: (3, 6, False), 11: (3, 6, False)}


@pytest.mark.parametrize("dim", [64, 100])
def test_estimates_are_unbiased_and_bounded(dim):
    """Estimates from the stored bits alone: no bias, errors as large as they say, and near pairs are never ruled out."""
    rng = np.random.default_rng(1)
    a, b = v._unit(rng.normal(size=(2000, dim))), rng.normal(size=(2000, dim))
    b = v._unit(a + rng.choice([0.2, 1, 3], (2000, 1)) * v._unit(b))
    true = (a * b).sum(1)
    est, sd = np.zeros(2000), np.zeros(2000)
    near = np.zeros(2000, bool)
    for k in range(2000):
        ca, cb = v.Codes.of(a[k : k + 1]), v.Codes.of(b[k : k + 1])
        e, s = ca.bounds(cb)
        est[k], sd[k], near[k] = e[0, 0], s[0, 0], ca.maybe_near(cb, 0.95)[0, 0]
    assert abs((est - true).mean()) < 0.01
    assert 0.5 < ((est - true) / sd).std() < 1.2
    assert near[true >= 0.95].all() and (true >= 0.95).sum() > 100 and not near[true < 0.2].any()
    assert v.Codes.of(a).code.nbytes == 2000 * 8 * -(-dim // 64)


@pytest.mark.parametrize("kind", ["int", "string", "long"])
def test_kinds_of_keys_and_null_ones(spark, kind):
    rows = [("3", [1.0, 0.0]), (None, [1.0, 0.001]), ("2", [1.0, 0.002]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), ("5", [-1.0, 0.0]), (None, None)]
    df = spark.createDataFrame(rows, "k string, embedding array<double>").withColumn("vec_id", F.col("k").cast(kind))
    got = sorted(((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in v.near_vectors(df).collect()))
    assert got == sorted([("3", 2, "2", False), ("None", 2, "2", False), ("2", 2, "2", True), ("None", 1, "None", True), ("None", 1, "None", True), ("5", 0, "5", True), ("None", 0, "None", True)])


def test_empty(spark):
    assert v.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
