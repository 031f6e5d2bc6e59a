import hashlib
import math
import zlib
from collections import Counter

import pytest

from corpuskin.llm.sharding import shard_records
from tests.llm import cases


def shard(key, weights):
    draw = lambda i: (int(hashlib.md5(f"{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return max(range(len(weights)), key=lambda i: (-weights[i] / math.log(draw(i)), -i))


@pytest.mark.parametrize("weights", [(1.0,) * 8, (3.0, 1.0, 2.0)])
def test_brute_force(spark, weights):
    got = shard_records(cases.docs(spark), weights).collect()
    assert len(got) == len(cases.rows())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), shard(r[0], weights), shard(r[0], (*weights, 1.0))) for r in cases.rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], len(weights)) and r["law"] == "key" for r in got)


def test_one_key_for_all(spark):
    df = spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string").repartition(7)
    got = shard_records(df).collect()
    assert sorted(r["slot"] for r in got) == list(range(500))


def test_shares_follow_weights(spark):
    df = spark.range(8000).selectExpr("id doc_id", "'x' text")
    n = Counter(r["shard"] for r in shard_records(df, (3.0, 1.0)).collect())
    assert abs(n[0] / 8000 - 0.75) < 0.03


def test_empty_and_bad(spark):
    assert shard_records(cases.none(spark)).collect() == []
    with pytest.raises(ValueError):
        shard_records(cases.none(spark), (1.0, 0.0))
