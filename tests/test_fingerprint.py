"""Coarse fingerprints: known values, and both forms against each other."""

import pytest
from pyspark.sql import functions as F

from corpuskin.functions.fnv import coarse_fingerprint, coarse_fingerprint_sql

KNOWN = [
    (0, None, b"\xaa" * 256, "cc2a5f61fa914b64"),
    (0, None, b"\xbb" * 256, "c499633cd240e024"),
    (0, None, b"\xcc" * 64, "aa0f9991b663157f"),
    (0, None, b"\xee" * 16, "65dd88271133256f"),
    (0, None, b"\xdd" * 128, "e969b3195fe3bebf"),
    (0, 7, b"\xdd" * 128, "c7481e9c986a2f78"),
    (0, None, bytes(range(256)) * 2, "07580ab03ee4d0b5"),
    (0, None, b"", "e604823a249029bf"),
    (1, None, b"", "529a2cdc8ff533ac"),
]


@pytest.fixture(scope="module")
def units(spark):
    rows = [(i, k, c, bytearray(p), len(p), want) for i, (k, c, p, want) in enumerate(KNOWN)]
    rows += [(100 + n, 0, 1, bytearray(bytes((n * 7 + j) % 256 for j in range(n))), n, "") for n in (1, 63, 64, 65, 127, 128, 129, 191, 192, 193, 1000)]
    return spark.createDataFrame(rows, "i int, kind int, compression int, payload binary, length long, want string")


@pytest.mark.parametrize("form", [coarse_fingerprint, coarse_fingerprint_sql])
def test_known(units, form):
    got = units.where("i < 100").select("want", form(F.col("kind"), F.col("length"), F.col("compression"), F.col("payload")).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_forms_agree(units):
    args = [F.col(c) for c in ("kind", "length", "compression", "payload")]
    assert all(r["a"] == r["b"] for r in units.select(coarse_fingerprint(*args).alias("a"), coarse_fingerprint_sql(*args).alias("b")).collect())


def test_null_payload(spark):
    df = spark.createDataFrame([(0, 4, None, None)], "kind int, length long, compression int, payload binary")
    assert df.select(coarse_fingerprint(*[F.col(c) for c in df.columns]).alias("x")).first()["x"] is None
