"""The pipeline's stages and the entry module; the queries with SQL against it."""

import os
import re

import pytest

import corpus_pipeline
from corpuskin.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_registered():
    import __spark_entry__

    q = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {re.match(r"op\d+_", k)[0] for k in QUERIES} and "pipeline" in q and set(QUERIES) < set(q)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), duck(SF), ORACLE_SQL[name])


def test_stages(spark):
    from corpuskin.llm.packing import default_tokenizer_path, encoder
    from tests.llm.test_decontaminate import brute
    from tests.llm.test_secrets import spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        sizes.append(len(after))
        if name == "benchmark_decontamination":
            assert set(after) == {i for i, t in before.items() if not brute(t, items)[1]}
        elif name == "secret_scan":
            assert set(after) == set(before) and not any(spans(t) for t in after.values())
            assert all(after[i] == before[i] for i in before if not spans(before[i]))
        elif name == "simhash_near_dedup":
            assert {t.lower().split().__repr__() for t in after.values()} <= {t.lower().split().__repr__() for t in before.values()}
            assert len(set(after.values())) == len(after)
    assert sizes[1] >= 0.99 * sizes[0] and sizes[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokens, sequences = {}, {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    encode = encoder(default_tokenizer_path())
    assert tokens == {i: len(encode(t or "")) + 1 for i, t in after.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.01 * sum(tokens.values()) / 2048 + 1


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns(spark):
    """Columns that are named like the operators' own come through the stages unchanged."""
    from corpuskin.llm import langid, secrets, simhash, toxicity

    own = ["_key", "_rules", "_row", "_keep", "_spans", "_id", "fp", "lang_pred", "lang_score", "lang_rejected", "toxic_score", "secret_spans", "component_id", "text2"]
    df = spark.createDataFrame([(1, "token=abcdef1 some words here", "en", *own), (2, None, None, *own)], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in own))
    model = langid.fit_language_model(spark.read.parquet(f"{SF}/documents.parquet"))
    for got in (secrets.mask_secrets(df), simhash.drop_near_duplicates(df), langid.keep_known_languages(df, model)):
        assert got.columns == df.columns
        assert got.collect() and all(r[c] == c for r in got.collect() for c in own)
    assert langid.with_language(df, model).count() == secrets.scan_secrets(df).count() == 2
    blank = toxicity.fit_toxic_model(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.with_toxicity(df, blank).count() == 2
