"""Texts of several MB through every operator: whole results, to the last word."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskin.llm import decontaminate, langid, licenses, packing, repeats, secrets, sharding, simhash, toxicity
from tests.llm import cases

ITEM = "a benchmark item of more than ten words that stands at the very end"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(31)
    text = " ".join(cases.prose(rng, 5000) for _ in range(120))
    return f"{text} token=abcdef123456 Released under the MIT License. badword {ITEM}"


@pytest.fixture(scope="module")
def docs(spark, long_text):
    rows = [(1, long_text), (2, "a short text"), (3, long_text), (4, "x" * 3_000_000), (5, " " * 3_000_000 + "end")]
    assert len(long_text) > 2_500_000
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_groups_and_passages(docs):
    got = rows_of(simhash.near_duplicate_groups(docs))
    assert got[1]["component_id"] == got[3]["component_id"] == 1 and got[1]["fp"] == got[3]["fp"] and got[4]["component_id"] == 4
    assert sorted(rows_of(simhash.drop_near_duplicates(docs))) == [1, 2, 4, 5]
    spans = rows_of(repeats.repeated_passages(docs))
    assert [(s["start"], s["end"]) for s in spans[1]["spans"]] == [(0, spans[1]["n_words"])] and not spans[2]["spans"]


def test_scans(docs, long_text, spark):
    spans = rows_of(secrets.scan_secrets(docs))[1]["secret_spans"]
    at = long_text.index("token=")
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("assign", at, at + len("token=abcdef123456"))]
    masked = rows_of(secrets.mask_secrets(docs))
    assert masked[1]["text"] == long_text.replace("token=abcdef123456", "[secret]") and masked[4]["text"] == "x" * 3_000_000
    found = rows_of(licenses.find_licenses(docs))
    assert found[1]["labels"] == "mit" and found[1]["first_word"] == found[1]["n_words"] - len(ITEM.split()) - 3 and found[5]["n_words"] == 1
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    hits = rows_of(decontaminate.contaminated_words(docs, bench))
    n = len(decontaminate.words_of(long_text))
    assert [(x["start"], x["end"]) for x in hits[1]["hits"]] == [(n - len(ITEM.split()), n)] and hits[3]["items"] == ["7"] and not hits[2]["hits"]
    assert sorted(rows_of(decontaminate.drop_contaminated(docs, bench))) == [2, 4, 5]


def test_packing_and_shards(docs, long_text):
    got = packing.pack(docs).where("doc_id = 1").orderBy("piece").collect()
    n = len(packing.encoder(packing.default_tokenizer_path())(long_text)) + 1
    assert sum(r["length"] for r in got) == n and [r["start"] for r in got[1:]] == [r["start"] + r["length"] for r in got[:-1]]
    assert {r["length"] for r in got[1:]} == {2048}
    assert rows_of(sharding.shard_records(docs))[1]["size"] == len(long_text.encode()) + 1


def test_models(docs, spark):
    made = docs.withColumn("lang", F.when(F.col("doc_id") == 2, "bb").otherwise("aa"))
    model = langid.train(langid.training_rows(made))
    assert all(0 <= r["lang_score"] <= 1 for r in langid.with_language(docs, model).collect())
    labels = spark.createDataFrame([(1, 1), (3, 1), (2, 0), (4, 0), (5, 0)], "doc_id long, toxic int")
    rows, hashes, values = toxicity.training_rows(docs, labels)
    assert len(rows) in (0, 5)
    assert all(0 <= r["toxic_score"] <= 1 for r in toxicity.with_toxicity(docs, toxicity.train(rows, hashes, values)).collect())
