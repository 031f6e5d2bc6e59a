"""Language identification and toxicity: accuracy on rows that training hasn't seen, and odd inputs."""

import math
import os
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuskin.llm import langid, toxicity
from tests.llm import cases

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op8_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all() and got["rejected"].mean() < 0.01
    kept = langid.keep_known_languages(docs, langid.fit_language_model(docs))
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def sample(texts):
    return pd.DataFrame([(lang, i, [langid._packed(*b) for b in langid.bags_of(t, i)]) for i, (lang, t) in enumerate(texts)], columns=["lang", "h", "bags"])


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(1)
    return langid.train(sample([(lang, cases.prose(rng, 100, s)) for _ in range(60) for lang, s in (("aa", ("ba", "de", "fo")), ("bb", ("ki", "lu", "mo")))]))


def plain_language(model, text):
    """(probabilities, subwords) by a loop over every run of every word."""
    words = text.lower().encode().translate(langid._BLANK).split()
    total, n = np.zeros(model.table.shape[1]), 0
    for w in words:
        marked = b"<" + w + b">"
        ids = [langid.bucket(marked[i : i + k]) for k in langid.RUNS for i in range(len(marked) - k + 1)] + [zlib.crc32(w) % langid.BUCKETS]
        for i in ids:
            total += model.table[i]
        n += len(ids)
    z = total / n if n else total
    z = ((z if model.out is None else z @ model.out) + model.bias) / model.heat
    p = np.exp(z - z.max())
    return p / p.sum(), n


def test_language_scores_by_a_plain_loop(languages):
    many = langid.train(sample([(f"l{k:02}", cases.prose(random.Random(k), 30)) for k in range(20) for _ in range(3)]), epochs=1)
    assert languages.out is None and many.out is not None
    for model in (languages, many):
        score = langid.scorer(model)
        for text in [r[1] for r in cases.rows() if langid.has_letter(r[1])] + ["w" * 300_000 + " é 中文 ß x"]:
            got, n = score(text)
            want, m = plain_language(model, text)
            assert n == m and np.allclose(got, want, atol=1e-6)


def test_bags_count_every_subword():
    text = "one two one é " + "long" * 30
    ids, often = langid.bag(langid.words_of(text))
    want = {}
    for w in langid.words_of(text):
        marked = b"<" + w + b">"
        for i in [langid.bucket(marked[i : i + k]) for k in langid.RUNS for i in range(len(marked) - k + 1)] + [langid.word_bucket(w)]:
            want[i] = want.get(i, 0) + 1
    assert dict(zip(ids.tolist(), often.tolist(), strict=True)) == want


def test_whole_texts_teach(spark):
    """Words anywhere in a long text reach the model's training."""
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(17576))
    got = langid.training_rows(spark.createDataFrame([(1, text, "xx")], "doc_id long, text string, lang string"))
    ids, part, n = langid._unpacked(got["bags"][0][0])
    assert {langid.word_bucket(w) for w in langid.words_of(text)} <= set(ids.tolist()) and n > 17576 * 5


def test_many_languages(spark):
    df = spark.range(1800).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.chr(97 + F.col("id") % 26)).alias("text"), F.concat(F.lit("l"), F.col("id") % 600).alias("lang"))
    got = langid.training_rows(df)
    assert got["lang"].nunique() == 600 and len(got) == 1800
    assert len(langid.train(got.groupby("lang").head(1), epochs=1).langs) == 600
    assert len(langid.training_rows(df, 700)) == 600


def test_language_of_odd_texts(spark, languages):
    got = langid.with_language(cases.docs(spark), languages).select("doc_id", "text", "lang_pred", "lang_score", "lang_rejected").collect()
    assert len(got) == len(cases.rows())
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1
        assert letters or r["lang_rejected"]
    assert langid.with_language(cases.none(spark), languages).collect() == []


def test_language_scores(languages):
    score = langid.scorer(languages)
    assert score("badefo fodeba")[0][0] > 0.9 and score("kilumo moki")[0][1] > 0.9 and score(None) is None and score("12 !?") is None
    assert abs(score("badefo" * 5000)[0].sum() - 1) < 1e-9


def test_other_key_names_and_null_keys(spark):
    df = spark.createDataFrame([(None, "never learned", "zz"), *((i, f"text {i}", ("en", "de")[i % 2]) for i in range(40))], "k long, t string, l string")
    model = langid.fit_language_model(df, "k", "t", "l")
    assert set(model.langs) == {"en", "de"}
    assert df.select(langid.fold("k", 4).alias("f")).where("f < 0").count() == 1


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = langid.fit_language_model(df)
    assert [r["lang_pred"] for r in langid.with_language(df, model).collect()] == ["und"]


def test_sample_is_bounded_and_even(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 10 == 0, "xx").otherwise("yy").alias("lang"))
    got = langid.training_rows(df, 200)
    assert got.groupby("lang").size().to_dict() == {"xx": 100, "yy": 100}
    assert set(got["h"]) == set(langid.training_rows(df.repartition(9), 200)["h"])


@tables
def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    hit = got["predicted"] == 1
    assert (got["toxic"][hit] == 1).mean() > 0.95 and hit[got["toxic"] == 1].mean() > 0.75
    assert ((got["score"] >= 0.7) == hit).all() and got["score"].between(0, 1).all()


def test_toxic_sample_is_bounded_and_whole(spark):
    """``limit`` rows are ``limit`` rows, repeated ids too; all terms of long texts are seen."""
    filler = lambda i: " ".join(f"t{j}x{i % 7}" for j in range(12000))
    made = [(i, ("zzzmark " if i % 2 else "") + (filler(i) if i < 30 else f"short {i}")) for i in range(200)]
    docs = spark.createDataFrame(made + made[:50], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows, hashes, values = toxicity.training_rows(docs, labels, 120)
    assert len(rows) == 120 and rows["y"].sum() == 60 and len(hashes) == len(values)
    rows, hashes, _ = toxicity.training_rows(docs, labels)
    assert len(rows) == 200 and set(toxicity.hashed_terms(b"zzzmark")) <= set(hashes.tolist())
    at = {int(x) for x in toxicity.hashed_terms(b"zzzmark")}
    for (_, t), y in zip(made, [i % 2 for i in range(200)], strict=True):
        assert (at <= set(toxicity.distinct_terms(t).tolist())) == bool(y)
    assert len(toxicity.distinct_terms(filler(1))) > 12000


def test_toxicity_by_a_plain_loop(spark):
    """Scores of all texts against the sum over every pair of terms."""
    made = toxic_rows(300)
    docs = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")
    model = toxicity.fit_toxic_model(docs, spark.createDataFrame([(r[0], r[2]) for r in made], "doc_id long, toxic int"))
    place = {int(h): i for i, h in enumerate(model.hashes)}
    for r in toxicity.with_toxicity(docs, model).collect():
        at = sorted({place[h] for w in r["text"].encode().translate(toxicity._FOLD).split() for h in toxicity.hashed_terms(w) if h in place})
        z = model.bias
        for n, i in enumerate(at):
            z += model.linear[i] * model.values[i]
            for j in at[:n]:
                z += float(model.factors[i] @ model.factors[j]) * model.values[i] * model.values[j]
        z = math.copysign(math.log1p(abs(z)), z)
        assert abs(r["toxic_score"] - 1 / (1 + math.exp(-(model.slope * z + model.offset)))) < 1e-9


def toxic_rows(n=600):
    """Toxic only where two words meet: neither word says so alone."""
    rng = random.Random(2)
    out = []
    for i in range(n):
        a, b = i % 2, i // 2 % 2
        text = " ".join([cases.prose(rng, 5), "badword" if a else "", "people" if b else "", cases.prose(rng, 5)])
        out.append((i, text, int(a and b)))
    return out


def test_pairs_of_words(spark):
    made = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in made], "doc_id long, toxic int")
    model = toxicity.fit_toxic_model(docs.where("doc_id < 400"), labels.where("doc_id < 400"))
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.with_toxicity(docs.where("doc_id >= 400"), model).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in made if i >= 400)
    assert right >= 0.97 * len(got)


def test_toxicity_of_odd_texts(spark):
    made = toxic_rows(200)
    docs = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in made] + [(1, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxic_model(docs, labels)
    got = toxicity.with_toxicity(cases.docs(spark), model).select("toxic_score").collect()
    assert len(got) == len(cases.rows()) and all(0 <= r["toxic_score"] <= 1 for r in got)
    assert toxicity.with_toxicity(cases.none(spark), model).collect() == []
    blank = toxicity.fit_toxic_model(docs, labels.limit(0))
    assert {r["toxic_score"] for r in toxicity.with_toxicity(docs, blank).collect()} == {0.5}
