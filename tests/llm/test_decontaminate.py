import random
import re

import pytest

from corpuskin.llm import decontaminate as d
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, width=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        windows = [x[k : k + width] for k in range(max(1, len(x) - width + 1))] if x else []
        for win in windows:
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def items():
    made = {r[0]: r[1] for r in cases.rows()}
    long_ = made[20] or ""
    return [(1, made[11]), (2, "one two"), (3, None), (4, ""), (5, " ".join(words(made[40])[:12])), (6, made[11]), (7, "x" * 5000), (8, "a B, c"), (9, long_), (10, "emoji"), (11, "long " * 12)]


@pytest.mark.parametrize("most", [d.MOST_BITS, 64])
def test_brute_force(spark, items, most, monkeypatch):
    """Also where the filter is so small that all shingles pass it."""
    monkeypatch.setattr(d, "MOST_BITS", most)
    monkeypatch.setattr(d, "LEAST_BITS", min(most, d.LEAST_BITS))
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = d.contaminated_words(cases.docs(spark), bench).collect()
    have = sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["hits"]), r["items"]) for r in got), key=repr)
    assert have == sorted(((r[0], *brute(r[1], items)) for r in cases.rows()), key=repr)
    for r in got:
        assert all(x["end"] < y["start"] for x, y in zip(r["hits"], r["hits"][1:], strict=False))


def test_drop(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = d.drop_contaminated(cases.docs(spark), bench)
    assert kept.columns == cases.docs(spark).columns
    want = sorted(((r[0], r[1]) for r in cases.rows() if not brute(r[1], items)[1]), key=repr)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == want


def test_empty(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.contaminated_words(cases.none(spark), bench).collect() == []
    got = d.contaminated_words(cases.docs(spark), bench.limit(0)).collect()
    assert len(got) == len(cases.rows()) and not any(r["hits"] or r["items"] for r in got)
    assert d.drop_contaminated(cases.docs(spark), bench.limit(0)).count() == len(cases.rows())


@pytest.mark.parametrize("width", [1, 2, 3, 10])
def test_many_items_over_a_shuffled_input(spark, width):
    """Items drawn from the texts, at all widths; keys that are no longs, or null, or repeat."""
    rng = random.Random(width)
    texts = [cases.prose(rng, rng.randint(0, 40), ("a", "b", "c", "d")) for _ in range(80)]
    bench = []
    for i in range(120):
        w = words(rng.choice(texts))
        at = rng.randint(0, len(w))
        bench.append((f"i{i % 100}", " ".join(w[at : at + rng.randint(0, 14)])))
    made = [(None if i % 9 == 0 else f"k{i % 50}", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(made, "name string, text string").repartition(7, "text")
    got = d.contaminated_words(docs, spark.createDataFrame(bench, "item_id string, text string"), width=width, key="name").collect()
    have = sorted(((r["name"], r["n_words"], sum(x["end"] - x["start"] for x in r["hits"]), r["items"]) for r in got), key=repr)
    assert have == sorted(((k, *brute(t, bench, width)) for k, t in made), key=repr)
    with pytest.raises(ValueError):
        d.contaminated_words(docs.withColumnRenamed("name", "hits"), docs, key="hits")
