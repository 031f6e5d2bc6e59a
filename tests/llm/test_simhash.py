import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from corpuskin.llm import simhash
from corpuskin.plans import shared
from tests.llm import cases


def plain_print(text, width=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("width", [3, 5])
def test_fingerprints(width, monkeypatch):
    for r in cases.rows():
        assert simhash.fingerprint(r[1], width) == plain_print(r[1], width)
    monkeypatch.setattr(simhash, "PIECE_BYTES", 7)
    text = "some words and a verylongword   then\nmore words again and again x y z"
    assert list(w for p in simhash.word_pieces(text.encode(), 7) for w in p) == text.encode().split()


def test_same_hash_as_the_engine(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a b c",), ("é",)], "s string").select(F.xxhash64("s").alias("h"), "s").collect()
    assert all(r["h"] % 2**64 == xxhash.xxh64_intdigest(r["s"].encode(), 42) for r in got)


def groups(prints):
    """component of each (id, print), by all pairs."""
    ids = sorted({i for i, _ in prints if i is not None})
    by = {}
    for i, p in prints:
        by.setdefault(p, []).append(i)
    distinct = list(by)
    comp = {p: p for p in distinct}

    def root(p):
        while comp[p] != p:
            p = comp[p]
        return p

    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= 3:
                comp[root(distinct[a])] = root(distinct[b])
    least = {}
    for p, members in by.items():
        known = [m for m in members if m is not None]
        least[root(p)] = min([least.get(root(p), float("inf")), *known])
    assert ids
    return {p: (None if least[root(p)] == float("inf") else least[root(p)]) for p in distinct}


def test_groups_by_brute_force(spark):
    got = simhash.near_duplicate_groups(cases.docs(spark)).collect()
    want = groups([(r[0], plain_print(r[1])) for r in cases.rows()])
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == Counter((r[0], plain_print(r[1]), want[plain_print(r[1])]) for r in cases.rows())


@pytest.mark.parametrize("hot", [10**6, 5])
def test_links_by_brute_force(spark, hot):
    rng = random.Random(2)
    made = set()
    for base in (rng.getrandbits(64) for _ in range(3)):
        for low, high, n in ((0, 64, 80), (0, 32, 60), (32, 64, 60)):
            for _ in range(n):
                x = base
                for b in rng.sample(range(low, high), rng.randint(0, 6)):
                    x ^= 1 << b
                made.add(x)
    u = np.array(sorted(made), np.uint64)
    signed = u.view(np.int64)
    want = {tuple(sorted((int(signed[i]), int(signed[j])), reverse=True)) for i in range(len(u)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= 3}
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    got = [(r["src"], r["dst"]) for r in simhash.links(df, 3, hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_links_of_crowded_keys_in_small_plans(spark):
    """The splits of crowded keys are queries of their own: what one query's plan holds doesn't grow with them."""
    rows = [(x | y << 20,) for x in range(40) for y in range(3)]
    found = simhash.links(spark.createDataFrame(rows, "fp long"), 3, 5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6


@pytest.mark.parametrize("hot", [10**6, 5])
def test_variants_are_not_broadcast_whatever_the_threshold(spark, monkeypatch, hot):
    """Spark takes the 66 variants of a fingerprint for two rows: by its threshold it would build them all on the driver."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    plans = []
    write = shared.materialize

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(shared, "small_broadcasts", lambda _: None)
    monkeypatch.setattr(simhash, "materialize", noted)
    try:
        spark.conf.set(name, "10m")
        rows = [(x | y << 20,) for x in range(40) for y in range(3)]
        found = simhash.links(spark.createDataFrame(rows, "fp long"), 3, hot)
        plans.append(("links", found._jdf.queryExecution().optimizedPlan().toString()))
        joins = [line for label, plan in plans if label in ("links", "hot-pairs") for line in plan.splitlines() if "Join Inner" in line]
        assert joins and all("strategy=merge" in line for line in joins), joins
    finally:
        spark.conf.set(name, before)


def test_open_pairs_of_bands_are_not_broadcast(spark, monkeypatch):
    """A node's bands stand in each of its rows: files of such rows are far smaller than what the driver would build of them."""
    plans = []
    write = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, label))
    simhash.near_copies(spark.createDataFrame([(i, f"a b c d e f g h {i % 3}") for i in range(6)], "doc_id long, text string"), "doc_id")
    last = [plan for label, plan in plans if label == "pairs"][-1]
    assert "strategy=merge" in last


def test_drop_keeps_one(spark):
    kept = simhash.drop_near_duplicates(cases.docs(spark))
    assert kept.columns == cases.docs(spark).columns
    got = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    made = [(r[0], r[1]) for r in cases.rows()]
    least = {}
    comp = groups([(r[0], plain_print(r[1], 5)) for r in made])
    for i, t in made:
        c = plain_print(t, 5)
        root = min(p for p in comp if comp[p] == comp[c] and comp[c] is not None) if comp[c] is not None else c
        least[root] = min(least.get(root, (True, 0)), (i is None, i if i is not None else 0))
    assert len(got) == len(set(got)) == len(least)
    assert {(i is None, i or 0) for i, _ in got} == set(least.values())
    assert got.count((11, made[11][1])) == 1 and (12, made[12][1]) not in got and (12, "another text with the same id") in got


def test_empty(spark):
    assert simhash.near_duplicate_groups(cases.none(spark)).collect() == []
    assert simhash.drop_near_duplicates(cases.none(spark)).collect() == []


def test_several_prints(spark):
    """Groups over several fingerprints are the components of all pairs that any of them links."""
    rng = random.Random(6)
    base = [cases.prose(rng, 150).split() for _ in range(8)]
    made = []
    for i in range(120):
        w = list(base[i % 8])
        for k in rng.sample(range(len(w)), rng.randint(0, 6)):
            w[k] = cases.prose(rng, 1)
        made.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(spark.createDataFrame(made, "doc_id long, text string"), width=5, prints=3).collect()}
    fps = [simhash.fingerprints(t, 5, 3) for _, t in made]
    comp = list(range(len(made)))
    for _ in made:
        for a in range(len(made)):
            for b in range(a):
                if any((x ^ y).bit_count() <= 3 for x, y in zip(fps[a], fps[b], strict=True)):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == dict(enumerate(comp)) and len(set(comp)) > 8
    assert fps[0][0] == simhash.fingerprint(made[0][1], 5) and len(set(fps[0])) == 3


def plain_set(text, width=5):
    words = text.lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def similar_pairs(rng, n=150):
    """Texts of which each two in turn have a Jaccard similarity of five-word shingles just over 0.8."""
    made = []
    for _ in range(n):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(250, 450))]
        a, changed, last = " ".join(w), list(w), w
        for k in rng.sample(range(len(w)), len(w)):
            changed[k] = f"v{rng.randrange(10**6)}"
            x, y = plain_set(a), plain_set(" ".join(changed))
            if len(x & y) < 0.8 * len(x | y):
                break
            last = list(changed)
        made += [a, " ".join(last)]
    return made


def test_drop_finds_pairs_at_the_threshold(spark):
    texts = similar_pairs(random.Random(4))
    sims = [len(plain_set(a) & plain_set(b)) / len(plain_set(a) | plain_set(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert min(sims) >= 0.8 and sum(sims) / len(sims) < 0.82
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept >= set(range(0, len(texts), 2))
    print("recall at 0.8:", 1 - len(kept & set(range(1, len(texts), 2))) / len(sims))
    assert len(kept & set(range(1, len(texts), 2))) <= 0.01 * len(sims)


def test_drop_needs_more_than_a_repeated_line(spark):
    """A line repeated a hundred times decides the fingerprints of texts that share nothing else."""
    rng = random.Random(8)
    line = " ".join(f"line{i}" for i in range(11)) + "\n"
    own = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1000)) for _ in range(3)]
    made = list(enumerate(line * 100 + t for t in own))
    a, b = (simhash.fingerprints(t, 5, 4) for _, t in made[:2])
    assert any((x ^ y).bit_count() <= 3 for x, y in zip(a, b, strict=True))
    kept = simhash.drop_near_duplicates(spark.createDataFrame([*made, (3, made[0][1] + " end")], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == {0, 1, 2}


def test_drop_links_by_brute_force(spark):
    """Chains of edits: the components of all pairs at 0.8 or more, also where a band's least node is none of the two."""
    rng = random.Random(12)
    made = []
    for _ in range(6):
        w = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(15):
            v = list(w)
            for k in rng.sample(range(len(v)), rng.randint(0, 8)):
                v[k] = f"v{rng.randrange(10**6)}"
            made.append(" ".join(v))
    sets = [plain_set(t) for t in made]
    comp = list(range(len(made)))
    for a in range(len(made)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((comp[a], comp[b]))
                comp = [lo if c == hi else c for c in comp]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), "doc_id").collect()}
    assert got == dict(enumerate(comp)) and 6 < len(set(comp)) < len(made)
