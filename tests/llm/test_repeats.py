from collections import Counter

import numpy as np
import pytest

from corpuskin.llm import repeats
from tests.llm import cases


def words(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()


def brute(made, least):
    counts = Counter(tuple(words(t)[i : i + least]) for _, t in made for i in range(len(words(t)) - least + 1))
    out = []
    for k, t in made:
        w, spans = words(t), []
        for i in range(len(w) - least + 1):
            if counts[tuple(w[i : i + least])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        out.append((k, len(w), [tuple(s) for s in spans]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "seed"), [(50, 16), (8, 3), (5, 5), (2, 1)])
def test_brute_force(spark, least, seed):
    made = [(r[0], r[1]) for r in cases.rows()]
    got = repeats.repeated_passages(cases.docs(spark), least=least, seed=seed).collect()
    assert sorted(((r["doc_id"], r["n_words"], [(x["start"], x["end"]) for x in r["spans"]]) for r in got), key=repr) == brute(made, least)


def test_hashes_of_runs():
    w = repeats.word_hashes(" ".join(f"w{i % 7}" for i in range(40)))
    runs = repeats.Runs(w)
    h = runs.hashes(np.arange(31), 10)
    for i in range(31):
        for j in range(31):
            assert (h[i] == h[j]) == (w[i : i + 10].tolist() == w[j : j + 10].tolist())


def test_empty_and_bad(spark):
    assert repeats.repeated_passages(cases.none(spark)).collect() == []
    with pytest.raises(ValueError):
        repeats.repeated_passages(cases.none(spark), least=5, seed=6)
