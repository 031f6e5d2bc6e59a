import math
import re

import pytest

from corpuskin.llm import licenses
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(text, templates=licenses.TEMPLATES, threshold=0.8):
    words = WORD.findall(fold(text or ""))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    best, labels = 0.0, set(base)
    for t in templates:
        want, length = set(licenses.template_tokens(t.notice)), len(licenses.template_words(t.notice))
        for i in range(len(words)):
            have = set(words[i : i + length])
            if words[i] in want and len(have & want) >= math.ceil(threshold * len(want) - 1e-9) and have >= set(t.required) and not have & set(t.never):
                labels.add(t.label)
                best = max(best, len(have & want) / len(want))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best


MORE = [
    "mit license MIT license\nMIT-License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the X)",
    "hereby granted free of charge to any person obtaining a copy of this software and documentation files",
    "permission granted",
    "license mit\nlicensed cc by nc\n4 0 by cc nc licensed",
    "general public license general public license",
]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_brute_force(spark, threshold):
    made = [*((r[0], r[1]) for r in cases.rows()), *enumerate(MORE, 1000)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = licenses.find_licenses(df, threshold=threshold)
    have = sorted((tuple(r)[:8] for r in got.collect()), key=repr)
    want = sorted(((i, *brute(t, threshold=threshold)) for i, t in made), key=repr)
    assert [(*h[:7], round(h[7], 9)) for h in have] == [(*w[:7], round(w[7], 9)) for w in want]


def test_matches_say_where(spark):
    df = spark.createDataFrame([(1, "x y\nLicensed under CC BY-NC 4.0.\ny")], "doc_id long, text string")
    (m,) = licenses.find_licenses(df).first()["matches"]
    assert (m["word"], m["label"], m["share"]) == (2, "cc-by-nc", 1.0)


def test_other_licenses_notices_are_told_apart(spark):
    """Each notice has its own label, and of other families' none; near misses have none."""
    made = [(i, t.notice) for i, t in enumerate(licenses.TEMPLATES)]
    none = ["Released under the Zlib License.", "Released under the GNU General Public License", "Released under the Apache License", "Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"]
    made += list(enumerate(none, 100))
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in licenses.find_licenses(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    also = {"lgpl": {"gpl"}, "agpl": {"gpl"}, "bsd-3": set()}  # the phrase "general public license" stands in their notices too
    for i, t in enumerate(licenses.TEMPLATES):
        assert t.label in got[i] and got[i] - {t.label} <= also.get(t.label, set()), (t, got[i])
    assert [got[i] for i in range(100, 105)] == [set(), {"gpl"}, {"apache"}, set(), set()]


def test_empty(spark):
    assert licenses.find_licenses(cases.none(spark)).collect() == []


def test_wrapped_notices(spark):
    """Each template wrapped at 40 to 80 columns, in a comment among other words, has its label; one cut apart by other words hasn't."""
    import textwrap

    made, want = [], {}
    for t in licenses.TEMPLATES:
        label, notice = t.label, t.notice
        for width in (40, 70, 80):
            lead = "other words " * 5
            text = "\n".join(" * " + x for x in textwrap.wrap(lead + notice + " and so on", width))
            made.append((len(made), text))
            want[len(made) - 1] = label
        far = notice.replace(" ", "\n" + "far apart " * 20)
        made.append((len(made), far))
    got = {r["doc_id"]: r for r in licenses.find_licenses(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    for i, label in want.items():
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, made[i]
        assert any(m["label"] == label and m["share"] == 1.0 for m in got[i]["matches"]), made[i]
    assert all(not got[i]["matches"] for i in got if i not in want)


def test_sql_finds_wrapped_notices(spark, tmp_path):
    """The query and its SQL on notices that are wrapped, cut short, mixed up, repeated in rows, and on odd texts."""
    import textwrap

    from tests.compare import assert_same, duck

    made = [r[:2] for r in cases.rows() if r[0] is not None]
    for n, t in enumerate(licenses.TEMPLATES):
        w = t.notice.split()
        made += [(1000 + 4 * n + k, "\n # ".join(textwrap.wrap(x, 50))) for k, x in enumerate((t.notice, " ".join(w[: len(w) * 9 // 10]), " ".join(w[::-1]), "a b c " + t.notice + " " + t.notice))]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(licenses.op5_license_scan(spark, str(tmp_path)), duck(str(tmp_path)), licenses.ORACLE_OP5)
