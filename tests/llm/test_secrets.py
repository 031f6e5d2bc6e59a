import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpuskin.llm.secrets import RULES, mask_secrets, op2_secret_scan, scan_secrets, span_text, trigram_clauses
from tests.llm import cases


def spans(text):
    found = []
    for rank, r in enumerate(RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), rank, f"{r.kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


MANY = [
    "token=token:abcdefgh token=secret=abcdef password:x password : 'longenough'",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "AKIA",
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18 + " xoxb-1234567890-abc",
    "apiKEY='ABCDEF' ApI_kEy=ABCDEF",
    "token = aaaaaa " * 400,
    "deadbeefdeadbeefdeadbeef token=deadbeefdeadbeefdeadbeef",
    "AIza" + "b-C_" * 9 + " sk_live_" + "a1" * 12 + " rk_live_" + "Z" * 20 + " glpat-" + "x_" * 10 + " npm_" + "q" * 36,
    "AIza" + "b" * 34 + " sk_live_short glpat-" + "x" * 19 + " npm_" + "q" * 35 + " pk_live_" + "a" * 24,
    "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12 + ". eyJhbGciOi.x.y",
]


def test_brute_force(spark):
    made = [*((r[0], r[1]) for r in cases.rows()), *enumerate(MANY, 1000)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = scan_secrets(df).select("doc_id", "text", span_text(F.col("secret_spans")).alias("s")).collect()
    assert len(got) == len(made)
    for r in got:
        assert r["s"] == ",".join(spans(r["text"])), r["text"]


def test_query_columns(spark, tmp_path):
    cases.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_secret_scan(spark, str(tmp_path)).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (11, 12)}
    for i, t, *_ in cases.rows():
        if i in (11, 12):
            continue
        base = [s for s in spans(t) if s.split(":")[0] in ("assign", "access", "hex")]
        assert by[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert by[i]["n_assign"] == sum(s.startswith("assign") for s in base)


def test_mask_and_empty(spark):
    df = spark.createDataFrame([(1, "a token=abcdef1 b password=abcdef2", 3), (2, None, 0), (3, "none", 4)], "doc_id long, text string, n_chars int")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in mask_secrets(df, length="n_chars").collect()}
    assert got == {1: ("a [secret] b [secret]", 21), 2: (None, None), 3: ("none", 4)}
    assert scan_secrets(cases.none(spark)).collect() == []


@pytest.mark.parametrize("rule", RULES, ids=lambda r: r.kind)
def test_clauses_hold_for_matches(rule):
    clauses = trigram_clauses(rule.pattern)
    for text in MANY:
        for m in re.finditer(rule.pattern, text):
            assert clauses is None or any(all(t in m.group().lower() for t in c) for c in clauses)


def test_rule_without_trigrams():
    assert trigram_clauses(r"[0-9]+") is None
    assert trigram_clauses(r"ab|cdef") is None
    assert trigram_clauses(r"abc(d|e)") == [frozenset({"abc", "bcd"}), frozenset({"abc", "bce"})]


def test_mask_brute_force(spark):
    """Masked texts against a plain loop: overlaps, many matches, characters beyond the first plane, a text of several MB."""
    long = "é😀 token=abcdef12 filler words " * 60000
    made = [*((r[0], r[1]) for r in cases.rows()), *enumerate([*MANY, "😀token=abcdef😀AKIA" + "Z" * 20 + "é", "token=" + "a" * 30 + "token=bbbbbbbb"], 1000), (3000, long)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)

    def masked(text):
        spans = []
        for r in RULES:
            spans += [(m.start(), m.end()) for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least]
        out, at = [], 0
        for s, e in sorted(spans):
            if s >= at:
                out += [text[at:s], "[secret]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    got = sorted(((r["doc_id"], r["text"]) for r in mask_secrets(df).collect()), key=repr)
    assert got == sorted(((i, None if t is None else masked(t)) for i, t in made), key=repr)


def test_sql(spark, tmp_path):
    """All kinds, and near misses, against the SQL."""
    from corpuskin.llm.secrets import ORACLE_OP2
    from tests.compare import assert_same, duck

    made = [*((r[0], r[1]) for r in cases.rows() if r[0] is not None), *enumerate(MANY, 1000)]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(op2_secret_scan(spark, str(tmp_path)), duck(str(tmp_path)), ORACLE_OP2)
