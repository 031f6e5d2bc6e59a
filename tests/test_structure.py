"""Profiles, corpus statistics, structural scores, archetypes, shared runs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskin.functions import labels
from corpuskin.operators import archetype as at
from corpuskin.operators import archive, corpus, reports, structural
from corpuskin.operators import profile as pr

IFDS = "file_id long, ifd_index int, width int, height int, compression int, tile_width int, tile_height int, unit_count int, role string, description string"


def ifds(spark, rows):
    return spark.createDataFrame(rows, IFDS)


def simple(file_id, n, text, compression=7, width=1000):
    return [(file_id, i, width, 800, compression, 256, 256, 4, None, text if i == 0 else None) for i in range(n)]


def test_tokens(spark):
    df = spark.createDataFrame([("Aperio|AppMag = 20|MPP = 0.4952",), ("Aperio Image Library v11.2.1|AppMag = 20|MPP = 0.4952|é x-1",), ("",), (None,)], "t string")
    got = [r["x"] for r in df.select(labels.description_tokens(F.col("t")).alias("x")).collect()]
    assert got[0] == ["aperio", "appmag", "mpp"]
    assert got[1] == ["aperio", "appmag", "image", "library", "mpp", "v1121", "x1", "é"]
    assert got[2] == [] and got[3] is None


@pytest.mark.parametrize(
    ("strip", "kind", "text", "role"),
    [(False, 0, None, None), (True, 0, None, "thumbnail"), (True, 1, "label", "label"), (True, 1, "macro", "macro"), (True, None, "Aperio…\r\nlabel", "label"), (True, None, "some text", None), (False, None, "label", None)],
)
def test_roles(spark, strip, kind, text, role):
    from corpuskin.sources.slides import section_role

    df = spark.createDataFrame([(strip, kind, text)], "s boolean, k int, t string")
    assert df.select(pr.detect_role(F.col("s"), F.col("k"), F.col("t")).alias("r")).first()["r"] == role
    assert section_role(strip, kind, text) == role


def test_label_and_macro(spark):
    strip = lambda f, i, w, h, role: (f, i, w, h, 7, None, None, 1, role, None)
    rows = [strip(0, 0, 1280, 431, None), strip(0, 1, 387, 463, None), strip(1, 0, 9, 9, "macro"), strip(1, 1, 9, 9, None), strip(2, 0, 9, 9, None), strip(3, 0, 5, 5, None), strip(3, 1, 5, 5, None)]
    got = {(r["file_id"], r["ifd_index"]): r["role"] for r in pr.resolve_label_macro(ifds(spark, rows)).collect()}
    assert got == {(0, 0): "macro", (0, 1): "label", (1, 0): "macro", (1, 1): "label", (2, 0): None, (3, 0): "label", (3, 1): "macro"}


def test_mode_ties_take_the_largest(spark):
    d = spark.createDataFrame([(0, "width", "9", 2), (0, "width", "10", 2), (0, "width", None, 1)], "position int, field string, value string, n_files long")
    assert corpus.position_modes(d).first()["value"] == "10"
    assert [r["value"] for r in corpus.top_values(d, 2).orderBy("rank").collect()] == ["9", "10"]
    assert corpus.top_values(d, 2).first()["more"] == 1


def pair(spark, a, b):
    return structural.score_profiles(pr.build_profiles(ifds(spark, a + b))).first()


def test_structural_scores(spark):
    same = pair(spark, simple(0, 3, "foo|bar"), simple(1, 3, "foo|bar"))
    assert same["score"] == 1.0
    assert pair(spark, simple(0, 3, "foo"), simple(1, 4, "foo"))["ifd_count_score"] == 0.5
    assert pair(spark, simple(0, 1, "foo"), simple(1, 1, "foo", compression=1))["structure_score"] == pytest.approx(0.6)
    assert pair(spark, simple(0, 1, "foo"), simple(1, 1, "foo", compression=None))["structure_score"] == pytest.approx(0.6)
    assert pair(spark, simple(0, 1, "x1"), simple(1, 1, "x1", width=1200))["structure_score"] == pytest.approx(1.0)
    assert pair(spark, simple(0, 1, "x1"), simple(1, 1, "x1", width=1300))["structure_score"] == pytest.approx(0.7)
    assert pair(spark, simple(0, 1, None), simple(1, 1, None))["token_score"] == 1.0
    assert pair(spark, simple(0, 1, "foo|bar"), simple(1, 1, "foo|baz"))["token_score"] == pytest.approx(1 / 3)


def made_of(spark, seed, files):
    rng = random.Random(seed)
    side = lambda: rng.choice([None, 0, 1, 80, 100, 101, 125, 126, 1000])
    words = lambda: "|".join(rng.sample(["aa", "bb", "cc", "dd", "ee"], rng.randint(0, 5)))
    rows = [(f, i, side(), side(), rng.choice([None, 1, 7]), 256, 256, 4, None, words()) for f in range(files) for i in range(rng.randint(1, 5))]
    return pr.build_profiles(ifds(spark, rows))


def test_scores_are_those_of_the_expressions(spark, monkeypatch):
    monkeypatch.setattr(structural, "OUT_ROWS", 50)
    profiles = made_of(spark, 5, 70)
    none = profiles.where("file_id = 0").select(F.lit(-1).cast("long").alias("file_id"), F.lit(0).cast("long").alias("ifd_count"), F.slice("ifds", 1, 0).alias("ifds"), F.slice("description_tokens", 1, 0).alias("description_tokens"), "description_preamble")
    profiles = profiles.unionByName(none).cache()
    a, b = (profiles.select(*[F.col(c).alias(f"{c}_{k}") for c in ("file_id", "ifd_count", "ifds", "description_tokens")]) for k in "ab")
    both = a.crossJoin(b).where("file_id_a < file_id_b")
    shared = F.least("ifd_count_a", "ifd_count_b").cast("int")
    agree = F.zip_with(F.slice("ifds_a", F.lit(1), shared), F.slice("ifds_b", F.lit(1), shared), structural.position_agreement)
    structure = F.when(shared == 0, F.lit(0.0)).otherwise(F.aggregate(agree, F.lit(0.0), lambda s, x: s + x) / shared)
    want = {(r[0], r[1]): (r[2], r[3]) for r in both.select("file_id_a", "file_id_b", structure, labels.jaccard(F.col("description_tokens_a"), F.col("description_tokens_b"))).collect()}
    found = structural.score_profiles(profiles).collect()
    assert {(r["a"], r["b"]): (r["structure_score"], r["token_score"]) for r in found} == want and len(found) == 71 * 70 // 2
    best = sorted(found, key=lambda r: (-r["score"], r["a"], r["b"]))
    for n, least in ((1, None), (40, 0.6), (3000, 0.5)):
        assert structural.best_profile_pairs(profiles, n, least).collect() == [r for r in best if r["score"] >= (least or 0)][:n]


def test_the_best_pairs_are_picked_where_they_are_scored(spark):
    profiles = made_of(spark, 6, 400)
    assert structural._scored(profiles, 3, 0.6).count() <= 36 * 3  # of each two of 8 blocks
    assert structural._scored(profiles, least=0.6).count() > 1000


def test_each_two_blocks_are_a_task(spark):
    scored = structural._scored(made_of(spark, 6, 400))
    rows = [r["count"] for r in scored.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) == 36 and sum(rows) == 400 * 399 // 2


def test_sizes_match_by_integers_as_by_quotients():
    values = [None, 0, 1, 4, 5, 6, 79, 80, 81, 99, 100, 101, 125, 126, (1 << 31) - 1, 1717986917, 1717986918]
    for more, small in (([], True), ([-3], False), ([1 << 31, 5 << 29], False)):
        sizes = structural._Sizes(pa.array(values + more, pa.int64()))
        every = np.arange(len(values + more))
        assert sizes.small == small
        assert (sizes.match(every, every) == structural._matches(sizes.all[:, None], sizes.all)).all()


def test_json_of_all_pairs_is_that_of_the_scores(spark):
    profiles = made_of(spark, 7, 60)
    names = spark.createDataFrame([(f, None if f == 7 else "x" * (f % 4) + 'é"\\\n' * (f % 3)) for f in range(60) if f != 5], "file_id long, name string").cache()
    want = reports.pair_json(structural.score_profiles(profiles), names)
    got = reports.all_pairs_json(profiles, names)
    assert got.columns == want.columns
    rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == rows and len(rows) == 59 * 58 // 2


def test_half_up_is_that_of_spark(spark):
    rng = random.Random(9)
    values = [k / n for n in (1, 3, 32, 160, 800, 4000, 20000, 200000, 2000000) for k in {0, n, *(rng.randint(0, n) for _ in range(200))}]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for n in (4, 6):
        want = [int(r[0] * 10**n) for r in df.select(F.round("x", n).cast(f"decimal(9,{n})")).collect()]
        assert reports._half_up(np.array(values), n).tolist() == want


def test_names_are_joined_before_pairs_are_made(spark):
    from corpuskin.plans.queries import QUERIES

    plan = QUERIES["pair_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and plan.index("MapInArrow") < plan.index("Join")


def test_json_of_all_pairs_deals_tokens_as_small_numbers(spark, monkeypatch):
    """A file goes to a task for each block: its common tokens go as their places, not as hashes that don't compress."""
    taken = []
    rows_of = structural.scored_rows
    monkeypatch.setattr(structural, "scored_rows", lambda p, *a, **b: taken.append(p) or rows_of(p, *a, **b))
    rows = simple(0, 2, "aa|bb|cc") + simple(1, 2, "aa|bb|dd") + simple(2, 3, None)
    names = spark.createDataFrame([(i, f"f{i}") for i in range(3)], "file_id long, name string")
    assert reports.all_pairs_json(pr.build_profiles(ifds(spark, rows)), names).count() == 3
    got = {r["file_id"]: r["t"] for r in taken[0].select("file_id", "t").collect()}
    assert [sum(0 <= t < 2 for t in got[i]) for i in range(3)] == [2, 2, 0] and [len(got[i]) for i in range(3)] == [3, 3, 0]


def test_signature(spark):
    rows = [(0, 0, 100, 80, 7, 64, 64, 1, None, None), (0, 1, 50, 40, None, None, None, 1, None, None)]
    assert pr.structural_signature(pr.build_profiles(ifds(spark, rows))).first()["signature"] == "n=2 [0:100x80/c=7/tiled=64x64] [1:50x40/c=?/strip]"


def test_archetypes_by_size(spark):
    rows = sum([simple(i, 7, "foo|bar") for i in range(3)] + [simple(i, 6, "foo|bar") for i in (3, 4)], [])
    found, members = at.derive_archetypes(pr.build_profiles(ifds(spark, rows)))
    got = {r["archetype_id"]: r for r in found.collect()}
    assert got[0]["n_files"] == 3 and got[1]["n_files"] == 2 and got[0]["common_tokens"] == ["bar", "foo"]
    assert {r["file_id"]: r["archetype_id"] for r in members.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}
    rel = {(r["archetype_id"], r["other_id"]): (r["relation"], r["note"]) for r in at.archetype_relations(found).collect()}
    assert rel == {(0, 1): ("same_tokens", "IFD count -1 (6 vs 7)"), (1, 0): ("same_tokens", "IFD count -1 (6 vs 7)")}
    assert [tuple(r) for r in at.first_equal(found).collect()] == [(1, 0)]


def test_token_relations(spark):
    rows = simple(0, 2, "aa|bb|cc|extra") + simple(1, 2, "aa|bb|cc|extra") + simple(2, 3, "aa|bb|cc") + simple(3, 4, None) + simple(4, 4, None)
    found, members = at.derive_archetypes(pr.build_profiles(ifds(spark, rows)))
    rel = {(r["archetype_id"], r["other_id"]): r["relation"] for r in at.archetype_relations(found).collect()}
    by = {r["first_file"]: r["archetype_id"] for r in found.collect()}
    assert rel == {(by[2], by[0]): "subset_of", (by[0], by[2]): "superset_of"}
    assert by.keys() == {0, 2, 3}, "files without tokens are alike"


def test_copies_are_one_node_of_the_token_graph(spark, monkeypatch):
    met = []
    links = at.token_links
    monkeypatch.setattr(at, "token_links", lambda rows, *a: met.append(rows.count()) or links(rows, *a))
    rows = sum([simple(i, 2, "aa|bb|cc|dd") for i in range(20)] + [simple(i, 2, "aa|bb|cc|ee") for i in range(20, 40)] + [simple(i, 2, None) for i in (41, 40)] + [simple(42, 3, "aa|bb|cc|dd")], [])
    got = {r["file_id"]: r["first_file"] for r in at.token_clusters(pr.build_profiles(ifds(spark, rows))).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 40: 40, 41: 40, 42: 42}
    assert met == [4]


def test_sets_are_put_in_order_where_they_are(spark, monkeypatch):
    """No token of a set is dealt to be told its number of files."""
    plans = {}
    write = at.materialize
    monkeypatch.setattr(at, "materialize", lambda df, label: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, label))
    monkeypatch.setattr(at, "COMMON_TOKENS", 2, raising=False)
    rows = [(0, (1,), ["aa", "bb", "cc"]), (1, (1,), ["aa", "bb", "dd"]), (2, (1,), ["aa", "ee"]), (3, (1,), ["aa", "bb", "ff"]), (4, (2,), ["aa", "bb"])]
    got = at.token_links(spark.createDataFrame(rows, "file_id long, skeleton struct<k:int>, description_tokens array<string>")).collect()
    assert {(r["a"], r["b"]) for r in got} == {(0, 1), (0, 3), (1, 3)}
    assert "Join" not in plans["ordered"] and "Aggregate" not in plans["ordered"]


def test_tokens_of_copies_are_counted_by_classes(spark, monkeypatch):
    """Neither the tokens of each copy nor those of an archetype of one class are listed."""
    held = []
    write = at.materialize
    monkeypatch.setattr(at, "materialize", lambda df, label: held.append((label, write(df, label))) or held[-1][1])
    rows = sum([simple(i, 2, "aa|bb|cc") for i in range(9)] + [simple(9, 2, "aa|bb|dd")] + [simple(i, 3, "xx|yy") for i in (10, 11)], [])
    found, members = at.derive_archetypes(pr.build_profiles(ifds(spark, rows)))
    got = {r["archetype_id"]: (r["n_files"], r["first_file"], r["common_tokens"], r["variable_tokens"]) for r in found.collect()}
    assert got == {0: (10, 0, ["aa", "bb"], ["cc", "dd"]), 1: (2, 10, ["xx", "yy"], [])}
    assert {r["file_id"]: r["archetype_id"] for r in members.collect()} == {**dict.fromkeys(range(10), 0), 10: 1, 11: 1}
    assert [df.columns for label, df in held if label == "classes"] == [["file_id", "skeleton", "description_tokens", "first_file", "n", "n_files", "classes"]]


def test_lines_of_archetypes_deal_no_sets(spark):
    """Equal common tokens meet on 128 bits, not on the sets themselves."""
    rows = simple(0, 2, "aa|bb") + simple(1, 3, "aa|bb")
    lines = reports.archetype_lines(at.derive_archetypes(pr.build_profiles(ifds(spark, rows)))[0])
    assert "hashpartitioning(common_tokens" not in lines._jdf.queryExecution().executedPlan().toString()
    assert [r["line"] for r in lines.where("part = 2").orderBy("archetype_id").collect()] == ["    tokens (2 common): [same as B]", "    tokens (2 common): [same as A]"]


def test_variable_tokens(spark):
    rows = simple(0, 2, "aa|bb|cc") + simple(1, 2, "aa|bb|dd")
    found, _ = at.derive_archetypes(pr.build_profiles(ifds(spark, rows)))
    r = found.first()
    assert (r["n_files"], r["common_tokens"], r["variable_tokens"]) == (2, ["aa", "bb"], ["cc", "dd"])


def test_diff_notes(spark):
    rows = simple(0, 2, "aa") + [(1, 0, 9, 9, None, None, None, 1, None, "aa"), (1, 1, 9, 9, 7, 1, 1, 1, None, None)]
    found, _ = at.derive_archetypes(pr.build_profiles(ifds(spark, rows)))
    notes = {r["note"] for r in at.archetype_relations(found).collect()}
    first = found.orderBy("archetype_id").first()["first_file"]
    assert notes == {"IFD 0 compression Some(7)→None; IFD 0 layout tiled→strip" if first == 0 else "IFD 0 compression None→Some(7); IFD 0 layout strip→tiled"}


def texts(spark, rows):
    return spark.createDataFrame([(0, p, i, None if b is None else bytearray(b)) for p, i, b in rows], "group_id long, path string, ifd_index int, bytes binary")


@pytest.mark.parametrize(
    ("a", "b", "runs"),
    [(b"AAAAA___BBBBB", b"AAAAA!!!BBBBB", [(0, 5), (8, 13)]), (b"ABC_1234", b"ABC!5678", []), (b"ABCD_1", b"ABCD!2", [(0, 4)]), (b"ABCDEF", b"ABCD", [(0, 4)]), (b"ABCDEF", None, [(0, 6)]), (b"", b"ABCD", [])],
)
def test_shared_runs(spark, a, b, runs):
    got = archive.shared_runs(texts(spark, [("a", 0, a), ("b", 0, b)]))
    assert sorted((r["run_start"], r["run_end"]) for r in got.collect()) == runs


def test_segments_and_bytes(spark):
    t = texts(spark, [("a", 0, b"Aperio|MPP = 0.4952"), ("b", 0, b"Aperio|MPP = 0.5000"), ("a", 1, None), ("b", 1, b"text")])
    got = [(r["ifd_index"], r["kind"]) for r in archive.segments(t).orderBy("ifd_index", "seg_no").collect()]
    assert got == [(0, "shared"), (0, "gap"), (1, "gap")]
    shared = b"Aperio|MPP = 0."
    assert bytes(archive.archetype_bytes(t).first()["bytes"]) == len(shared).to_bytes(4, "little") + shared + archive.GAP * 2


def test_no_members(spark):
    with pytest.raises(ValueError):
        archive.archetype_bytes(spark.createDataFrame([], "group_id long, path string, ifd_index int, bytes binary"))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_token_links_by_all_pairs(spark, threshold):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 20))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = set(rng.choice(base)) | {f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 4))}
        rows.append((i, (i % 2,), sorted(words)[: rng.randint(0, 24)]))
    got = {(r["a"], r["b"]) for r in at.token_links(spark.createDataFrame(rows, "file_id long, skeleton struct<k:int>, description_tokens array<string>"), threshold).collect()}
    want = {(i, j) for i, s, a in rows for j, s2, b in rows if i < j and s == s2 and a and b and len(set(a) & set(b)) >= threshold * len(set(a) | set(b))}
    for k in (0, 1):
        empty = [i for i, s, a in rows if not a and s == (k,)]
        want |= {(empty[0], j) for j in empty[1:]}
    assert got == want
