"""Candidates, confirmation, overlap, graph and clusters on small tables."""

import pytest

from corpuskin.operators import dedup, graph, overlap

UNITS = "file_id long, ifd_index int, unit_index int, kind int, compression int, length long, coarse_fp string, payload binary"


def files(spark, ids):
    return spark.createDataFrame([(i, f"f{i}", 10_000) for i in ids], "file_id long, path string, file_size long")


def units(spark, rows):
    return spark.createDataFrame([(f, 0, n, 0, c, length, fp, bytearray(p)) for n, (f, c, length, fp, p) in enumerate(rows)], UNITS)


def one(df):
    return df.first().asDict()


def test_three_files_one_unit(spark):
    u = units(spark, [(i, None, 4096, "aa", b"x") for i in range(3)])
    r = dedup.find_candidates(u, files(spark, range(3)))
    assert one(r.totals) == {"groups": 1, "cross_file_groups": 1, "candidate_units": 3, "reusable_bytes": 8192}


def test_repeats_within_a_file(spark):
    u = units(spark, [(0, 7, 512, "aa", b"x"), (0, 7, 512, "aa", b"x")])
    r = dedup.find_candidates(u, files(spark, [0, 1]))
    assert one(r.totals)["groups"] == 1 and one(r.totals)["cross_file_groups"] == 0
    assert {x["file_id"]: (x["total_units"], x["candidate_units"]) for x in r.per_file.collect()} == {0: (2, 0), 1: (0, 0)}


def test_null_compression_equals_itself_only(spark):
    u = units(spark, [(0, None, 8, "aa", b"x"), (1, None, 8, "aa", b"x"), (2, 7, 8, "aa", b"x"), (3, None, 8, None, b"x")])
    r = dedup.find_candidates(u, files(spark, range(4)))
    assert sorted(x["file_id"] for x in r.units.collect()) == [0, 1]


def test_confirmation(spark):
    u = units(spark, [(0, None, 32, "aa", b"A"), (1, None, 32, "aa", b"A"), (2, None, 32, "aa", b"B"), (3, None, 8, "bb", b"C"), (4, None, 8, "bb", b"D")])
    fs = files(spark, range(5))
    c = dedup.find_candidates(u, fs)
    r = dedup.confirm_candidates(c, u, fs)
    assert one(r.totals) == {"groups": 1, "cross_file_groups": 1, "confirmed_units": 2, "reusable_bytes": 32, "false_positive_groups": 1}
    assert [x["coarse_fp"] for x in dedup.false_positives(c, r).collect()] == ["bb"]


def test_unknown_file(spark):
    u = units(spark, [(9, None, 8, "aa", b"A")])
    fs = files(spark, [0])
    with pytest.raises(ValueError, match="unknown file 9"):
        dedup.confirm_candidates(dedup.find_candidates(u, fs), u, fs)


def test_empty(spark):
    u, fs = units(spark, []) if False else spark.createDataFrame([], UNITS), files(spark, [0])
    r = dedup.find_candidates(u, fs)
    assert one(r.totals) == {"groups": 0, "cross_file_groups": 0, "candidate_units": 0, "reusable_bytes": 0}
    assert one(overlap.file_entries(fs, u)) == {"file_id": 0, "path": "f0", "eligible_bytes": 0, "eligible_units": 0}


def test_overlap_counts_presence(spark):
    m = spark.createDataFrame([("g", f, 512) for f in (0, 0, 0, 1)], "g string, file_id long, length long")
    assert [tuple(r) for r in overlap.pair_overlaps(m, ["g"]).collect()] == [(0, 1, 512, 1)]


def test_overlaps_of_copies_are_met_once(spark, monkeypatch):
    """Pairs by brute force, also where a group's lengths differ; of files with the same groups one is joined."""
    import random

    rng = random.Random(7)
    sets = [{(f"g{g}", rng.choice([g, 7])) for g in rng.sample(range(30), 6)} for _ in range(12)]
    of = {f: sets[rng.randrange(12)] for f in range(90)}
    m = spark.createDataFrame([(f, g, n) for f, own in of.items() for g, n in own] + [(None, "g1", 7)], "file_id long, g string, length long")
    met, plain = [], overlap.class_overlaps
    monkeypatch.setattr(overlap, "class_overlaps", lambda held: met.append(held.count()) or plain(held))
    got = overlap.pair_overlaps(m, ["g"])
    want = [(a, b, [n for g, n in of[a] for h, _ in of[b] if g == h]) for a in of for b in of if a < b]
    assert sorted(map(tuple, got.collect())) == sorted((a, b, sum(x), len(x)) for a, b, x in want if x) != []
    assert met == [6 * len({frozenset(x) for x in of.values()})]


def test_scores(spark):
    e = spark.createDataFrame([(0, "a", 1000, 1), (1, "b", 2000, 1), (2, "c", 0, 0), (3, "d", 0, 0)], "file_id long, path string, eligible_bytes long, eligible_units long")
    o = spark.createDataFrame([(0, 1, 500, 1)], "a long, b long, shared_bytes long, shared_groups long")
    s = {(r["a"], r["b"]): r["score"] for r in overlap.score_pairs(e, o, exhaustive=True).collect()}
    assert len(s) == 6 and s[0, 1] == 0.25 and s[2, 3] == 0.0 and s[0, 2] == 0.0
    assert overlap.score_pairs(e, o).count() == 1
    with pytest.raises(ValueError):
        overlap.top_pairs(overlap.score_pairs(e, o), 0)


def scores(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, score double")


def test_threshold_is_inclusive(spark):
    assert graph.similarity_edges(scores(spark, [(0, 1, 0.35), (1, 2, 0.35 - 1e-10)])).count() == 1


def test_clusters(spark):
    s = scores(spark, [(3, 4, 0.9), (0, 1, 0.9), (1, 2, 0.8), (7, 9, 0.9)])
    fs = files(spark, range(7))
    got = {r["file_id"]: r["cluster_id"] for r in graph.clusters(graph.graph_nodes(fs, s), s).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 3, 7: 4, 9: 4}
    assert {r["file_id"]: r["degree"] for r in graph.node_degrees(graph.graph_nodes(fs, s), s).collect()}[1] == 2


def test_cluster_stats(spark):
    members = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 2), (5, 2), (6, 2)], "file_id long, cluster_id long")
    e = spark.createDataFrame([(i, 10) for i in range(7)], "file_id long, eligible_bytes long")
    s = scores(spark, [(0, 1, 0.9), (1, 2, 0.6), (0, 2, 0.7), (4, 5, 0.5), (5, 6, 0.5)])
    got = {r["cluster_id"]: r for r in graph.cluster_stats(members, e, s).collect()}
    assert (got[0]["min_score"], got[0]["max_score"], got[0]["total_bytes"]) == (0.6, 0.9, 30)
    assert abs(got[0]["avg_score"] - 2.2 / 3) < 1e-12
    assert got[1]["min_score"] is None and got[1]["avg_score"] is None
    assert (got[2]["min_score"], got[2]["max_score"]) == (0.0, 0.5)


def test_long_chain_and_hub(spark):
    from corpuskin.plans.shared import connected_components

    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    df = spark.createDataFrame(chain + hub + [(5, 5)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(400)) and len(got) == 701


@pytest.mark.parametrize("threshold", [0.05, 0.35, 0.5, 1.0])
def test_similar_pairs_are_the_scores_that_reach_the_threshold(spark, threshold):
    import random

    rng = random.Random(4)
    rows = [(f, f"g{g}", rng.choice([0, 1, 5, 100, 1000]) if g % 5 else 30) for f in range(40) for g in rng.sample(range(60), rng.randint(0, 12))]
    size = {g: n for _, g, n in rows}
    rows = [(f, g, size[g]) for f, g, _ in rows] + [(f, "all", 40) for f in range(40)] + [(41, "big", 9000), (42, "big", 9000), (42, "big", 9000), (43, "big", 9000)]
    m = spark.createDataFrame(rows, "file_id long, g string, length long")
    rows.remove((41, "all", 40)) if (41, "all", 40) in rows else None
    fs = files(spark, range(45))
    e = overlap.file_entries(fs, m)
    want = overlap.score_pairs(e, overlap.pair_overlaps(m, ["g"])).where(f"score >= {threshold}")
    got = overlap.similar_pairs(e, m, ["g"], threshold)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    with pytest.raises(ValueError):
        overlap.similar_pairs(e, m, ["g"], 0)
