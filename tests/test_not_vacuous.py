"""Queries whose rows would agree with their SQL on data that shows nothing: what their data has to show."""

import os

import pytest

from corpuskin.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_archetypes_have_members(spark):
    rows = QUERIES["archetypes"](spark, SF).collect()
    assert sum(r["n_files"] > 1 for r in rows) >= 3 and any(r["n_variable"] > 0 and r["n_files"] > 1 for r in rows)
    placed = QUERIES["token_clusters"](spark, SF).collect()
    assert any(r["file_id"] != r["first_file"] for r in placed)


def test_related_rows(spark):
    kinds = {r["relation"] for r in QUERIES["archetype_relations"](spark, SF).collect()}
    assert kinds == {"same_tokens", "subset_of", "superset_of"}
    assert len({r["note"] for r in QUERIES["skeleton_diff_notes"](spark, SF).collect()}) > 3
    assert QUERIES["same_as"](spark, SF).count() > 3


def test_repeats_and_sides(spark):
    assert any(r["n_files"] > 1 for r in QUERIES["preamble_freq"](spark, SF).collect())
    assert {r["tile_size"] for r in QUERIES["geometry_files"](spark, SF).collect()} == {"256x128", "256x192"}


def test_containers_share_tiles(spark):
    rows = QUERIES["slide_confirmed"](spark, SF).collect()
    assert sum(r["cross_file"] for r in rows) > 3
    assert {r["error"].split(": ")[1][:8] for r in QUERIES["slide_errors"](spark, SF).collect()} == {"unsuppor", "unknown ", "over 102"}
