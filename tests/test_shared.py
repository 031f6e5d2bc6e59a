"""Intermediate tables: where they are written, and that they go."""

import os

import pytest

from corpuskin.plans import shared


def test_tables_go(spark):
    a, b = shared.materialize(spark.range(5), "a"), shared.materialize(spark.range(7), "b")
    folders = [f[5:].rsplit("/", 1)[0] for d in (a, b) for f in d.inputFiles()[:1]]
    folders = ["/" + f.lstrip("/") for f in folders]
    assert all(map(os.path.isdir, folders))
    shared.discard(a)
    assert [os.path.isdir(f) for f in folders] == [False, True]
    assert b.count() == 7


def test_written_tables_are_not_broadcast_by_their_files_bytes(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10m")  # Spark's default
        a, b = (shared.materialize(spark.range(300_000).withColumnRenamed("id", "k"), x) for x in "ab")
        plan = a.join(b, "k")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        spark.conf.set(name, "-1")
        shared.materialize(spark.range(1), "c")
        assert spark.conf.get(name) == "-1"
    finally:
        spark.conf.set(name, before)


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Option:
        def isDefined(self):
            return False

    class Fake:
        master = "local-cluster[2,1,1024]"
        conf = sparkContext = _jsc = None

        def __init__(self):
            self.conf = self.sparkContext = self._jsc = self

        def get(self, *_):
            return None

        def sc(self):
            return self

        def getCheckpointDir(self):
            return Option()

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        fake = Fake()
        fake.master = master
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            shared.work_dir(fake)
