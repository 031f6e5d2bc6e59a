from corpuskin.streaming.manifests import follow

SCHEMA = "file_id long, ifd_index int, unit_index int, kind int, compression int, length long, coarse_fp string"


def test_batches(spark, tmp_path):
    source, store, matches, check = (str(tmp_path / n) for n in ("in", "store", "matches", "check"))
    batches = [[(0, 0, 0, 0, None, 8, "aa"), (0, 0, 1, 0, 7, 8, "aa")], [(1, 0, 0, 0, None, 8, "aa"), (1, 0, 1, 0, None, 8, "aa")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        follow(spark, spark.readStream.schema(SCHEMA).parquet(source), store, matches, check).awaitTermination(60)
    got = sorted((r["file_id"], r["unit_index"], r["seen_file_id"], r["seen_unit_index"]) for r in spark.read.parquet(matches).collect())
    assert got == [(1, 0, 0, 0), (1, 1, 0, 0), (1, 1, 1, 0)]
    assert spark.read.parquet(store).count() == 4
