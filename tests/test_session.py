"""Staged tables and their folders."""

import os

from opinara.session import delete_folder, discard, shared_dir, staged


def test_discarded_tables_are_deleted_and_others_stay(spark):
    kept, gone = (staged(spark.range(5), "session-test") for _ in range(2))
    path = gone.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    discard(gone, gone, spark.range(3))
    assert not os.path.exists(path) and kept.count() == 5


def test_one_partition_goes_alone(spark):
    path = shared_dir(spark, "session-parts")
    spark.range(4).selectExpr("id", "id % 2 AS part").write.partitionBy("part").parquet(path)
    delete_folder(spark, f"{path}/part=0")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]
