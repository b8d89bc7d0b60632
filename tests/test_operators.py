"""Materialized intermediate results."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators.materialize import discard, discard_all, materialize, materialized_paths
from vitrine.session import checkpoint_dir


def test_materialize_writes_under_the_checkpoint_folder(spark):
    df = materialize(spark.range(0, 5).withColumn("r", F.rand(7)), "t")
    first = sorted((r.id, r.r) for r in df.collect())
    assert first == sorted((r.id, r.r) for r in df.collect())          # fixed once written
    from urllib.parse import urlparse
    assert urlparse(df.inputFiles()[0]).path.startswith(urlparse(checkpoint_dir(spark)).path)


def test_discard_deletes_the_folders(spark):
    import os
    from urllib.parse import urlparse

    before = materialized_paths()
    one, two = (materialize(spark.range(3), "gone") for _ in range(2))
    assert materialized_paths() - before == {one.materialized_path, two.materialized_path}
    discard(one)
    discard(one)                                   # a second time is no error
    discard(spark.range(1))                        # nor is a frame that was not written
    assert not os.path.exists(urlparse(one.materialized_path).path) and two.count() == 3
    assert discard_all(spark, materialized_paths() - before) == 1
    assert not os.path.exists(urlparse(two.materialized_path).path)
    assert materialized_paths() == before
