"""Cut lineage by writing an intermediate result to the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vitrine.session import checkpoint_dir

_written: set[str] = set()


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint folder and read it back.

    One job computes and writes the rows (``DataFrame.checkpoint`` runs the plan
    twice unless the input is cached). The result has a fresh lineage: a lost
    executor re-reads the files instead of recomputing upstream stages, and
    values computed once (ids, positions) stay fixed for every later reader.

    The folder stays until ``discard`` or ``discard_all``: a lazy result that
    reads it may be evaluated at any later time.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/vitrine-{label}-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.materialized_path = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _written.discard(path)


def discard(df: DataFrame) -> None:
    """Delete the folder behind a frame that ``materialize`` returned; nothing may read it later."""
    path = getattr(df, "materialized_path", None)
    if path in _written:
        _delete(df.sparkSession, path)


def materialized_paths() -> set[str]:
    """Folders this process has written and not yet discarded."""
    return set(_written)


def discard_all(spark: SparkSession, paths: set[str] | None = None) -> int:
    """Delete the given folders (default: all of this process); returns their number.

    For the end of a job, when no lazy result is left that reads them.
    """
    paths = sorted(_written if paths is None else paths & _written)
    for path in paths:
        _delete(spark, path)
    return len(paths)
