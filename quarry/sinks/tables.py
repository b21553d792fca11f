"""Table sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quarry.session import scratch_path


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """K1: replace the table at ``path``, all its partitions included."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append(df: DataFrame, path: str) -> None:
    """K2: add rows. A rerun of the same input adds them again; use
    ``write_part`` when reruns must replace."""
    df.write.mode("append").parquet(path)


def write_part(df: DataFrame, path: str, run_id: str, part: int = 0) -> None:
    """K2 with D16: rows land under ``run_id=…/part=…`` and a rerun of the
    same run and part replaces exactly that partition, with nothing if it
    has no rows, so retries never duplicate and never leave old rows."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
        raise ValueError("run_id names a folder: letters, digits, dot, dash and underscore only")
    df.drop("run_id", "part").write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}/part={int(part)}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """K3: write once to a fresh path under the shared checkpoint folder and
    continue from the written table. This cuts the lineage (a lost
    executor re-reads files instead of recomputing the plan) and avoids
    overwriting a path the same plan still reads."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    for staged in _SCOPES:
        staged.append(path)
    return spark.read.parquet(path)


_SCOPES: list[list[str]] = []


@contextmanager
def staged_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Delete what was staged inside when the block ends. For jobs whose
    results are written before that; not for a frame that is still lazy.
    Yields the list of paths, from which the block may take what is to stay."""
    staged: list[str] = []
    _SCOPES.append(staged)
    try:
        yield staged
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not staged]
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in staged:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
