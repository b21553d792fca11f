"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir
from quarry.sinks.tables import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package, once per context: Spark sends
    them the package's sources as a Python file."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="quarry-package-")      # the driver serves it while the context lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    sc._quarry_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the input folder; also points the session's checkpoints
    at the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back:
    cuts the lineage, and gives the planner real file sizes, so that its own
    threshold decides whether a side is small enough to broadcast."""
    return materialize(df, name)


def free_name(columns, wanted: str) -> str:
    """``wanted``, or with underscores until no column has that name
    (Spark resolves names without regard to case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the ``len + 1`` offsets of its rows
    in them; a null row is empty. No copy of the text is made."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    _, offs, data = arr.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    off = np.frombuffer(offs, kind, count=arr.offset + n + 1)[arr.offset:].astype(np.int64)
    byts = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return byts[off[0]:off[-1]], off - off[0]
