"""Text sources (S5, S6): directories of whole files and diff files.

Folders are listed in Spark: a frontier of folders is expanded level by level
by tasks that each list some folders through ``pyarrow.fs``. File names go
from there to the tasks that read the files and never to the driver, and no
name is left out, whatever it begins with (Spark's own file scans skip files
and folders whose names begin with ``_`` or ``.``, and empty files).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sinks.tables import materialize

DEEPEST = 200                     # levels of folders; deeper ones are taken for a loop of links
TASK_BYTES = 64 << 20             # of files read by a task
RANGE_BYTES = 64 << 20            # of a diff file read by a task
BATCH_BYTES = 8 << 20             # of files handed on at once
PATCH_START = b"\ndiff --git "    # between two records of a diff file


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system: a path without one
    belongs to the session's default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def _opener(root: str):
    """A function that opens the file system of ``root`` in a task: ``(file
    system, path of the root in it)``. The tasks get plain closures, so they
    need no package of this library."""

    def opened():
        from pyarrow import fs
        scheme, _, rest = root.partition(":")
        scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
        # only the scheme and authority go through the URI parser: names may hold any character
        if rest.startswith("//"):
            authority, slash, inside = rest[2:].partition("/")
            filesystem, _ = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
            return filesystem, slash + inside if scheme in ("file", "hdfs", "viewfs") else f"{authority}/{inside}"
        return fs.FileSystem.from_uri(f"{scheme}:///")[0], rest

    return opened


def _lister(root: str, suffixes: tuple[str, ...]):
    opened = _opener(root)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        filesystem, prefix = opened()
        for batch in batches:
            for folder in batch.column("rel").to_pylist():
                at = f"{prefix}/{folder}" if folder else prefix
                if not folder and filesystem.get_file_info([at])[0].type == fs.FileType.File:
                    raise NotADirectoryError(at)
                inside = filesystem.get_file_info(fs.FileSelector(at, recursive=False))
                rows = [(f"{folder}/{i.base_name}" if folder else i.base_name, i.type == fs.FileType.Directory, i.size)
                        for i in inside if i.type == fs.FileType.Directory or i.base_name.endswith(suffixes)]
                for k in range(0, len(rows), 10_000):
                    rel, is_folder, size = zip(*rows[k:k + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rel, pa.string()), pa.array(is_folder, pa.bool_()), pa.array(size, pa.int64())],
                        names=["rel", "is_folder", "size"])

    return run


def list_files(spark: SparkSession, path: str, suffixes: Iterable[str] = ("",), recursive: bool = False) -> DataFrame:
    """``(rel, size)`` of the files under ``path`` whose name ends with one of
    ``suffixes``; ``rel`` is relative to ``path``. One Spark job per level of
    folders; each folder is listed by one task. A missing folder is an error."""
    root, suffixes = qualified(spark, path), tuple(suffixes)
    folders, found = spark.createDataFrame([("",)], "rel string"), None
    for _ in range(DEEPEST):
        level = materialize(folders.mapInArrow(_lister(root, suffixes), "rel string, is_folder boolean, size bigint"), "listing")
        files = level.filter(~F.col("is_folder")).select("rel", "size")
        found = files if found is None else found.unionByName(files)
        folders = level.filter("is_folder").select("rel")
        if not recursive or folders.isEmpty():
            return found
        # by number, so that adaptive execution does not put all folders into one task
        tasks = min(folders.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
        folders = folders.repartition(tasks, "rel")
    raise ValueError(f"more than {DEEPEST} levels of folders under {root}")


def _dealt(files: DataFrame, *by: str) -> DataFrame:
    """The files dealt to tasks of about ``TASK_BYTES``, at least one for each core."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, min(n, max(cores, -(-size // TASK_BYTES)))), *by)


def _reader(root: str):
    opened = _opener(root)

    def run(batches):
        import pyarrow as pa
        filesystem, prefix = opened()
        rows, held = [], 0

        def flush():
            rel, data, error = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(rel, pa.string()), pa.array(data, pa.binary()), pa.array(error, pa.string())],
                                              names=["rel", "content", "error"])

        for batch in batches:
            for rel in batch.column("rel").to_pylist():
                try:
                    with filesystem.open_input_stream(f"{prefix}/{rel}", compression=None) as f:
                        rows.append((rel, f.read(), None))
                except OSError as e:
                    rows.append((rel, None, f"{type(e).__name__}: {e}"))
                held += len(rows[-1][1] or b"")
                if held >= BATCH_BYTES or len(rows) >= 1000:      # large files do not wait for one another
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return run


def _checked_text(content: Column, error: Column | None = None) -> tuple[Column, Column]:
    """``(text, read_error)``: bytes that are not UTF-8 have a NULL text."""
    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    bad = F.when(~valid, F.lit("the file is not valid UTF-8"))
    return F.when(valid, text), bad if error is None else F.coalesce(error, bad)


def read_text_dir(spark: SparkSession, path: str,
                  suffixes: Iterable[str] = (".py", ".sql"),
                  recursive: bool = False) -> DataFrame:
    """Every file under ``path`` whose name ends with one of
    ``suffixes``, one row per file: ``(file_name, path, text, read_error)``.

    Files are listed and read in Spark, empty ones, and names and folders that
    begin with ``_`` or ``.`` included. A file that cannot be opened or is not
    valid UTF-8 has a NULL text and says so in ``read_error``; it does not
    stop the others. Files with other suffixes are never opened.
    """
    root = qualified(spark, path)
    files = _dealt(list_files(spark, path, suffixes, recursive), "rel")
    read = files.select("rel").mapInArrow(_reader(root), "rel string, content binary, error string")
    text, error = _checked_text(F.col("content"), F.col("error"))
    return read.select(
        F.regexp_extract("rel", r"([^/]*)$", 1).alias("file_name"),
        F.concat(F.lit(f"{root}/"), "rel").alias("path"), text.alias("text"), error.alias("read_error"))


def _or_stop(name: Column, text: Column, error: Column) -> Column:
    return F.when(error.isNull(), text).otherwise(F.raise_error(F.concat(name, F.lit(": "), error)))


def read_diffs(spark: SparkSession, path: str, suffix: str = ".diff") -> DataFrame:
    """Many diff files at once, ``diff_id`` = file name, one row per file.
    A file that is not valid UTF-8 stops the job: its chunks could not be
    trusted. For diffs that do not fit a row see ``read_patches``."""
    df = read_text_dir(spark, path, suffixes=(suffix,))
    return df.select(F.col("file_name").alias("diff_id"),
                     _or_stop(F.col("path"), F.col("text"), F.col("read_error")).alias("text"))


def _record_reader(root: str, block: int):
    opened = _opener(root)

    def records(f, start: int, end: int):
        """(offset, bytes) of the records that begin in [start, end): at the
        beginning of the file and behind each line break before a patch."""
        at = max(start - 1, 0)                    # the line break may be the byte before the range
        f.seek(at)
        data, head, scan = bytearray(), 0, 0      # the open record begins at data[head]; data[0] is byte ``at``
        mine = start == 0
        while True:
            hit = data.find(PATCH_START, scan)
            if hit < 0:
                keep = head if mine else max(len(data) - len(PATCH_START) + 1, 0)
                scan = max(len(data) - len(PATCH_START) + 1, keep) - keep
                at, head = at + keep, 0
                del data[:keep]
                more = None if not mine and at + 1 >= end else f.read(block)
                if not more:
                    if mine and data:
                        yield at, bytes(data)
                    return
                data += more
                continue
            if mine:
                yield at + head, bytes(data[head:hit + 1])
            if at + hit + 1 >= end:
                return
            head, scan, mine = hit + 1, hit + 1, True

    def run(batches):
        import pyarrow as pa
        filesystem, prefix = opened()
        rows, held = [], 0

        def flush():
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["rel", "pos", "content"])

        for batch in batches:
            for rel, start, size in zip(*(batch.column(c).to_pylist() for c in ("rel", "start", "size"))):
                with filesystem.open_input_file(f"{prefix}/{rel}") as f:
                    for pos, data in records(f, start, start + size):
                        rows.append((rel, pos, data))
                        held += len(data)
                        if held >= BATCH_BYTES or len(rows) >= 1000:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    return run


def read_patches(spark: SparkSession, path: str, suffix: str = ".diff", range_bytes: int = RANGE_BYTES,
                 block: int = 4 << 20) -> DataFrame:
    """S6 for diffs of any size: ``(diff_id, pos, text)``, one row for each
    record of each diff file: what stands before its first ``diff --git`` line,
    and each patch from that line on. ``pos`` is the record's byte offset, so
    the records of a file in that order are the file.

    A file is read in ranges of ``range_bytes`` by as many tasks; a record
    belongs to the range in which it begins. An empty file has no record. Bytes
    that are not UTF-8 stop the job."""
    root = qualified(spark, path)
    files = list_files(spark, path, (suffix,))
    last = F.floor((F.col("size") - 1) / F.lit(range_bytes)).cast("bigint")
    ranges = files.filter(F.col("size") > 0).select("rel", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    ranges = ranges.select("rel", (F.col("k") * range_bytes).alias("start"),
                           F.least(F.lit(range_bytes), F.col("size") - F.col("k") * range_bytes).alias("size"))
    read = _dealt(ranges, "rel", "start").mapInArrow(_record_reader(root, block), "rel string, pos bigint, content binary")
    text, error = _checked_text(F.col("content"))
    return read.select(F.col("rel").alias("diff_id"), "pos", _or_stop(F.concat(F.lit(f"{root}/"), "rel"), text, error).alias("text"))


def write_text_files(df: DataFrame, root: str, rel_path: str = "path", text: str | Column = "text") -> DataFrame:
    """Write each row's text (UTF-8) or bytes to ``<root>/<rel_path>`` from
    the executors, through ``pyarrow.fs`` (local, HDFS or object stores).
    Returns ``(rel_path, bytes)`` rows once the write has run (lazy)."""
    schema = T.StructType([T.StructField(rel_path, T.StringType()),
                           T.StructField("bytes", T.LongType())])
    opened = _opener(qualified(df.sparkSession, root))

    def write(batches):
        import pyarrow as pa
        filesystem, prefix = opened()
        made = set()
        for batch in batches:
            sizes = []
            for p, data in zip(batch.column(rel_path).to_pylist(), batch.column("data").to_pylist()):
                target = f"{prefix}/{p}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                with filesystem.open_output_stream(target, compression=None) as out:
                    out.write(data or b"")
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([batch.column(rel_path), pa.array(sizes, pa.int64())],
                                             names=[rel_path, "bytes"])

    data = (F.col(text) if isinstance(text, str) else text).cast("binary").alias("data")
    return df.select(rel_path, data).mapInArrow(write, schema)
