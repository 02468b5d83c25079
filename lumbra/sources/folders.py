"""Files below a folder, listed and read by tasks, so that the driver holds neither names nor contents.

Spark's own readers keep each file's status and place in a plan on the driver, close to a
kilobyte a file.  Here tasks walk the folders: each lists those it is given, goes on into
what is below them until it has seen ``AT_ONCE`` names, and hands other folders back, which
are dealt to tasks anew.  A folder itself is listed by one task, a name at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written
from .writer import UNFINISHED

#: Names after which a task goes no deeper by itself.
AT_ONCE = 1_000
#: Bytes that a task reads, and what opening a file counts for.
TASK_BYTES, OPEN_BYTES = 64 << 20, 16 << 10
#: Rows, and bytes of contents, that a task hands to Spark together.
ROWS, SLICE_BYTES = 5_000, 2 << 20
_NAMES = pa.schema([("below", pa.binary()), ("folder", pa.bool_()), ("length", pa.int64()), ("modified", pa.int64())])
_CONTENTS = pa.schema([("below", pa.binary()), ("content", pa.binary())])


def local(root: str) -> str | None:
    """A root's path on the local file system; none if it is elsewhere.  As in Spark's paths, nothing in it is escaped."""
    path = re.sub(r"\Afile:/+", "/", root)
    return None if re.match(r"[A-Za-z][\w+.-]*:/", path) else os.path.abspath(path)


def located(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and its path there."""
    path = local(root)
    return (fs.LocalFileSystem(), path) if path else fs.FileSystem.from_uri(root)


def reachable(spark: SparkSession, root: str) -> bool:
    """Whether a root is a folder that tasks can list by themselves."""
    if not re.match(r"[A-Za-z][\w+.-]*:/", root) and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
        return False
    try:
        system, path = located(root)
        return system.get_file_info(path).type == fs.FileType.Directory
    except (OSError, pa.ArrowException):
        return False


def entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int | None]]:
    """What a folder holds: names, whether they are folders, sizes, seconds of the last change."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, None if info.mtime_ns is None else info.mtime_ns // 10**9
        return
    with os.scandir(folder) as found:
        for entry in found:
            try:
                inner = entry.is_dir()
                if inner or entry.is_file():
                    state = entry.stat()
                    yield entry.name, inner, state.st_size, int(state.st_mtime // 1)
            except FileNotFoundError:  # gone meanwhile
                continue


def walk(root: str, at_once: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files below folders ``below``, and folders that are left to other tasks."""
    system, top = located(root)
    rows: list[tuple[bytes, bool, int, int | None]] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NAMES.types, strict=True)], schema=_NAMES)
    for batch in batches:
        for given in batch.column("below").to_pylist():
            todo, seen = [os.fsdecode(given)], 0
            while todo:
                folder = todo.pop()
                if seen >= at_once:
                    rows.append((os.fsencode(folder), True, 0, None))
                    continue
                for name, inner, length, modified in entries(system, f"{top}/{folder}" if folder else top):
                    seen += 1
                    if name.startswith(".") or UNFINISHED.match(name):
                        continue
                    below = f"{folder}/{name}" if folder else name
                    if inner and seen < at_once:
                        todo.append(below)
                    else:
                        rows.append((os.fsencode(below), inner, length, modified))
                    if len(rows) >= ROWS:
                        yield made()
                        rows.clear()
    if rows:
        yield made()


def listed(spark: SparkSession, root: str, at_once: int = AT_ONCE) -> DataFrame:
    """All files below a folder, at any depth: ``below``, the path from there in bytes, ``length`` and ``modified``, in seconds.

    Names that start with ``.`` and files that a writer has not finished are passed over.
    """
    schema = "below binary, folder boolean, length long, modified long"
    level, files = spark.range(1, numPartitions=1).select(F.lit(b"").alias("below")), None
    while True:
        found = written(level.mapInArrow(partial(walk, root, at_once), schema), "folder-files")
        here = found.where("NOT folder").drop("folder")
        files = here if files is None else files.unionByName(here)
        deeper = found.where("folder").select("below")
        open_ = deeper.count()
        if not open_:
            return files
        level = deeper.repartition(min(open_, 4 * spark.sparkContext.defaultParallelism))


def read(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of files ``below``."""
    system, top = located(root)
    names: list[bytes] = []
    contents: list[bytes] = []
    size = 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(contents, pa.binary())], schema=_CONTENTS)
    for batch in batches:
        for name in batch.column("below").to_pylist():
            path = f"{top}/{os.fsdecode(name)}"
            with open(path, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_stream(path) as file:
                content = file.read()
            if names and (size + len(content) > SLICE_BYTES or len(names) >= ROWS):
                yield made()
                names.clear(), contents.clear()
                size = 0
            names.append(name)
            contents.append(content)
            size += len(content)
    if names:
        yield made()


def contents(files: DataFrame, root: str) -> DataFrame:
    """``below, content`` of files that :func:`listed` found, dealt to tasks by their number and size."""
    number, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(number, files.sparkSession.sparkContext.defaultParallelism), (size + number * OPEN_BYTES) // TASK_BYTES)
    return files.select("below").repartition(tasks).mapInArrow(partial(read, root), "below binary, content binary")
