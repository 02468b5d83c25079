"""A sink that writes one file per row: a table of keys and contents becomes a folder of documents.

Registered as a Python data source, ``df.write.format("document_folder").mode("append").save(root)``
takes ``chave`` and ``conteudo`` (text or bytes).  Each task writes its files under names of
its own and, when all are there, gives them their final ones: a reader never sees part of
a file, and a task that is run again puts the same files in the same places.  A task that
fails takes its unfinished files away.  What goes to the driver is one message of two
numbers from each task, however many files there are.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "document_folder"
#: How names of files begin that a task has not finished.
UNFINISHED = re.compile("_[0-9a-f]{32}-")


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and its path there."""
    if re.match(r"[A-Za-z][\w+.-]*:/", root):
        return fs.FileSystem.from_uri(re.sub(r"\Afile:/+", "file:///", root))
    return fs.LocalFileSystem(), root


def place(root: str, key: str | None) -> str:
    """Where a key's file is: below the root, whatever the key."""
    parts = [p for p in (key or "").replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"a document's key must name a file below the root, not {key!r}")
    return posixpath.join(root, *parts)


@dataclass
class Written(WriterCommitMessage):
    """Files and bytes of a task."""

    files: int
    size: int


class FolderWriter(DataSourceArrowWriter):
    """Writes batches of ``chave, conteudo``."""

    def __init__(self, root: str) -> None:
        self._root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """All files of a task; of equal keys the last one stays, a null content is an empty file."""
        system, root = opened(self._root)
        made: set[str] = set()
        pending: dict[str, str] = {}
        size = 0
        try:
            for batch in iterator:
                texts = batch.column("conteudo").cast(pa.binary())
                for key, content in zip(batch.column("chave").to_pylist(), texts, strict=True):
                    final = place(root, key)
                    folder, name = posixpath.split(final)
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    # a leading underscore hides it from Spark's readers, UNFINISHED from ours
                    pending[final] = pending.get(final) or posixpath.join(folder, f"_{uuid.uuid4().hex}-{name}"[:200])
                    with system.open_output_stream(pending[final]) as out:
                        out.write(content.as_buffer() or b"")
                    size += len(content.as_buffer() or b"")
            files = len(pending)
            while pending:
                final, temporary = next(iter(pending.items()))
                system.move(temporary, final)
                del pending[final]
        finally:
            for temporary in pending.values():
                if system.get_file_info(temporary).type == fs.FileType.File:
                    system.delete_file(temporary)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        """Mark the folder as whole, with how much was written."""
        system, root = opened(self._root)
        done = [m for m in messages if m]
        system.create_dir(root, recursive=True)
        with system.open_output_stream(posixpath.join(root, "_SUCCESS")) as out:
            out.write(f'{{"files": {sum(m.files for m in done)}, "bytes": {sum(m.size for m in done)}}}\n'.encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Leave finished files: they are whole, and running the job again replaces them."""


class DocumentFolder(DataSource):
    """A folder of documents, one file per row."""

    @classmethod
    def name(cls) -> str:
        """The format's name."""
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        """A writer for ``chave`` and ``conteudo``; folders are added to, not replaced."""
        if overwrite:
            raise ValueError("a document folder is added to: use mode append")
        if {"chave", "conteudo"} - set(schema.names):
            raise ValueError("a document folder needs the columns chave and conteudo")
        return FolderWriter(self.options["path"])


def write_documents(documents: DataFrame, root: str) -> None:
    """Write ``chave, conteudo`` as one file per row below a folder, at the place that each key names."""
    documents.sparkSession.dataSource.register(DocumentFolder)
    documents.select("chave", "conteudo").write.format(NAME).mode("append").save(root)
