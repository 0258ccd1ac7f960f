"""Text files with names of the caller's, written by the tasks and published together."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ATTEMPTS = "_attempts"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path inside it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task's files."""

    folder: str


class NamedFilesWriter(DataSourceArrowWriter):
    """Each task writes whole files into a folder of its own; only the commit gives them their place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _opened(self.path)
        folder = f"{root}/{ATTEMPTS}/{uuid.uuid4().hex}"
        name, out, done = None, None, set()
        try:
            files.create_dir(folder, recursive=True)
            for batch in iterator:
                for wanted, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if wanted != name:
                        if out is not None:
                            out.close()
                        if not wanted or "/" in wanted or wanted.startswith(("_", ".")):
                            raise ValueError(f"no usable file name: {wanted!r}")
                        if wanted in done:
                            raise ValueError(f"rows of {wanted!r} are not together")
                        done.add(wanted)
                        name, out = wanted, files.open_output_stream(f"{folder}/{wanted}")
                    out.write(((line or "") + "\r\n").encode())
            if out is not None:
                out.close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            files.delete_dir(folder)
            raise
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        found = [i for m in messages if m for i in files.get_file_info(fs.FileSelector(m.folder))]
        names = [i.base_name for i in found]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks have written one file name")
        if not self.overwrite:
            taken = {i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File} & set(names)
            if taken:
                self.abort(messages)
                raise ValueError(f"files are there already: {sorted(taken)[:5]}")
        for info in found:
            files.move(info.path, f"{root}/{info.base_name}")
        files.delete_dir(f"{root}/{ATTEMPTS}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        if files.get_file_info(f"{root}/{ATTEMPTS}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{ATTEMPTS}")


class NamedFiles(DataSource):
    """``df.write.format("named_files")``: two columns, file name and line; rows of a file are together and in order."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named_files(rows: DataFrame, path: str, filename: str, line: str, order: list[str], overwrite: bool = False) -> None:
    """One text file for each file name, its lines in order; complete or not there at all.

    Files are spread over the tasks by name and streamed, so none is held in memory. ``path`` is a folder that
    the driver and all executors reach. Files of other names stay; one of the same name is
    replaced only with ``overwrite``. A failed job leaves no file behind.
    """
    rows.sparkSession.dataSource.register(NamedFiles)
    dealt = rows.repartition(filename).sortWithinPartitions(filename, *order)
    out = dealt.select(F.col(filename).cast("string").alias("filename"), F.col(line).cast("string").alias("line"))
    out.write.format("named_files").mode("overwrite" if overwrite else "append").save(path)
